"""The chromosome arm table and lookups in it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Chromosome, centromere, chromosome end.
CHROMOSOMES: tuple[tuple[str, int, int], ...] = (
    ("chr1", 123400000, 248956422),
    ("chr2", 93900000, 242193529),
    ("chr3", 90900000, 198295559),
    ("chr4", 50000000, 190214555),
    ("chr5", 48800000, 181538259),
    ("chr6", 59800000, 170805979),
    ("chr7", 60100000, 159345973),
    ("chr8", 45200000, 145138636),
    ("chr9", 43000000, 138394717),
    ("chr10", 39800000, 133797422),
    ("chr11", 53400000, 135086622),
    ("chr12", 35500000, 133275309),
    ("chr13", 17700000, 114364328),
    ("chr14", 17200000, 107043718),
    ("chr15", 19000000, 101991189),
    ("chr16", 36800000, 90338345),
    ("chr17", 25100000, 83257441),
    ("chr18", 18500000, 80373285),
    ("chr19", 26200000, 58617616),
    ("chr20", 28100000, 64444167),
    ("chr21", 12000000, 46709983),
    ("chr22", 15000000, 50818468),
    ("chrX", 61000000, 156040895),
    ("chrY", 10400000, 57227415),
)

#: The longest arm table that is turned into a lookup expression; it bounds what goes into a plan.
MOST_CHROMOSOMES = 1000


def arm_rows() -> list[tuple[str, int, int, str]]:
    """(chrom, start, end, arm): a p row and a q row for each chromosome."""
    return [row for chrom, cent, end in CHROMOSOMES for row in ((chrom, 0, cent, "p"), (chrom, cent, end, "q"))]


def arm_table(spark: SparkSession, rows: Sequence[tuple[str, int, int, str]] | None = None) -> DataFrame:
    return spark.createDataFrame(list(arm_rows() if rows is None else rows), "chrom string, start long, end long, arm string")


def reduce_arms(arms: DataFrame) -> DataFrame:
    """One row a chromosome: centromere (the end of its p arm; null without one) and chr_end."""
    centromere = F.max(F.when(F.col("arm") == "p", F.col("end"))).alias("centromere")
    return arms.groupBy("chrom").agg(centromere, F.greatest(F.max("end"), F.lit(0)).alias("chr_end"))


def arm_of(chrom: Column | str, pos: Column | str, centromeres: Sequence[tuple[str, int | None]] | None = None) -> Column:
    """'p' before the centromere, 'q' from it on (also beyond the chromosome's end); null for an unknown chromosome.

    The table is small and fixed, so the lookup is a literal map inside the projection: no join, no exchange.
    """
    known = [(c, e) for c, e, _ in CHROMOSOMES] if centromeres is None else [(c, e) for c, e in centromeres if e is not None]
    if len(known) > MOST_CHROMOSOMES:
        raise ValueError(f"more than {MOST_CHROMOSOMES} chromosomes; use with_arm with a table")
    chrom, pos = (F.col(x) if isinstance(x, str) else x for x in (chrom, pos))
    if not known:
        return F.lit(None).cast("string")
    at = F.try_element_at(F.create_map(*[F.lit(v) for pair in known for v in pair]), chrom)
    return F.when(pos < at, F.lit("p")).when(at.isNotNull() & pos.isNotNull(), F.lit("q"))


def with_arm(variants: DataFrame, arms: DataFrame | None = None) -> DataFrame:
    """``variants`` (chrom, pos) with its arm. A custom arm table is reduced and joined; Spark broadcasts it if it is small."""
    if arms is None:
        return variants.withColumn("arm", arm_of("chrom", "pos"))
    known = reduce_arms(arms).select(F.col("chrom").alias("__chrom"), "centromere")
    at = F.col("centromere")
    arm = F.when(F.col("pos") < at, F.lit("p")).when(at.isNotNull() & F.col("pos").isNotNull(), F.lit("q"))
    return variants.join(known, F.col("chrom") == F.col("__chrom"), "left").withColumn("arm", arm).drop("__chrom", "centromere")
