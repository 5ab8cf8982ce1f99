"""Germline variants: annotation and genotype filters, arms, and the collected store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varfold.functions.special import staged
from varfold.sources import vcf
from varfold.sources.arms import arm_of, with_arm

#: Population allele frequency above which a variant is a common germline one.
COMMON_AF = 0.05


def genotype_class(genotype: Column | str) -> Column:
    """'homalt' if both alleles are 1, 'hetalt' if one is, else 'skip' (reference, other alleles, missing, haploid)."""
    g = F.col(genotype) if isinstance(genotype, str) else genotype
    alleles = F.split(F.coalesce(g, F.lit("")), "[/|]")
    ones = F.size(F.filter(alleles, lambda a: a == "1"))
    return F.when(F.size(alleles) != 2, "skip").when(ones == 2, "homalt").when(ones == 1, "hetalt").otherwise("skip")


def is_common(af_text: Column | str, least: float = COMMON_AF) -> Column:
    """True where the frequency's text is a number above ``least``; missing, empty, malformed and NaN text is not."""
    af = (F.col(af_text) if isinstance(af_text, str) else af_text).try_cast("double")
    return F.coalesce((af > least) & ~F.isnan(af), F.lit(False))


def germline_variants(records: DataFrame, keys: list[str] | None, least_af: float = COMMON_AF, sample: int = 0, arms: DataFrame | None = None, every_alt: bool = False) -> DataFrame:
    """(chrom, pos, arm, genotype, depth, alt, vaf) of the common het and hom variants among VCF records.

    The filters stand before the arm lookup, and the whole is one stage without an exchange. Each field is split once. Variants on
    chromosomes that the arm table lacks stay, with a null arm. Reads are those of the first alternative allele, and the
    depth is DP where given; with ``every_alt`` they are those of all alternative alleles, and the depth is the sum of AD where given.
    """
    af = vcf.csq_value(vcf.info_field("INFO", "CSQ"), keys, "AF")
    common = staged(records.select("CHROM", "POS", "INFO", "FORMAT", F.get("samples", F.lit(sample)).alias("sample")), af=af).where(is_common("af", least_af))
    split = common.select("CHROM", "POS", F.split("FORMAT", ":").alias("names"), F.split("sample", ":").alias("values"))
    texts = {n: vcf.field_of(n, F.col("names"), F.col("values")) for n in ("GT", "DP", "AD")}
    called = staged(split, genotype=genotype_class(texts["GT"]), dp=texts["DP"], reads=vcf.reads_of(texts["AD"])).where(F.col("genotype") != "skip")
    out = staged(
        called.select(F.col("CHROM").alias("chrom"), F.col("POS").alias("pos"), "genotype", "dp", "reads"),
        depth=vcf.total_depth(F.col("reads"), F.col("dp"), every_alt),
        alt=vcf.alt_depth(F.col("reads"), every_alt),
    )
    out = with_arm(out, arms) if arms is not None else out.withColumn("arm", arm_of("chrom", "pos"))
    share = F.when(F.col("depth") > 0, F.col("alt") / F.col("depth"))
    return out.select("chrom", "pos", "arm", "genotype", "depth", "alt", share.alias("vaf"))


def read_germline_variants(spark: SparkSession, path: str, least_af: float = COMMON_AF, sample: int = 0, every_alt: bool = False, split_bytes: int = vcf.SPLIT_BYTES) -> DataFrame:
    """Germline variants of the VCF file(s) at ``path``; block-gzip files are read in ranges of ``split_bytes``."""
    return germline_variants(vcf.read_vcf(spark, path, split_bytes), vcf.read_csq_keys(spark, path), least_af, sample, None, every_alt)


def malformed_af(records: DataFrame, keys: list[str] | None) -> DataFrame:
    """One row: how many records have a frequency that is not a number, and so were dropped."""
    records = staged(records, af=vcf.csq_value(vcf.info_field("INFO", "CSQ"), keys, "AF"))
    af = F.col("af")
    bad = (af != "") & af.try_cast("double").isNull()
    return records.agg(F.count_if(bad).alias("malformed"))


def collected(variants: DataFrame) -> DataFrame:
    """The store by chromosome, arm and genotype: ``variants`` as a list of (DP, alt_DP, VAF).

    Lists grow with the data; this is a view for small results. Aggregate the flat relation instead.
    """
    item = F.struct(F.col("depth").alias("DP"), F.col("alt").alias("alt_DP"), F.col("vaf").alias("VAF"))
    return variants.groupBy("chrom", "arm", "genotype").agg(F.collect_list(item).alias("variants"))


def valid_counts(variants: DataFrame, alt: str = "alt", depth: str = "depth") -> DataFrame:
    """Rows with 0 <= alt <= depth; the others have no Beta-Binomial probability."""
    return variants.where((F.col(alt) >= 0) & (F.col(alt) <= F.col(depth)))


def weighted_counts(variants: DataFrame, keys: tuple[str, ...], alt: str = "alt", depth: str = "depth") -> DataFrame:
    """keys, alt, depth and the number of rows (weight), of all rows: also of those that have no probability."""
    return variants.groupBy(*keys, F.col(alt).alias("alt"), F.col(depth).alias("depth")).agg(F.count("*").alias("weight"))


def histogram(variants: DataFrame, keys: tuple[str, ...], alt: str = "alt", depth: str = "depth") -> DataFrame:
    """Sufficient statistics: keys, alt, depth and the number of rows. Every likelihood depends on a row through these only."""
    return weighted_counts(valid_counts(variants, alt, depth), keys, alt, depth)
