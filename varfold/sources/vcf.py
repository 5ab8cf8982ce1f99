"""VCF text as a DataFrame: header, records, annotation and sample fields."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varfold.functions.special import staged
from varfold.sources.bgzf import SPLIT_BYTES, head_of, opened, read_blocks

FIXED = ("CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT")
#: Names of files that may be block-gzip.
PACKED = r"(?i)\.(gz|bgz|bgzf)$"


def csq_keys(description: str) -> list[str]:
    """Names of the annotation's fields: what follows 'Format: ' in its header description, split at bars."""
    _, found, keys = description.replace('"', "").partition("Format: ")
    if not found:
        raise ValueError(f"no field list in the CSQ description {description!r}")
    return [k.strip() for k in keys.split("Format: ")[0].split("|")]


def files_at(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files at ``path``, a file, folder or pattern; nothing is read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def opens(files: DataFrame) -> bool:
    """Whether there are files, and Arrow has their file system."""
    first = files.first()
    try:
        return first is not None and bool(opened(first["path"]))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False


def heads(files: DataFrame) -> DataFrame:
    """(path, length, blocked, head) of each file: whether it is block-gzip, and its header's text. Tasks read the beginnings of the files only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [head_of(p) for p in batch.column(0).to_pylist()]
            columns = [*batch.columns, pa.array([b for b, _ in found], pa.bool_()), pa.array([h.decode("utf-8", "replace") for _, h in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["path", "length", "blocked", "head"])

    return files.mapInArrow(run, "path string, length long, blocked boolean, head string")


def header_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) the header lines of the files at ``path``.

    Only the beginnings of the files are read, so the work doesn't grow with the records; where Arrow can't open the path's file system, Spark
    reads the files as text, whole.
    """
    files = files_at(spark, path)
    if not opens(files):
        return spark.read.text(path).where(F.col("value").startswith("#"))
    return heads(files).select(F.explode(F.split("head", "\n")).alias("value"))


def read_csq_keys(spark: SparkSession, path: str) -> list[str] | None:
    """The annotation's field names from the header of the file(s) at ``path``; None if it declares none."""
    declared = header_lines(spark, path).where(F.col("value").startswith("##INFO=<ID=CSQ,"))
    rows = declared.select(F.regexp_extract("value", r'Description="([^"]*)"', 1).alias("d")).distinct().limit(100).collect()
    lists = {tuple(csq_keys(r["d"])) for r in rows}
    if len(lists) > 1:
        raise ValueError(f"the files at {path} declare different CSQ fields")
    return list(lists.pop()) if lists else None


def parse_records(lines: DataFrame, column: str = "value") -> DataFrame:
    """Records of VCF text lines: the fixed fields (POS as long) and ``samples``, an array of the sample columns.

    A line is split once, whatever is filtered on later.
    """
    records = lines.where(~F.col(column).startswith("#") & (F.trim(column) != ""))
    parts = records.select(F.split(column, "\t").alias("f"))
    fields = {n: F.get("f", F.lit(i)) for i, n in enumerate(FIXED)}
    fields["POS"] = fields["POS"].try_cast("long")
    samples = F.when(F.size("f") > len(FIXED), F.slice("f", len(FIXED) + 1, F.size("f"))).otherwise(F.array().cast("array<string>"))
    return staged(parts, **fields, samples=samples).drop("f")


def read_lines(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(value) the lines of the file(s) at ``path``. Plain and block-gzip files are split over tasks; other gzip files are one task each, as are all
    where Arrow can't open the path's file system."""
    packed = files_at(spark, path).where(F.col("path").rlike(PACKED))
    if not opens(packed):  # none of them may be block-gzip, or none can be told
        return spark.read.text(path)
    blocked = [(r["path"], r["length"]) for r in heads(packed).where("blocked").select("path", "length").collect()]
    if not blocked:
        return spark.read.text(path)
    lines, known = read_blocks(spark, blocked, split_bytes), {p for p, _ in blocked}
    others = [r["path"] for r in files_at(spark, path).select("path").collect() if r["path"] not in known]
    return lines.unionByName(spark.read.text(others)) if others else lines


def read_vcf(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of the VCF file(s) at ``path``, plain, block-gzip or gzip (see ``read_lines``)."""
    return parse_records(read_lines(spark, path, split_bytes))


def write_vcf(lines: DataFrame, header: str, path: str, column: str = "value") -> None:
    """Write text lines of records as a text folder, which readers take as one VCF: the header is in one of its files, the others have records alone.

    ``bgzf.write_blocks`` writes files that are each a whole VCF.
    """
    head = lines.sparkSession.createDataFrame([(h,) for h in header.splitlines()], "value string").coalesce(1)
    head.unionByName(lines.select(F.col(column).alias("value"))).write.text(path)


def info_field(info: Column | str, key: str) -> Column:
    """The value of an INFO key; null if the key is absent or has none."""
    found = F.filter(F.split(info, ";"), lambda x: x.startswith(f"{key}="))
    return F.substring(F.get(found, F.lit(0)), len(key) + 2, 1 << 30)


def csq_value(csq: Column | str, keys: list[str] | None, key: str) -> Column:
    """A field of the first transcript of an annotation; null if the header or the record lacks it."""
    if not keys or key not in keys:
        return F.lit(None).cast("string")
    first = F.get(F.split(csq, ","), F.lit(0))
    return F.get(F.split(first, "[|]"), F.lit(len(keys) - 1 - keys[::-1].index(key)))


def field_of(key: str, names: Column, values: Column) -> Column:
    """The value of the first of ``names`` that is ``key``; null if absent or '.'."""
    at = F.array_position(names, F.lit(key)).cast("int")
    value = F.when(at > 0, F.get(values, at - 1))
    return F.when(value != ".", value)


def reads_of(ad: Column) -> Column:
    """Reads by allele, the reference first, from the text of AD."""
    return F.transform(F.split(ad, ","), lambda x: x.try_cast("int"))


def alt_depth(reads: Column, every: bool = False) -> Column:
    """Reads of the first alternative allele, or of every one."""
    if not every:
        return F.get(reads, F.lit(1))
    return F.when(F.size(reads) > 1, F.aggregate(F.slice(reads, 2, F.greatest(F.size(reads), F.lit(2))), F.lit(0), lambda s, x: s + x))


def total_depth(reads: Column, dp: Column, every: bool = False) -> Column:
    """DP, or else the sum of AD; with ``every`` the sum of AD, or else DP."""
    total = F.aggregate(reads, F.lit(0), lambda s, x: s + x)
    return F.coalesce(total, dp.try_cast("int")) if every else F.coalesce(dp.try_cast("int"), total)
