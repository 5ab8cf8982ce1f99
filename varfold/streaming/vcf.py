"""VCF lines as they arrive: the same columns as the batch reader's, so the same filters hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from varfold.operators.variants import COMMON_AF, germline_variants
from varfold.sources.vcf import parse_records


def stream_germline_variants(spark: SparkSession, path: str, keys: list[str], least_af: float = COMMON_AF, sample: int = 0) -> DataFrame:
    """Germline variants of the VCF files that appear in a folder. ``keys`` are the annotation's fields, as ``read_csq_keys`` finds them in any one file."""
    return germline_variants(parse_records(spark.readStream.text(path)), keys, least_af, sample)
