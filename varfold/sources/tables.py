"""Synthetic variants derived from the line-item table, for queries and benchmarks. They say nothing about biology."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("sample_id", "chrom", "arm")


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, l_linenumber, sample_id, chrom, pos, origin, genotype, depth, alt), a row a line item."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    ci, rf, germ = F.col("l_partkey") % 25, F.col("l_returnflag"), F.col("l_linestatus") == "F"
    d, t = (F.round(F.col(c) * 100).cast("int") for c in ("l_discount", "l_tax"))
    depth = F.col("l_quantity").cast("int") + 20
    percent = (
        F.when(germ & (rf == "R"), 90 + d)
        .when(germ & (ci % 5 == 0), 62 + d + t)
        .when(germ, 41 + d + t)
        .when(rf == "A", 10 + d)
        .when(rf == "N", 41 + d + t)
        .otherwise(80 + d)
    )
    chrom = F.when(ci < 22, F.concat(F.lit("chr"), (ci + 1).cast("string"))).when(ci == 22, "chrX").when(ci == 23, "chrY").otherwise("chrUn")
    return line.select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_suppkey") % 8).cast("int").alias("sample_id"),
        chrom.alias("chrom"),
        ((F.col("l_orderkey") * 1000003 + F.col("l_partkey") * 7919 + F.col("l_linenumber") * 104729) % 250000000).cast("long").alias("pos"),
        F.when(germ, "germline").otherwise("somatic").alias("origin"),
        F.when(germ & (rf == "R"), "homalt").when(germ, "hetalt").alias("genotype"),
        depth.alias("depth"),
        F.floor(depth * percent / F.lit(100.0)).cast("int").alias("alt"),
    )


#: The same in SQL, as the body of two common table expressions b and v.
VARIANTS_SQL = """b as (select l_orderkey, l_linenumber, l_partkey, l_suppkey,
  cast(l_quantity as int)+20 as depth, cast(round(l_discount*100) as int) as d,
  cast(round(l_tax*100) as int) as t, l_returnflag as rf, l_linestatus as ls, l_partkey % 25 as ci from lineitem),
raw as (select l_orderkey, l_linenumber, cast(l_suppkey % 8 as int) as sample_id,
  case when ci<22 then concat('chr', cast(ci+1 as varchar)) when ci=22 then 'chrX' when ci=23 then 'chrY' else 'chrUn' end as chrom,
  cast((l_orderkey*1000003 + l_partkey*7919 + l_linenumber*104729) % 250000000 as bigint) as pos,
  case when ls='F' then 'germline' else 'somatic' end as origin,
  case when ls='F' and rf='R' then 'homalt' when ls='F' then 'hetalt' end as genotype,
  depth,
  case when ls='F' and rf='R' then 90+d when ls='F' and ci % 5 = 0 then 62+d+t when ls='F' then 41+d+t
       when rf='A' then 10+d when rf='N' then 41+d+t else 80+d end as vaf_pct
  from b)"""
