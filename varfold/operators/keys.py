"""Joins and grouped work on keys that may be null (an unknown arm)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varfold.functions.names import unused_prefix


def join_on(left: DataFrame, right: DataFrame, keys: tuple[str, ...], how: str = "left") -> DataFrame:
    """Join on equal keys, nulls taken as equal; the left side's keys stay. Other columns must have different names."""
    p = unused_prefix(left, right)
    renamed = right.select(*[F.col(k).alias(f"{p}{k}") for k in keys], *[f"`{c}`" for c in right.columns if c not in keys])
    same = reduce(lambda c, k: c & F.col(k).eqNullSafe(F.col(f"{p}{k}")), keys, F.lit(True))
    return left.join(renamed, same, how).drop(*[f"{p}{k}" for k in keys])


def dealt_by(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``df`` dealt by key for grouped fits. A fit costs time, not bytes, so the number of partitions is stated: left to itself,
    adaptive execution would merge partitions of so few bytes into one task."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)
