"""What the operators of this subpackage share: shared tables, column selection, Arrow helpers, components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varfold.sources.shared import SharedTable, drop_tables, shared_dir  # noqa: F401  taken from here by the operators and tests

#: Rows handed to Python code at a time are cut so that their text stays near this many bytes.
BLOCK_BYTES = 4 << 20


#: Rows of a side that is broadcast, at most: some tens of MB where a row has a few numbers.
SIDE_ROWS = 1 << 18


def broadcast_if_small(side: DataFrame) -> DataFrame:
    """``side``, a stored table of a few numbers a row, to be broadcast if it has at most SIDE_ROWS rows; else the join shuffles both sides."""
    return F.broadcast(side) if side.limit(SIDE_ROWS + 1).count() <= SIDE_ROWS else side


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(id_col: str, folds: int) -> F.Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def blocks(batches: Iterable[pa.RecordBatch], text: int | str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of about ``limit`` bytes of text, so that very long texts don't add up."""
    for batch in batches:
        column = batch.column(text)
        sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        if start < batch.num_rows:
            yield batch.slice(start)


_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _inverse_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    p = np.full(n, _PRIME)
    q = np.full(n, np.uint64(pow(int(_PRIME), -1, 1 << 64)))
    p[:1] = q[:1] = 1
    return np.multiply.accumulate(p), np.multiply.accumulate(q)


_POWERS: tuple[np.ndarray, np.ndarray] = _inverse_powers(1 << 16)


class SpanHashes:
    """Polynomial hashes (mod 2**64) of spans of an array of small numbers, from one prefix sum."""

    def __init__(self, data: np.ndarray) -> None:
        global _POWERS
        if len(data) > len(_POWERS[0]):
            _POWERS = _inverse_powers(1 << int(len(data)).bit_length())
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS[0][: len(data)], out=self._sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self._sums[ends] - self._sums[starts]) * _POWERS[1][starts]
        h ^= h >> np.uint64(32)
        return h * np.uint64(0xD6E8FEB86659FD93)

    def all(self, width: int) -> np.ndarray:
        """The hashes of all spans of ``width``, by their start."""
        h = (self._sums[width:] - self._sums[:-width]) * _POWERS[1][: len(self._sums) - width]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span of ``data``."""
    return SpanHashes(data)(starts, ends)


#: A key of so many rows at least may be hot; and at most so many keys are, since each has more than that share of all rows.
HOT_ROWS, HOT_KEYS = 1024, 1 << 16


def join_one(rows: DataFrame, ones: DataFrame, key: str, count_col: str) -> DataFrame:
    """``rows`` with the row of ``ones`` that its key has; ``count_col`` there says how many rows the key has.

    Keys with more than HOT_ROWS rows and more than a share of 1 / HOT_KEYS of all are fewer than HOT_KEYS, whatever the
    data, so these are broadcast and their rows stay where they are; the others are joined by a shuffle without hot keys.
    ``ones`` should be a stored table, since it is read more than once.
    """
    n = F.col(count_col)
    whole = ones.agg(F.sum(n).alias("total"), F.max(n).alias("most")).first()
    least = max(HOT_ROWS, (whole["total"] or 0) // HOT_KEYS)
    if (whole["most"] or 0) <= least:
        return rows.join(ones.drop(count_col), key)
    hot = F.broadcast(ones.where(n > least).drop(count_col))
    cold = rows.join(hot.select(key), key, "left_anti").join(ones.where(n <= least).drop(count_col), key)
    return rows.join(hot, key).unionByName(cold)


def _changed(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
    return row["n"], row["x"] or 0


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of the graph of ``edges(u long, v long)``: one row (node, root) for each node that isn't a root.

    Alternating large-star and small-star rounds; each writes its edges to the shared folder, so lineage stays short
    and no component is ever gathered in one task. Minima are aggregated on the map side; the joins that give every
    edge its node's minimum are plain shuffled joins, whose hot keys adaptive execution splits. Self-loops and
    repeated edges are allowed. An empty input gives an empty result.
    """
    start = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = SharedTable(start, "edges")
    seen = _changed(now.df)
    for _ in range(max_rounds):
        if not seen[0]:
            return now.df.select(F.col("u").alias("node"), F.col("v").alias("root"))
        e = now.df
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        mid = SharedTable(large, "edges")
        now.drop()
        e = mid.df
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        small = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        now = SharedTable(small, "edges")
        mid.drop()
        was, seen = seen, _changed(now.df)
        if was == seen:
            return now.df.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
