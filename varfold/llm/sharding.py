"""Sharding: minimax contiguous partition of atomic groups.

Rows with equal texts form one atomic group. Groups stand in the order of their SHA-256, which no key can skew, and
are cut into ``shards`` contiguous runs whose largest total is as small as it can be. The smallest feasible capacity
is found by binary search; each check fills shards greedily.

No task and not the driver ever holds all groups. Groups are first summed into slices of the hash range. If a slice
counts as one atom, a feasible capacity is an upper bound; if a slice may be cut anywhere, it is a lower bound. While
the two differ, the few slices in which the greedy cuts of either search fall are divided into 256 finer ones, down to
single groups where needed. When the bounds meet, the capacity is exact, whatever the sizes.

Defined results: null text counts as empty (size 1, one group with the empty texts); repeated rows are members of
their group; with fewer groups than shards the last shards have no rows; an empty table gives an empty result;
columns other than the two named ones are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varfold.llm.common import SharedTable, table

#: Bytes of the hash that make the first slices: at most 65,536 sums reach the driver at first, and 256 for each slice divided.
SLICE_BYTES = 2
#: Rows of a part of a shard, in which slots are counted apart, on average at most; and the fewest parts of a shard.
PART_ROWS, PARTS = 1 << 18, 64


@dataclass
class _Line:
    """Atoms in order: the hash's first bytes, the size, and whether several groups are in it."""

    keys: list[bytes]
    sizes: list[int]
    several: list[bool]
    totals: list[int] = field(init=False)

    def __post_init__(self) -> None:
        self.totals = [0, *accumulate(self.sizes)]

    def fill(self, capacity: int, shards: int, divisible: bool) -> tuple[bool, list[int], set[bytes]]:
        """Greedy shards: whether they take all, the atoms at which they end, and the slices in which they end."""
        spent, ends, met, totals = 0, [], set(), self.totals
        for _ in range(shards):
            at = bisect_right(totals, spent + capacity) - 1
            inside = at < len(self.keys) and totals[at] < spent + capacity and self.several[at]
            if inside:
                met.add(self.keys[at])
            spent = spent + capacity if divisible and inside else totals[at]
            ends.append(at)
        return spent >= totals[-1], ends, met

    def least(self, shards: int, divisible: bool) -> int:
        """The smallest feasible capacity."""
        low, high = 0, self.totals[-1]
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self.fill(middle, shards, divisible)[0] else (middle + 1, high)
        return high


def _sums(groups: DataFrame, size: int, within: list[bytes] | None = None) -> list[tuple[bytes, int, bool]]:
    """Slices by the first ``size`` bytes, in order; only those inside the slices ``within``, which are a byte shorter."""
    if within is not None:
        groups = groups.where(F.substring("key", 1, size - 1).isin([F.lit(bytearray(w)) for w in within]))
    rows = groups.groupBy(F.substring("key", 1, size).alias("slice")).agg(F.sum("total").alias("total"), F.count("*").alias("n"))
    return sorted((bytes(r["slice"]), int(r["total"]), r["n"] > 1) for r in rows.collect())


def find_cuts(groups: DataFrame, shards: int) -> tuple[list[bytes], int]:
    """Lower bounds of the keys of shards 1 and on (shards without rows at the end have none), and the smallest capacity.

    ``groups`` has one row a group: key binary, total long.
    """
    atoms = _sums(groups, SLICE_BYTES)
    if not atoms:
        return [], 0
    while True:
        line = _Line(*map(list, zip(*atoms, strict=True)))
        low, high = line.least(shards, divisible=True), line.least(shards, divisible=False)
        _, ends, met = line.fill(high, shards, divisible=False)
        if low == high:
            return [line.keys[e] for e in ends[:-1] if e < len(line.keys)], high
        met |= line.fill(low, shards, divisible=True)[2]
        finer = [x for size in sorted({len(m) for m in met}) for x in _sums(groups, size + 1, [m for m in met if len(m) == size])]
        atoms = sorted([a for a in atoms if a[0] not in met] + finer)


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) of each row: groups of equal texts stay whole, shards hold nearly equal bytes.

    size is the text's UTF-8 bytes plus 1; slots are gapless from 0 in each shard. The text is read once and is
    not shuffled; what is shuffled are its hash and size.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    made = docs.select(
        F.col(id_col).cast("long").alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("key"),
    )
    rows = SharedTable(made, "sizes").df
    groups = SharedTable(rows.groupBy("key").agg(F.sum("size").alias("total")), "groups")
    cuts, _ = find_cuts(groups.df, shards)
    groups.drop()
    shard = sum((F.when(F.col("key") >= F.lit(bytearray(c)), 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    parts = max(PARTS, -(-rows.count() // (shards * PART_ROWS)))
    part = F.pmod(F.xxhash64("id", "key"), F.lit(parts)).cast("int")
    placed = rows.select("id", "size", "text_crc32", shard.alias("shard"), part.alias("part"))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", "part", before.alias("start"))  # a row a part, so one for PART_ROWS rows or so
    order = Window.partitionBy("shard", "part").orderBy("id", "text_crc32", "size")
    numbered = placed.withColumn("rank", F.row_number().over(order) - 1)
    slot = (F.col("start") + F.col("rank")).cast("long").alias("slot")
    return numbered.join(F.broadcast(starts), ["shard", "part"]).select("id", "size", "text_crc32", "shard", slot)


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law of bytes."""
    found = shard_by_bytes(table(spark, sf_dir, "documents"), 8)
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
