"""Near-duplicates at an exact Jaccard index of word-shingle sets: SimHash candidates first, prefix filtering for the rest.

SimHash fingerprints of the texts are linked by the grid of ``simhash`` (segment bit counts, Manhattan bound, exact Hamming
test), and these links are verified on the whole sets. Bits only estimate the index, so an exact path takes what they miss:

All shingles stand in one order. Two sets of a Jaccard index of t or more share a shingle among the first n - ceil(t n) + 1 of
each (n its size), so pairs that meet in no such prefix need no look, and no pair above the threshold is lost. The position
of the shared shingle bounds how much two sets can have in common; pairs that this rules out are left as well (the first
shared shingle of a true pair never rules it out). What remains is verified on the whole sets.

Any order gives the same links. Shingles that are frequent in a sample of texts come last in it, so that few prefixes hold
them; the others are in the order of their hashes. Texts with equal sets are one node from the start.

Texts are not sent with candidates. A set has a mark of a few bits a shingle, which bounds what two sets can have in common; pairs
that their marks rule out go first. The others are verified on their texts, which are fetched for the sets that need it.

Pairs are taken in rounds (ROUNDS). The first takes the SimHash links, and neighbours by size in the cells of each set's first
few shingles (a cell: the nodes that have a shingle in their prefixes), a number in proportion to the nodes; the next take nodes at a few
distances in all cells that are still in different components, and the last all pairs that are. Of what the marks leave, each set's best pairs
are verified first; the others wait for the next round, and those that are in one component by then go. So each link is verified or its ends
are in one component already. A set of many pairs is sent to several tasks, each for a bounded number of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varfold.llm.common import SharedTable, blocks, broadcast_if_small, connected_components
from varfold.llm.simhash import CELL_ROWS, assign_components, grid_links, majority, shingle_hashes

#: Bits of 64 in which fingerprints that are candidates differ at most.
BITS = 4
#: The sample that frequent shingles are counted in, how often they occur there at least, and how many are held at most. These only set the order.
SAMPLE, FREQUENT, HELD = 16, 4, 1 << 17
#: Similarity is held in thousandths, so that the threshold is met exactly.
_UNIT = 1000
_WORD = (1 << 64) - 1
#: Cells of at most so many rows are compared by shifts over the whole batch.
_SMALL = 12
#: Places of a prefix in whose cells neighbours are taken in the first round, so that a set has a few candidates there, however many shingles it shares.
HEAD = 4
#: Rounds: how far apart in a cell the rows of different components stand that are compared (None: all), and how many pairs of a set are verified
#: (None: all). The first has its own candidates.
ROUNDS: tuple[tuple[tuple[int, ...] | None, int | None], ...] = (((), 1), ((1, 2, 5, 11, 23, 47, 95, 191), 2), ((3, 7, 15, 31, 63, 127, 255), 4), (None, None))
#: Bits of a mark for each shingle, at least.
BITS_EACH = 4
#: Pairs of one set that are dealt to a task together.
SPLIT = 1024
#: Pairs that a task holds before it hands them on.
_TOGETHER = 1 << 18


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct shingles' hashes in ascending order."""
    return np.unique(shingle_hashes(text, words))


def prefix_size(n: int, least: int) -> int:
    """How many first shingles of a set of ``n`` may hold the first that it shares with a set of ``least`` thousandths or more."""
    return n - -(-least * n // _UNIT) + 1 if n else 0


def alike(a: np.ndarray, b: np.ndarray, least: int) -> bool:
    """Whether two sets (ascending) have a Jaccard index of ``least`` thousandths or more; empty ones are alike."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return _UNIT * common >= least * (len(a) + len(b) - common)


def mark(found: np.ndarray) -> np.ndarray:
    """Bits of the places that a set's hashes have, BITS_EACH to twice as many a hash, as bytes."""
    bits = np.zeros(max(64, 1 << (BITS_EACH * len(found) - 1).bit_length()) if len(found) else 64, bool)
    bits[(found & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little")


def most_common(a: np.ndarray, b: np.ndarray, n: int, m: int) -> int:
    """How much sets of ``n`` and ``m`` hashes with the marks ``a`` and ``b`` can have in common at most."""
    if len(a) > len(b):
        a, b, n, m = b, a, m, n
    b = np.bitwise_or.reduce(b.reshape(-1, len(a)), axis=0)
    return min(n - int(np.bitwise_count(a & ~b).sum()), m - int(np.bitwise_count(b & ~a).sum()))


def in_order(found: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """An ascending set in the common order: frequent shingles last, by their counts and then their hashes; and how many are not frequent."""
    if not len(frequent) or not len(found):
        return found, len(found)
    at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
    known = frequent[at] == found
    return np.concatenate((found[~known], found[known][np.argsort(counts[at[known]], kind="stable")])), int((~known).sum())


def _frequent(docs: DataFrame, text_col: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 0):
            found = [shingle_set(t, words) for t in batch.column(0).to_pylist()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["shingle"])

    sample = docs.where(F.pmod(F.xxhash64(text_col), F.lit(SAMPLE)) == 0).select(F.col(text_col).alias("text"))
    counts = sample.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    rows = counts.orderBy(F.desc("n"), "shingle").limit(HELD).collect()
    shingles = np.array([r["shingle"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], np.array([r["n"] for r in rows], np.int64)[order]


def _prints(docs: DataFrame, id_col: str, text_col: str, words: int, least: int) -> DataFrame:
    """(id, fp, other, key, n, sim, rare, prefix, bits): fp and other are hashes of the set, key of the row's id and text, sim is the SimHash
    fingerprint; the first ``rare`` shingles of the prefix are not among the frequent ones; bits is the set's mark."""
    order = docs.sparkSession.sparkContext.broadcast(_frequent(docs, text_col, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 2):
            fps, others, sizes, sims, rare, prefixes, bits = [], [], [], [], [], [], []
            for text in batch.column(2).to_pylist():
                hashes = shingle_hashes(text, words)
                found = np.unique(hashes)
                sims.append(majority(hashes)[0])
                whole = xxhash.xxh3_128_intdigest(found.tobytes(), 42)
                fps.append(whole & _WORD)
                others.append(whole >> 64)
                sizes.append(len(found))
                whole, n_rare = in_order(found, *order.value)
                prefix = whole[: prefix_size(len(found), least)]
                prefixes.append(prefix.view(np.int64))
                rare.append(min(n_rare, len(prefix)))
                bits.append(mark(found).tobytes())
            out = [batch.column(0), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, others)), batch.column(1), pa.array(sizes, pa.int64()), pa.array(sims, pa.int64()), pa.array(rare, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(out, ["id", "fp", "other", "key", "n", "sim", "rare", "prefix", "bits"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, fp long, other long, key long, n long, sim long, rare long, prefix array<long>, bits binary")


def _told_apart(prints: DataFrame) -> DataFrame:
    """``prints`` with fp such that different sets have different ones: where two sets share a hash, both halves of it give a new one."""
    shared = prints.groupBy("fp").agg(F.min("other").alias("low"), F.max("other").alias("high")).where("low <> high").select("fp", F.lit(True).alias("shared"))
    shared = SharedTable(shared, "shared").df
    if shared.isEmpty():
        return prints
    return prints.join(shared, "fp", "left").withColumn("fp", F.when(F.col("shared"), F.xxhash64("fp", "other")).otherwise(F.col("fp"))).drop("shared")


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Rows sorted by their first two columns, as arrays of whole runs of these."""
    held = None
    for batch in batches:
        fresh = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], 1)
        held = fresh if held is None else np.concatenate((held, fresh))
        if len(held):
            whole = int(np.flatnonzero((held[:, :2] != held[-1, :2]).any(1)).max(initial=-1)) + 1
            if whole:
                yield held[:whole]
            held = held[whole:]
    if held is not None and len(held):
        yield held


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, fp, n, rest) of frequent cells, and of others with more than one row; (..., frequent) come in sorted by cell.

    Holds one batch and the row before it.
    """
    held, given = None, False  # the last row, and whether it has gone out already
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.concat_batches([held, batch])
        cell = rows.column(0).to_numpy()
        same = cell[1:] == cell[:-1]
        keep = np.concatenate(([False], same)) | np.concatenate((same, [False])) | rows.column(4).to_numpy(zero_copy_only=False)
        if given:
            keep[0] = False
        held, given = rows.slice(rows.num_rows - 1), bool(keep[-1]) or (given and rows.num_rows == 1)
        out = rows.filter(pa.array(keep))
        if out.num_rows:
            yield pa.RecordBatch.from_arrays(out.columns[:4], out.schema.names[:4])


def _possible(a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Whether rows (cell, pair, n, fp, rest, part) that share a shingle can be alike, and are in different parts."""
    return ((_UNIT + least) * np.minimum(a[..., 4], b[..., 4]) >= least * (a[..., 2] + b[..., 2])) & (a[..., 5] != b[..., 5])


def _pairs(rows: np.ndarray, least: int, shifts: tuple[int, ...] | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Possible pairs within runs of (cell, pair), sorted by size: of rows that stand so far apart, or all."""
    bounds = np.flatnonzero(np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(1), [True])))
    sizes = np.diff(bounds)
    run_at = np.repeat(np.arange(len(sizes)), sizes)
    every = shifts is None
    small = np.flatnonzero(sizes[run_at] <= _SMALL) if every else np.arange(len(rows))
    for shift in range(1, _SMALL) if every else shifts:
        at = np.flatnonzero(run_at[small][shift:] == run_at[small][:-shift])
        a, b = rows[small[at]], rows[small[at + shift]]
        good = _possible(a, b, least)
        yield a[good, 3], b[good, 3]
    for k in np.flatnonzero(sizes > _SMALL) if every else ():
        mine = rows[bounds[k] : bounds[k + 1]]
        parts, counts = np.unique(mine[:, 5], return_counts=True)
        for row in mine[mine[:, 5] != parts[counts.argmax()]]:  # within the largest part there is nothing to compare
            good = _possible(row, mine, least)
            yield np.full(int(good.sum()), row[3]), mine[good, 3]


def _pairer(least: int, shifts: tuple[int, ...] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def out(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = (np.concatenate(c) for c in zip(*found, strict=True))
        both = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for rows in _units(batches):
            for pair in _pairs(rows, least, shifts):
                if len(pair[0]):
                    found.append(pair)
                    size += len(pair[0])
                if size > _TOGETHER:
                    yield out(found)
                    found, size = [], 0
        if found:
            yield out(found)

    return run


def _candidates(cells: DataFrame, hot: DataFrame, least: int, shifts: tuple[int, ...] | None) -> DataFrame:
    """Distinct pairs (u, v) to verify; ``cells`` has cell, fp, n, rest and part. Pairs of chunks of a large cell are units of their own."""
    k = F.col("chunks")
    mine = F.pmod(F.xxhash64("fp"), k).cast("int")
    others = F.transform(F.array_except(F.sequence(F.lit(0), k - 1), F.array(mine)), lambda o: F.least(o, mine) * k + F.greatest(o, mine))
    pairs = F.when(k.isNull(), F.array(F.lit(0))).otherwise(others)
    spread = cells.join(hot, "cell", "left").select("cell", F.explode(pairs).alias("pair"), "n", "fp", "rest", "part")
    dealt = spread.repartition(F.col("cell"), F.col("pair")).sortWithinPartitions("cell", "pair", "n", "fp")
    return dealt.mapInArrow(_pairer(least, shifts), "u long, v long").distinct()


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (u, v) of neighbours with one fingerprint; (sim, fp) come in sorted."""
    last: tuple[int, int] | None = None
    for batch in batches:
        sim, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if last is not None:
            sim, fp = np.append(last[0], sim), np.append(last[1], fp)
        if len(sim):
            last = (sim[-1], fp[-1])
            same = np.flatnonzero(sim[1:] == sim[:-1])
            a, b = fp[same], fp[same + 1]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["u", "v"])


def _simhash_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (u, v) of sets by their fingerprints; ``nodes`` has fp and sim.

    Sets of one fingerprint stand in a row, of which tasks have a range each, and are paired with their neighbours; a pair that a
    range cuts is left to the exact path. One set of each fingerprint stands for it in the grid's links.
    """
    row = nodes.select("sim", "fp").repartitionByRange("sim", "fp").sortWithinPartitions("sim", "fp")
    same = row.mapInArrow(_chained, "u long, v long")
    first = SharedTable(nodes.groupBy("sim").agg(F.min("fp").alias("u")), "sims").df
    near = grid_links(first.select(F.col("sim").alias("fp")), BITS)
    near = near.join(first.select(F.col("sim").alias("u"), F.col("u").alias("a")), "u").join(first.select(F.col("sim").alias("v"), F.col("u").alias("b")), "v")
    return same.unionByName(near.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")))


def _with_ends(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """``pairs`` (u, v; a stored table) with the columns of ``rows`` (fp, ...) for both ends, as a_... and b_..., sorted by v.

    A pair costs time rather than bytes, so it is dealt over a stated number of partitions, which adaptive execution leaves as it is. What belongs
    to a set of many pairs is sent to several partitions, for SPLIT pairs or so each.
    """
    spark = pairs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    sides, dealt, many = {"u": "v", "v": "u"}, pairs.select("u", "v"), {}
    for end, other in sides.items():
        counted = pairs.groupBy(end).agg(F.count("*").alias("m")).where(F.col("m") > SPLIT)
        found = SharedTable(counted.select(end, F.ceil(F.col("m") / SPLIT).cast("int").alias("parts")), "hot-ends").df
        part = F.lit(0)
        if not found.isEmpty():
            many[end], dealt = found, dealt.join(found, end, "left")
            part = F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1))).cast("int")
        dealt = dealt.withColumn(f"part_{end}", part).drop("parts")
    for end, name in zip(sides, "ab", strict=True):
        own = rows.select(F.col("fp").alias(end), *[F.col(c).alias(f"{name}_{c}") for c in rows.columns if c != "fp"])
        if end in many:
            own = own.join(many[end], end, "left").withColumn(f"part_{end}", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        else:
            own = own.withColumn(f"part_{end}", F.lit(0))
        dealt = dealt.repartition(n, end, f"part_{end}").join(own, [end, f"part_{end}"]).drop(f"part_{end}")
    return dealt.sortWithinPartitions("v")


def _plausible(pairs: DataFrame, marks: DataFrame, least: int) -> DataFrame:
    """The pairs (u, v; a stored table) that the marks of their sets don't rule out, with score, the bound in thousandths; ``marks`` has fp, n and bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, n, m, a, b = batch.columns
            scores = []
            for x, y, p, q in zip(n.to_pylist(), m.to_pylist(), a, b, strict=True):
                common = most_common(np.frombuffer(p.as_buffer(), np.uint8), np.frombuffer(q.as_buffer(), np.uint8), x, y)
                scores.append(_UNIT * common // max(x + y - common, 1) if _UNIT * common >= least * (x + y - common) else -1)
            score = np.array(scores, np.int64)
            yield pa.RecordBatch.from_arrays([u, v, pa.array(score)], ["u", "v", "score"]).filter(pa.array(score >= 0))

    rows = _with_ends(pairs, marks.select("fp", "n", "bits")).select("u", "v", "a_n", "b_n", "a_bits", "b_bits")
    return rows.mapInArrow(run, "u long, v long, score long")


def _best(pairs: DataFrame, most: int = 1) -> DataFrame:
    """Of the pairs (u, v, score) those that are among the ``most`` of the largest score for one of their sets: in proportion to the sets."""
    pair = F.struct(-F.col("score"), "u", "v")
    both = pairs.select(F.col("u").alias("node"), pair.alias("pair")).unionByName(pairs.select(F.col("v").alias("node"), pair.alias("pair")))
    if most == 1:
        return both.groupBy("node").agg(F.min("pair").alias("pair")).select("pair.u", "pair.v").distinct()
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("pair")))
    return ranked.where(F.col("rank") <= most).select("pair.u", "pair.v").distinct()


def _apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs (u, v, score) whose sets are in different components; ``parts`` has fp and root."""
    of = lambda end: parts.select(F.col("fp").alias(end), F.col("root").alias(f"root_{end}"))
    both = pairs.join(of("u"), "u", "left").join(of("v"), "v", "left")
    return both.where(F.coalesce("root_u", "u") != F.coalesce("root_v", "v")).select("u", "v", "score")


def _texts_of(pairs: DataFrame, docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(fp, text) of the sets in ``pairs``; ``keys`` has fp and the key and id of a row that has the set."""
    ends = pairs.select(F.col("u").alias("fp")).unionByName(pairs.select(F.col("v").alias("fp"))).distinct()
    asked = SharedTable(keys.join(ends, "fp", "left_semi"), "asked").df
    once = docs.select(F.xxhash64(id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return SharedTable(once.join(broadcast_if_small(asked), ["key", "id"]).groupBy("fp").agg(F.first("text").alias("text")), "texts").df


def _verified(pairs: DataFrame, texts: DataFrame, words: int, least: int) -> DataFrame:
    """The pairs (u, v; a stored table) whose whole sets are alike; ``texts`` has fp and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[tuple[int | None, np.ndarray]] = [(None, np.empty(0, np.uint64))] * 2
        for batch in (part for b in batches for half in blocks([b], 2) for part in blocks([half], 3)):
            ids, texts = (batch.column(0).to_pylist(), batch.column(1).to_pylist()), batch.columns[2:]
            keep = []
            for i in range(batch.num_rows):
                for k in (0, 1):
                    if last[k][0] != ids[k][i]:
                        last[k] = (ids[k][i], shingle_set(texts[k][i].as_py(), words))
                keep.append(alike(last[0][1], last[1][1], least))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return _with_ends(pairs, texts).select("u", "v", "a_text", "b_text").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, fp, component_id) where documents whose sets of ``words``-word shingles have a Jaccard index of ``similarity`` or more are linked."""
    least = round(_UNIT * similarity)
    if not 0 < least <= _UNIT:
        raise ValueError("similarity must be above 0 and at most 1")
    prints = _told_apart(SharedTable(_prints(docs, id_col, text_col, words, least), "prints").df)
    nodes = prints.groupBy("fp").agg(F.first("n").alias("n"), F.first("rare").alias("rare"), F.first("prefix").alias("prefix"))
    keys = prints.groupBy("fp").agg(F.min(F.struct("key", "id")).alias("k"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.min("sim").alias("sim"))
    marks = SharedTable(keys.select("fp", "k.key", "k.id", "n", "bits", "sim"), "marks").df
    spread = nodes.select("fp", "n", "rare", F.posexplode("prefix").alias("at", "cell"))
    spread = spread.select("cell", "fp", "n", (F.col("n") - F.col("at")).alias("rest"), (F.col("at") >= F.col("rare")).alias("frequent"))
    # Cells with one row have no pairs and go. Frequent shingles have more, so their rows stay and are dealt by their sets. No other
    # cell is hot: one that is not among the HELD most frequent has no more rows than a HELD-th of all, by the sample's counts.
    salt = F.when(F.col("frequent"), F.col("fp")).otherwise(0)
    dealt = spread.repartition(F.col("cell"), salt).sortWithinPartitions("cell")
    cells = SharedTable(dealt.mapInArrow(_shared, "cell long, fp long, n long, rest long"), "cells").df
    sizes = cells.groupBy("cell").agg(F.count("*").alias("m")).where(F.col("m") > CELL_ROWS)
    hot = SharedTable(sizes.select("cell", F.ceil(F.col("m") / (CELL_ROWS // 2)).cast("int").alias("chunks")), "hot-cells").df
    head = cells.where(F.col("n") - F.col("rest") < HEAD).withColumn("part", F.col("fp"))
    meet = _candidates(head, hot, least, (1,)).unionByName(_simhash_pairs(marks))

    def links(pairs: DataFrame) -> DataFrame:
        texts = _texts_of(pairs, docs, marks.select("fp", "key", "id"), id_col, text_col)
        return SharedTable(_verified(pairs, texts, words, least), "links").df

    pairs = SharedTable(meet.distinct(), "pairs").df
    open_ = SharedTable(_plausible(pairs, marks, least), "plausible").df  # candidates of which the marks have ruled out none
    seen, edges, parts = pairs, None, None
    for shifts, most in ROUNDS:
        if parts is not None:
            parted = cells.join(parts, "fp", "left").withColumn("part", F.coalesce("root", "fp")).drop("root")
            pairs = SharedTable(_candidates(parted, hot, least, shifts).join(seen, ["u", "v"], "left_anti"), "pairs").df
            fresh, seen = _plausible(pairs, marks, least), seen.unionByName(pairs)
            open_ = SharedTable(_apart(open_, parts).unionByName(fresh), "plausible").df
        chosen = SharedTable(_best(open_, most) if most else open_.select("u", "v"), "chosen").df
        found = links(chosen)
        edges = found if edges is None else edges.unionByName(found)
        if most:
            open_ = open_.join(chosen, ["u", "v"], "left_anti")
            parts = SharedTable(connected_components(edges).select(F.col("node").alias("fp"), "root"), "parts").df
    return assign_components(prints.select("id", "fp"), edges)
