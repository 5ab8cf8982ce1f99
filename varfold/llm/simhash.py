"""SimHash near-duplicates: fingerprints, a segment-popcount grid join, exact verification, components.

Every fingerprint of 64 bits is mapped to the bit counts of 32 segments of two bits. The Manhattan distance of two
such vectors never exceeds the Hamming distance of the fingerprints, so it is a lower bound. The range join runs on
a grid: the 32 counts form 8 blocks, and a pair within distance d disagrees in at most d blocks, so it agrees in all
counts of some choice of 8 - d blocks. Each choice is one grid; a cell is the counts of its blocks. Pairs in a cell
pass the Manhattan bound and then the exact Hamming test.

Cells are never expanded into pairs that leave a task: a cell yields a spanning forest of its links, which has the
same components. Cells are counted first (pre-aggregated); a cell of more than ``CELL_ROWS`` members is cut into
chunks, and each pair of chunks is a task's unit of its own, so that neither one task nor one cell grows without bound.

Defined results: null text counts as empty; a text without words has fingerprint 0 and is linked like any other;
rows with equal fingerprints are always in one component, so repeated rows and ties need no order; a null id stays a
row and never is a component's id unless all its ids are null; empty tables give empty results; columns other than
the two named ones are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varfold.functions.names import unused_prefix
from varfold.llm.common import SharedTable, blocks, broadcast_if_small, connected_components, join_one

#: Members of a grid cell that one unit of work compares at most; larger cells are cut into chunks of half as many.
CELL_ROWS = 4096
#: Hashes whose bits are counted at a time.
COUNT_ROWS = 1 << 16
GRID_BLOCKS = 8
#: Unlike fingerprints that share a cell with one, up to which cells are of counts alone.
FELLOWS = 4
_LOW = np.uint64(0x5555555555555555)
_ONE = np.uint64(1)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of ``words`` words, repeats included; of the whole sequence if it is shorter."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(found), xxhash.xxh64_digest
    if len(found) <= words:
        return np.frombuffer(digest(joined, 42), ">u8").astype(np.uint64)
    ends = list(accumulate(map((1).__add__, map(len, found))))
    starts = [0, *ends[: len(found) - words]]
    raw = b"".join([digest(joined[s : e - 1], 42) for s, e in zip(starts, ends[words - 1 :], strict=True)])
    return np.frombuffer(raw, ">u8").astype(np.uint64)


def majority(hashes: np.ndarray, width: int = 1) -> np.ndarray:
    """``width`` times 64 bits that are set in over half the hashes, as signed longs; all after the first from remixed hashes."""
    out = np.zeros(width, np.int64)
    for k in range(width if len(hashes) else 0):
        if k:
            hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            hashes = hashes ^ (hashes >> np.uint64(32))
        counts = np.zeros(64, np.int64)
        for at in range(0, len(hashes), COUNT_ROWS):
            part = hashes[at : at + COUNT_ROWS].astype("<u8").view(np.uint8).reshape(-1, 8)
            counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int32)
        out[k] = np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0]
    return out


def _fingerprinter(words: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 1):
            prints = [majority(shingle_hashes(text, words), width) for text in batch.column(1).to_pylist()]
            out = [batch.column(0), *(pa.array([p[k] for p in prints], pa.int64()) for k in range(width))]
            yield pa.RecordBatch.from_arrays(out, ["id", *(f"fp{k}" for k in range(width))])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, width: int = 1) -> DataFrame:
    """(id, fp, fp0 ...) of each document. Whole texts, one pass, no shuffle.

    fp0 and on are the fingerprint's ``width`` longs; fp stands for all of them (it is fp0 if there is one, else their hash).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    longs = [f"fp{k}" for k in range(width)]
    found = rows.mapInArrow(_fingerprinter(words, width), "id long, " + ", ".join(f"{c} long" for c in longs))
    return found.select("id", (F.xxhash64(*longs) if width > 1 else F.col("fp0")).alias("fp"), *longs)


def counts_of(fp: np.ndarray) -> np.ndarray:
    """The embedding: bit counts of 32 segments of two bits, packed two bits each."""
    return (fp & _LOW) + ((fp >> _ONE) & _LOW)


def manhattan(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """Manhattan distance of packed count vectors: a lower bound of the Hamming distance."""
    x = a ^ b
    low, high = x & _LOW, (x >> _ONE) & _LOW
    return np.bitwise_count(low | high) + np.bitwise_count(high & ~low)


def _near(counts: np.ndarray, fp: np.ndarray, c: np.ndarray, v: np.ndarray, most: int) -> np.ndarray:
    """Rows of ``fp`` within ``most`` bits of ``v``: those within the Manhattan bound, verified exactly."""
    near = np.flatnonzero(manhattan(counts, c).sum(1, dtype=np.int64) <= most)
    return near[np.bitwise_count(fp[near] ^ v).sum(1, dtype=np.int64) <= most]


def _forest(node: np.ndarray, fp: np.ndarray, most: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges (root, member) of a spanning forest of the links among distinct fingerprints."""
    left, counts = np.arange(len(node)), counts_of(fp)
    roots, members = [], []
    while len(left) > 1:
        root, front = left[0], [left[0]]
        left = left[1:]
        while front and len(left):
            v = front.pop()
            near = _near(counts[left], fp[left], counts[v], fp[v], most)
            if len(near):
                hit = left[near]
                roots.append(np.full(len(hit), node[root]))
                members.append(node[hit])
                front += hit.tolist()
                left = np.delete(left, near)
    return roots, members


#: Cells of at most so many members are compared by shifts over the whole batch instead of one by one.
_SMALL = 12


def _links(cells: np.ndarray, node: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal cells."""
    us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    if len(cells) > 1:
        bounds = np.flatnonzero(np.concatenate(([True], (cells[1:] != cells[:-1]).any(1), [True])))
        sizes = np.diff(bounds)
        size_at = np.repeat(sizes, sizes)
        small = np.flatnonzero((size_at > 1) & (size_at <= _SMALL))
        run_at, counts = np.repeat(np.arange(len(sizes)), sizes)[small], counts_of(fp[small])
        for shift in range(1, min(_SMALL, len(small))):
            at = np.flatnonzero(run_at[shift:] == run_at[:-shift])
            if not len(at):
                break
            at = at[manhattan(counts[at], counts[at + shift]).sum(1, dtype=np.int64) <= most]
            a, b = small[at], small[at + shift]
            near = (np.bitwise_count(fp[a] ^ fp[b]).sum(1, dtype=np.int64) <= most) & (node[a] != node[b])
            us.append(node[a][near])
            vs.append(node[b][near])
        for k in np.flatnonzero(sizes > _SMALL):
            mine, at = np.unique(node[bounds[k] : bounds[k + 1]], return_index=True)
            roots, members = _forest(mine, fp[bounds[k] + at], most)
            us += roots
            vs += members
    return np.concatenate(us), np.concatenate(vs)


def _linker(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (cell, pair, fp, fp0 ...) sorted by cell and pair come in; links (u, v) go out. Holds one cell's unit at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def out(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            u, v = _links(rows[:, :2], rows[:, 2], rows[:, 3:].view(np.uint64), most)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            fresh = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], 1)
            held = fresh if held is None else np.concatenate((held, fresh))
            if not len(held):
                continue
            whole = int(np.flatnonzero((held[:, :2] != held[-1, :2]).any(1)).max(initial=-1)) + 1
            yield from out(held[:whole])
            held = held[whole:]
        if held is not None:
            yield from out(held)

    return run


def exact_segments(nodes: int) -> int:
    """How many segments of each kept block have their bits in the cell, so that an unlike fingerprint is met about FELLOWS times a grid.

    Two fingerprints agree in a segment's count with probability 3/8, in its bits with 1/4; four kept blocks have 16 segments.
    """
    wanted = math.log(max(nodes * (3 / 8) ** 16 / FELLOWS, 1.0), 1.5)
    return min(4, math.ceil(wanted / 4))


def grid_cells(nodes: DataFrame, max_distance: int, exact: int = 0) -> DataFrame:
    """(cell, fp, fp0) of each fingerprint ``fp``: one cell for each choice of blocks that a link may leave untouched.

    A cell is the counts of these blocks, and the bits of the first ``exact`` segments of each: a link leaves both as they
    are, so cells grow finer with the number of fingerprints and lose nothing.
    """
    if not 0 <= max_distance < GRID_BLOCKS:
        raise ValueError(f"the grid has {GRID_BLOCKS} blocks, so it serves distances below {GRID_BLOCKS}")
    wide = 64 // GRID_BLOCKS
    masks = [sum(((1 << wide) - 1) << (wide * b) for b in kept) for kept in combinations(range(GRID_BLOCKS), GRID_BLOCKS - max_distance)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    low = F.lit(0x5555555555555555)
    even, odd = F.col("fp").bitwiseAND(low), F.shiftrightunsigned("fp", 1).bitwiseAND(low)
    counts = even.bitwiseXOR(odd).bitwiseOR(F.shiftleft(even.bitwiseAND(odd), 1))
    keyed = nodes.select("fp", counts.alias("counts"))
    bits = sum(((1 << 2 * exact) - 1) << (wide * b) for b in range(GRID_BLOCKS))
    bits_of = [m & bits for m in masks]
    known = [F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in bits_of] if exact else []
    cells = F.array(*[F.xxhash64(F.lit(i), F.col("counts").bitwiseAND(F.lit(m)), *known[i : i + 1]) for i, m in enumerate(signed)])
    return keyed.select(F.explode(cells).alias("cell"), "fp", F.col("fp").alias("fp0"))


def links(cells: DataFrame, max_distance: int) -> DataFrame:
    """Links (u, v) among fingerprints that share a cell: enough of them to give the same components as all do.

    ``cells`` has cell, fp (a node's key) and fp0 ... (its longs).
    """
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > CELL_ROWS)
    hot = SharedTable(sizes.select("cell", F.ceil(F.col("n") / (CELL_ROWS // 2)).cast("int").alias("chunks")), "hot-cells")
    k = F.col("chunks")
    mine = F.pmod(F.xxhash64("fp"), k).cast("int")
    others = F.transform(F.array_except(F.sequence(F.lit(0), k - 1), F.array(mine)), lambda o: F.least(o, mine) * k + F.greatest(o, mine))
    pairs = F.when(k.isNull(), F.array(F.lit(0))).otherwise(others)
    longs = [c for c in cells.columns if c not in ("cell", "fp")]
    spread = cells.join(hot.df, "cell", "left").select("cell", F.explode(pairs).alias("pair"), "fp", *longs)
    dealt = spread.repartition(F.col("cell"), F.col("pair")).sortWithinPartitions("cell", "pair")
    return dealt.mapInArrow(_linker(max_distance), "u long, v long")


def assign_components(prints: DataFrame, edges: DataFrame) -> DataFrame:
    """prints(id, fp) with component_id: the smallest id of all documents whose fingerprints ``edges`` connect."""
    roots = connected_components(edges)
    per_print = prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    rooted = SharedTable(per_print.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "rooted").df
    per_root = SharedTable(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("prints")), "roots").df
    of_print = SharedTable(join_one(rooted, per_root, "root", "prints").select("fp", "n", "component_id"), "named").df
    return join_one(prints, of_print, "fp", "n").select("id", "fp", "component_id")


def grid_links(prints: DataFrame, max_distance: int) -> DataFrame:
    """Links (u, v) among the distinct fingerprints ``fp`` within ``max_distance`` bits: enough of them to give the same components."""
    # Each fingerprint becomes a row a grid next, so the few small partitions that distinct leaves are dealt out first.
    context = prints.sparkSession.sparkContext
    nodes = SharedTable(prints.select("fp").distinct().repartition(4 * max(context.defaultParallelism, 1), "fp"), "nodes").df
    return links(grid_cells(nodes, max_distance, exact_segments(nodes.count())), max_distance)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, max_distance: int = 4) -> DataFrame:
    """One row for each row of ``docs``: (id, fp, component_id), linking fingerprints at ``max_distance`` bits or fewer."""
    prints = SharedTable(fingerprints(docs, id_col, text_col, words).select("id", "fp"), "prints").df
    return assign_components(prints, grid_links(prints, max_distance))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` less its near-duplicates: of each component the document with the smallest id stays.

    Links are all pairs whose sets of ``words``-word shingles have an exact Jaccard index of ``similarity`` or more.
    Rows that share an id stand or fall together, but exact repeats of id and text are reduced to one, the least by its
    other columns (those that can be ordered). Rows with a null id have no place in a component's order and all stay.
    """
    from varfold.llm.jaccard import near_duplicates  # which builds on this module

    p, known = unused_prefix(docs), docs.where(F.col(id_col).isNotNull())
    own, print_ = F.col(f"{p}id"), F.xxhash64(text_col)
    found = near_duplicates(known, id_col, text_col, words, similarity)
    # Fewer rows go than stay, so those that go are looked up. A null id equals none and stays.
    gone = found.groupBy(F.col("id").alias(f"{p}id")).agg(F.max(F.col("id") == F.col("component_id")).alias("stays")).where("not stays").select(f"{p}id")
    once = docs.join(broadcast_if_small(SharedTable(gone, "gone").df), F.col(id_col) == own, "left_anti")
    counted = known.groupBy(F.col(id_col).alias(f"{p}id"), print_.alias(f"{p}text")).agg(F.count("*").alias(f"{p}n"))
    repeated = SharedTable(counted.where(F.col(f"{p}n") > 1).drop(f"{p}n"), "repeated").df
    if not repeated.isEmpty():
        same = (F.col(id_col) == own) & (print_ == F.col(f"{p}text"))
        ordered = [f"`{f.name}`" for f in docs.schema.fields if not re.search("map<|variant", f.dataType.simpleString())]
        least = F.min_by(F.struct(*[f"`{c}`" for c in docs.columns]), F.struct(*ordered)).alias(f"{p}row")
        # Repeats meet in an aggregate, which reduces them before they are shuffled.
        one = once.join(repeated, same, "left_semi").groupBy(F.col(id_col).alias(f"{p}id"), print_.alias(f"{p}text")).agg(least).select(f"{p}row.*")
        once = once.join(repeated, same, "left_anti").unionByName(one)
    return once


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """Components of all documents at four-word shingles and 4 bits."""
    found = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


