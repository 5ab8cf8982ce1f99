"""Document fingerprints: improbable byte windows in chained Bloom filters.

A window of 64 bytes slides over a text's UTF-8 bytes; its Shannon entropy is kept by one addition and one removal a
step, as an exact integer. Its rarity is how improbable that entropy is for running text (under a normal law whose mean
and spread are fixed values); windows of very low entropy are too weak to be features. A window is selected where
no window within RADIUS bytes is rarer (the first of equals), so a feature depends on its neighbourhood only and survives
edits elsewhere. Selected windows, each distinct one once and in the order of the text, go into a chain of Bloom filters
of 2,048 bits with at most FEATURES of them each. Two chains are compared by the overlap of bits less the overlap that
chance gives: each filter of the chain with fewer filters takes its best match in the other, weighted by its features.

Whole texts are read, whatever their length. Defined results: null text counts as empty; a text without any selected window (empty,
short or monotonous) has one feature, the hash of the whole text; equal texts have equal fingerprints and likeness
1; the likeness is symmetric and lies in 0 to 1; rows that repeat have equal fingerprints; empty tables give empty
results; columns other than the two named ones are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varfold.llm.common import blocks, span_hashes, table

WINDOW, RADIUS = 64, 32
#: Bits of a filter, bits a feature sets, features of a filter at most.
FILTER_BITS, HASHES, FEATURES = 2048, 5, 128
#: Mean and spread of a window's entropy in running text, and the least entropy of a feature.
TYPICAL, SPREAD, WEAKEST = 4.0, 0.25, 2.0
#: Texts are put through together up to this many bytes.
_TOGETHER = 1 << 19
_SCALE = 1 << 16
_PART = np.array([0, *(round(c * np.log2(c) * _SCALE) for c in range(1, WINDOW + 1))], np.int32)
_STEP = np.diff(_PART, prepend=0).astype(np.int32)  # what the c-th equal byte adds


def window_sums(data: np.ndarray) -> np.ndarray:
    """sum(round(c * log2(c) * 2**16)) over the byte counts c of each window of WINDOW bytes, by its start."""
    n = len(data)
    if n < WINDOW:
        return np.empty(0, np.int64)
    order = np.argsort(data, kind="stable")
    key = data[order].astype(np.int64) * (n + WINDOW) + order
    into = np.ones(n, np.int32)  # equal bytes among the WINDOW ending here
    out = np.ones(n, np.int32)  # equal bytes among the WINDOW starting here
    k, at = 1, np.flatnonzero(key[1:] - key[:-1] < WINDOW) + 1
    while len(at):
        into[at] += 1
        out[at - k] += 1
        k += 1
        at = at[at >= k]
        at = at[key[at] - key[at - k] < WINDOW]
    gain, loss = np.empty(n, np.int32), np.empty(n, np.int32)
    gain[order], loss[order] = _STEP[into], _STEP[out]
    # The first window has no bytes that go; the bytes before a window's last are counted as they came.
    change = gain.astype(np.int64)
    change[WINDOW:] -= loss[:-WINDOW]
    return np.cumsum(change)[WINDOW - 1 :]


def _rarity(sums: np.ndarray) -> np.ndarray:
    """Negative log-probability of the window's entropy in thousandths, 0 for windows that are too weak."""
    entropy = (np.log2(WINDOW) - sums / (WINDOW * _SCALE)).astype(np.float32)
    rank = (500 * ((entropy - np.float32(TYPICAL)) / np.float32(SPREAD)) ** 2).astype(np.int32) + 1
    rank[entropy < WEAKEST] = 0
    return rank


def _run_max(x: np.ndarray, size: int) -> np.ndarray:
    """max(x[i : i + size]) for each i, what lies beyond the end counting as -1; size is a power of two."""
    shift = 1
    while shift < size:
        x = np.maximum(x, np.concatenate((x[shift:], np.full(min(shift, len(x)), -1, x.dtype))))
        shift *= 2
    return x


def select(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the selected windows in ``data``, and the number of the text (starts[i], ends[i]) each lies in."""
    rank = np.full(len(data), -1, np.int32)
    sums = window_sums(data)
    if not len(sums):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    rank[: len(sums)] = _rarity(sums)
    valid = np.zeros(len(data) + 1, np.int32)
    whole = ends - starts >= WINDOW
    valid[starts[whole]] += 1
    valid[ends[whole] - WINDOW + 1] -= 1
    rank[np.cumsum(valid[:-1]) == 0] = -1  # a window of one text never ends in another, and doesn't outrank its windows
    ahead = _run_max(rank, RADIUS)
    after = np.concatenate((ahead[1:], [-1]))
    before = np.concatenate((np.full(min(RADIUS, len(rank)), -1, rank.dtype), ahead[:-RADIUS]))
    for i in range(1, min(RADIUS, len(rank))):
        before[i] = rank[:i].max()
    at = np.flatnonzero((rank > 0) & (rank > before) & (rank >= after))
    return at, np.searchsorted(starts, at, side="right") - 1


def digests(texts: list[bytes]) -> list[bytes]:
    """The fingerprint of each text: its filters, 256 bytes each, and each filter's features as two bytes before it."""
    out: list[bytes] = []
    at = 0
    while at < len(texts):
        n, size = 0, 0
        while at + n < len(texts) and (not n or size + len(texts[at + n]) <= _TOGETHER):
            size += len(texts[at + n]) + 1
            n += 1
        out += _digests(texts[at : at + n])
        at += n
    return out


def _digests(texts: list[bytes]) -> list[bytes]:
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    data = np.frombuffer(b"\0".join(texts), np.uint8)
    where, owner = select(data, starts, ends)
    hashes = span_hashes(data, where, where + WINDOW) if len(where) else np.empty(0, np.uint64)
    without = np.setdiff1d(np.arange(len(texts)), owner)
    whole = [int.from_bytes(hashlib.sha256(texts[i]).digest()[:8], "little") for i in without]
    hashes, owner = np.append(hashes, np.array(whole, np.uint64)), np.append(owner, without)
    place = np.arange(len(owner))
    order = np.lexsort((place, hashes, owner))
    first = np.ones(len(order), bool)
    first[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    keep = np.sort(order[first])
    keep = keep[np.argsort(owner[keep], kind="stable")]
    hashes, owner = hashes[keep], owner[keep]
    counts = np.bincount(owner, minlength=len(texts))
    nth = np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]
    filters = -(-counts // FEATURES)
    base = np.cumsum(filters) - filters
    mine = base[owner] + nth // FEATURES
    bits = np.zeros((int(filters.sum()), FILTER_BITS), bool)
    for k in range(HASHES):
        bits[mine, ((hashes >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
    packed = np.concatenate([np.bincount(mine, minlength=len(bits)).astype("<u2")[:, None].view(np.uint8), np.packbits(bits, axis=1)], 1)
    return [packed[b : b + f].tobytes() for b, f in zip(base, filters, strict=True)]


def likeness(a: bytes, b: bytes) -> float:
    """0 to 1: the normalised overlap of two chains; 1 for equal ones."""
    if a == b:
        return 1.0
    if (len(b), b) < (len(a), a):
        a, b = b, a
    wide = 2 + FILTER_BITS // 8
    x, y = (np.frombuffer(c, np.uint8).reshape(-1, wide) for c in (a, b))
    features = x[:, :2].copy().view("<u2")[:, 0].astype(float)
    x, y = x[:, 2:].copy().view(np.uint64), y[:, 2:].copy().view(np.uint64)
    set_x, set_y = np.bitwise_count(x).sum(1, dtype=np.int64), np.bitwise_count(y).sum(1, dtype=np.int64)
    total = 0.0
    for row, own, weight in zip(x, set_x, features, strict=True):
        common = np.bitwise_count(row & y).sum(1, dtype=np.int64)
        chance = own * set_y / FILTER_BITS
        room = np.minimum(own, set_y) - chance
        total += weight * float(np.clip((common - chance) / np.maximum(room, 1e-9), 0, 1).max())
    return min(total / features.sum(), 1.0)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint binary) of each row of ``docs``; one pass over whole texts, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 1):
            made = digests([(t or "").encode("utf-8", "replace") for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["id", "fingerprint"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, fingerprint binary")


#: Ranges of ids that are put in order apart: so many at least, one for so many bytes of text, and so many at most (they are listed in the plan).
RANGES, RANGE_BYTES, MOST_RANGES = 64, 64 << 20, 1 << 18
_LAST = -(1 << 63)


def _range_of(id_: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds the id reaches: a binary search, the widest step first."""
    if not bounds:
        return F.lit(0)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    known = F.lit(np.array(bounds, np.int64))
    reach = lambda at, step: F.coalesce(F.get(known, at + step - 1) <= id_, F.lit(False))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(reach(at, step), at + step).otherwise(at))


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(range, id, ahead, text) dealt by range and sorted by descending id, each range followed by the next one's first row.

    ``ahead`` is true for such a row, which belongs to another range. Equal ids are in order of their texts; null ids come
    last; after the last row comes the first. Texts are shuffled once. The number of ranges, each a task's, follows from the bytes of text.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ranges = min(max(RANGES, -(-size // RANGE_BYTES)), MOST_RANGES)
    bounds = sorted(set(map(int, rows.select("id").where(F.col("id") != _LAST).approxQuantile("id", [k / ranges for k in range(1, ranges)], 1 / (4 * ranges)))))
    rows = rows.withColumn("range", _range_of(F.col("id"), bounds))
    firsts = rows.groupBy("range").agg(F.max("id").alias("id")).orderBy(F.desc("range")).collect()  # a row a range
    if not firsts:
        return rows.select("range", "id", F.lit(False).alias("ahead"), "text")
    # The first row of a range also follows the last row of the range before it in descending order.
    first_id, goes_to = np.full(len(bounds) + 1, _LAST), np.full(len(bounds) + 1, -1, np.int32)
    for i, f in enumerate(firsts):
        first_id[f["range"]], goes_to[f["range"]] = f["id"], firsts[i - 1]["range"]
    own = F.struct(F.col("range"), F.lit(False).alias("ahead"))
    other = F.struct(F.get(F.lit(goes_to), F.col("range")).alias("range"), F.lit(True).alias("ahead"))
    goes = F.when(F.col("id") == F.get(F.lit(first_id), F.col("range")), F.array(own, other)).otherwise(F.array(own))
    dealt = rows.select(F.explode(goes).alias("to"), "id", "text").select("to.range", "id", "to.ahead", "text")
    return dealt.repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions("range", "ahead", F.desc("id"), "text")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``in_order`` come in; each row that isn't ahead goes out with the digests of its text and its edited text."""
    held: list[tuple] = []  # (range, id, ahead, text, digest), the last rows without a successor yet
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if a[0] == b[0] and not a[2]]
        edits = []
        for a, b in pairs:
            cut = len(a[3]) // 3
            edits.append((a[3][: len(a[3]) - cut] + b[3][:cut]).encode("utf-8", "replace"))
        made = digests(edits)
        out = [
            (None if a[1] == _LAST else a[1], len(a[3]), hashlib.sha256(e).hexdigest(), a[4], d, likeness(a[4], d), likeness(a[4], b[4]))
            for (a, b), e, d in zip(pairs, edits, made, strict=True)
        ]
        columns = list(zip(*out, strict=True)) or [[]] * 7
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    for batch in blocks(batches, 3, 1 << 21):
        rows = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
        # Of the rows ahead of a range only the first counts.
        rows = [r for i, r in enumerate(rows) if not (r[2] and ((rows[i - 1] if i else (held or [(None, None, False)])[-1])[2]))]
        made = digests([r[3].encode("utf-8", "replace") for r in rows])
        held += [(*r, d) for r, d in zip(rows, made, strict=True)]
        yield from flush(held)
        held = held[-1:]


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint beside that of its edited text (last third replaced by the next text's beginning) and the likenesses."""
    schema = "id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
    return in_order(docs, id_col, text_col).mapInArrow(_edited, schema)


def op3_digests(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    found = compare_with_edits(table(spark, sf_dir, "documents"))
    hexed = [F.lower(F.hex(c)).alias(c) for c in ("fingerprint", "edited_fingerprint")]
    return found.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", *hexed, "near_edited", "near_next")
