"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters, digits and bytes beyond ASCII, in lower case (A-Z). A text's features are the presence of
its words, of its pairs of neighbours and of its pairs with one word between them, hashed into 2**BITS slots. The
learner keeps a rate for each coordinate and an L1 penalty, so most weights end at zero: what is broadcast for scoring
are the others, at most 2**BITS pairs of index and weight.

Learning takes a bounded sample of labelled rows (SAMPLE, in the order of a hash of their ids) and makes ``updates`` updates,
whatever the number of rows, one row after the other in one task that streams them: it goes through the sample in turns,
in another order each, until they are made. Features are extracted in parallel, from whole texts. Scoring is one pass over
all rows without a shuffle.

Defined results: null text counts as empty; an empty text has no features and gets the score of the bias; labels that
are null or neither 0 nor 1 are ignored; of several labels for a document the mean decides (0.5 or more is 1), of
several rows with one id the one with the least features is learnt from; without labelled rows every score is 0.5.
Rows that repeat are scored alike; columns other than the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varfold.llm.common import SharedTable, blocks, crc_fold, span_hashes, table

BITS = 18
#: Labelled rows learnt from at most, and updates made in all; not fewer, so that the whole sample is seen.
SAMPLE, UPDATES = 40_000, 40_000
ALPHA, BETA, L1, L2 = 1.0, 1.0, 12.0, 0.5

_WORD = np.zeros(256, bool)
_WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
for _c in range(256):
    _WORD[_c] |= chr(_c).isascii() and chr(_c).isalnum()
    if 65 <= _c <= 90:
        _LOWER[_c] = _c + 32


def _slot(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, slot) of each feature of each text, repeats included."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    data = _LOWER[np.frombuffer(b"\n".join(raw), np.uint8)]
    solid = np.concatenate(([False], _WORD[data], [False]))
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    doc = np.searchsorted(np.cumsum(sizes + 1), starts, side="right")
    h = span_hashes(data, starts, ends)
    docs, slots = [doc], [_slot(h)]
    for gap, factor in ((1, np.uint64(0x9E3779B97F4A7C15)), (2, np.uint64(0xC2B2AE3D27D4EB4F))):
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            docs.append(doc[gap:][same])
            slots.append(_slot((h[:-gap] * factor + h[gap:])[same]))
    return np.concatenate(docs), np.concatenate(slots)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, 2):
        n = batch.num_rows
        keys = np.unique((lambda d, s: d << BITS | s)(*features(batch.column(2).to_pylist())))
        offsets = np.searchsorted(keys >> BITS, np.arange(n + 1)).astype(np.int32)
        found = pa.ListArray.from_arrays(pa.array(offsets), pa.array((keys & ((1 << BITS) - 1)).astype(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], ["id", "label", "features"])


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """FTRL-proximal over the rows in order; gives (slot, weight) where the weight isn't zero, the bias as slot -1."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias_z = bias_n = 0.0

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    bias = 0.0
    for batch in batches:
        offsets, values = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy(zero_copy_only=False)
        for k, label in enumerate(batch.column(0).to_pylist()):
            at = values[offsets[k] : offsets[k + 1]]
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - label
            grown = ns + g * g
            z[at] = zs + g - (np.sqrt(grown) - np.sqrt(ns)) / ALPHA * w
            n[at] = grown
            bias_z, bias_n = bias_z + g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / ALPHA * bias, bias_n + g * g
            bias = -bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA)
    w = weights(z, n)
    at = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(w[at], bias))], ["slot", "weight"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "label", id_col: str = "doc_id", text_col: str = "text", updates: int = UPDATES) -> dict[int, float]:
    """Weights by slot (the bias at -1), learnt by so many updates from the documents that ``labels`` (id, label 0 or 1) marks."""
    one = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    sample = one.orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")  # at most SAMPLE rows
    found = rows.select("id", "label", "text").mapInArrow(_extract, "id long, label int, features array<int>")
    kept = SharedTable(found.groupBy("id", "label").agg(F.min("features").alias("features")), "toxic")
    count = kept.df.count()
    if not count:
        kept.drop()
        return {}
    turns = kept.df.withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(-(-updates // count)))))
    ordered = turns.repartition(1).sortWithinPartitions("turn", F.xxhash64("id", "turn"), "id").select("label", "features").limit(updates)
    weights = {r["slot"]: r["weight"] for r in ordered.mapInArrow(_learn, "slot int, weight double").collect()}
    kept.drop()
    return weights


def score_toxicity(docs: DataFrame, weights: dict[int, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each row of ``docs``."""
    at = np.array(sorted(k for k in weights if k >= 0), np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((at, np.array([weights[int(k)] for k in at]), weights.get(-1, 0.0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, values, bias = shared.value
        dense = np.zeros(1 << BITS)
        dense[where] = values
        active = dense != 0
        for batch in blocks(batches, 1):
            doc, slot = features(batch.column(1).to_pylist())
            hit = active[slot]
            keys = np.unique(doc[hit] << BITS | slot[hit])
            total = np.bincount(keys >> BITS, dense[keys & ((1 << BITS) - 1)], batch.num_rows) + bias
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], ["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, score double")


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents; learnt from labelled rows whose crc32 mod 5 isn't 0."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = fit_toxicity(docs, labels.where(crc_fold("doc_id", 5) != 0), "toxic")
    scored = score_toxicity(docs, weights).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", (crc_fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
