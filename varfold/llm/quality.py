"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text becomes a vector of transformed counts (word and line lengths, letter case, symbols, repetition, entropy).
Class means and covariances come from sums over all labelled training rows, aggregated by Spark: two rows reach the
driver. Covariances are shrunk towards the pooled one and towards its diagonal; a score is the difference of the two
Mahalanobis log-densities, from Cholesky factors computed once and kept in the model, then calibrated to a probability
by a logistic fit on the binned differences of the training rows.

Defined results: null text counts as empty; an empty text has the statistics of no words and gets the score of that
vector; labels that are null or neither 0 nor 1 are ignored; of several labels for a document the mean of those
decides (0.5 or more is 1); if a class has no training row, every score is the training share of class 1 (0.5 without
any row). Rows that repeat are scored alike; columns other than the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varfold.llm.common import SharedTable, blocks, crc_fold, span_hashes, table

#: Share of the pooled covariance in each class's, and of its diagonal in the result.
POOLED, DIAGONAL = 0.1, 0.05
#: A document is kept from this score on.
KEEP = 0.7
#: Bytes of text whose statistics are taken together, which take some 100 bytes of memory each.
TOGETHER = 1 << 20

_CLASS = np.full(256, 7, np.uint8)  # 7: bytes beyond ASCII
_CLASS[:128] = 6  # symbols and control bytes
for _chars, _k in ((b" \t\n\r\x0b\x0c", 0), (b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3), (b".,;:?'\"()-", 4), (b"!", 5)):
    _CLASS[np.frombuffer(_chars, np.uint8)] = _k
FEATURES = ("words", "word_length", "word_spread", "upper", "digits", "stops", "shouts", "symbols", "beyond_ascii", "distinct_words", "top_word", "repeated_lines", "line_words", "entropy")
def statistics(texts: list[str | None]) -> np.ndarray:
    """One row of FEATURES for each text."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    n, sizes = len(raw), np.array([len(r) for r in raw], np.int64)
    data = np.frombuffer(b"\n".join(raw), np.uint8)  # a newline keeps words of neighbours apart
    doc = np.repeat(np.arange(n), sizes + 1)[: len(data)]
    kind = _CLASS[data]
    inner = np.ones(len(data), bool)
    inner[(np.cumsum(sizes + 1) - 1)[:-1]] = False
    counts = np.bincount(doc[inner] * 8 + kind[inner], minlength=8 * n).reshape(n, 8).astype(float)
    solid = np.concatenate(([False], kind != 0, [False]))
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edge[::2], edge[1::2]
    owner, lengths = doc[np.minimum(starts, max(len(data) - 1, 0))] if len(data) else np.empty(0, int), (ends - starts).astype(float)
    words = np.bincount(owner, minlength=n).astype(float)
    total, squares = np.bincount(owner, lengths, n), np.bincount(owner, lengths**2, n)
    some = np.maximum(words, 1)
    mean = total / some
    spread = np.sqrt(np.maximum(squares / some - mean**2, 0))
    distinct, top = np.zeros(n), np.zeros(n)
    if len(starts):
        h = span_hashes(data, starts, ends)
        order = np.lexsort((h, owner))
        h, o = h[order], owner[order]
        first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (o[1:] != o[:-1]))))
        runs = np.diff(np.append(first, len(h)))
        distinct = np.bincount(o[first], minlength=n).astype(float)
        np.maximum.at(top, o[first], runs)
    lines, repeated = np.ones(n), np.zeros(n)
    for i, r in enumerate(raw):
        if b"\n" in r:
            found = [x for x in r.split(b"\n") if x]
            lines[i], repeated[i] = max(len(found), 1), 1 - len(set(found)) / max(len(found), 1)
    size = np.maximum(sizes, 1)
    entropy = np.zeros(n)
    for at in range(0, n, 4096):  # a table of 256 counts a document
        part = (doc >= at) & (doc < at + 4096) & inner
        table_ = np.bincount((doc[part] - at) * 256 + data[part], minlength=256 * min(4096, n - at)).reshape(-1, 256)
        p = table_ / size[at : at + 4096, None]
        entropy[at : at + 4096] = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
    letters = np.maximum(counts[:, 1] + counts[:, 2] + counts[:, 7], 1)
    return np.stack([
        np.log1p(words),
        np.log1p(mean),
        np.log1p(spread),
        np.sqrt(counts[:, 2] / letters),
        np.sqrt(counts[:, 3] / size),
        np.sqrt(counts[:, 4] / some),
        np.sqrt(counts[:, 5] / some),
        np.sqrt(counts[:, 6] / some),
        np.sqrt(counts[:, 7] / size),
        np.log1p(distinct) / np.log1p(some),
        np.sqrt(top / some),
        np.sqrt(repeated),
        np.log1p(words / lines),
        entropy / 8,
    ], 1)


def _mapper(keep: int, finish: Callable[[np.ndarray], list[pa.Array]], names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The first ``keep`` columns stay; the text in the column after them becomes what ``finish`` makes of its statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, keep, TOGETHER):
            made = finish(statistics(batch.column(keep).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], *made], names)

    return run


@dataclass(frozen=True)
class QualityModel:
    """Means, inverse Cholesky factors and log-determinants of both classes; slope and offset of the calibration."""

    means: np.ndarray
    whiten: np.ndarray
    log_det: np.ndarray
    slope: float
    offset: float

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0."""
        density = [-0.5 * ((((x - self.means[c]) @ self.whiten[c].T) ** 2).sum(1) + self.log_det[c]) for c in (0, 1)]
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _logistic(self.slope * np.clip(self.difference(x), -60, 60) + self.offset)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _constant(share: float) -> QualityModel:
    d = len(FEATURES)
    share = min(max(share, 1e-6), 1 - 1e-6)
    return QualityModel(np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2), 0.0, float(np.log(share / (1 - share))))


def _calibrate(bins: np.ndarray, ones: np.ndarray, alls: np.ndarray) -> tuple[float, float]:
    """Logistic slope and offset for binned differences, by damped Newton steps."""
    theta, x = np.array([0.2, 0.0]), np.stack([bins, np.ones_like(bins)], 1)
    for _ in range(100):
        p = _logistic(x @ theta)
        gradient = x.T @ (ones - alls * p) - np.array([1e-3, 0]) * theta
        curve = (x * (alls * p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-6])
        step = np.linalg.solve(curve, gradient)
        step *= min(1.0, 2 / max(np.abs(step).max(), 1e-12))
        theta = theta + step
        if np.abs(step).max() < 1e-9:
            break
    return max(float(theta[0]), 0.0), float(theta[1])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, *FEATURES) of each row of ``docs``; one pass over whole texts, no shuffle."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    as_columns = _mapper(1, lambda x: [pa.array(x[:, j]) for j in range(x.shape[1])], ["id", *FEATURES])
    return rows.mapInArrow(as_columns, "id long, " + ", ".join(f"{n} double" for n in FEATURES))


def fit_quality(labelled: DataFrame, label_col: str = "label") -> QualityModel:
    """Fit on all rows of ``labelled`` (label 0 or 1, and FEATURES). Only class sums and bin counts reach the driver."""
    d, names = len(FEATURES), list(FEATURES)
    kept = SharedTable(labelled.where(F.col(label_col).isin(0, 1)).select(F.col(label_col).cast("int").alias("label"), *names), "quality")
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = kept.df.groupBy("label").agg(F.count("*").alias("n"), *[F.sum(n).alias(f"s{i}") for i, n in enumerate(names)], *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"s{i}_{j}") for i, j in pairs])
    found = {r["label"]: r for r in sums.collect()}
    if len(found) < 2:
        kept.drop()
        return _constant(next(iter(found)) if found else 0.5)
    n = np.array([found[c]["n"] for c in (0, 1)], float)
    means = np.array([[found[c][f"s{i}"] for i in range(d)] for c in (0, 1)]) / n[:, None]
    within = np.zeros((2, d, d))
    for c in (0, 1):
        for i, j in pairs:
            within[c, i, j] = within[c, j, i] = found[c][f"s{i}_{j}"] - n[c] * means[c, i] * means[c, j]
    pooled = within.sum(0) / n.sum()
    whiten, log_det = np.zeros((2, d, d)), np.zeros(2)
    for c in (0, 1):
        mixed = (1 - POOLED) * within[c] / n[c] + POOLED * pooled
        mixed = (1 - DIAGONAL) * mixed + DIAGONAL * np.diag(np.diag(pooled)) + 1e-6 * np.eye(d)
        factor = np.linalg.cholesky(mixed)
        whiten[c], log_det[c] = np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum()
    raw = QualityModel(means, whiten, log_det, 1.0, 0.0)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(d)], 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(np.clip(raw.difference(x), -60, 60) * 4).astype(np.int32))], ["label", "bin"])

    counts = kept.df.mapInArrow(binned, "label int, bin int").groupBy("bin").agg(F.sum("label").alias("ones"), F.count("*").alias("n")).collect()
    kept.drop()
    slope, offset = _calibrate(*(np.array([r[k] for r in counts], float) / s for k, s in (("bin", 4), ("ones", 1), ("n", 1))))
    return QualityModel(means, whiten, log_det, slope, offset)


def score_quality(statistics_of: DataFrame, model: QualityModel) -> DataFrame:
    """(id, score) of each row of ``document_statistics``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["id", "score"])

    return statistics_of.select("id", *FEATURES).mapInArrow(run, "id long, score double")


def keep_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", least: float = KEEP) -> DataFrame:
    """The rows of ``docs`` whose score is ``least`` or more, all columns kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks([batch], text_col, TOGETHER):
                yield part.filter(pa.array(model.score(statistics(part.column(text_col).to_pylist())) >= least))

    return docs.mapInArrow(run, docs.schema)


def training_rows(statistics_of: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, id_col: str = "doc_id") -> DataFrame:
    """(label, *FEATURES) of labelled documents outside the held-out fold; one label for each id."""
    one = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    return statistics_of.join(one.where(crc_fold("id", folds) != held_out), "id").select("label", *FEATURES)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """Quality scores of all documents; learnt from labelled rows whose crc32 mod 4 isn't 2."""
    found = SharedTable(document_statistics(table(spark, sf_dir, "documents")), "statistics").df
    model = fit_quality(training_rows(found, table(spark, sf_dir, "labels"), "quality", 4, 2))
    scored = score_quality(found, model).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", (crc_fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))
