"""Embedding whitening: covariance by Chan merging, eigenvectors on the driver, a second pass that verifies the identity.

Entries become integers (64ths, rounded down, moved by OFFSET), and the fit list is each distinct integer vector once. Each
partition of it gives its count, sums, mean and scatter around that mean; ``treeReduce`` merges these pairwise by Chan's
formula, scatter + scatter + gap gap' * n m / (n + m), so nothing is ever squared before it is centred. What reaches the driver is one
such summary, whose size is set by the dimension alone. The driver takes the eigenvectors; a second pass over the fit
list projects it, merges the summaries of the whitened vectors in the same way, and holds their covariance against the identity.

Defined results: a vector that is null, or holds a null or non-finite entry, is left out. The vectors of the commonest length
make the space (of equally common ones the longest); others have no coordinates there and are left out too. 64 * c is held
within 2**62 either way. Repeated vectors count once in the fit and have a row each in the result, whatever their ids, null ones
included. A component whose eigenvalue is not above rounding has no whitened value (null) and no part in identity_error;
explained is null without any variance, identity_error without any such component, deviation where it doesn't fit a long. An empty
table, or one with empty vectors only, gives an empty result. Columns other than the two named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varfold.llm.common import SharedTable, table

UNIT, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Eigenvalues up to this share of the trace, times the dimension, are rounding.
ROUNDING = 1e-14
_HELD = float(1 << 62)


class Summary(NamedTuple):
    """Count, exact sums, mean and centred scatter of some vectors."""

    n: int
    sums: list[int]
    mean: np.ndarray
    scatter: np.ndarray


def summary(x: np.ndarray, sums: list[int]) -> Summary:
    """Of the rows of ``x`` (at least one)."""
    mean = x.mean(0)
    gap = x - mean
    return Summary(len(x), sums, mean, gap.T @ gap)


def merge(a: Summary, b: Summary) -> Summary:
    """Chan's pairwise formula."""
    n, gap = a.n + b.n, b.mean - a.mean
    scatter = a.scatter + b.scatter + np.outer(gap, gap) * (a.n * (b.n / n))
    return Summary(n, [p + q for p, q in zip(a.sums, b.sums, strict=True)], a.mean + gap * (b.n / n), scatter)


def exact_sums(x: np.ndarray) -> list[int]:
    """Sums of the columns of integers, as whole numbers of any size."""
    if len(x) and int(np.abs(x).max()) < (1 << 62) // len(x):
        return x.sum(0).tolist()
    return x.astype(object).sum(0).tolist()


def _rows(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _summarised(rows: DataFrame, dims: int, of: Callable[[np.ndarray], tuple[np.ndarray, list[int]]]) -> Summary:
    """The summary of what ``of`` makes of the integer vectors ``x``; there is at least one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Summary | None = None
        for batch in batches:
            if batch.num_rows:
                fresh = summary(*of(_rows(batch.column(0), dims)))
                held = fresh if held is None else merge(held, fresh)
        if held is not None:
            columns = [[held.n], [list(map(str, held.sums))], [held.mean.tolist()], [held.scatter.ravel().tolist()]]
            kinds = (pa.int64(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["n", "sums", "mean", "scatter"])

    parts = rows.select("x").mapInArrow(run, "n long, sums array<string>, mean array<double>, scatter array<double>")

    def read(r) -> Summary:
        size = len(r["mean"])
        return Summary(r["n"], list(map(int, r["sums"])), np.array(r["mean"]), np.array(r["scatter"]).reshape(size, size))

    return parts.rdd.map(read).treeReduce(merge)


@dataclass
class Whitening:
    """A fitted transformation: counts and sums of the fit list, components by falling eigenvalue, and how well it whitens."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: list[float | None]
    usable: np.ndarray
    identity_error: float | None = None

    @property
    def centre(self) -> np.ndarray:
        """The mean less OFFSET."""
        return np.array([(s - self.n * OFFSET) / self.n for s in self.sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of integer vectors; 0 where a component is not usable."""
        scale = np.where(self.usable, 1 / np.sqrt(np.where(self.usable, self.values, 1)), 0)
        return ((x - OFFSET).astype(float) - self.centre) @ self.vectors * scale

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n * x - sums) ** 2."""
        far = np.abs(x).max(initial=0)
        rough = self.n * x.astype(float) - np.array(self.sums, float)
        if self.n * float(far) < _HELD and (rough * rough).sum(1).max(initial=0) < _HELD:
            gap = self.n * x - np.array(self.sums, np.int64)
            return (gap * gap).sum(1).tolist()
        whole = ((self.n * x.astype(object) - np.array(self.sums, object)) ** 2).sum(1)
        return [v if v < 1 << 63 else None for v in whole.tolist()]


def decompose(found: Summary, components: int = COMPONENTS) -> Whitening:
    """Eigenvectors of the covariance (divisor n); the largest entry of each is positive."""
    values, vectors = np.linalg.eigh(found.scatter / found.n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    vectors = vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(0)[None], 0) < 0, -1, 1)
    trace = float(np.trace(found.scatter)) / found.n
    explained = [float(v) / trace if trace > 0 else None for v in np.maximum(values, 0)]
    return Whitening(found.n, found.sums, values, vectors, explained, values > trace * ROUNDING * len(found.mean))


def integer_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x) of each usable row: whole numbers in place of the entries."""
    entry = lambda c: F.least(F.greatest(c.cast("double") * UNIT, F.lit(-_HELD)), F.lit(_HELD))
    bad = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    usable = df.where(F.col(vec_col).isNotNull()).where(~F.exists(vec_col, bad))
    return usable.select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda c: F.floor(entry(c)) + OFFSET).alias("x"))


def fit_whitening(rows: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening:
    """Fit on the distinct vectors ``x`` of ``rows``, verified by a second pass over them."""
    fit_list = SharedTable(rows.select("x").distinct(), "fit-list").df
    found = decompose(_summarised(fit_list, dims, lambda x: ((x - OFFSET).astype(float), exact_sums(x))), components)
    seen = _summarised(fit_list, dims, lambda x: (found.project(x), [0]))
    covariance = (seen.scatter / seen.n)[np.ix_(found.usable, found.usable)]
    found.identity_error = float(np.abs(covariance - np.eye(len(covariance))).max()) if len(covariance) else None
    return found


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each usable row of ``df`` and component."""
    schema = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = integer_vectors(df, id_col, vec_col)
    common = rows.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("dims")).first()
    dims = common["dims"] if common else 0
    if not dims:
        return df.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size("x") == dims)
    found = fit_whitening(rows, dims, components)
    k = len(found.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch.column(1), dims)
            times = np.repeat(np.arange(len(x)), k)
            columns = [
                batch.column(0).take(pa.array(times)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(times), found.n, np.int64)),
                pa.array(found.deviations(x), pa.int64()).take(pa.array(times)),
                pa.array(found.project(x).ravel(), mask=np.tile(~found.usable, len(x))),
                pa.array(found.explained * len(x), pa.float64()),
                pa.array([found.identity_error] * len(times), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return rows.mapInArrow(run, schema)


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    """All embeddings, whitened to their first 16 components."""
    found = whiten(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "component", "n", "deviation", "whitened", "explained", "identity_error")
