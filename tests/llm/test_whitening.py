"""Embedding whitening against plain NumPy."""

from __future__ import annotations

import math
from fractions import Fraction
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from varfold.llm import whitening

SF = "/root/testdata/sf0.01"


def plain(vectors: list, components: int = 16):
    """(x, deviations, whitened up to sign, explained) of usable vectors, from distinct ones."""
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], object)
    fit = np.array(sorted(set(map(tuple, x.tolist()))), object)
    n, sums = len(fit), fit.sum(0)
    deviation = ((n * x - sums) ** 2).sum(1).tolist()
    centre = np.array([float(Fraction(int(s), n) - 1_000_000) for s in sums])
    gap = (fit - 1_000_000).astype(float) - centre
    values, vectors_ = np.linalg.eigh(gap.T @ gap / n)
    values, vectors_ = values[::-1][:components], vectors_[:, ::-1][:, :components]
    z = ((x - 1_000_000).astype(float) - centre) @ vectors_ / np.sqrt(values)
    return n, deviation, z, values / np.trace(gap.T @ gap / n)


def by_row(rows) -> dict:
    out: dict = {}
    for r in rows:
        out.setdefault(r.id, {})[r.component] = r
    return out


def matches(rows, ids: list, vectors: list, components: int = 16) -> None:
    n, deviation, z, explained = plain(vectors, components)
    got = by_row(rows)
    assert sorted(got) == sorted(ids) and {len(v) for v in got.values()} == {z.shape[1]}
    found = np.array([[got[i][k + 1].whitened for k in range(z.shape[1])] for i in ids])
    signs = np.sign((found * z).sum(0))
    assert np.allclose(found * signs, z, rtol=1e-8, atol=1e-8)
    for i, d in zip(ids, deviation, strict=True):
        for k, e in enumerate(explained, 1):
            r = got[i][k]
            assert r.n == n and r.deviation == d and r.explained == pytest.approx(e, rel=1e-9) and r.identity_error < 1e-9


def test_table_equals_numpy(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    df = whitening.op13_whitening(spark, SF)
    assert df.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    got = df.withColumnRenamed("vec_id", "id").collect()
    assert len(got) == 16 * len(rows)
    matches(got, [r.vec_id for r in rows], [r.embedding for r in rows])
    # The second pass by hand: whitened vectors of the fit list have the identity as covariance.
    z = np.array([[r.whitened for r in sorted(v.values(), key=lambda r: r.component)] for v in by_row(got).values()])
    assert np.abs(np.cov(z.T, bias=True) - np.eye(16)).max() < 1e-9


def test_merging_in_any_order_equals_one_pass():
    rng = np.random.default_rng(4)
    x = rng.normal(3, 2, (997, 7)) + 10.0**6
    cuts = np.sort(rng.choice(range(1, 997), 60, replace=False))
    parts = [whitening.summary(p, [len(p)]) for p in np.split(x, cuts)]
    rng.shuffle(order := list(range(len(parts))))
    got = reduce(whitening.merge, [parts[i] for i in order])
    while len(parts) > 1:  # and in pairs
        parts = [whitening.merge(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    for found in (got, parts[0]):
        assert found.n == 997 and found.sums == [997]
        assert np.allclose(found.scatter, 997 * np.cov(x.T, bias=True), rtol=1e-9, atol=1e-5)
        assert np.allclose(found.mean, x.mean(0), rtol=1e-14)


def test_hard_rows(spark):
    rng = np.random.default_rng(2)
    good = rng.normal(0, 1, (60, 5)).tolist()
    rows = [(i, v) for i, v in enumerate(good)] + [(100 + i, good[3]) for i in range(40)] + [(None, good[4]), (7, good[8])]
    bad = [(200, None), (201, [1.0, None, 2.0, 3.0, 4.0]), (202, [float("nan")] * 5), (203, [1.0, 2.0, float("inf"), 0.0, 0.0]), (204, [float("-inf")] * 5), (205, []), (206, [1.0]), (207, [0.0] * 6)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    for name in ("id", "x", "n", "component", "sums", "dims"):
        df = df.withColumn(name, F.lit("clash"))
    got = whitening.whiten(df.repartition(7)).collect()
    assert len(got) == 5 * len(rows) and {r.n for r in got} == {60}
    keyed = [r for r in got if r.id not in (None, 7)]
    matches_ids = [i for i in range(60) if i != 7] + list(range(100, 140))
    n, deviation, z, _ = plain([v for _, v in rows])
    of = {i: k for k, (i, _) in enumerate(rows) if i not in (None, 7)}
    found = by_row(keyed)
    assert sorted(found) == sorted(matches_ids)
    w = np.array([[found[i][k].whitened for k in range(1, 6)] for i in matches_ids])
    want = z[[of[i] for i in matches_ids]]
    assert np.allclose(np.abs(w), np.abs(want), atol=1e-8) and all(found[i][1].deviation == deviation[of[i]] for i in matches_ids)
    assert sorted(r.component for r in got if r.id is None) == [1, 2, 3, 4, 5] and sum(r.id == 7 for r in got) == 10


def test_without_variance_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    flat = whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0])], schema)).collect()
    assert len(flat) == 4 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained is None and r.identity_error is None for r in flat)
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(5)], schema)).collect()
    assert {r.component for r in line if r.whitened is not None} == {1} and {r.component for r in line} == {1, 2, 3}
    assert max(r.identity_error for r in line) < 1e-9 and math.isclose(max(r.explained for r in line), 1)
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, []), (2, None)], schema)).collect() == []


def test_entries_of_any_size(spark):
    """Sums and deviations stay exact where they pass a long; deviations that don't fit are null."""
    rows = [(0, [1e15, 1.0]), (1, [-1e15, 2.0]), (2, [3e14, 1e300]), (3, [0.0, -1e300])]
    got = by_row(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert all(r.deviation is None and r.n == 4 for v in got.values() for r in v.values())
    rows = [(0, [1e6, 1.0]), (1, [-1e6, 2.0]), (2, [3e5, 7.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    matches(got, [0, 1, 2], [v for _, v in rows])
