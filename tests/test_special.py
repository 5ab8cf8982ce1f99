"""Column and NumPy kernels against DuckDB's and Python's log-gamma."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from varfold.functions import numeric, special


def exact(k: int, n: int, a: float, b: float) -> float:
    lb = lambda x, y: math.lgamma(x) + math.lgamma(y) - math.lgamma(x + y)
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + lb(k + a, n - k + b) - lb(a, b)


def test_lgamma(spark):
    x = np.concatenate([np.geomspace(1e-9, 1e6, 400), np.arange(1, 60)])
    got = np.array([r[0] for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(special.lgamma("x")).collect()])
    want = np.array([math.lgamma(v) for v in x])
    assert np.abs((got - want) / np.maximum(1, np.abs(want))).max() < 1e-12
    assert np.abs((numeric.lgamma(x) - want) / np.maximum(1, np.abs(want))).max() < 1e-12


CASES = [(0, 10, 2.0, 3.0), (10, 10, 2.0, 3.0), (5, 10, 1e-12, 1e-12), (30, 60, 25.0, 25.0), (0, 0, 5.0, 5.0), (7, 90, 0.5, 400.0)]


def test_logpmf(spark):
    frame = spark.createDataFrame(CASES + [(11, 10, 1.0, 1.0), (-1, 10, 1.0, 1.0)], "k int, n int, a double, b double")
    got = [r[0] for r in frame.select(special.beta_binom_logpmf("k", "n", "a", "b")).collect()]
    want = [exact(k, n, max(a, 1e-9), max(b, 1e-9)) for k, n, a, b in CASES]
    assert got[:-2] == pytest.approx(want, rel=1e-9, abs=1e-9) and got[-2:] == [None, None]
    k, n, a, b = map(np.array, zip(*CASES, strict=True))
    assert numeric.beta_binom_logpmf(k, n, a, b) == pytest.approx(want, rel=1e-9, abs=1e-9)
    total = sum(math.exp(v) for v in numeric.beta_binom_logpmf(np.arange(31), 30, 2.5, 4.0))
    assert total == pytest.approx(1)
    assert numeric.beta_binom_logpmf(3, 10, 5.0, 5.0) == pytest.approx(numeric.beta_binom_logpmf(7, 10, 5.0, 5.0))


def test_shapes_and_clip(spark):
    frame = spark.createDataFrame([(0.3, 50.0), (0.0, 10.0), (1.0, 10.0), (None, 1.0), (float("nan"), 1.0)], "mu double, kappa double")
    a, b = special.shapes("mu", "kappa")
    rows = frame.select(a.alias("a"), b.alias("b"), special.clip("mu", 0.1, 0.9).alias("c")).collect()
    assert (rows[0].a, rows[0].b) == pytest.approx((15.0, 35.0))
    assert rows[1].a == pytest.approx(1e-5) and rows[2].b == pytest.approx(1e-5)
    assert [rows[i].c for i in range(3)] == [0.3, 0.1, 0.9] and rows[3].c is None and math.isnan(rows[4].c)
    assert all(r.a + r.b == pytest.approx(k) for r, k in zip(rows[:3], (50, 10, 10), strict=True))


def test_vectors(spark):
    frame = spark.createDataFrame([([0.2, 0.5, 0.3],), ([0.4, 0.4, 0.2],), ([1.0, -800.0, 1.0],)], "x array<double>")
    rows = frame.select(special.logsumexp("x").alias("l"), special.label("x", 0.45).alias("t"), special.label("x").alias("u"), special.softmax("x", special.logsumexp("x")).alias("s")).collect()
    assert [r.l for r in rows] == pytest.approx([np.log(np.exp(x).sum()) for x in ([0.2, 0.5, 0.3], [0.4, 0.4, 0.2], [1.0, -800.0, 1.0])])
    assert [r.t for r in rows] == [1, -1, 0] and [r.u for r in rows] == [1, 0, 0]
    assert all(sum(r.s) == pytest.approx(1) for r in rows)
    names = spark.range(4).select(special.component_name((F.col("id") - 0).cast("int"))).collect()
    assert [r[0] for r in names] == ["subclonal", "clonal", "loh", None]


def test_maximise():
    for peak in (0.11, 0.5, 0.89, 0.0, 1.0):
        assert numeric.maximise(lambda x, p=peak: -((x - p) ** 2) - 0.3 * abs(x - p) ** 3, 0.0, 1.0, 1e-8) == pytest.approx(peak, abs=1e-5)


@pytest.mark.parametrize("seed", range(5))
def test_mle_beats_a_grid(seed):
    rng = np.random.default_rng(seed)
    depth = rng.integers(20, 100, 300)
    alt = rng.binomial(depth, rng.beta(*numeric.shapes([0.3, 0.5, 0.48, 0.15, 0.9][seed], [20, 80, 900, 5, 50][seed]), 300))
    pairs, weight = np.unique(np.stack([alt, depth], 1), axis=0, return_counts=True)
    counts = numeric.Counts(pairs[:, 0].astype(float), pairs[:, 1].astype(float), weight.astype(float))
    mu, kappa, ll = numeric.fit_beta_binomial_mle(counts)
    best = max(numeric.beta_binom_logpmf(alt, depth, *numeric.shapes(m, k)).sum() for m in np.linspace(0.01, 0.99, 99) for k in np.geomspace(1, 1000, 60))
    assert ll >= best - 1e-6
    assert ll == pytest.approx(numeric.beta_binom_logpmf(alt, depth, *numeric.shapes(mu, kappa)).sum(), rel=1e-10)


def test_mle_without_data():
    none = np.empty(0)
    assert numeric.fit_beta_binomial_mle(numeric.Counts(none, none, none)) == (0.5, 50.0, 0.0)
