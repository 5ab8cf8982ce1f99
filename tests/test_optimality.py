"""Optimality of mixture fits: slopes, points around, and that an unfinished fit is told from a finished one."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from varfold.functions import numeric
from varfold.functions import special as sp
from varfold.operators import mixture as m
from varfold.operators.optimality import optimality, slopes
from varfold.operators.prior import default_prior, priors
from varfold.operators.specs import FitOptions, SomaticMixtureSpec
from varfold.plans import registry

SPEC = SomaticMixtureSpec()
PRIOR = {"mu_prior_mean": [0.15, 0.5, 0.85], "mu_prior_sigma": [0.08, 0.12, 0.12], "kappa_prior_mean": [50.0] * 3, "kappa_prior_log_sigma": 0.5, "pi_prior": [2.0, 4.0, 2.0]}
HASTY = FitOptions(tol=1e9, n_restarts=1)


@pytest.fixture(scope="module")
def counts():
    rng = np.random.default_rng(3)
    depth = rng.integers(20, 120, 700)
    alt = rng.binomial(depth, rng.choice([0.12, 0.45, 0.8], 700, p=[0.3, 0.5, 0.2]))
    pairs, weight = np.unique(np.stack([alt, depth], 1), axis=0, return_counts=True)
    return numeric.Counts(*pairs.T.astype(float), weight.astype(float))


def objective(counts, mu, kappa, pi) -> float:
    loglik, *_ = counts.e_step(np.array(mu), np.array(kappa), np.array(pi))
    z = (np.array(mu) - PRIOR["mu_prior_mean"]) / PRIOR["mu_prior_sigma"], np.log(np.array(kappa) / PRIOR["kappa_prior_mean"]) / PRIOR["kappa_prior_log_sigma"]
    return loglik - 0.5 * sum(float(x @ x) for x in z) + float(np.array(PRIOR["pi_prior"]) @ np.log(pi))


def frame(spark, counts):
    rows = [("a", int(a), int(d), int(w)) for a, d, w in zip(counts.alt, counts.depth, counts.weight, strict=True)]
    return spark.createDataFrame(rows, "chrom string, alt int, depth int, weight long")


def with_parameters(df, mu, kappa, pi):
    own = {n: F.array(*sp.literals(v)) for n, v in (("mu", mu), ("kappa", kappa), ("pi", pi))}
    return df.withColumns(own | {n: c for n, c in default_prior().items() if n in m.NEEDED})


def test_digamma(spark):
    xs = [1e-6, 0.001, 0.5, 1.0, 2.0, 8.0, 30.5, 1e4, 1e8]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(sp.digamma("x")).collect()]
    assert got == pytest.approx(numeric.polygammas(np.array(xs))[0].tolist(), rel=1e-13)
    assert numeric.polygammas(1.0)[0] == pytest.approx(-0.5772156649015329, abs=1e-12) and numeric.polygammas(1.0)[1] == pytest.approx(math.pi**2 / 6, rel=1e-12)
    assert numeric.polygammas(0.5)[0] == pytest.approx(-0.5772156649015329 - 2 * math.log(2), abs=1e-12) and numeric.polygammas(0.5)[1] == pytest.approx(math.pi**2 / 2, rel=1e-12)
    step = 1e-4
    for x in (0.7, 5.0, 300.0):
        assert float(numeric.lgamma(x * (1 + step)) - numeric.lgamma(x * (1 - step))) / (2 * step * x) == pytest.approx(float(numeric.polygammas(x)[0]), rel=1e-6)


def test_slopes_equal_differences(spark, counts):
    mu, kappa, pi = [0.17, 0.47, 0.83], [30.0, 70.0, 55.0], [0.3, 0.5, 0.2]
    got = slopes(with_parameters(frame(spark, counts), mu, kappa, pi), ("chrom",)).first()
    for k in range(3):
        move = np.eye(3)[k] * 1e-5
        by_mu = (objective(counts, mu + move, kappa, pi) - objective(counts, mu - move, kappa, pi)) / 2e-5
        by_kappa = (objective(counts, mu, kappa * np.exp(move), pi) - objective(counts, mu, kappa * np.exp(-move), pi)) / 2e-5
        assert got.mu_slopes[k] == pytest.approx(by_mu, rel=1e-5, abs=1e-3) and got.kappa_slopes[k] == pytest.approx(by_kappa, rel=1e-5, abs=1e-3)


def test_slopes_of_a_law_equal_differences(counts):
    f = counts.objective(counts.weight)
    for mu, kappa in ((0.3, 12.0), (0.45, 60.0), (0.7, 300.0)):
        first, second, by_log, curve = f.slopes(mu, kappa)
        h = 1e-4
        assert first == pytest.approx((f(mu + h, kappa) - f(mu - h, kappa)) / (2 * h), rel=1e-4)
        assert second == pytest.approx((f(mu + h, kappa) - 2 * f(mu, kappa) + f(mu - h, kappa)) / h**2, rel=1e-4)
        assert by_log == pytest.approx((f(mu, kappa * math.exp(h)) - f(mu, kappa * math.exp(-h))) / (2 * h), rel=1e-4)
        assert curve == pytest.approx((f(mu, kappa * math.exp(h)) - 2 * f(mu, kappa) + f(mu, kappa * math.exp(-h))) / h**2, rel=1e-3, abs=1e-2)


def test_climb_finds_what_the_search_finds_with_fewer_looks(counts):
    looks = {"newton": 0, "search": 0}
    f = counts.objective(counts.weight)

    def slope(m):
        looks["newton"] += 1
        return f.slopes(m, 20.0)[:2]

    def value(m):
        looks["search"] += 1
        return f(m, 20.0)

    searched = numeric.maximise(value, 0.02, 0.98, tolerance=1e-8)
    found = numeric.climb(slope, searched - 0.02, 0.02, 0.98)  # from near by, as in all but the first turns
    assert found == pytest.approx(searched, abs=1e-6) and abs(f.slopes(found, 20.0)[0]) < 1e-3
    assert 3 * looks["newton"] <= looks["search"]


@pytest.mark.parametrize(
    ("slope", "start", "want"),
    [
        (lambda x: (1.0 - x, -1.0), 0.3, 1.0),
        (lambda x: (3.0 - x, -1.0), 0.3, 2.0),  # rises up to the bound
        (lambda x: (-1.0 - x, -1.0), 0.3, 0.0),
        (lambda x: (2.0, 0.5), 0.3, 2.0),  # never bends
        (lambda x: (math.atan(30 * (1.2 - x)), -30 / (1 + 900 * (1.2 - x) ** 2)), 1.9, 1.2),  # steps lead far away
        (lambda x: (1.5 - x**3, -3 * x * x), -5.0, 1.5 ** (1 / 3)),
    ],
)
def test_climb(slope, start, want):
    assert numeric.climb(slope, start, 0.0, 2.0) == pytest.approx(want, abs=1e-8)


def test_finished_fits_are_told_from_unfinished_ones(spark, counts):
    rows = frame(spark, counts)
    variants = rows.select("chrom", "alt", "depth", F.explode(F.sequence(F.lit(1), "weight")).alias("copy"))
    prior = priors(spark.createDataFrame([("a",)], "chrom string"), None, ("chrom",))
    fit = lambda options: m.fit_mixture(variants, prior, ("chrom",), options=options).cache()
    good, hasty = fit(None), fit(HASTY)
    r, h = (optimality(variants, f, ("chrom",)).first() for f in (good, hasty))
    own = good.first()
    assert r.objective == pytest.approx(objective(counts, own.mu, own.kappa, own.pi), abs=1e-6)
    assert r.is_optimum and r.gain < 1e-6 and r.pi_gap < 1e-6
    assert not h.is_optimum and h.gain > 0.01
    at = slopes(rows.join(good, "chrom"), ("chrom",)).first()
    assert max(map(abs, [*at.mu_slopes, *at.kappa_slopes])) < 0.1
    # One parameter off is enough.
    for name, k in (("mu", 1), ("kappa", 2), ("pi", 0)):
        off = good.withColumn(name, F.array(*[x * (1.05 if i == k else 1.0) for i, x in enumerate(sp.three(name))]))
        assert not optimality(variants, off, ("chrom",)).first().is_optimum, name


@pytest.mark.parametrize("query", ["mixture_fit_checked", "arms_checked"])
def test_checks_fail_for_fits_after_one_step(spark, monkeypatch, query):
    fit = m.fit_mixture
    monkeypatch.setattr(m, "fit_mixture", lambda variants, prior, keys=m.KEYS, spec=None, options=None: fit(variants, prior, keys, spec, HASTY))
    rows = getattr(registry, query)(spark, "/root/testdata/sf0.001").collect()
    few = [r for r in rows if r.n_variants < 3]
    assert all(r.optimum for r in few) and sum(not r.optimum for r in rows) > 0.5 * (len(rows) - len(few)) > 10


def test_restarts_are_groups_with_the_same_fits(spark, counts):
    """Runs beside each other give bit for bit what one after the other gives, and each is a task's unit of its own."""
    rng = np.random.default_rng(5)
    rows = []
    for key in ("a", None, "b"):
        depth = rng.integers(20, 60, 80)
        rows += [(key, int(a), int(d)) for a, d in zip(rng.binomial(depth, rng.choice([0.2, 0.5, 0.8], 80)), depth, strict=True)]
    variants = spark.createDataFrame(rows + [("c", 3, 9)], "chrom string, alt int, depth int")
    prior = priors(variants.select("chrom").distinct(), None, ("chrom",))
    twice = prior.withColumn("note", F.lit("x")).union(prior.where("chrom = 'a'").withColumn("note", F.lit("y")))
    got = m.fit_mixture(variants, twice, ("chrom",)).collect()
    assert sorted((str(r.chrom), r.note) for r in got) == [("None", "x"), ("a", "x"), ("a", "y"), ("b", "x"), ("c", "x")]
    for r in got:
        own = [(a, d) for c, a, d in rows if c == r.chrom]
        if own:
            pairs, weight = np.unique(own, axis=0, return_counts=True)
            want = m.map_em(numeric.Counts(*pairs.T.astype(float), weight.astype(float)), PRIOR, SPEC, FitOptions())
            assert (r.mu, r.kappa, r.pi, r.loglik, r.n_iterations) == (want["mu"].tolist(), want["kappa"].tolist(), want["pi"].tolist(), want["loglik"], want["n_iterations"])
        else:
            assert r.n_variants == 1 and r.loglik == -math.inf
    best = [max(m.run_em(counts, PRIOR, SPEC, FitOptions(), k)["loglik"] for k in range(3)), m.map_em(counts, PRIOR, SPEC, FitOptions())["loglik"]]
    assert best[0] == best[1]


def test_chunks_do_not_matter(monkeypatch, counts):
    mu, kappa, pi = np.array([0.1, 0.5, 0.8]), np.array([20.0, 60.0, 90.0]), np.array([0.2, 0.5, 0.3])
    whole = counts.e_step(mu, kappa, pi)
    monkeypatch.setattr(numeric, "CHUNK", 7)
    parts = numeric.Counts(counts.alt, counts.depth, counts.weight).e_step(mu, kappa, pi)
    assert parts[0] == pytest.approx(whole[0], rel=1e-13) and parts[1] == pytest.approx(whole[1], rel=1e-12)
    assert [f(0.4, 30.0) for f in parts[2]] == pytest.approx([f(0.4, 30.0) for f in whole[2]], rel=1e-12)


def test_start_values_from_counts_equal_those_from_rows(spark):
    v = registry._somatic(spark, "/root/testdata/sf0.001")
    rows = v.select(*m.KEYS, sp.vaf("alt", "depth").alias("x"))
    bands = m._bands(F.col("x"))
    plain = rows.groupBy(*m.KEYS).agg(*[F.count_if(b).alias(f"n{i}") for i, b in enumerate(bands)], F.avg(F.when(bands[0], F.col("x"))).alias("m0"), F.median(F.when(bands[1], F.col("x"))).alias("m1"), F.avg(F.when(bands[2], F.col("x"))).alias("m2"))
    want = {(r.sample_id, r.chrom, r.arm): r for r in plain.collect()}
    got = m.smart_init(v).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r.sample_id, r.chrom, r.arm]
        for i in range(3):
            low, high = SPEC.bounds_mu[i]
            assert r.init_mu[i] == pytest.approx(min(max(w[f"m{i}"] if w[f"n{i}"] > m.BAND_COUNT else m.START_DEFAULT[i], low), high), abs=1e-12)


def test_a_key_of_a_million_pairs(monkeypatch):
    """Little is held besides the pairs, and what comes out is what one chunk gives."""
    import tracemalloc

    rng = np.random.default_rng(8)
    depth = rng.integers(1000, 30_000, 1_020_000)
    pairs, weight = np.unique(np.stack([rng.binomial(depth, rng.beta(5, 9, len(depth))), depth], 1), axis=0, return_counts=True)
    alt, depth = pairs.T.astype(float)
    assert len(alt) > 1_000_000
    mu, kappa, pi = np.array([0.15, 0.4, 0.8]), np.array([20.0, 14.0, 50.0]), np.array([0.2, 0.6, 0.2])
    tracemalloc.start()
    deep = numeric.Counts(alt, depth, weight.astype(float))
    loglik, mass, data = deep.e_step(mu, kappa, pi)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20
    monkeypatch.setattr(numeric, "CHUNK", 1 << 21)
    whole = numeric.Counts(alt, depth, weight.astype(float)).e_step(mu, kappa, pi)
    assert loglik == pytest.approx(whole[0], rel=1e-12) and mass == pytest.approx(whole[1], rel=1e-11)
    for a, b in zip(data, whole[2], strict=True):
        assert a.slopes(0.4, 15.0) == pytest.approx(b.slopes(0.4, 15.0), rel=1e-9)


def test_what_is_written_on_the_way_can_be_dropped(spark):
    import os

    from varfold.sources.shared import SharedTable, drop_tables, shared_path

    others, SharedTable.written[:] = list(SharedTable.written), []
    folder, table = shared_path(spark, "vcf"), SharedTable(spark.range(3), "fits")
    spark.range(2).write.csv(folder)
    assert SharedTable.written == [folder, table.path] and table.df.count() == 3
    assert drop_tables(spark) == 2 and not any(os.path.exists(p.removeprefix("file:")) for p in (folder, table.path))
    SharedTable.written[:] = others
