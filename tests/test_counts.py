"""Queries that score counts of (alt, depth): what is scored doesn't grow with the rows, and no row is lost."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from varfold.functions import special
from varfold.functions.numeric import Counts
from varfold.operators import mixture as m
from varfold.operators.specs import FitOptions, SomaticMixtureSpec
from varfold.operators.variants import weighted_counts
from varfold.plans import registry

from conftest import SF001


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """The line items, with some whose alt exceeds the depth and some without a quantity; and the same three times, at the same positions."""
    line = spark.read.parquet(f"{SF001}/lineitem.parquet")
    odd = F.col("l_orderkey") % 50
    line = line.withColumns({"l_discount": F.when(odd == 0, 1.5).otherwise(F.col("l_discount")), "l_quantity": F.when(odd != 1, F.col("l_quantity"))})
    once, thrice = (str(tmp_path_factory.mktemp(n)) for n in ("once", "thrice"))
    line.write.parquet(f"{once}/lineitem.parquet")
    line.crossJoin(spark.range(3).select((F.col("id") * 250_000_000).alias("shift"))).withColumn("l_orderkey", F.col("l_orderkey") + F.col("shift")).drop("shift").write.parquet(f"{thrice}/lineitem.parquet")
    return once, thrice


QUERIES = ["posteriors_by_name", "predicted", "component_rows", "uncertain_labels", "component_summary"]


@pytest.mark.parametrize("query", QUERIES)
def test_what_is_scored_does_not_grow(spark, monkeypatch, folders, query):
    seen, staged = [], special.staged

    def watched(rows, **columns):
        seen.append(rows.select("alt", "depth").count())
        return staged(rows, **columns)

    monkeypatch.setattr(special, "staged", watched)
    monkeypatch.setattr(m, "fit_mixture", lambda variants, prior, keys: registry._with_default(prior.select(*keys)))
    calls = [len(getattr(registry, query)(spark, folder).columns) and len(seen) for folder in folders]
    assert calls[0] and calls[1] == 2 * calls[0]
    assert seen[: calls[0]] == seen[calls[0] :]


def test_names_of_rows_and_of_counts(spark, folders):
    once, thrice = ({(r.chrom, r.component): r for r in registry.posteriors_by_name(spark, f).collect()} for f in folders)
    somatic = registry._somatic(spark, folders[0])
    assert sum(r.n for r in once.values()) == somatic.count()
    assert sum(r.n for (_, name), r in once.items() if name is None) == somatic.where("alt > depth or alt is null").count() > 0
    assert once.keys() == thrice.keys()
    for key, r in once.items():
        assert thrice[key].n == 3 * r.n
        if key[1] is not None:
            assert thrice[key].loglik == pytest.approx(3 * r.loglik, abs=0.01)


def test_sums_of_counts_are_those_of_rows(spark, folders):
    rows = registry._somatic(spark, folders[0])
    fits = registry._with_default(rows.select(*registry.ARM).distinct()).localCheckpoint()
    of_rows, of_counts = (m.predict(v, fits, registry.ARM, 0.9) for v in (rows, weighted_counts(rows, registry.ARM)))
    key = lambda r: tuple(str(x) for x in r)
    labels = [sorted(d.groupBy(*registry.ARM, "label").agg(n).collect(), key=key) for d, n in ((of_rows, F.count("*").alias("n")), (of_counts, F.sum("weight").alias("n")))]
    assert labels[0] == labels[1] and sum(r.n for r in labels[0]) == rows.count() and any(r.label is None for r in labels[0])
    one, two = ({(r.chrom, r.arm, r.component): r for r in s.collect()} for s in (m.component_summary(of_rows, fits, registry.ARM), m.component_summary(of_counts, fits, registry.ARM, "weight")))
    assert one.keys() == two.keys()
    for k, r in one.items():
        assert r.n_assigned == two[k].n_assigned and r.mean_responsibility == pytest.approx(two[k].mean_responsibility)


def test_turns_of_a_fit_do_not_grow_with_weights():
    rng = np.random.default_rng(7)
    depth = rng.integers(21, 71, 3000)
    alt = np.floor(depth * rng.choice([0.1, 0.15, 0.2, 0.41, 0.46, 0.55, 0.8, 0.85, 0.9], 3000))
    pairs, weight = np.unique(np.stack([alt, depth], 1), axis=0, return_counts=True)
    spec = SomaticMixtureSpec()
    prior = {"mu_prior_mean": spec.mu_default, "mu_prior_sigma": spec.mu_prior_sigma_default, "kappa_prior_mean": spec.kappa_default, "kappa_prior_log_sigma": spec.kappa_prior_log_sigma_default, "pi_prior": spec.pi_prior_default}
    for times in (1, 100, 10_000):
        counts = Counts(pairs[:, 0].astype(float), pairs[:, 1].astype(float), weight * float(times))
        runs = [m.run_em(counts, prior, spec, FitOptions(), r) for r in range(3)]
        assert all(r["converged"] and r["n_iterations"] <= 20 for r in runs), (times, [r["n_iterations"] for r in runs])
        assert max(r["loglik"] for r in runs) - min(r["loglik"] for r in runs) < 1e-9 * abs(runs[0]["loglik"])
