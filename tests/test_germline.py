"""Germline fits: ranges, fallbacks, flags, invariances."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from varfold.functions import numeric
from varfold.operators import germline as g
from varfold.operators.specs import GermlineSpec

SCHEMA = "chrom string, arm string, genotype string, alt int, depth int"
KEYS = ("chrom", "arm")


def rows(rng, chrom, arm, genotype, n, p, kappa=None):
    depth = rng.integers(30, 100, n)
    q = p if kappa is None else rng.beta(*numeric.shapes(p, kappa), n)
    return [(chrom, arm, genotype, int(a), int(d)) for a, d in zip(rng.binomial(depth, q), depth, strict=True)]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(42)
    out = rows(rng, "chr1", "p", "hetalt", 200, 0.5, 60) + rows(rng, "chr1", "p", "homalt", 40, 0.98)
    out += rows(rng, "chr2", "q", "hetalt", 60, 0.7, 50)
    out += [("chr3", "p", "hetalt", 15, 30), ("chr3", "p", "hetalt", 18, 35), ("chr3", "p", "homalt", 5, 30)]
    out += rows(rng, "chr4", "p", "homalt", 10, 0.97)
    out += rows(rng, "chrUn", None, "hetalt", 20, 0.45)
    return out + [("chr5", "p", "skip", 1, 2)]


@pytest.fixture(scope="module")
def fits(spark, data):
    return {r.chrom: r for r in g.fit_germline(spark.createDataFrame(data, SCHEMA), KEYS).collect()}


def test_fits_recover_parameters(fits):
    r = fits["chr1"]
    assert r.mu_het == pytest.approx(0.5, abs=0.03) and 30 < r.kappa_het < 150
    assert r.mu_hom == pytest.approx(0.98, abs=0.02) and (r.n_het, r.n_hom) == (200, 40)
    assert not r.has_loh_signal and r.confidence == 1 and r.het_direction == 0
    assert r.loglik == r.loglik_het + r.loglik_hom and r.n_variants == 240
    assert fits["chr2"].mu_het == pytest.approx(0.7, abs=0.04)
    assert fits["chr2"].has_loh_signal and fits["chr2"].het_direction == 1


def test_fallbacks(fits):
    r = fits["chr3"]
    mean = (15 / (30 + 1e-9) + 18 / (35 + 1e-9)) / 2
    assert (r.mu_het, r.kappa_het, r.loglik_het) == (pytest.approx(mean), 50.0, 0.0)
    assert (r.mu_hom, r.kappa_hom, r.loglik_hom) == (0.9, 100.0, 0.0)
    assert fits["chr4"].mu_het == 0.5 and fits["chr4"].kappa_het == 50.0 and fits["chr4"].n_het == 0
    assert fits["chr2"].mu_hom == 0.98 and fits["chr2"].n_hom == 0
    assert "chr5" not in fits
    assert fits["chrUn"].arm is None and fits["chrUn"].n_het == 20


def test_objective_is_no_worse_than_a_grid(data, fits):
    for chrom, spec in (("chr1", GermlineSpec()), ("chr2", GermlineSpec())):
        alt, depth = np.array([r[3:] for r in data if r[0] == chrom and r[2] == "hetalt"]).T
        best = max(numeric.beta_binom_logpmf(alt, depth, *numeric.shapes(m, k)).sum() for m in np.linspace(*spec.mu_het_bounds, 81) for k in np.geomspace(*spec.kappa_bounds, 50))
        assert fits[chrom].loglik_het >= best - 1e-6


def test_order_partitions_and_weights_do_not_matter(spark, data, fits):
    shuffled = spark.createDataFrame(data[::-1], SCHEMA).repartition(7)
    again = {r.chrom: r for r in g.fit_germline(shuffled, KEYS).collect()}
    assert {c: (r.mu_het, r.kappa_het, r.loglik) for c, r in again.items()} == {c: (r.mu_het, r.kappa_het, r.loglik) for c, r in fits.items()}
    twice = {r.chrom: r for r in g.fit_germline(spark.createDataFrame(data * 2, SCHEMA), KEYS).collect()}
    assert twice["chr1"].mu_het == pytest.approx(fits["chr1"].mu_het, abs=1e-5)
    assert twice["chr1"].loglik == pytest.approx(2 * fits["chr1"].loglik, rel=1e-8)


def test_mask_and_spec(spark, data):
    frame = spark.createDataFrame(data, SCHEMA).where("chrom = 'chr1'").withColumn("is_het", F.col("genotype") == "hetalt").drop("genotype")
    r = g.fit_germline_from_mask(frame, keys=KEYS).first()
    assert (r.n_het, r.n_hom) == (200, 40)
    r = g.fit_germline(spark.createDataFrame(data, SCHEMA).where("chrom = 'chr2'"), KEYS, GermlineSpec(loh_imbalance_threshold=0.3)).first()
    assert r.has_loh_signal and not r.has_loh_by_spec
    assert g.fit_germline(spark.createDataFrame([], SCHEMA), KEYS).collect() == []
