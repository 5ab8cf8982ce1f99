"""The registered fits use the operator's own restarts."""

from __future__ import annotations

import pytest

from varfold.operators import mixture
from varfold.operators.specs import FitOptions
from varfold.plans import registry


@pytest.mark.parametrize("query", ["fit_sample_arm", "predicted"])
def test_fits_take_the_default_restarts(spark, monkeypatch, query):
    seen, fit = [], mixture.fit_mixture

    def watched(variants, prior, keys=mixture.KEYS, spec=None, options=None):
        seen.append(options or FitOptions())
        return fit(variants, prior, keys, spec, options)

    monkeypatch.setattr(mixture, "fit_mixture", watched)
    getattr(registry, query)(spark, "/root/testdata/sf0.001")
    assert seen == [FitOptions()]
