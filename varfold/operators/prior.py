"""Priors of the somatic mixture: from germline estimates, or the default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varfold.functions.special import clip, literals
from varfold.operators.germline import KEYS
from varfold.operators.keys import join_on
from varfold.operators.specs import SomaticMixtureSpec

PRIOR = ("mu_prior_mean", "mu_prior_sigma", "kappa_prior_mean", "kappa_prior_log_sigma", "pi_prior", "loh_detected", "confidence", "source")


def germline_prior(tumor_purity: float | Column = 1.0) -> dict[str, Column]:
    """Prior columns from mu_het, kappa_het, has_loh_signal and confidence. Hom estimates play no part, so they are pruned."""
    purity = tumor_purity if isinstance(tumor_purity, Column) else F.lit(float(tumor_purity))
    loh, mu, sure = F.col("has_loh_signal"), F.col("mu_het"), F.col("confidence")
    balanced = clip(0.5 * purity + 0.5 * (1.0 - purity), 0.35, 0.65)
    mean = F.array(
        clip(0.15 * purity, 0.05, 0.25),
        F.when(loh, mu).otherwise(balanced),
        F.when(loh, clip(F.when(mu > 0.5, mu).otherwise(1.0 - mu), 0.6, 0.95)).otherwise(0.85),
    )
    scale = 1.0 / (0.5 + 0.5 * sure)
    sigma = F.array(0.08 * scale, F.when(loh, 0.05).otherwise(0.10) * scale, F.when(loh, 0.08).otherwise(0.12) * scale)
    weight = F.array(*[F.when(loh, a).otherwise(b) * (1.0 + sure) for a, b in ((1.0, 2.0), (3.0, 4.0), (3.0, 1.5))])
    kappa = F.array(*[F.col("kappa_het")] * 3)
    return dict(zip(PRIOR, (mean, sigma, kappa, F.lit(0.5), weight, loh, sure, F.lit("germline")), strict=True))


def default_prior(spec: SomaticMixtureSpec | None = None) -> dict[str, Column]:
    spec = spec or SomaticMixtureSpec()
    arrays = [F.array(*literals(x)) for x in (spec.mu_default, spec.mu_prior_sigma_default, spec.kappa_default)]
    rest = (F.lit(spec.kappa_prior_log_sigma_default), F.array(*literals(spec.pi_prior_default)), F.lit(False), F.lit(0.0), F.lit("default"))
    return dict(zip(PRIOR, (*arrays, *rest), strict=True))


def priors(keys_of: DataFrame, germline: DataFrame | None, keys: tuple[str, ...] = KEYS, tumor_purity: float | Column = 1.0, min_germline_het: int = 5, spec: SomaticMixtureSpec | None = None, fit_col: str | None = None) -> DataFrame:
    """One prior for each row of ``keys_of``: from its germline estimate if that has enough het variants, else the default.

    ``fit_col`` names a further column for the estimate used, a struct of ``germline``'s columns; null for the default.
    """
    base = default_prior(spec)
    if germline is None:
        return keys_of.select(*keys, *[c.alias(n) for n, c in base.items()])
    used = [F.struct(*[c for c in germline.columns if c not in keys]).alias(fit_col)] if fit_col else []
    own = germline.where(F.col("n_het") >= min_germline_het).select(*keys, *[c.alias(n) for n, c in germline_prior(tumor_purity).items()], *used)
    joined = join_on(keys_of.select(*keys), own, keys)
    has = F.col("source").isNotNull()
    return joined.select(*keys, *[F.when(has, F.col(n)).otherwise(base[n]).alias(n) for n in PRIOR], *([fit_col] if fit_col else []))
