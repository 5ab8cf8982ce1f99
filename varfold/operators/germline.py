"""Germline estimates by key: counts, moments, fallbacks, the likeliest Beta-Binomial law, and flags."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varfold.functions.numeric import Counts, fit_beta_binomial_mle
from varfold.functions.names import require
from varfold.functions.special import clip, vaf
from varfold.operators.keys import dealt_by, join_on
from varfold.operators.specs import GermlineSpec
from varfold.operators.variants import histogram, valid_counts

KEYS = ("sample_id", "chrom", "arm")
#: Fixed values of the fallbacks: (count from which a fit is made is in the spec) clip bounds of the mean, precision, mean without data.
HET_FALLBACK, HET_KAPPA = (0.3, 0.7), 50.0
HOM_FALLBACK, HOM_KAPPA, HOM_MU = (0.9, 0.999), 100.0, 0.98


def counts_by_class(variants: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys with n_het, n_hom and the mean fractions of both classes; one partial aggregation, one exchange."""
    v = valid_counts(variants).withColumn("__vaf", vaf("alt", "depth"))
    het, hom = F.col("genotype") == "hetalt", F.col("genotype") == "homalt"
    return v.groupBy(*keys).agg(
        F.count_if(het).alias("n_het"),
        F.count_if(hom).alias("n_hom"),
        F.avg(F.when(het, F.col("__vaf"))).alias("mean_het"),
        F.avg(F.when(hom, F.col("__vaf"))).alias("mean_hom"),
        F.var_pop(F.when(het, F.col("__vaf"))).alias("var_het"),
        F.var_pop(F.when(hom, F.col("__vaf"))).alias("var_hom"),
    )


def moment_start(mean: Column | str, var: Column | str, mu_bounds: tuple[float, float], kappa_bounds: tuple[float, float]) -> tuple[Column, Column]:
    """Mean and precision by moments, inside the bounds; precision 50 where the variance gives none."""
    mu = clip(mean, mu_bounds[0] + 0.01, mu_bounds[1] - 0.01)
    var = F.col(var) if isinstance(var, str) else var
    room = mu * (1.0 - mu)
    return mu, F.when((var > 0) & (var < room), clip(room / var - 1.0, *kappa_bounds)).otherwise(50.0)


def fallback(n: Column | str, mean: Column | str, kind: str, spec: GermlineSpec) -> tuple[Column, Column]:
    """(mu, kappa) where a class has too few variants to fit; nulls where it has enough."""
    n = F.col(n) if isinstance(n, str) else n
    least, bounds, kappa, empty = (
        (spec.min_variants_het, HET_FALLBACK, HET_KAPPA, spec.mu_het_expected) if kind == "het" else (spec.min_variants_hom, HOM_FALLBACK, HOM_KAPPA, HOM_MU)
    )
    few = n < least
    return F.when(n == 0, empty).when(few, clip(mean, *bounds)), F.when(few, kappa)


def with_flags(fits: DataFrame, spec: GermlineSpec | None = None) -> DataFrame:
    """Derived columns: totals, imbalance, both LOH rules (fixed threshold, the spec's), confidence, direction."""
    spec = spec or GermlineSpec()
    imbalance = F.abs(F.col("mu_het") - 0.5)
    return fits.select(
        "*",
        (F.col("n_het") + F.col("n_hom")).alias("n_variants"),
        (F.col("loglik_het") + F.col("loglik_hom")).alias("loglik"),
        imbalance.alias("allelic_imbalance"),
        ((F.col("n_het") >= 10) & (imbalance > 0.10)).alias("has_loh_signal"),
        ((F.col("n_het") >= 10) & (imbalance > spec.loh_imbalance_threshold)).alias("has_loh_by_spec"),
        clip(F.col("n_het") / 30.0, 0.1, 1.0).alias("confidence"),
        F.when(imbalance < 0.05, 0).when(F.col("mu_het") > 0.5, 1).otherwise(-1).alias("het_direction"),
    )


def _schema_of(df: DataFrame, columns: tuple[str, ...]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def counts_of(rows: pd.DataFrame | pa.Table) -> Counts:
    """The pairs of one group, in order."""
    alt, depth, weight = (rows[c].to_numpy().astype(float) for c in ("alt", "depth", "weight"))
    order = np.lexsort((depth, alt))
    return Counts(alt[order], depth[order], weight[order])


def fit_classes(variants: DataFrame, keys: tuple[str, ...] = KEYS, spec: GermlineSpec | None = None) -> DataFrame:
    """keys, genotype, mu, kappa, loglik of each class with enough variants to fit.

    The rows are first reduced to counts of (alt, depth), which bounds what a grouped task holds by the range of depths.
    """
    spec = spec or GermlineSpec()
    het, hom = F.col("genotype") == "hetalt", F.col("genotype") == "homalt"
    hist = histogram(variants.where(het | hom), (*keys, "genotype"))
    columns = (*keys, "genotype")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        kind = rows["genotype"].iloc[0]
        bounds, least = (spec.mu_het_bounds, spec.min_variants_het) if kind == "hetalt" else (spec.mu_hom_bounds, spec.min_variants_hom)
        found = rows[list(columns)].iloc[:1]
        if rows["weight"].sum() < least:
            return found.iloc[:0].assign(mu=np.array([], float), kappa=np.array([], float), loglik=np.array([], float))
        mu, kappa, loglik = fit_beta_binomial_mle(counts_of(rows), bounds, spec.kappa_bounds)
        return found.assign(mu=mu, kappa=kappa, loglik=loglik)

    return dealt_by(hist, columns).groupBy(*columns).applyInPandas(fit, _schema_of(hist, columns) + ", mu double, kappa double, loglik double")


def fit_germline(variants: DataFrame, keys: tuple[str, ...] = KEYS, spec: GermlineSpec | None = None) -> DataFrame:
    """One row a key: both classes' mean, precision, log-likelihood and count, and the flags.

    ``variants`` has the keys, genotype ('hetalt' or 'homalt'), alt and depth. Classes with too few variants take the
    fallback values and log-likelihood 0. Without hom rows this is the het-only fit.
    """
    spec = spec or GermlineSpec()
    require(variants, (*keys, "genotype", "alt", "depth"), "fit_germline")
    germline = variants.where(F.col("genotype").isin("hetalt", "homalt"))
    counts = counts_by_class(germline, keys)
    fitted = fit_classes(germline, keys, spec)
    wide = fitted.groupBy(*keys).agg(*[F.max(F.when(F.col("genotype") == g, F.col(c))).alias(f"{c}_{s}_fit") for g, s in (("hetalt", "het"), ("homalt", "hom")) for c in ("mu", "kappa", "loglik")])
    both = join_on(counts, wide, keys)
    out = [F.col(k) for k in keys]
    for s in ("het", "hom"):
        mu, kappa = fallback(f"n_{s}", f"mean_{s}", s, spec)
        out += [F.coalesce(mu, f"mu_{s}_fit").alias(f"mu_{s}"), F.coalesce(kappa, f"kappa_{s}_fit").alias(f"kappa_{s}"), F.coalesce(f"loglik_{s}_fit", F.lit(0.0)).alias(f"loglik_{s}"), f"n_{s}"]
    return with_flags(both.select(*out), spec)


def fit_germline_from_mask(variants: DataFrame, mask: str = "is_het", keys: tuple[str, ...] = KEYS, spec: GermlineSpec | None = None) -> DataFrame:
    """The same from rows with a boolean: true for het, false for hom; rows with a null mask take no part."""
    require(variants, (mask,), "fit_germline_from_mask")
    kind = F.when(F.col(mask), "hetalt").when(~F.col(mask), "homalt")
    return fit_germline(variants.withColumn("genotype", kind), keys, spec)
