"""The three-component Beta-Binomial mixture: start values, MAP fits of all keys in one job, posteriors, labels, summaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from varfold.functions import special as sp
from varfold.functions.names import require, unused_prefix
from varfold.functions.numeric import Counts, better
from varfold.operators.germline import KEYS, counts_of, fit_germline
from varfold.operators.keys import dealt_by, join_on
from varfold.operators.prior import PRIOR, priors
from varfold.operators.specs import FitOptions, SomaticMixtureSpec
from varfold.operators.variants import histogram

#: Fixed values of the start: bands of the fraction, the count above which a band's statistic is used, values without one.
SUB_BELOW, CLONAL_BAND, LOH_ABOVE, BAND_COUNT = 0.25, (0.35, 0.65), 0.65, 5
START_DEFAULT = (0.15, 0.50, 0.85)
#: Jitter of later restarts.
MU_JITTER, KAPPA_JITTER = 0.08, (0.7, 1.3)
PARAMETERS = 8
#: By how much of its size a data log-likelihood is rounded; more than the default tolerance only from 10 million on.
LOGLIK_ROUNDING = 1e-13
#: The prior's columns that a fit reads.
NEEDED = ["mu_prior_mean", "mu_prior_sigma", "kappa_prior_mean", "kappa_prior_log_sigma", "pi_prior"]
FIT = ("mu", "kappa", "pi", "n_variants", "loglik", "bic", "converged", "n_iterations")
_FIT_SCHEMA = "mu array<double>, kappa array<double>, pi array<double>, n_variants long, loglik double, bic double, converged boolean, n_iterations int"


def _bands(x):
    """Whether a fraction is in the band of each component: a Column of them or an array."""
    return x < SUB_BELOW, (x >= CLONAL_BAND[0]) & (x <= CLONAL_BAND[1]), x > LOH_ABOVE


def smart_init(variants: DataFrame, keys: tuple[str, ...] = KEYS, spec: SomaticMixtureSpec | None = None) -> DataFrame:
    """keys and init_mu, the start of the three means: mean, median and mean of the fraction's bands, within bounds."""
    require(variants, (*keys, "alt", "depth"), "smart_init")
    return start_of_counts(variants.groupBy(*keys, "alt", "depth").agg(F.count("*").alias("weight")), keys, spec)


def start_of_counts(counts: DataFrame, keys: tuple[str, ...] = KEYS, spec: SomaticMixtureSpec | None = None) -> DataFrame:
    """The same from counts (keys, alt, depth, weight), which are fewer than rows: means and exact medians weighted by them."""
    spec = spec or SomaticMixtureSpec()
    require(counts, (*keys, "alt", "depth", "weight"), "start_of_counts of a histogram")
    v = counts.select(*keys, sp.vaf("alt", "depth").alias("vaf"), "weight")
    x, w = F.col("vaf"), F.col("weight")
    bands = _bands(x)
    mean = lambda b: F.sum(F.when(b, x * w)) / F.sum(F.when(b, w))
    found = v.groupBy(*keys).agg(
        *[F.coalesce(F.sum(F.when(b, w)), F.lit(0)).alias(f"n{i}") for i, b in enumerate(bands)],
        mean(bands[0]).alias("m0"),
        F.percentile(F.when(bands[1], x), F.lit(0.5), w).alias("m1"),
        mean(bands[2]).alias("m2"),
    )
    start = [sp.clip(F.when(F.col(f"n{i}") > BAND_COUNT, F.col(f"m{i}")).otherwise(START_DEFAULT[i]), *spec.bounds_mu[i]) for i in range(3)]
    return found.select(*keys, F.array(*start).alias("init_mu"))


def _weighted_start(counts: Counts, bounds) -> np.ndarray:
    x = counts.alt / (counts.depth + sp.VAF_EPSILON)
    out = []
    for i, band in enumerate(_bands(x)):
        weight = counts.weight[band]
        if weight.sum() <= BAND_COUNT:
            out.append(START_DEFAULT[i])
        elif i == 1:
            order = np.argsort(x[band])
            reach, ranked = np.cumsum(weight[order]), x[band][order]
            total = reach[-1]
            out.append(float(np.mean([ranked[np.searchsorted(reach, q, side="right")] for q in ((total - 1) // 2, total // 2)])))
        else:
            out.append(float(np.average(x[band], weights=weight)))
    return np.array([min(max(v, b[0]), b[1]) for v, b in zip(out, bounds, strict=True)])


def starts(first_mu: np.ndarray, mu0: np.ndarray, kappa0: np.ndarray, spec: SomaticMixtureSpec, options: FitOptions) -> list[tuple[np.ndarray, np.ndarray]]:
    """Start means and precisions of each restart: halfway between data and prior first, then jittered priors."""
    rng, (low, high) = np.random.default_rng(options.random_state), np.array(spec.bounds_mu).T
    out = [(np.clip((first_mu + mu0) / 2, low, high), kappa0.copy())]
    for _ in range(options.n_restarts - 1):
        mu = np.clip(mu0 + rng.uniform(-MU_JITTER, MU_JITTER, 3), low, high)
        out.append((mu, np.clip(kappa0 * rng.uniform(*KAPPA_JITTER, 3), *spec.bounds_kappa)))
    return out


def run_em(counts: Counts, prior: dict, spec: SomaticMixtureSpec, options: FitOptions, restart: int = 0) -> dict:
    """One MAP-EM run on weighted counts, from the start values of restart number ``restart``."""
    mu0, sigma, kappa0, weight0 = (np.array(prior[n], float) for n in ("mu_prior_mean", "mu_prior_sigma", "kappa_prior_mean", "pi_prior"))
    log_sigma = float(prior["kappa_prior_log_sigma"])
    log0, log_bounds = np.log(kappa0), np.log(spec.bounds_kappa)
    mu, kappa = starts(_weighted_start(counts, spec.bounds_mu), mu0, kappa0, spec, options)[restart]
    pi, last, settled = weight0 / weight0.sum(), -np.inf, False
    for turn in range(1, options.max_iter + 1):
        loglik, mass, data = counts.e_step(mu, kappa, pi)
        if abs(loglik - last) < max(options.tol, LOGLIK_ROUNDING * abs(loglik)):  # no finer than a sum over many rows is rounded
            settled = True
            break
        last = loglik
        pi = mass + weight0
        pi = pi / pi.sum()
        for k, own in enumerate(data):

            def of_mu(m, own=own, k=k):
                return own(m, kappa[k]) - 0.5 * ((m - mu0[k]) / sigma[k]) ** 2

            def mu_slopes(m, own=own, k=k):
                first, second, *_ = own.slopes(m, kappa[k])
                return first - (m - mu0[k]) / sigma[k] ** 2, second - 1 / sigma[k] ** 2

            mu[k] = better(of_mu, mu_slopes, mu[k], *spec.bounds_mu[k])

            def of_kappa(t, own=own, k=k):
                return own(mu[k], np.exp(t)) - 0.5 * ((t - log0[k]) / log_sigma) ** 2

            def kappa_slopes(t, own=own, k=k):
                *_, first, second = own.slopes(mu[k], np.exp(t))
                return first - (t - log0[k]) / log_sigma**2, second - 1 / log_sigma**2

            kappa[k] = np.clip(np.exp(better(of_kappa, kappa_slopes, np.log(kappa[k]), *log_bounds)), *spec.bounds_kappa)
    return {"mu": mu, "kappa": kappa, "pi": pi, "loglik": loglik, "bic": PARAMETERS * np.log(counts.total) - 2 * loglik, "converged": settled, "n_iterations": turn}


def map_em(counts: Counts, prior: dict, spec: SomaticMixtureSpec, options: FitOptions) -> dict:
    """The best of several MAP-EM runs: largest data log-likelihood, the earliest of equals."""
    return max((run_em(counts, prior, spec, options, r) for r in range(options.n_restarts)), key=lambda found: found["loglik"])


def _fit_key(counts: Counts, prior: dict, spec: SomaticMixtureSpec, options: FitOptions, restart: int) -> dict:
    """One run for one key; the prior's values where there are fewer than three variants."""
    n = int(counts.total)
    if n >= 3:
        return run_em(counts, prior, spec, options, restart) | {"n_variants": n}
    weight = np.array(prior["pi_prior"], float)
    loglik, bic = (0.0, 0.0) if n == 0 else (-np.inf, np.inf)
    return {"mu": prior["mu_prior_mean"], "kappa": prior["kappa_prior_mean"], "pi": weight / weight.sum(), "n_variants": n, "loglik": loglik, "bic": bic, "converged": True, "n_iterations": 0}


def fit_mixture(variants: DataFrame, prior: DataFrame, keys: tuple[str, ...] = KEYS, spec: SomaticMixtureSpec | None = None, options: FitOptions | None = None) -> DataFrame:
    """One row for each row of ``prior``: its columns and the fit.

    Keys without variants take the prior's values, log-likelihood 0; keys with one or two take them too, with -inf
    (and BIC +inf). All keys are fitted in one job, on their counts of (alt, depth): what a grouped task holds is bounded by
    the range of depths, and only parameters come back. Restarts are groups of their own, so they run beside each other; of a key's
    runs the one with the largest log-likelihood stays, the earliest of equals. Each prior meets its counts once, so whatever
    ``prior`` was made from is computed once. Posteriors are then plain columns (``posteriors``).
    """
    spec, options = spec or SomaticMixtureSpec(), options or FitOptions()
    require(variants, (*keys, "alt", "depth"), "fit_mixture")
    require(prior, (*keys, *NEEDED), "fit_mixture with a prior (see priors)")
    kept = prior.select(*[f"`{c}`" for c in prior.columns if c not in FIT])
    own_columns, p = kept.columns, unused_prefix(kept)
    run, every = f"{p}run", F.explode(F.sequence(F.lit(0), F.lit(options.n_restarts - 1)))
    kinds = (*[pa.list_(pa.float64())] * 3, pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.int32())

    def fit(own: pa.Table, rows: pa.Table) -> pa.Table:
        values: dict = dict.fromkeys(FIT)
        if own.num_rows:  # counts of keys that have no prior give no row
            values = _fit_key(counts_of(rows), own.slice(0, 1).select(NEEDED).to_pylist()[0], spec, options, own.column(run)[0].as_py())
        for name, kind in zip(FIT, kinds, strict=True):
            own = own.append_column(name, pa.array([values[name]] * own.num_rows, kind))
        return own

    tried, counts = kept.withColumn(run, every), histogram(variants, keys).withColumn(run, every)
    schema = StructType([*tried.schema.fields, *StructType.fromDDL(_FIT_SCHEMA).fields])
    groups = (*keys, run)
    runs = dealt_by(tried, groups).groupBy(*groups).cogroup(dealt_by(counts, groups).groupBy(*groups)).applyInArrow(fit, schema)
    # The prior's rows come from one run; of the fits the best stays.
    rows = F.collect_list(F.when(F.col(run) == 0, F.struct(*[f"`{c}`" for c in own_columns])))
    best = F.min_by(F.struct(*FIT), F.struct(-F.col("loglik"), F.col(run)))
    of_key = runs.groupBy(*[F.col(k).alias(f"{p}{k}") for k in keys]).agg(rows.alias(f"{p}rows"), best.alias(f"{p}fit"))
    return of_key.select(F.explode(f"{p}rows").alias(f"{p}row"), f"{p}fit").select(f"{p}row.*", f"{p}fit.*")


def e_step(rows: DataFrame, mu: Column | str = "mu", kappa: Column | str = "kappa", pi: Column | str = "pi") -> DataFrame:
    """``rows`` (alt, depth and parameters) with log_norm and resp: log-likelihood and posteriors of each row. Plain columns."""
    p = unused_prefix(rows)
    laws = {f"{p}j{k}": (m, c) for k, (m, c) in enumerate(zip(sp.three(mu), sp.three(kappa), strict=True))}
    names = [f"{p}w{k}" for k in range(3)]
    rows = sp.with_logpmf(rows, laws).withColumns({n: F.ln(w + sp.PI_FLOOR) + F.col(j) for n, j, w in zip(names, laws, sp.three(pi), strict=True)})
    # Scalars and stages instead of array functions: a lambda would compute the sum anew for each element.
    w, top, lse = [F.col(n) for n in names], F.col(f"{p}top"), F.col(f"{p}lse")
    rows = rows.withColumn(f"{p}top", F.greatest(*w))
    rows = rows.withColumn(f"{p}lse", top + F.ln(F.exp(w[0] - top) + F.exp(w[1] - top) + F.exp(w[2] - top)))
    rows = sp.staged(rows, log_norm=lse, resp=F.array(*[F.exp(x - lse) for x in w]))
    return rows.drop(*laws, *names, f"{p}top", f"{p}lse")


def posteriors(variants: DataFrame, fits: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``variants`` with resp, the posterior of each component under its key's fit.

    Rows are scored where they are, which saves joining them with scored counts; where only sums are wanted, hand in
    ``weighted_counts`` of the rows, which are few, and weight the sums. The fits are one row a key, and Spark broadcasts them when they are small. Filters on resp or on what is derived from it
    read the computed value. Columns resp and log_norm of ``variants`` are replaced and dropped.
    """
    require(variants, (*keys, "alt", "depth"), "posteriors")
    require(fits, (*keys, "mu", "kappa", "pi"), "posteriors under a fit (see fit_mixture)")
    p = unused_prefix(variants)
    parameters = fits.select(*keys, *[F.col(c).alias(f"{p}{c}") for c in ("mu", "kappa", "pi")])
    scored = e_step(join_on(variants, parameters, keys, "inner"), f"{p}mu", f"{p}kappa", f"{p}pi")
    return scored.drop(f"{p}mu", f"{p}kappa", f"{p}pi", "log_norm")


def predict(variants: DataFrame, fits: DataFrame, keys: tuple[str, ...] = KEYS, threshold: float = 0.0) -> DataFrame:
    """``variants`` with resp and label: the likeliest component, or -1 where its posterior is below the threshold (0 turns that off)."""
    return posteriors(variants, fits, keys).withColumn("label", sp.label("resp", threshold))


def assignments(variants: DataFrame, fits: DataFrame, keys: tuple[str, ...] = KEYS, threshold: float = 0.5) -> DataFrame:
    """Labels of the training variants; uncertain below 0.5."""
    return predict(variants, fits, keys, threshold)


def component_rows(scored: DataFrame, component: int) -> DataFrame:
    """Scored rows whose likeliest component is ``component``, however uncertain."""
    require(scored, ("resp",), "component_rows of scored variants (see predict)")
    return scored.where(sp.argmax("resp") == component)


def component_summary(scored: DataFrame, fits: DataFrame, keys: tuple[str, ...] = KEYS, weight: str | None = None) -> DataFrame:
    """Three rows a key: component, mu, kappa, pi, n_assigned, mean_responsibility. ``weight`` names the number of rows where counts were scored."""
    require(scored, (*keys, "resp", *([weight] if weight else [])), "component_summary of scored variants (see predict)")
    require(fits, (*keys, "mu", "kappa", "pi"), "component_summary under a fit (see fit_mixture)")
    p = unused_prefix(scored)
    own, w, resp = F.col(f"{p}k"), F.col(weight) if weight else F.lit(1), sp.three("resp")
    counted = scored.withColumn(f"{p}k", sp.argmax("resp")).groupBy(*keys).agg(
        *[F.coalesce(F.sum(F.when(own == k, w)), F.lit(0)).alias(f"n{k}") for k in range(3)],
        *[(F.sum(w * r) / F.sum(F.when(r.isNotNull(), w))).alias(f"r{k}") for k, r in enumerate(resp)],
    )
    joined = join_on(fits.select(*keys, "mu", "kappa", "pi"), counted, keys)
    rows = F.array(*[F.struct(F.lit(sp.COMPONENTS[k]).alias("component"), *[F.get(c, F.lit(k)).alias(c) for c in ("mu", "kappa", "pi")], F.coalesce(f"n{k}", F.lit(0)).alias("n_assigned"), F.col(f"r{k}").alias("mean_responsibility")) for k in range(3)])
    return joined.select(*keys, F.explode(rows).alias("c")).select(*keys, "c.*")


def fit_arms(germline: DataFrame, somatic: DataFrame, keys: tuple[str, ...] = KEYS, tumor_purity: float = 1.0, min_germline_het: int = 5, germline_spec=None, spec: SomaticMixtureSpec | None = None, options: FitOptions | None = None) -> DataFrame:
    """The whole pipeline for all keys at once: germline fit, prior, mixture; one row for each key that has any variant.

    ``germline_fit`` is a struct, null where the key has fewer het variants than ``min_germline_het``.
    """
    fits = fit_germline(germline, keys, germline_spec).where(F.col("n_het") >= min_germline_het)
    every = germline.select(*keys).union(somatic.select(*keys)).distinct()
    prior = priors(every, fits, keys, tumor_purity, min_germline_het, spec, fit_col="germline_fit")
    found = fit_mixture(somatic, prior, keys, spec, options).select(*keys, *PRIOR, *FIT, "germline_fit")
    return found.withColumnsRenamed({"confidence": "prior_confidence", "source": "prior_source"})
