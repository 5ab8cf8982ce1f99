"""How far mixture fits are from an optimum: the objective at points around each fit, its slopes, and the weights' equation.

The objective of a fit is the log-likelihood of its variants under the mixture and the log-priors of weights, means and precisions.
Everything is a plain expression over counts, so it holds fits against what they claim without running them again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varfold.functions import special as sp
from varfold.functions.names import require
from varfold.operators.germline import KEYS
from varfold.operators.keys import join_on
from varfold.operators.mixture import NEEDED, e_step
from varfold.operators.specs import SomaticMixtureSpec
from varfold.operators.variants import histogram

#: Steps of a mean, and factors of a precision, at which the objective is looked at around a fit.
MU_STEP, KAPPA_FACTOR = 0.002, 1.05
#: The fit itself and twelve points, each with one parameter moved: (component, step of its mean, factor of its precision).
POINTS = ((0, 0.0, 1.0), *((k, d, f) for k in range(3) for d, f in ((-MU_STEP, 1.0), (MU_STEP, 1.0), (0.0, 1 / KAPPA_FACTOR), (0.0, KAPPA_FACTOR))))
#: Least gain of the objective, and least gap of a weight, that show that a fit is no optimum.
GAIN, GAP = 1e-3, 1e-4


def log_prior(mu: list[Column], kappa: list[Column], prior: str = "") -> Column:
    """Log-density of the means (normal) and precisions (log-normal) up to a constant; ``prior`` is put before the prior's column names."""
    mean, sigma, kappa0 = (sp.three(f"{prior}{c}") for c in ("mu_prior_mean", "mu_prior_sigma", "kappa_prior_mean"))
    spread = F.col(f"{prior}kappa_prior_log_sigma")
    z = [(m - a) / s for m, a, s in zip(mu, mean, sigma, strict=True)] + [F.ln(c / b) / spread for c, b in zip(kappa, kappa0, strict=True)]
    return F.lit(-0.5) * sum((x * x for x in z[1:]), z[0] * z[0])


def slopes(counts: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, mu_slopes and kappa_slopes: derivatives of the objective by each mean and by the logarithm of each precision.

    ``counts`` has the keys, alt, depth, weight, the parameters mu, kappa and pi, and the prior's columns. The derivative of the
    mixture's log-likelihood by a component's parameters is that of the component's own, weighted by posteriors.
    """
    require(counts, (*keys, "alt", "depth", "weight", "mu", "kappa", "pi", *NEEDED), "slopes")
    scored = e_step(counts)
    k, n, w = F.col("alt").cast("double"), F.col("depth").cast("double"), F.col("weight")
    laws = [(*sp.shapes(m, c), c, m) for m, c in zip(sp.three("mu"), sp.three("kappa"), strict=True)]
    args = {f"x{i}{s}": e for i, (a, b, c, _) in enumerate(laws) for s, e in (("a", k + a), ("b", n - k + b), ("s", n + c))}
    staged = sp.staged(scored, **args)
    sums = {f"{name}{i}": F.sum(w * F.get("resp", F.lit(i)) * (sp.digamma(f"x{i}{name}") if name != "r" else 1.0)) for i in range(3) for name in ("a", "b", "s", "r")}
    found = staged.groupBy(*keys, *[c for c in ("mu", "kappa", *NEEDED)]).agg(*[e.alias(c) for c, e in sums.items()])
    by_mu, by_kappa = [], []
    mean, sigma, kappa0 = (sp.three(c) for c in ("mu_prior_mean", "mu_prior_sigma", "kappa_prior_mean"))
    for i, (a, b, c, m) in enumerate(laws):
        mass = F.col(f"r{i}")
        one, two, three = F.col(f"a{i}") - mass * sp.digamma(a), F.col(f"b{i}") - mass * sp.digamma(b), mass * sp.digamma(c) - F.col(f"s{i}")
        by_mu.append(c * (one - two) - (m - mean[i]) / (sigma[i] * sigma[i]))
        by_kappa.append(c * (m * one + (F.lit(1.0) - m) * two + three) - F.ln(c / kappa0[i]) / (F.col("kappa_prior_log_sigma") * F.col("kappa_prior_log_sigma")))
    return found.select(*keys, F.array(*by_mu).alias("mu_slopes"), F.array(*by_kappa).alias("kappa_slopes"))


def optimality(variants: DataFrame, fits: DataFrame, keys: tuple[str, ...] = KEYS, spec: SomaticMixtureSpec | None = None) -> DataFrame:
    """keys, objective, gain, pi_gap and is_optimum of each fit that has variants, ``fits`` being what ``fit_mixture`` or ``fit_arms`` gives.

    ``gain`` is what the best of twelve points around adds to the objective, and ``pi_gap`` how far a weight is from what the
    posteriors give. Where a fit took the prior's values for want of variants, neither says anything about it.
    """
    spec = spec or SomaticMixtureSpec()
    require(fits, (*keys, "mu", "kappa", "pi", *NEEDED), "optimality of a fit (see fit_mixture)")
    points = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), F.lit(d).alias("d"), F.lit(f).alias("f")) for i, (k, d, f) in enumerate(POINTS)])
    moved_mu = F.array(*[sp.clip(m + F.when(F.col("p.k") == k, F.col("p.d")).otherwise(0.0), *spec.bounds_mu[k]) for k, m in enumerate(sp.three("mu"))])
    moved_kappa = F.array(*[sp.clip(c * F.when(F.col("p.k") == k, F.col("p.f")).otherwise(1.0), *spec.bounds_kappa) for k, c in enumerate(sp.three("kappa"))])
    own = fits.select(*keys, "mu", "kappa", "pi", *NEEDED, F.explode(points).alias("p"))
    # The fit itself stays as it is, also where it starts beyond the bounds.
    own = own.withColumns({"at_mu": F.when(F.col("p.i") == 0, F.col("mu")).otherwise(moved_mu), "at_kappa": F.when(F.col("p.i") == 0, F.col("kappa")).otherwise(moved_kappa)})
    own = own.withColumn("prior", log_prior(sp.three("at_mu"), sp.three("at_kappa"))).select(*keys, "p.i", "at_mu", "at_kappa", "pi", "pi_prior", "prior")
    scored = e_step(join_on(histogram(variants, keys), own, keys, "inner"), "at_mu", "at_kappa", "pi")
    sums = scored.groupBy(*keys, "i", "pi", "pi_prior", "prior").agg(
        F.sum(F.col("weight") * F.col("log_norm")).alias("loglik"), *[F.sum(F.col("weight") * F.get("resp", F.lit(k))).alias(f"r{k}") for k in range(3)]
    )
    pi, weight = sp.three("pi"), sp.three("pi_prior")
    of_pi = sum((b * F.ln(a) for a, b in zip(pi[1:], weight[1:], strict=True)), weight[0] * F.ln(pi[0]))
    mass = [F.col(f"r{k}") + weight[k] for k in range(3)]
    total = mass[0] + mass[1] + mass[2]
    valued = sums.select(*keys, "i", (F.col("loglik") + F.col("prior") + of_pi).alias("objective"), F.greatest(*[F.abs(m / total - p) for m, p in zip(mass, pi, strict=True)]).alias("gap"))
    at = F.when(F.col("i") == 0, F.col("objective"))
    out = valued.groupBy(*keys).agg(F.max(at).alias("objective"), F.max(F.when(F.col("i") > 0, F.col("objective"))).alias("best"), F.max(F.when(F.col("i") == 0, F.col("gap"))).alias("pi_gap"))
    gain = F.col("best") - F.col("objective")
    return out.select(*keys, "objective", gain.alias("gain"), "pi_gap", ((gain <= GAIN) & (F.col("pi_gap") <= GAP)).alias("is_optimum"))
