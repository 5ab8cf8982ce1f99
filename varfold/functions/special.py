"""Column builders: log-gamma and the Beta-Binomial law, clipping, and vectors of three components.

Everything here is a plain Spark expression, so it stays inside generated code and can be aggregated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varfold.functions.names import unused_prefix

#: Fixed values of the model.
VAF_EPSILON = 1e-9
SHAPE_FLOOR = 1e-9
MU_EDGE = 1e-6
PI_FLOOR = 1e-10
COMPONENTS = ("subclonal", "clonal", "loh")

_SHIFT = 8
_HALF_LOG_TAU = 0.9189385332046727
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
#: Of x**-2, x**-4, ... in the series of digamma: the slopes of the terms above.
_DIGAMMA = tuple((2 * i + 1) * c for i, c in enumerate(_STIRLING))


def col(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def lgamma(x: Column | str | float) -> Column:
    """Log-gamma of a positive number: Stirling's series at x + 8, less the logarithm of x (x + 1) ... (x + 7)."""
    x = col(x)
    z = x + float(_SHIFT)
    r = F.lit(1.0) / z
    series = reduce(lambda s, c: s * r * r + c, reversed(_STIRLING[:-1]), F.lit(_STIRLING[-1])) * r
    rising = reduce(lambda p, i: p * (x + float(i)), range(1, _SHIFT), x)
    return (z - 0.5) * F.ln(z) - z + _HALF_LOG_TAU + series - F.ln(rising)


def digamma(x: Column | str | float) -> Column:
    """The slope of log-gamma at a positive number: its series at x + 8, less 1 / x + ... + 1 / (x + 7)."""
    x = col(x)
    z = x + float(_SHIFT)
    r = F.lit(1.0) / z
    series = reduce(lambda s, c: s * r * r + c, reversed(_DIGAMMA[:-1]), F.lit(_DIGAMMA[-1])) * r * r
    return F.ln(z) - 0.5 * r - series - reduce(lambda s, i: s + F.lit(1.0) / (x + float(i)), range(1, _SHIFT), F.lit(1.0) / x)


def staged(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with more columns that are computed once a row.

    They are elements of a one-row generator, which the optimiser neither merges with later projections nor lets filters
    pass, so a filter on them reads their values instead of repeating their expressions.
    """
    others = [F.col(f"`{c}`") for c in rows.columns if c not in columns]
    return rows.select(*others, F.inline(F.array(F.struct(*[e.alias(n) for n, e in columns.items()]))))


def ln_beta(a: Column, b: Column) -> Column:
    return lgamma(a) + lgamma(b) - lgamma(a + b)


def ln_choose(n: Column | str, k: Column | str) -> Column:
    n, k = col(n), col(k)
    return lgamma(n + 1.0) - lgamma(k + 1.0) - lgamma(n - k + 1.0)


def clip(x: Column | str | float, low: float, high: float) -> Column:
    """x within [low, high]; null and NaN stay."""
    x = col(x)
    return F.when(F.isnan(x), x).when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def vaf(alt: Column | str, depth: Column | str) -> Column:
    """Allele fraction; the small constant keeps depth 0 defined and moves exact band edges."""
    return col(alt).cast("double") / (col(depth).cast("double") + VAF_EPSILON)


def shapes(mu: Column | str | float, kappa: Column | str | float) -> tuple[Column, Column]:
    """Shape parameters of the Beta law with this mean and precision."""
    m, k = clip(mu, MU_EDGE, 1 - MU_EDGE), col(kappa)
    return m * k, (F.lit(1.0) - m) * k


def beta_binom_logpmf(k: Column | str, n: Column | str, alpha: Column | str | float, beta: Column | str | float) -> Column:
    """Log-probability of k of n under the Beta-Binomial law; shapes are at least 1e-9. Null unless 0 <= k <= n."""
    k, n = col(k).cast("double"), col(n).cast("double")
    a, b = F.greatest(col(alpha), F.lit(SHAPE_FLOOR)), F.greatest(col(beta), F.lit(SHAPE_FLOOR))
    return F.when((k >= 0) & (k <= n), ln_choose(n, k) + ln_beta(k + a, n - k + b) - ln_beta(a, b))


def with_logpmf(rows: DataFrame, laws: dict[str, tuple[Column | str, Column | str]], alt: str = "alt", depth: str = "depth") -> DataFrame:
    """``rows`` with a log-probability column for each law (mean, precision).

    Shapes, then the arguments of the log-gammas, then the log-gammas are columns of stages of their own: as one
    expression they would repeat each other many times over and outgrow generated code.
    """
    k, n, p = F.col(alt).cast("double"), F.col(depth).cast("double"), unused_prefix(rows)
    means = {}
    for i, (m, c) in enumerate(laws.values()):
        means |= {f"{p}m{i}": col(m), f"{p}c{i}": col(c)}
    rows, names = rows.withColumns(means), rows.columns
    shaped = {}
    for i in range(len(laws)):
        a, b = shapes(f"{p}m{i}", f"{p}c{i}")
        shaped |= {f"{p}a{i}": F.greatest(a, F.lit(SHAPE_FLOOR)), f"{p}b{i}": F.greatest(b, F.lit(SHAPE_FLOOR))}
    rows = rows.withColumns(shaped)
    args = {"n": n + 1.0, "k": k + 1.0, "d": n - k + 1.0}
    for i in range(len(laws)):
        a, b = F.col(f"{p}a{i}"), F.col(f"{p}b{i}")
        args |= {f"a{i}": a, f"b{i}": b, f"s{i}": a + b, f"ka{i}": k + a, f"db{i}": n - k + b, f"ns{i}": n + a + b}
    rows = rows.withColumns({f"{p}x{c}": e for c, e in args.items()})
    rows = rows.withColumns({f"{p}g{c}": lgamma(f"{p}x{c}") for c in args})
    g = {c: F.col(f"{p}g{c}") for c in args}
    choose, valid = g["n"] - g["k"] - g["d"], (k >= 0) & (k <= n)
    laws_of = {name: F.when(valid, choose + g[f"ka{i}"] + g[f"db{i}"] - g[f"ns{i}"] + g[f"s{i}"] - g[f"a{i}"] - g[f"b{i}"]) for i, name in enumerate(laws)}
    return rows.select(*[f"`{c}`" for c in names if c not in laws], *[e.alias(c) for c, e in laws_of.items()])


def logsumexp(x: Column | str) -> Column:
    x = col(x)
    top = F.array_max(x)
    return top + F.ln(F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - top)))


def softmax(x: Column | str, lse: Column | str) -> Column:
    total = col(lse)
    return F.transform(col(x), lambda v: F.exp(v - total))


def argmax(x: Column | str) -> Column:
    """Index of the largest element, the first of equals."""
    x = col(x)
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def label(resp: Column | str, threshold: float = 0.0) -> Column:
    """The likeliest component, or -1 if its posterior is below the threshold."""
    return F.when(F.array_max(col(resp)) < threshold, -1).otherwise(argmax(resp)).cast("int")


def component_name(index: Column | str) -> Column:
    """Name of a component index; null beyond the components."""
    return F.get(F.array(*[F.lit(c) for c in COMPONENTS]), col(index))


def three(x: Column | str) -> list[Column]:
    """The elements of an array of three."""
    return [F.get(col(x), F.lit(k)) for k in range(3)]


def literals(values) -> list[Column]:
    return [F.lit(float(v)) for v in values]
