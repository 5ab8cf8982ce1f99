"""NumPy kernels for grouped functions: log-gamma and its derivatives, Beta-Binomial likelihoods from marginal counts, bounded searches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from varfold.functions.special import _DIGAMMA, _HALF_LOG_TAU, _SHIFT, _STIRLING, MU_EDGE, PI_FLOOR, SHAPE_FLOOR

_RISE = np.arange(_SHIFT, dtype=float)[:, None]
_GOLD = (3 - 5**0.5) / 2
#: Pairs whose posteriors are held at a time.
CHUNK = 1 << 16
#: By how much of its size a sum of weighted log-probabilities is rounded, at most.
ROUNDING = 1e-12


def lgamma(x: np.ndarray | float) -> np.ndarray:
    """The same series as the Column form."""
    x = np.asarray(x, float)
    z = x + _SHIFT
    r = 1 / z
    series = np.polynomial.polynomial.polyval(r * r, _STIRLING) * r
    rising = np.log((x.reshape(1, -1) + _RISE).prod(0)).reshape(x.shape)
    return (z - 0.5) * np.log(z) - z + _HALF_LOG_TAU + series - rising


def polygammas(x: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """Digamma and trigamma of positive numbers: their series at x + 8, and the terms of the shift."""
    x = np.asarray(x, float)
    z = x + _SHIFT
    r = 1 / z
    terms = 1 / (x.reshape(1, -1) + _RISE)
    square = r * r
    first = np.log(z) - r / 2 - np.polynomial.polynomial.polyval(square, _DIGAMMA) * square
    slopes = np.polynomial.polynomial.polyval(square, [2 * (i + 1) * c for i, c in enumerate(_DIGAMMA)]) * square * r
    second = r + square / 2 + slopes
    return first - terms.sum(0).reshape(x.shape), second + (terms * terms).sum(0).reshape(x.shape)


def shapes(mu: float, kappa: float) -> tuple[float, float]:
    m = min(max(mu, MU_EDGE), 1 - MU_EDGE)
    return m * kappa, (1 - m) * kappa


def beta_binom_logpmf(k, n, alpha, beta) -> np.ndarray:
    """Log-probability of k of n; shapes are at least 1e-9."""
    k, n = np.asarray(k, float), np.asarray(n, float)
    a, b = np.maximum(alpha, SHAPE_FLOOR), np.maximum(beta, SHAPE_FLOOR)
    choose = lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
    return choose + lgamma(k + a) + lgamma(n - k + b) - lgamma(n + a + b) + lgamma(a + b) - lgamma(a) - lgamma(b)


class Objective:
    """sum of weight * log-probability as a function of (mu, kappa), without the constant ln C part, from weights by axis."""

    def __init__(self, folded: np.ndarray, points: np.ndarray, part: np.ndarray, mass: float) -> None:
        used = folded != 0
        self._folded, self._points, self._part, self._mass = folded[used], points[used], part[used], mass

    def __call__(self, mu: float, kappa: float) -> float:
        a, b = (max(v, SHAPE_FLOOR) for v in shapes(mu, kappa))
        own = lgamma(np.concatenate((self._points + np.array([a, b, a + b])[self._part], [a, b, a + b])))
        return float(self._folded @ own[:-3] + self._mass * (own[-1] - own[-2] - own[-3]))

    def slopes(self, mu: float, kappa: float) -> tuple[float, float, float, float]:
        """First and second derivative by mu, and by ln kappa."""
        a, b = (max(v, SHAPE_FLOOR) for v in shapes(mu, kappa))
        psi, psi1 = polygammas(np.concatenate((self._points + np.array([a, b, a + b])[self._part], [a, b, a + b])))
        ends = self._mass * np.array([-1.0, -1.0, 1.0])
        one = np.bincount(self._part, self._folded * psi[:-3], 3) + ends * psi[-3:]
        two = np.bincount(self._part, self._folded * psi1[:-3], 3) + ends * psi1[-3:]
        m = a / (a + b)
        by_kappa = m * one[0] + (1 - m) * one[1] + one[2]
        curve = m * m * two[0] + (1 - m) ** 2 * two[1] + two[2]
        return kappa * float(one[0] - one[1]), kappa * kappa * float(two[0] + two[1]), kappa * float(by_kappa), kappa * kappa * float(curve) + kappa * float(by_kappa)


@dataclass
class Counts:
    """Distinct (alt, depth) pairs of one group with their multiplicities.

    A weighted log-likelihood splits into sums over alt, over depth - alt and over depth alone, so an evaluation
    costs as many log-gammas as these have distinct values, however many pairs or rows there are. Posteriors are made for CHUNK
    pairs at a time and folded into these sums, so a group of many pairs holds little besides the pairs.
    """

    alt: np.ndarray
    depth: np.ndarray
    weight: np.ndarray

    def __post_init__(self) -> None:
        self._axes = []
        for values in (self.alt, self.depth - self.alt, self.depth):
            distinct, place = np.unique(values, return_inverse=True)
            self._axes.append((distinct, place.astype(np.int32)))
        self._points = np.concatenate([d for d, _ in self._axes])
        self._part = np.repeat(np.arange(3), [len(d) for d, _ in self._axes])
        self._sign = np.where(self._part == 2, -1.0, 1.0)
        self.choose = np.concatenate([lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) for n, k in ((self.depth[c], self.alt[c]) for c in self._chunks())] or [np.empty(0)])

    @property
    def total(self) -> float:
        return float(self.weight.sum())

    def _chunks(self) -> list[slice]:
        return [slice(i, i + CHUNK) for i in range(0, len(self.alt), CHUNK)]

    def _fold(self, weight: np.ndarray, of: slice = slice(None)) -> np.ndarray:
        """Weights summed by the distinct values of each axis."""
        return np.concatenate([np.bincount(place[of], weight, len(d)) for d, place in self._axes]) * self._sign

    def objective(self, weight: np.ndarray) -> Objective:
        """(mu, kappa) -> sum of weight * log-probability, without the constant ln C part."""
        return Objective(self._fold(weight), self._points, self._part, float(weight.sum()))

    def _laws(self, mu: float, kappa: float) -> tuple[list[np.ndarray], float]:
        """What the distinct values of each axis add to a log-probability, and what all pairs have."""
        a, b = (max(v, SHAPE_FLOOR) for v in shapes(mu, kappa))
        spread = lgamma(self._points + np.array([a, b, a + b])[self._part]) * self._sign
        ab = lgamma(np.array([a, b, a + b]))
        return np.split(spread, np.cumsum([len(d) for d, _ in self._axes])[:-1]), float(ab[2] - ab[0] - ab[1])

    def _logpmf(self, law: tuple[list[np.ndarray], float], of: slice) -> np.ndarray:
        parts = [s[place[of]] for s, (_, place) in zip(law[0], self._axes, strict=True)]
        return self.choose[of] + parts[0] + parts[1] + parts[2] + law[1]

    def logpmf(self, mu: float, kappa: float) -> np.ndarray:
        return self._logpmf(self._laws(mu, kappa), slice(None))

    def e_step(self, mu: np.ndarray, kappa: np.ndarray, pi: np.ndarray) -> tuple[float, np.ndarray, list[Objective]]:
        """Log-likelihood under a mixture, each component's expected count, and its objective for the pairs weighted by its posteriors."""
        laws = [self._laws(m, c) for m, c in zip(mu, kappa, strict=True)]
        loglik, mass, folded = 0.0, np.zeros(len(laws)), [np.zeros(len(self._points)) for _ in laws]
        for of in self._chunks():
            joint = np.stack([np.log(p + PI_FLOOR) + self._logpmf(law, of) for p, law in zip(pi, laws, strict=True)], 1)
            top = joint.max(1, keepdims=True)
            lse = top[:, 0] + np.log(np.exp(joint - top).sum(1))
            own = np.exp(joint - lse[:, None]) * self.weight[of, None]
            loglik += float(self.weight[of] @ lse)
            mass += own.sum(0)
            for k in range(len(laws)):
                folded[k] += self._fold(own[:, k], of)
        return loglik, mass, [Objective(f, self._points, self._part, float(m)) for f, m in zip(folded, mass, strict=True)]


def maximise(f: Callable[[float], float], low: float, high: float, tolerance: float = 1e-5, rounds: int = 200) -> float:
    """The place of a maximum of f in (low, high): golden sections, and a parabola through the best three points where it helps."""
    best = low + _GOLD * (high - low)
    points = [(f(best), best)] * 3  # best, second, third
    step = before = 0.0
    for _ in range(rounds):
        best, middle = points[0][1], 0.5 * (low + high)
        slack = tolerance / 3 + 1.5e-8 * abs(best)
        if abs(best - middle) <= 2 * slack - 0.5 * (high - low):
            break
        trial = None
        if abs(before) > slack:
            (f0, x0), (f1, x1), (f2, x2) = points
            u, v = (x0 - x1) * (f0 - f2), (x0 - x2) * (f0 - f1)
            if v != u:
                move = 0.5 * ((x0 - x2) * v - (x0 - x1) * u) / (u - v)
                if abs(move) < abs(0.5 * before) and low < x0 + move < high:
                    trial = move
                    if min(x0 + move - low, high - x0 - move) < 2 * slack:
                        trial = np.copysign(slack, middle - x0)
        if trial is None:
            before = (high if best < middle else low) - best
            step = _GOLD * before
        else:
            before, step = step, trial
        x = best + (step if abs(step) >= slack else np.copysign(slack, step))
        y = f(x)
        if y >= points[0][0]:
            low, high = (best, high) if x >= best else (low, best)
            points = [(y, x), points[0], points[1]]
        else:
            low, high = (low, x) if x >= best else (x, high)
            if y >= points[1][0] or points[1][1] == best:
                points = [points[0], (y, x), points[1]]
            elif y >= points[2][0] or points[2][1] in (best, points[1][1]):
                points = [points[0], points[1], (y, x)]
    return points[0][1]


def climb(slopes: Callable[[float], tuple[float, float]], start: float, low: float, high: float, tolerance: float = 1e-6, rounds: int = 60) -> float:
    """Where a slope changes from up to down in [low, high]: Newton steps from ``start``, halved brackets where these lead away.

    ``slopes`` gives the first and second derivative. The last step is below ``tolerance``, so what is left is about its square. A bound is returned where the function still rises towards it.
    """
    x, inner, outer = min(max(start, low), high), low, high
    untried = {low, high}
    for _ in range(rounds):
        first, second = slopes(x)
        if first == 0 or (x == high and first > 0) or (x == low and first < 0):
            break
        inner, outer = (x, outer) if first > 0 else (inner, x)
        new = x - first / second if second < 0 else np.copysign(np.inf, first)
        if not inner < new < outer:
            end = outer if first > 0 else inner
            new = end if end in untried else 0.5 * (inner + outer)
            untried.discard(end)
        step, x = abs(new - x), new
        if step <= tolerance * max(1.0, abs(x)):
            break
    return float(x)


def better(f: Callable[[float], float], slopes: Callable[[float], tuple[float, float]], start: float, low: float, high: float) -> float:
    """A maximum of f: by ``climb`` from ``start``, or by ``maximise`` where that doesn't lead up.

    Values are compared up to their rounding: at the maximum of a sum over millions of rows, ``climb`` would else be taken to have
    failed by it, and the coarser search would lead away again from where it had settled.
    """
    found, before = climb(slopes, start, low, high), f(start)
    return found if f(found) >= before - ROUNDING * abs(before) else maximise(f, low, high)


def fit_beta_binomial_mle(counts: Counts, mu_bounds: tuple[float, float] = (0.01, 0.99), kappa_bounds: tuple[float, float] = (1.0, 1000.0)) -> tuple[float, float, float]:
    """Mean, precision and log-likelihood of the likeliest Beta-Binomial law inside the box; (0.5, 50, 0) without data.

    Mean and log-precision are nearly orthogonal, so Newton steps over one and then the other settle within a few turns.
    It starts from the moments and from a coarse grid, whichever is better.
    """
    if not len(counts.alt):
        return 0.5, 50.0, 0.0
    f = counts.objective(counts.weight)
    fraction = counts.alt / (counts.depth + 1e-9)
    mean = float(np.average(fraction, weights=counts.weight))
    spread = float(np.average((fraction - mean) ** 2, weights=counts.weight))
    mu = min(max(mean, mu_bounds[0] + 0.01), mu_bounds[1] - 0.01)
    moments = mu * (1 - mu) / spread - 1 if 0 < spread < mu * (1 - mu) else 50.0
    log_low, log_high = np.log(kappa_bounds[0]), np.log(kappa_bounds[1])
    starts = [float(np.log(min(max(moments, kappa_bounds[0]), kappa_bounds[1]))), *np.linspace(log_low, log_high, 7)]
    log_kappa = max(starts, key=lambda t: f(mu, float(np.exp(t))))
    value = f(mu, float(np.exp(log_kappa)))
    for _ in range(40):
        mu_new = better(lambda m, t=log_kappa: f(m, float(np.exp(t))), lambda m, t=log_kappa: f.slopes(m, float(np.exp(t)))[:2], mu, *mu_bounds)
        log_new = better(lambda t, m=mu_new: f(m, float(np.exp(t))), lambda t, m=mu_new: f.slopes(m, float(np.exp(t)))[2:], log_kappa, log_low, log_high)
        new = f(mu_new, float(np.exp(log_new)))
        if new > value:
            mu, log_kappa = mu_new, log_new
        gain, value = new - value, max(new, value)
        if gain < 1e-10 * max(1.0, abs(value)):
            break
    return mu, float(np.exp(log_kappa)), value + float(counts.weight @ counts.choose)
