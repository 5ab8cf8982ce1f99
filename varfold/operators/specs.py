"""Settings of the models, with their fixed default values."""

from __future__ import annotations

from dataclasses import dataclass

Three = tuple[float, float, float]


@dataclass(frozen=True)
class GermlineSpec:
    mu_het_expected: float = 0.5
    mu_het_bounds: tuple[float, float] = (0.10, 0.90)
    mu_hom_bounds: tuple[float, float] = (0.85, 0.9999)
    kappa_bounds: tuple[float, float] = (5.0, 1000.0)
    loh_imbalance_threshold: float = 0.10
    min_variants_het: int = 5
    min_variants_hom: int = 3


@dataclass(frozen=True)
class SomaticMixtureSpec:
    bounds_mu: tuple[tuple[float, float], tuple[float, float], tuple[float, float]] = ((0.02, 0.30), (0.25, 0.75), (0.50, 0.99))
    bounds_kappa: tuple[float, float] = (5.0, 500.0)
    mu_default: Three = (0.15, 0.50, 0.85)
    kappa_default: Three = (50.0, 50.0, 50.0)
    pi_prior_default: Three = (2.0, 4.0, 2.0)
    mu_prior_sigma_default: Three = (0.08, 0.12, 0.12)
    kappa_prior_log_sigma_default: float = 0.5


@dataclass(frozen=True)
class FitOptions:
    max_iter: int = 500
    tol: float = 1e-6
    n_restarts: int = 3
    random_state: int = 42

    def __post_init__(self) -> None:
        if self.max_iter < 1 or self.n_restarts < 1:
            raise ValueError("max_iter and n_restarts must be 1 or more")
