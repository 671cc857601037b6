"""The cross-sectional fit of one date in NumPy: for the beta scan, live periods and plug-ins."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

#: A direction collapses if its squared weighted length is at most this times the larger of 1 and the factor's own.
COLLAPSE = 100 * np.finfo(float).eps


@dataclass(frozen=True)
class Fit:
    """``coefficients`` lead with the intercept; ``rows`` are the places of the usable rows in the input.

    ``names`` are the factors in the order of the columns, where the residualizer knows them.
    """

    rows: np.ndarray
    basis: np.ndarray
    coefficients: np.ndarray
    centers: np.ndarray
    scales: np.ndarray
    residuals: np.ndarray
    r_squared: float = np.nan
    projection: np.ndarray | None = None
    names: tuple[str, ...] = ()

    @property
    def rank(self) -> int:
        return len(self.coefficients)


def usable(returns: np.ndarray, exposures: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.isfinite(returns) & np.isfinite(weights) & (weights > 0) & np.isfinite(exposures).all(axis=1)


def fit(returns: np.ndarray, exposures: np.ndarray, weights: np.ndarray, winsor: float, scaled: Sequence[bool], sequential: bool = True) -> Fit | None:
    """Winsorize, center, scale, then remove factors in order (or jointly) with weights; None if not estimable."""
    rows = np.flatnonzero(usable(returns, exposures, weights))
    r, x, w = returns[rows], exposures[rows], weights[rows]
    count = x.shape[1]
    if len(rows) <= 1 + count:
        return None
    if winsor > 0:
        low, high = np.quantile(x, [winsor, 1 - winsor], axis=0)
        x = np.clip(x, low, high)
    total = w.sum()
    centers = w @ x / total
    z = x - centers
    spread = np.sqrt(w @ z**2 / total)
    if not (np.isfinite(spread) & (spread > 0)).all():
        return None
    scales = np.where(scaled, spread, 1.0)
    z = z / scales
    weighted = w[:, None] * z
    gram = z.T @ weighted
    lower, pivot = np.eye(count), np.zeros(count)
    for j in range(count):
        pivot[j] = gram[j, j] - (lower[j, :j] ** 2 * pivot[:j]).sum()
        if pivot[j] <= COLLAPSE * max(1.0, gram[j, j]):
            return None
        for k in range(j + 1, count):
            lower[k, j] = (gram[k, j] - (lower[k, :j] * lower[j, :j] * pivot[:j]).sum()) / pivot[j]
    basis = np.linalg.solve(lower, z.T).T
    if not sequential:
        basis = z
    # Coefficients are linear in the returns: rows of the projection.
    ones = w / total
    inner = np.linalg.solve(gram, weighted.T) if not sequential else (w[:, None] * basis).T / pivot[:, None]
    inner = inner - inner.sum(axis=1)[:, None] * ones  # the intercept is removed first
    projection = np.vstack([ones, inner])
    coefficients = projection @ r
    residuals = r - coefficients[0] - basis @ coefficients[1:]
    spread_of_returns = w @ (r - coefficients[0]) ** 2
    r_squared = 1 - (w @ residuals**2) / spread_of_returns if spread_of_returns > 0 else np.nan
    return Fit(rows, basis, coefficients, centers, scales, residuals, float(r_squared), projection)
