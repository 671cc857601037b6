"""Fits of a period that follow single returns: which numbers they keep, and how one row moves them.

``Projected`` serves every residualizer whose fits know their projection: a changed return of a row in the fit moves the
coefficients by one column of it, and a row that enters or leaves asks for a new fit. ``Moments`` serves the built-in
fits without winsorizing: weighted moments of the rows take a row in, out or over by a rank-one step, and a matrix of the
factors' size is factorized again; no other row is looked at.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Protocol

import numpy as np

from crossfactor.operators.fit import OwnFit, Residualizer
from crossfactor.operators.kernel import COLLAPSE, Fit


@dataclass(frozen=True)
class Row:
    """A member's exposures and weight, its return before and after, and its column of the last fit's projection, if it was in it."""

    exposures: np.ndarray
    weight: float
    before: float
    after: float
    projection: np.ndarray | None


class Incremental(Protocol):
    """``start`` gives the numbers of a period without returns; ``step`` moves them, or asks for a new fit by None."""

    residualizer: OwnFit

    def start(self, exposures: np.ndarray, weights: np.ndarray) -> np.ndarray: ...

    def step(self, held: np.ndarray, row: Row) -> np.ndarray | None: ...

    def refit(self, fit: Fit | None) -> np.ndarray:
        """The numbers after a new fit."""
        ...

    def current(self, held: np.ndarray, last: Fit | None, returns: np.ndarray, exposures: np.ndarray, weights: np.ndarray) -> Fit | None:
        """The fit of all rows as the numbers have it; ``last`` is the last new fit."""
        ...


def scored(fit: Fit, returns: np.ndarray, weights: np.ndarray) -> Fit:
    """The fit with residuals and R² of its coefficients."""
    r, w = returns[fit.rows], weights[fit.rows]
    residuals = r - fit.coefficients[0] - fit.basis @ fit.coefficients[1:]
    spread = w @ (r - fit.coefficients[0]) ** 2
    return replace(fit, residuals=residuals, r_squared=float(1 - (w @ residuals**2) / spread) if spread > 0 else np.nan)


@dataclass(frozen=True)
class Projected:
    """The coefficients are kept."""

    residualizer: OwnFit

    def start(self, exposures: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return np.zeros(0)

    def step(self, held: np.ndarray, row: Row) -> np.ndarray | None:
        if row.projection is None or not len(held) or not np.isfinite([row.before, row.after]).all():
            return None
        return held + row.projection * (row.after - row.before)

    def refit(self, fit: Fit | None) -> np.ndarray:
        return np.zeros(0) if fit is None else fit.coefficients

    def current(self, held: np.ndarray, last: Fit | None, returns: np.ndarray, exposures: np.ndarray, weights: np.ndarray) -> Fit | None:
        return None if last is None or not len(held) else scored(replace(last, coefficients=held), returns, weights)


@dataclass(frozen=True)
class Moments:
    """Weighted moments of (1, exposures less a reference, return) are kept; the reference is the members' mean, so that little cancels."""

    residualizer: Residualizer

    def __post_init__(self) -> None:
        if self.residualizer.winsor_quantile or self.residualizer.uniform:
            raise ValueError("moments follow fits without winsorized or checked rows only")

    def start(self, exposures: np.ndarray, weights: np.ndarray) -> np.ndarray:
        finite = np.isfinite(exposures).all(axis=1) & np.isfinite(weights) & (weights > 0)
        count = exposures.shape[1]
        reference = exposures[finite].mean(axis=0) if finite.any() else np.zeros(count)
        return np.concatenate((reference, [0.0], np.zeros((count + 1) * (count + 2))))

    def step(self, held: np.ndarray, row: Row) -> np.ndarray:
        count = len(row.exposures)
        usable = np.isfinite(row.exposures).all() and np.isfinite(row.weight) and row.weight > 0
        if not usable:
            return held
        out = held.copy()
        left = np.append(1.0, row.exposures - out[:count])
        for value, sign in ((row.before, -1), (row.after, 1)):
            if np.isfinite(value):
                out[count] += sign
                out[count + 1 :] += sign * row.weight * np.outer(left, np.append(left, value)).ravel()
        return out

    def refit(self, fit: Fit | None) -> np.ndarray:
        raise NotImplementedError("moments need no new fit")

    def current(self, held: np.ndarray, last: Fit | None, returns: np.ndarray, exposures: np.ndarray, weights: np.ndarray) -> Fit | None:
        count = exposures.shape[1]
        reference, number, table = held[:count], held[count], held[count + 1 :].reshape(count + 1, count + 2)
        if number <= 1 + count:
            return None
        total = table[0, 0]
        mean = table[0, 1:-1] / total
        centered = table[1:, 1:-1] - total * np.outer(mean, mean)
        spread = np.sqrt(np.maximum(np.diag(centered), 0) / total)
        if not (np.isfinite(spread) & (spread > 0)).all():
            return None
        scales = np.where(self.residualizer.scaled, spread, 1.0)
        gram = centered / np.outer(scales, scales)
        moment = (table[1:, -1] - mean * table[0, -1]) / scales
        lower, pivot = np.eye(count), np.zeros(count)
        for j in range(count):
            pivot[j] = gram[j, j] - (lower[j, :j] ** 2 * pivot[:j]).sum()
            if pivot[j] <= COLLAPSE * max(1.0, gram[j, j]):
                return None
            for k in range(j + 1, count):
                lower[k, j] = (gram[k, j] - (lower[k, :j] * lower[j, :j] * pivot[:j]).sum()) / pivot[j]
        removed = np.linalg.solve(lower, moment) / pivot
        centers = mean + reference
        rows = np.flatnonzero(np.isfinite(returns) & np.isfinite(weights) & (weights > 0) & np.isfinite(exposures).all(axis=1))
        z = (exposures[rows] - centers) / scales
        basis = np.linalg.solve(lower, z.T).T if self.residualizer.sequential else z
        taken = removed if self.residualizer.sequential else np.linalg.solve(lower.T, removed)
        fit = Fit(rows, basis, np.append(table[0, -1] / total, taken), centers, scales, np.zeros(0), names=self.residualizer.factor_order)
        return scored(fit, returns, weights)


def incremental(residualizer: OwnFit) -> Incremental:
    """Moments where they serve, else the projection."""
    plain = isinstance(residualizer, Residualizer) and not residualizer.winsor_quantile and not residualizer.uniform
    return Moments(residualizer) if plain else Projected(residualizer)
