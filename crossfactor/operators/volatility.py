"""Residual volatility that follows the fits: a second model of the ordered scan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from crossfactor.operators.factors import FactorModel, check_names
from crossfactor.operators.kernel import Fit
from crossfactor.operators.scan import Day, OrderedModel, Slots


@dataclass(frozen=True)
class ResidualVolatility(OrderedModel):
    """Adds ``name``, the root of an exponential mean of a ticker's squared residuals.

    Until a ticker has been in a fit its exposure is the base factor ``seed``, say a trailing volatility of its returns;
    each fit then moves the mean from the exposure that it read. Tickers without either take no part.
    """

    base: FactorModel
    seed: str
    decay: float
    name: str = "RVOL"

    def __post_init__(self) -> None:
        if not 0 < self.decay < 1:
            raise ValueError("decay must be in (0, 1)")
        if self.seed not in self.base.names:
            raise ValueError(f"the base has no factor {self.seed}")
        check_names(self.names)

    @property
    def own(self) -> tuple[str, ...]:
        return (self.name,)

    def prepare(self) -> PreparedVolatility:
        return PreparedVolatility(self)


class PreparedVolatility:
    """Variances by slot; NaN before a ticker's first fit."""

    def __init__(self, model: ResidualVolatility) -> None:
        self.model, self.slots, self.variances = model, Slots(), np.zeros(0)

    def exposures(self, day: Day) -> dict[str, np.ndarray]:
        self.at, fresh = self.slots.of(day.tickers)
        self.variances = np.append(self.variances, np.full(int(fresh.sum()), np.nan))
        held = np.sqrt(self.variances[self.at])
        self.read = np.where(np.isnan(held), day[self.model.seed], held)
        return {self.model.name: self.read}

    def update(self, day: Day, fit: Fit | None) -> None:
        if fit is not None:
            self.variances[self.at[fit.rows]] = self.model.decay * self.read[fit.rows] ** 2 + (1 - self.model.decay) * fit.residuals**2

    def state(self, tickers: Sequence[str]) -> np.ndarray:
        at, _ = self.slots.of(tickers)
        return self.variances[at][:, None]

    def restore(self, tickers: Sequence[str], rows: np.ndarray) -> None:
        at, fresh = self.slots.of(tickers)
        self.variances = np.append(self.variances, np.full(int(fresh.sum()), np.nan))
        self.variances[at] = rows[:, 0]
