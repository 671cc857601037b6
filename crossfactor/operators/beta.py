"""Recursively updated market beta.

Market returns, bootstrap betas, members, weights and base exposures are relational and parallel. Only
the clipped recursion couples dates: it is a prepared model of the ordered scan, which reads betas before a date's
fit and updates them after it. It holds two numbers a ticker, so its memory follows the tickers and not the history.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from crossfactor.functions.columns import by_date, finite, previous_session
from crossfactor.operators.calendar import with_ordinals
from crossfactor.operators.factors import FactorModel, check_names
from crossfactor.operators.kernel import Fit, usable
from crossfactor.operators.scan import Day, OrderedModel, Slots
from crossfactor.operators.universe import sent_if_small


def market_returns(panel: DataFrame, index: DataFrame | None = None, cap: str = "lagged_cap") -> DataFrame:
    """(date, market_return): returns weighted by lagged caps, of rows in ``index`` if given."""
    rows = panel if index is None else panel.join(index.select("date", "ticker"), ["date", "ticker"], "left_semi")
    w, r = F.col(cap), F.col("return")
    rows = rows.where(finite(w) & (w > 0) & finite(r))
    return rows.groupBy("date").agg((F.sum(w * r) / F.sum(w)).alias("market_return"))


def market_return_over(window: WindowSpec, cap: str = "lagged_cap") -> Column:
    """The same as a column over a window of the index's rows."""
    w, r = F.col(cap), F.col("return")
    used = F.when(finite(w) & (w > 0) & finite(r), w)
    return F.try_divide(F.sum(used * r).over(window), F.sum(used).over(window))


@dataclass(frozen=True)
class RecursiveBeta(OrderedModel):
    """Adds the factor ``name`` after those of ``base``."""

    base: FactorModel
    lookback_days: int
    min_periods: int
    decay: float
    name: str = "MKT"
    initial_beta: float = 1.0
    prior_variance: float = 1e-4
    lower: float = -5.0
    upper: float = 5.0

    def __post_init__(self) -> None:
        if not 0 < self.decay < 1:
            raise ValueError("decay must be in (0, 1)")
        if not 0 < self.min_periods <= self.lookback_days:
            raise ValueError("min_periods must be within the lookback")
        if self.prior_variance <= 0 or self.lower >= self.upper:
            raise ValueError("prior_variance must be positive and the bounds in order")
        check_names(self.names)

    @property
    def own(self) -> tuple[str, ...]:
        return (self.name,)

    @property
    def inputs(self) -> tuple[str, ...]:
        return ("market_return", "initial_beta")

    @property
    def history_business_days(self) -> int:
        return max(self.base.history_business_days, self.lookback_days)

    def bootstrap(self, panel: DataFrame, universe: DataFrame) -> DataFrame:
        """(ticker, initial_beta) of tickers with enough history before the first universe date.

        The proxy weights the first date's members alone, lagged on the calendar of their own rows.
        """
        # The start is one value, so that reading the panel filters by it. Null, of an empty universe, has nothing before it.
        found = universe.where("in_universe and date is not null").groupBy("date").count().orderBy("date").first()
        start, count = F.lit(found and found["date"]).cast("date"), found["count"] if found else 0
        first = sent_if_small(universe.where(F.col("in_universe") & (F.col("date") == start)).select("ticker"), count)
        # Lags look back: so the rows before the start are taken first, and only they move.
        before = panel.drop("lagged_cap").where(F.col("date") < start)
        lagged = previous_session(F.col("market_cap"))
        members = with_ordinals(before.drop("k").join(first, "ticker", "left_semi"))
        proxy = market_returns(members.withColumn("lagged_cap", lagged))
        # One row a session on the right side: the calendar's bound.
        history = before.withColumn("lagged_cap", lagged).join(F.broadcast(proxy), "date")
        w, r = F.col("lagged_cap"), F.col("return")
        recent = Window.partitionBy("ticker").orderBy(F.desc("k"))
        history = history.where(finite(w) & (w > 0) & finite(r)).withColumn("__back", F.row_number().over(recent)).where(F.col("__back") <= self.lookback_days)
        beta = history.groupBy("ticker").agg(F.count("*").alias("__n"), F.var_pop("market_return").alias("__v"), F.covar_pop("return", "market_return").alias("__c"))
        beta = beta.where((F.col("__n") >= self.min_periods) & (F.col("__v") > 0))
        clipped = F.least(F.greatest(F.col("__c") / F.col("__v"), F.lit(self.lower)), F.lit(self.upper))
        return beta.select("ticker", clipped.alias("initial_beta"))

    def with_inputs(self, members: DataFrame, panel: DataFrame, universe: DataFrame) -> DataFrame:
        """The members' market return, a window over their own rows, and the bootstrap, one row a ticker of the first snapshot's history."""
        return members.withColumn("market_return", market_return_over(by_date())).join(self.bootstrap(panel, universe), "ticker", "left")

    def prepare(self) -> PreparedBeta:
        return PreparedBeta(self)


class PreparedBeta:
    """The betas of a scan: read before a date's fit, moved after it."""

    def __init__(self, model: RecursiveBeta) -> None:
        self.model, self.slots, self.betas, self.fitted = model, Slots(), BetaState(model, np.zeros(0)), False

    def exposures(self, day: Day) -> dict[str, np.ndarray]:
        self.at, fresh = self.slots.of(day.tickers)
        given = day["initial_beta"][fresh]
        self.betas.add(np.where(np.isnan(given), self.model.initial_beta, given))
        self.beta = self.betas.read(self.at)
        return {self.model.name: self.beta}

    def update(self, day: Day, fit: Fit | None) -> None:
        if fit is not None:
            self.fitted = True
            self.betas.update(self.at, day.returns, day["market_return"][0], fit.coefficients[0], fit.centers[fit.names.index(self.model.name)])
            return
        base = self.model.base.names
        enough = usable(day.returns, np.column_stack([day[n] for n in base]), day.weights).sum() > 2 + len(base)
        if not self.fitted and enough and np.ptp(self.beta) == 0:
            raise ValueError(f"all {self.model.name} exposures are equal before the first fit: no ticker passed the bootstrap; lower min_periods or give more history")

    def state(self, tickers: Sequence[str]) -> np.ndarray:
        at, _ = self.slots.of(tickers)
        return np.column_stack((self.betas.numerators[at], self.betas.denominators[at]))

    def restore(self, tickers: Sequence[str], rows: np.ndarray) -> None:
        at, fresh = self.slots.of(tickers)
        self.betas.add(np.zeros(int(fresh.sum())))
        self.betas.numerators[at], self.betas.denominators[at] = rows.T


class BetaState:
    """Numerators and denominators by ticker slot."""

    def __init__(self, model: RecursiveBeta, betas: np.ndarray) -> None:
        self.model = model
        self.numerators = self.denominators = np.zeros(0)
        self.add(betas)

    def add(self, betas: np.ndarray) -> None:
        """Slots for more tickers, at these betas."""
        if len(betas):
            self.numerators = np.append(self.numerators, betas * self.model.prior_variance)
            self.denominators = np.append(self.denominators, np.full(len(betas), self.model.prior_variance))

    def read(self, slots: np.ndarray) -> np.ndarray:
        return self.numerators[slots] / self.denominators[slots]

    def update(self, slots: np.ndarray, returns: np.ndarray, market: float, intercept: float, center: float) -> None:
        """Observed returns of all members move their betas; bounded betas are written back."""
        if not np.isfinite([market, intercept, center]).all():
            return
        target = returns - intercept + center * market
        valid = np.isfinite(target)
        at = slots[valid]
        denominator = self.model.decay * self.denominators[at] + market**2
        numerator = self.model.decay * self.numerators[at] + market * target[valid]
        beta = np.clip(numerator / denominator, self.model.lower, self.model.upper)
        self.denominators[at], self.numerators[at] = denominator, beta * denominator
