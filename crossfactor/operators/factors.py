"""Characteristic factors as window columns over one sort by ticker and session.

A factor is a name, a function from nothing to a Column, and the business days of history that it
needs. Columns may use ``return``, ``market_cap``, ``k`` and the window of the ticker.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import TYPE_CHECKING, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossfactor.functions.columns import by_ticker, finite, previous_session
from crossfactor.operators.calendar import with_ordinals

if TYPE_CHECKING:
    from crossfactor.operators.fit import Fitted, OwnFit

#: Names that factors may not take, in any case.
RESERVED = {"date", "ticker", "return", "return_percent", "market_cap", "regression_weight", "specific_return", "intercept", "k", "in_universe", "member_rank"}


#: Rows of a dense table unless one asks for more: a century of sessions of 400,000 names.
DENSE = 10_000_000_000


@dataclass(frozen=True)
class Factor:
    name: str
    build: Callable[[], Column]
    history_business_days: int = 0

    def __post_init__(self) -> None:
        if not self.name or self.name.lower() in RESERVED or self.name.startswith("__"):
            raise ValueError(f"bad factor name {self.name!r}")
        if self.history_business_days < 0:
            raise ValueError("history must not be negative")


@dataclass(frozen=True)
class PythonFactor(Factor):
    """A factor in the user's Python: from a ticker's session ordinals, returns and caps, in order, to its exposures; NaN for none."""

    build: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


class FactorModel(Protocol):
    """Names, needed history, and exposures on the rows of a panel with ``return`` and ``k``.

    ``history_sessions`` says how many sessions before a row's own its exposures read: rows further back may be left out.
    Of members' rows with those exposures and weights, ``sections`` gives all factors and ``fit`` the fits; factors that need
    the fits before are theirs to make, from the columns of ``with_inputs``. ``passes`` says how often a fit reads the rows.
    """

    names: tuple[str, ...]
    history_business_days: int
    history_sessions: int
    passes: int

    def exposures(self, panel: DataFrame) -> DataFrame: ...

    def with_inputs(self, members: DataFrame, panel: DataFrame, universe: DataFrame) -> DataFrame: ...

    def sections(self, rows: DataFrame, residualizer: OwnFit) -> DataFrame: ...

    def fit(self, rows: DataFrame, residualizer: OwnFit) -> Fitted: ...


def check_names(names: Sequence[str]) -> None:
    if len({n.lower() for n in names}) != len(names):
        raise ValueError("factor names must differ, also by more than case")


def in_python(factors: Sequence[PythonFactor]) -> Callable[[pa.Table], pa.Table]:
    """A ticker's rows, sorted by session, with the factors' exposures."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("k")
        given = [rows[c].to_numpy() for c in ("k", "return", "market_cap")]
        for f in factors:
            rows = rows.append_column(f.name, pa.array(np.asarray(f.build(*given), float), from_pandas=True))
        return rows

    return run


@dataclass(frozen=True)
class CharacteristicModel:
    """Several factors in one pass: all windows share the sort by ticker. Those in Python take a ticker's rows at a time, all in one pass."""

    factors: tuple[Factor, ...]

    def __post_init__(self) -> None:
        if not self.factors:
            raise ValueError("at least one factor is needed")
        check_names(self.names)

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(f.name for f in self.factors)

    @property
    def history_business_days(self) -> int:
        return max(f.history_business_days for f in self.factors)

    @property
    def history_sessions(self) -> int:
        return self.history_business_days

    def exposures(self, panel: DataFrame) -> DataFrame:
        columns = [f for f in self.factors if not isinstance(f, PythonFactor)]
        out = panel.select("*", *(f.build().alias(f.name) for f in columns))
        if len(columns) == len(self.factors):
            return out
        own = [f for f in self.factors if isinstance(f, PythonFactor)]
        schema = T.StructType([*out.schema.fields, *(T.StructField(f.name, T.DoubleType()) for f in own)])
        return out.groupBy("ticker").applyInArrow(in_python(own), schema).select(*panel.columns, *self.names)

    @property
    def passes(self) -> int:
        return 3

    def with_inputs(self, members: DataFrame, panel: DataFrame, universe: DataFrame) -> DataFrame:
        return members

    def sections(self, rows: DataFrame, residualizer: OwnFit) -> DataFrame:
        return rows.select("date", "ticker", "return", "regression_weight", *self.names)

    def fit(self, rows: DataFrame, residualizer: OwnFit) -> Fitted:
        return residualizer.fit(rows)

    def dense(self, panel: DataFrame, largest: int = DENSE) -> DataFrame:
        """Exposures on every session of every ticker, the public table; fits need observed rows only.

        The grid has a row for each pair; more than ``largest`` raise before any is made.
        """
        own = panel if "k" in panel.columns else with_ordinals(panel)
        sizes = own.agg(F.count_distinct("date").alias("dates"), F.count_distinct("ticker").alias("tickers")).first()
        if sizes.dates * sizes.tickers > largest:
            raise ValueError(f"a dense table of {sizes.dates:,} sessions and {sizes.tickers:,} tickers has more than {largest:,} rows")
        grid = own.select("date", "k").distinct().crossJoin(own.select("ticker").distinct())
        return self.exposures(grid.join(own.drop("k"), ["date", "ticker"], "left")).select("date", "ticker", *self.names)


def size_factor(name: str = "SIZE") -> Factor:
    """The log of the previous session's market cap, where positive."""

    def build() -> Column:
        lagged = previous_session(F.col("market_cap"))
        return F.when(lagged > 0, F.log(lagged))

    return Factor(name, build, 1)


def momentum_factor(lookback_days: int, skip_days: int, min_periods: int, name: str = "MOM") -> Factor:
    """Compounded return over ``lookback_days`` sessions that end ``skip_days`` back.

    Null with fewer than ``min_periods`` valid returns, and with a return of -100 % or less in the window.
    """
    if lookback_days <= 0 or skip_days <= 0 or not 0 < min_periods <= lookback_days:
        raise ValueError("windows must be positive, and min_periods within the lookback")

    def build() -> Column:
        # Running sums up to two ordinals, and their differences: linear in rows, whatever the lookback.
        r, start = F.col("return"), Window.unboundedPreceding
        late, early = by_ticker().rangeBetween(start, -skip_days), by_ticker().rangeBetween(start, -(lookback_days + skip_days))
        valid = finite(r) & (r > -1)
        inside = lambda c: F.coalesce(F.sum(c).over(late), F.lit(0)) - F.coalesce(F.sum(c).over(early), F.lit(0))
        count = inside(F.when(valid, 1))
        crashes = inside(F.when(r.isNotNull() & ~F.isnan(r) & (r <= -1), 1))
        total = inside(F.when(valid, F.log1p(r)))
        return F.when((count >= min_periods) & (crashes == 0), F.expm1(total))

    return Factor(name, build, lookback_days + skip_days)


def long_term_reversal_factor(lookback_days: int, skip_days: int, min_periods: int, name: str = "HML") -> Factor:
    """Momentum with its sign turned."""
    inner = momentum_factor(lookback_days, skip_days, min_periods, name)
    return Factor(name, lambda: -inner.build(), inner.history_business_days)


def volatility_factor(lookback_days: int, min_periods: int, name: str = "VOL") -> Factor:
    """Sample deviation of the returns of the ``lookback_days`` sessions before."""

    def build() -> Column:
        frame = by_ticker().rangeBetween(-lookback_days, -1)
        r = F.when(finite(F.col("return")), F.col("return"))
        return F.when(F.count(r).over(frame) >= min_periods, F.stddev_samp(r).over(frame))

    return Factor(name, build, lookback_days)


def reversal_factor(name: str = "REV") -> Factor:
    """Minus the return of the previous session."""
    return Factor(name, lambda: -previous_session(F.col("return")), 1)
