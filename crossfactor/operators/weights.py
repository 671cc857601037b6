"""Regression weights."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from crossfactor.functions.columns import previous_session


class WeightModel(Protocol):
    history_business_days: int

    def column(self) -> Column: ...


@dataclass(frozen=True)
class EqualWeights:
    history_business_days: int = 0

    def column(self) -> Column:
        return F.lit(1.0)


@dataclass(frozen=True)
class SquareRootCapWeights:
    """The root of the previous session's market cap, where positive."""

    history_business_days: int = 1

    def column(self) -> Column:
        lagged = previous_session(F.col("market_cap"))
        return F.when(lagged > 0, F.sqrt(lagged))
