"""Column functions on the canonical panel: date, ticker, return_percent, market_cap."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

TICKER_WIDTH = 6


def finite(c: Column) -> Column:
    """True for numbers other than NaN and infinities; False for null."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def finite_or_null(c: Column) -> Column:
    return F.when(finite(c), c)


def percentage_return(c: Column | None = None) -> Column:
    """A return as a fraction."""
    return ((F.col("return_percent") if c is None else c) / 100.0).alias("return")


def padded_ticker(c: Column, width: int = TICKER_WIDTH) -> Column:
    """Zeros to the left up to ``width``; longer codes stay, which ``lpad`` alone would cut."""
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def by_ticker() -> Window:
    return Window.partitionBy("ticker").orderBy("k")


def by_date() -> Window:
    return Window.partitionBy("date")


def previous_session(c: Column) -> Column:
    """The value one session before; null if the ticker missed that session. Needs the ordinal ``k``."""
    w = by_ticker()
    return F.when(F.lag("k").over(w) == F.col("k") - 1, F.lag(c).over(w))
