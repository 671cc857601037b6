"""Point-in-time universes by lagged market capitalization."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossfactor.operators.calendar import AnalysisWindow, sessions
from crossfactor.sources.market import MarketDataSource


#: Members that a join may broadcast, at about 100 bytes each; more meet the panel by a shuffle.
MAX_SENT = 1_000_000


class UniverseBuilder(Protocol):
    def build(self, source: MarketDataSource, window: AnalysisWindow) -> DataFrame: ...


def positive(size: int) -> None:
    if size <= 0:
        raise ValueError("size must be positive")


@dataclass(frozen=True)
class FixedTopUniverse:
    """The largest names of the last snapshot before the first session, at all sessions. Caps must be positive."""

    size: int

    def __post_init__(self) -> None:
        positive(self.size)

    def build(self, source: MarketDataSource, window: AnalysisWindow) -> DataFrame:
        dates = source.trading_dates(window.start, window.end)
        first = dates.agg(F.min("date")).first()[0]
        if first is None:
            raise ValueError("the window has no sessions")
        before = first - dt.timedelta(days=1)
        try:
            snapshot = source.latest_date(before)
        except (ValueError, FileNotFoundError) as error:
            raise ValueError("no snapshot before the first session") from error
        ranked = source.load(snapshot, snapshot).where("market_cap > 0 and not isnan(market_cap)").orderBy(F.desc("market_cap"), "ticker").limit(self.size)
        members = ranked.select("ticker", "market_cap", F.row_number().over(Window.orderBy(F.desc("market_cap"), "ticker")).alias("member_rank"))
        if members.isEmpty():
            raise ValueError("no positive market caps in the snapshot")
        # At most ``size`` rows.
        return dates.crossJoin(F.broadcast(members.select("ticker", "member_rank"))).select("date", "ticker", F.lit(True).alias("in_universe"), "member_rank")


def leading(rows: DataFrame, size: int) -> DataFrame:
    """The rows that may be among a date's ``size`` largest caps, and few others: so ranking moves no whole panel.

    Rows are counted by date and step of the cap, each some 3 % wide; a date keeps the steps that hold its largest, and one more, as
    a sum of caps made anew may differ in its last digit. The bounds have a row a date, which the calendar's bound holds.
    """
    c = F.col("market_cap")
    step = F.signum(c) * F.floor(F.least(F.log1p(F.abs(c)) * 32, F.lit(1e6)))
    counts = rows.groupBy("date", step.alias("__step")).agg(F.count("*").alias("__n"))
    above = F.sum("__n").over(Window.partitionBy("date").orderBy(F.desc("__step"))) - F.col("__n")
    bounds = counts.withColumn("__above", above).where(F.col("__above") < size).groupBy("date").agg(F.min("__step").alias("__least"))
    return rows.join(F.broadcast(bounds), "date").where(step >= F.col("__least") - 1).drop("__least")


@dataclass(frozen=True)
class DailyTopUniverse:
    """Each session, the largest names of the session before. Caps of zero or less are kept, as ranks go by value."""

    size: int

    def __post_init__(self) -> None:
        positive(self.size)

    def build(self, source: MarketDataSource, window: AnalysisWindow) -> DataFrame:
        try:
            snapshot = source.latest_date(window.start - dt.timedelta(days=1))
        except (ValueError, FileNotFoundError):
            snapshot = window.start
        panel = source.load(snapshot, window.end)
        # A row a session: the calendar's bound holds, and one task numbers them.
        days = sessions(source.trading_dates(snapshot, window.end))
        effective = F.broadcast(days.select("date", F.lead("date").over(Window.orderBy("k")).alias("effective")).where("effective is not null"))
        rank = Window.partitionBy("date").orderBy(F.desc("market_cap"), "ticker")
        top = leading(panel.where("market_cap is not null and not isnan(market_cap)"), self.size).withColumn("member_rank", F.row_number().over(rank)).where(F.col("member_rank") <= self.size)
        rows = top.join(effective, "date").select(F.col("effective").alias("date"), "ticker", F.lit(True).alias("in_universe"), "member_rank")
        return rows.where((F.col("date") >= F.lit(window.start)) & (F.col("date") <= F.lit(window.end)))


def sent_if_small(members: DataFrame, count: int | None) -> DataFrame:
    """Members for a join with the panel: at most ``MAX_SENT`` counted rows are broadcast, so that the panel's rows do not move, whatever the
    session's threshold. If they were not counted, the optimizer decides."""
    return members if count is None or count > MAX_SENT else F.broadcast(members)


def universe_index(universe: DataFrame) -> DataFrame:
    return universe.where("in_universe").select("date", "ticker")


def universe_dates(universe: DataFrame) -> DataFrame:
    return universe_index(universe).select("date").distinct().orderBy("date")


def universe_members(universe: DataFrame, date: dt.date) -> DataFrame:
    return universe_index(universe).where(F.col("date") == F.lit(date)).select("ticker")
