"""Session calendar, ordinals and windows of dates."""

from __future__ import annotations

import calendar as months
import datetime as dt
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossfactor.functions.columns import previous_session
from crossfactor.sources.market import MarketDataSource

#: Sessions that the calendar may have, 400 years of days: more raise. So it may be broadcast.
MAX_SESSIONS = 150_000


@dataclass(frozen=True)
class AnalysisWindow:
    start: dt.date
    end: dt.date


def sessions(panel: DataFrame) -> DataFrame:
    """(date, k): the distinct dates of the panel with their ordinal from 1. One row a session, so one task numbers them."""
    number = F.row_number().over(Window.orderBy("date"))
    bounded = F.when(number <= MAX_SESSIONS, number).otherwise(F.raise_error(F.lit(f"more than {MAX_SESSIONS} sessions")).cast("int"))
    return panel.select("date").distinct().withColumn("k", bounded)


def with_ordinals(panel: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """The panel with each date's ordinal among its own sessions. The calendar has a row a session: at most ``MAX_SESSIONS``.

    ``days`` is that calendar if it was made before; else each reading of the result reads the panel's dates again.
    """
    return panel.join(F.broadcast(sessions(panel) if days is None else days), "date")


def previous_session_values(panel: DataFrame, column: str) -> DataFrame:
    """(date, ticker, previous): the ticker's value at the session before, null over a gap."""
    own = panel if "k" in panel.columns else with_ordinals(panel)
    return own.select("date", "ticker", previous_session(F.col(column)).alias("previous"))


def analysis_window(source: MarketDataSource, years: int, end: dt.date | None = None) -> AnalysisWindow:
    """The last ``years`` years to the latest session; 29 February clamps."""
    last = source.latest_date(end)
    year = last.year - years
    return AnalysisWindow(dt.date(year, last.month, min(last.day, months.monthrange(year, last.month)[1])), last)


def history_start(start: dt.date, business_days: int) -> dt.date:
    """Start less so many business days and a reserve of a tenth and a week for holidays."""
    if business_days <= 0:
        return start
    reserve = business_days // 10 + 7
    return np.busday_offset(np.datetime64(start), -business_days, roll="forward").astype(dt.date) - dt.timedelta(days=reserve)
