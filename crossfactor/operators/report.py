"""Report metrics: turnover, coverage of caps, autocorrelation, stage R², summaries, rolling means, profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossfactor.operators.calendar import sessions

#: Sessions a year.
YEAR = 252


def turnover(universe: DataFrame) -> DataFrame:
    """(date, entered, members, turnover): the share of members that were none at the universe's session before."""
    members = universe.where("in_universe").select("date", "ticker")
    days = sessions(members)
    own = members.join(F.broadcast(days), "date")  # a row a session
    before = own.select("ticker", (F.col("k") + 1).alias("k"), F.lit(1).alias("__was"))
    both = own.where("k > 1").join(before, ["ticker", "k"], "left")
    return both.groupBy("date").agg(F.count_if(F.col("__was").isNull()).alias("entered"), F.count("*").alias("members")).withColumn("turnover", F.col("entered") / F.col("members"))


def cap_coverage(panel: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """(date, share_N...): the part of the day's positive cap in its N largest names."""
    w = Window.partitionBy("date").orderBy(F.desc("market_cap"), "ticker")
    rows = panel.where("market_cap > 0").withColumn("__r", F.row_number().over(w))
    return rows.groupBy("date").agg(*((F.sum(F.when(F.col("__r") <= n, F.col("market_cap"))) / F.sum("market_cap")).alias(f"share_{n}") for n in sizes))


def autocorrelation(rows: DataFrame, value: str, minimum_pairs: int = 60) -> DataFrame:
    """(ticker, pairs, autocorrelation) of a value over consecutive dates of the rows."""
    own = rows.join(F.broadcast(sessions(rows)), "date")  # a row a session
    w = Window.partitionBy("ticker").orderBy("k")
    paired = own.withColumn("__p", F.when(F.lag("k").over(w) == F.col("k") - 1, F.lag(value).over(w))).where(F.col("__p").isNotNull() & F.col(value).isNotNull())
    return paired.groupBy("ticker").agg(F.count("*").alias("pairs"), F.corr(value, "__p").alias("autocorrelation")).where(F.col("pairs") >= minimum_pairs)


def mean_autocorrelation(rows: DataFrame, value: str, minimum_pairs: int = 60) -> DataFrame:
    """(tickers, mean, median) of the tickers' autocorrelations."""
    found = F.when(~F.isnan("autocorrelation"), F.col("autocorrelation"))
    return autocorrelation(rows, value, minimum_pairs).agg(F.count(found).alias("tickers"), F.avg(found).alias("mean"), F.percentile(found, F.lit(0.5)).alias("median"))


def dispersion(rows: DataFrame) -> DataFrame:
    """(date, raw, residual): the population deviations of a date's returns and residuals."""
    return rows.groupBy("date").agg(F.stddev_pop("return").alias("raw"), F.stddev_pop("specific_return").alias("residual"))


def stage_r_squared(rows: DataFrame, factors: Sequence[str]) -> DataFrame:
    """(date, one cumulative R² a factor): after each removal."""
    w, rest = F.col("regression_weight"), F.col("return") - F.col("__f0")
    spread, out = F.sum(w * rest * rest), []
    for j, name in enumerate(factors):
        rest = rest - F.col(f"__f{j + 1}") * F.col(f"__q{j}")
        out.append((1 - F.try_divide(F.sum(w * rest * rest), spread)).alias(f"r2_{name}"))
    return rows.groupBy("date").agg(*out)


def rolling_mean(series: DataFrame, value: str, length: int) -> DataFrame:
    """(date, value, mean): null until the window is full. A series has a row a session."""
    w = Window.orderBy("date").rowsBetween(-(length - 1), 0)
    return series.select("date", value, F.when(F.count(value).over(w) == length, F.avg(value).over(w)).alias("mean"))


def compounded(series: DataFrame, value: str) -> DataFrame:
    """(date, cumulative, growth): running sum and compounded growth of a series."""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return series.select("date", F.sum(value).over(w).alias("cumulative"), F.expm1(F.sum(F.log1p(value)).over(w)).alias("growth"))


def factor_summary(factor_returns: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(factor, mean, median, p05, p95, largest, annual_return, annual_volatility)."""
    stack = ", ".join(f"'{t}', `{t}`" for t in terms)
    long = factor_returns.select(F.expr(f"stack({len(terms)}, {stack}) as (factor, value)"))
    q = lambda p: F.percentile("value", F.lit(p))
    return long.groupBy("factor").agg(F.avg("value").alias("mean"), q(0.5).alias("median"), q(0.05).alias("p05"), q(0.95).alias("p95"), F.max("value").alias("largest"), (F.avg("value") * YEAR).alias("annual_return"), (F.stddev_samp("value") * F.sqrt(F.lit(YEAR))).alias("annual_volatility"))


def profile(frame: DataFrame) -> DataFrame:
    """(rows, dates, tickers) of a table; counts are exact."""
    keys = [F.count_distinct(c).alias(f"{c}s") for c in ("date", "ticker") if c in frame.columns]
    return frame.agg(F.count("*").alias("rows"), *keys)
