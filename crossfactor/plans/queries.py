"""The registered queries over the test tables and their DuckDB SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossfactor.operators import beta, calendar, factors, fit, report, universe, validate, volatility, weights
from crossfactor.functions.columns import padded_ticker
from crossfactor.plans.pipeline import Result, member_rows, prepared_panel, run_pipeline
from crossfactor.sources.artifacts import publish
from crossfactor.sources.market import FrameSource, YearlyParquetSource, event_panel, weekly_panel, write_yearly
from crossfactor.sources.working import working_folder, written
from crossfactor.streaming import events, live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: All sessions that have the history of the beta's bootstrap before them.
WINDOW = calendar.AnalysisWindow(dt.date(1995, 7, 3), dt.date(2001, 12, 31))
#: Names of the universe that fits, beta and reports work on, as in a production run; and of the short lists.
SIZE, LIST = 1000, 60
WINSOR = 0.01
MOMENTUM, REVERSAL, BETA = (12, 4, 8), (52, 13, 39), (26, 13, 0.97)
ORDER = ("SIZE", "MOM")
MODEL = factors.CharacteristicModel((factors.size_factor(), factors.momentum_factor(*MOMENTUM)))
BETA_ORDER = ("MKT", "SIZE", "MOM")


def rounded(frame: DataFrame, digits: int = 8) -> DataFrame:
    """Doubles rounded, with no negative zero."""
    return frame.select(*(((F.round(F.col(f"`{f.name}`"), digits) + F.lit(0.0)).alias(f.name)) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in frame.schema.fields))


def padded_sql(key: str) -> str:
    return f"CASE WHEN length({key}::VARCHAR) < 6 THEN lpad({key}::VARCHAR, 6, '0') ELSE {key}::VARCHAR END"


def ctes(size: int = SIZE) -> str:
    """Shared DuckDB CTEs: the weekly panel, its windows, a universe of so many names, and the two-factor fit."""
    return f"""
panel AS (
  SELECT date_trunc('week', l_shipdate)::DATE AS date, {padded_sql("l_suppkey")} AS ticker,
         100 * (avg(l_tax::DOUBLE) - avg(l_discount::DOUBLE)) AS return_percent,
         sum(l_extendedprice::DOUBLE * (1 - l_discount::DOUBLE)) AS market_cap
  FROM lineitem GROUP BY 1, 2),
cal AS (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM panel)),
p AS (
  SELECT panel.*, k, return_percent / 100 AS ret,
         CASE WHEN lag(k) OVER w = k - 1 THEN lag(market_cap) OVER w END AS lagged_cap,
         CASE WHEN lag(k) OVER w = k - 1 THEN lag(return_percent / 100) OVER w END AS lagged_ret
  FROM panel JOIN cal USING (date) WINDOW w AS (PARTITION BY ticker ORDER BY k)),
x AS (
  SELECT *, CASE WHEN lagged_cap > 0 THEN ln(lagged_cap) END AS size_x,
         CASE WHEN count(ret) OVER m >= {MOMENTUM[2]} AND max((ret <= -1)::INT) OVER m = 0 THEN exp(sum(ln(1 + ret)) OVER m) - 1 END AS mom_x,
         -CASE WHEN count(ret) OVER v >= {REVERSAL[2]} AND max((ret <= -1)::INT) OVER v = 0 THEN exp(sum(ln(1 + ret)) OVER v) - 1 END AS hml_x,
         CASE WHEN count(ret) OVER s >= 8 THEN stddev_samp(ret) OVER s END AS vol_x,
         CASE WHEN lagged_cap > 0 THEN sqrt(lagged_cap) END AS w
  FROM p WINDOW m AS (PARTITION BY ticker ORDER BY k RANGE BETWEEN {sum(MOMENTUM[:2]) - 1} PRECEDING AND {MOMENTUM[1]} PRECEDING),
                v AS (PARTITION BY ticker ORDER BY k RANGE BETWEEN {sum(REVERSAL[:2]) - 1} PRECEDING AND {REVERSAL[1]} PRECEDING),
                s AS (PARTITION BY ticker ORDER BY k RANGE BETWEEN 12 PRECEDING AND 1 PRECEDING)),
eff AS (SELECT a.date AS snap, b.date AS date FROM cal a JOIN cal b ON b.k = a.k + 1),
uni AS (
  SELECT eff.date, ticker, row_number() OVER (PARTITION BY eff.date ORDER BY market_cap DESC, ticker) AS member_rank
  FROM panel JOIN eff ON panel.date = eff.snap
  WHERE eff.date BETWEEN DATE '{WINDOW.start}' AND DATE '{WINDOW.end}'
  QUALIFY member_rank <= {size}),
u0 AS (
  SELECT date, ticker, ret, w, size_x, mom_x, count(*) OVER (PARTITION BY date) AS n
  FROM uni JOIN x USING (date, ticker) WHERE ret IS NOT NULL AND w > 0 AND size_x IS NOT NULL AND mom_x IS NOT NULL),
u1 AS (
  SELECT *, quantile_cont(size_x, {WINSOR}::DOUBLE) OVER d AS l1, quantile_cont(size_x, {1 - WINSOR}::DOUBLE) OVER d AS h1,
         quantile_cont(mom_x, {WINSOR}::DOUBLE) OVER d AS l2, quantile_cont(mom_x, {1 - WINSOR}::DOUBLE) OVER d AS h2
  FROM u0 WHERE n > 3 WINDOW d AS (PARTITION BY date)),
u2 AS (SELECT *, least(greatest(size_x, l1), h1) AS x1, least(greatest(mom_x, l2), h2) AS x2 FROM u1),
u3 AS (SELECT *, sum(w) OVER d AS sw, sum(w * x1) OVER d / sum(w) OVER d AS c1, sum(w * x2) OVER d / sum(w) OVER d AS c2, sum(w * ret) OVER d / sum(w) OVER d AS a FROM u2 WINDOW d AS (PARTITION BY date)),
u4 AS (SELECT *, sqrt(sum(w * (x1 - c1) ** 2) OVER d / sw) AS s1, sqrt(sum(w * (x2 - c2) ** 2) OVER d / sw) AS s2 FROM u3 WINDOW d AS (PARTITION BY date)),
u5 AS (SELECT *, (x1 - c1) / s1 AS z1, (x2 - c2) / s2 AS z2 FROM u4 WHERE s1 > 0 AND s2 > 0),
u6 AS (
  SELECT *, sum(w * z1 * z1) OVER d AS g11, sum(w * z1 * z2) OVER d AS g12, sum(w * z2 * z2) OVER d AS g22,
         sum(w * z1 * (ret - a)) OVER d AS b1, sum(w * z2 * (ret - a)) OVER d AS b2
  FROM u5 WINDOW d AS (PARTITION BY date)),
u7 AS (SELECT *, z1 AS q1, z2 - g12 / g11 * z1 AS q2, b1 / g11 AS f1, (b2 - g12 / g11 * b1) / (g22 - g12 * g12 / g11) AS f2 FROM u6),
e AS (SELECT *, ret - a - f1 * q1 - f2 * q2 AS eps FROM u7),
fr AS (SELECT date, any_value(a) AS i, any_value(f1) AS f1, any_value(f2) AS f2 FROM e GROUP BY date)
"""


def oracle(name: str, sql: str, digits: int = 8, doubles: str = "", size: int = SIZE) -> None:
    """SQL of a query: ``doubles`` names the columns to round."""
    names = doubles.split()
    replaced = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in names)
    ORACLE[name] = f"WITH {ctes(size).strip()} SELECT * {f'REPLACE ({replaced})' if names else ''} FROM ({sql}) _o"


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly_panel(spark, sf_dir)


def source(spark: SparkSession, sf_dir: str) -> FrameSource:
    """The panel, kept: universes, lags, bootstrap and sections of a query read it several times.

    Partitions are kept by date, so that those who read a range of dates pass over the other batches.
    """
    return FrameSource(panel(spark, sf_dir).sortWithinPartitions("date").persist())


def prepared(spark: SparkSession, sf_dir: str, days: DataFrame | None = None) -> DataFrame:
    return prepared_panel(source(spark, sf_dir).frame, days=days)


def daily_universe(spark: SparkSession, sf_dir: str, size: int = SIZE, days: DataFrame | None = None) -> DataFrame:
    return universe.DailyTopUniverse(size).build(FrameSource(source(spark, sf_dir).frame, days), WINDOW)


def members(spark: SparkSession, sf_dir: str, size: int = SIZE, days: DataFrame | None = None) -> DataFrame:
    """The daily universe, written once: several joins read it, and know its size."""
    return written(daily_universe(spark, sf_dir, size, days), "universe")


def ordered_rows(spark: SparkSession, sf_dir: str, model: factors.FactorModel, size: int = SIZE) -> DataFrame:
    """What a fit or the scan of a model reads. The calendar is written once, as several joins read it."""
    days = written(calendar.sessions(source(spark, sf_dir).frame), "calendar")
    own = members(spark, sf_dir, size, days)
    return member_rows(prepared(spark, sf_dir, days), own, model, weights.SquareRootCapWeights(), days, own.count())


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written once, as a fit reads them three times."""
    return written(MODEL.sections(ordered_rows(spark, sf_dir, MODEL), RESIDUALIZER), "sections")


RESIDUALIZER = fit.sequential_wls(ORDER, WINSOR)


def fitted(spark: SparkSession, sf_dir: str) -> fit.Fitted:
    return RESIDUALIZER.fit(sections(spark, sf_dir))


def disturbed(spark: SparkSession, sf_dir: str) -> fit.Fitted:
    """Fits whose residuals are off by a thousandth of the return, so that the checks' values are not all zero."""
    own = fitted(spark, sf_dir)
    return fit.Fitted(own.rows.withColumn("specific_return", F.col("specific_return") + F.col("return") / 1000), own.factors)


def with_holes(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables of a run whose residuals are null and returns infinite for some tickers."""
    own = fitted(spark, sf_dir)
    ends = lambda digit: F.col("ticker").endswith(digit)
    rows = own.rows.withColumn("specific_return", F.when(~ends("7"), F.col("specific_return"))).withColumn("return", F.when(ends("3"), F.lit(float("inf"))).otherwise(F.col("return")))
    return Result(fit.Fitted(rows, own.factors), rows).tables()


def register(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None, doubles: str = "", digits: int = 8, size: int = SIZE) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(run(spark, sf_dir), digits)
    if sql is not None:
        oracle(name, sql, digits, doubles, size)


register("panel", panel, "SELECT * FROM panel", "return_percent market_cap", 6)
ORACLE["panel_events"] = f"""
SELECT ts::DATE AS date, {padded_sql("user_id")} AS ticker, round(avg(value) / 10 - 5, 6) + 0.0 AS return_percent, round(sum(value), 6) + 0.0 AS market_cap
FROM events GROUP BY 1, 2"""
register("panel_events", event_panel, None, digits=6)
register("calendar", lambda s, d: calendar.sessions(panel(s, d)), "SELECT date, k::INT AS k FROM cal")
register("latest_date", lambda s, d: panel(s, d).where("date <= '1995-06-30'").agg(F.max("date").alias("latest")), "SELECT max(date) AS latest FROM panel WHERE date <= '1995-06-30'")
register("trading_dates", lambda s, d: FrameSource(panel(s, d)).trading_dates(dt.date(1998, 1, 1), dt.date(1998, 12, 31)), "SELECT date FROM cal WHERE date BETWEEN '1998-01-01' AND '1998-12-31'")
register("scan_range_tickers", lambda s, d: FrameSource(panel(s, d)).load(dt.date(1998, 1, 1), dt.date(1998, 6, 30), panel(s, d).where("ticker <= '000005'")), "SELECT * FROM panel WHERE date BETWEEN '1998-01-01' AND '1998-06-30' AND ticker <= '000005'", "return_percent market_cap", 6)


def yearly_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel written as files by year and read back by range."""
    folder = working_folder(spark, "years")
    write_yearly(panel(spark, sf_dir), folder, "panel")
    return YearlyParquetSource(spark, folder, "panel").load(dt.date(1993, 7, 1), dt.date(1998, 6, 30))


register("yearly_files", yearly_files, "SELECT * FROM panel WHERE date BETWEEN '1993-07-01' AND '1998-06-30'", "return_percent market_cap", 6)
register("prev_session_lag", lambda s, d: calendar.previous_session_values(panel(s, d), "market_cap"), "SELECT date, ticker, lagged_cap AS previous FROM p", "previous", 6)
register(
    "universe_fixed",
    lambda s, d: universe.FixedTopUniverse(LIST).build(FrameSource(panel(s, d)), WINDOW),
    f"""SELECT c.date, m.ticker, true AS in_universe, m.member_rank::INT AS member_rank FROM cal c,
    (SELECT ticker, row_number() OVER (ORDER BY market_cap DESC, ticker) AS member_rank FROM panel
     WHERE market_cap > 0 AND date = (SELECT max(date) FROM panel WHERE date < (SELECT min(date) FROM cal WHERE date >= '{WINDOW.start}')) QUALIFY member_rank <= {LIST}) m
    WHERE c.date BETWEEN '{WINDOW.start}' AND '{WINDOW.end}'""",
)
register("universe_daily", lambda s, d: daily_universe(s, d, LIST), "SELECT date, ticker, true AS in_universe, member_rank::INT AS member_rank FROM uni", size=LIST)
register("universe_dates", lambda s, d: universe.universe_dates(daily_universe(s, d)), "SELECT DISTINCT date FROM uni")
register("returns", lambda s, d: prepared(s, d).select("date", "ticker", "return"), 'SELECT date, ticker, ret AS "return" FROM p', '"return"')
for name, factor, column in (
    ("size", factors.size_factor(), "size_x"),
    ("momentum", factors.momentum_factor(*MOMENTUM), "mom_x"),
    ("reversal", factors.long_term_reversal_factor(*REVERSAL), "hml_x"),
    ("volatility", factors.volatility_factor(12, 8), "vol_x"),
    ("short_reversal", factors.reversal_factor(), "-lagged_ret"),
):
    register(name, lambda s, d, f=factor: factors.CharacteristicModel((f,)).exposures(prepared(s, d)).select("date", "ticker", F.col(f.name).alias("exposure")), f"SELECT date, ticker, {column} AS exposure FROM x", "exposure")


def python_momentum(k: np.ndarray, r: np.ndarray, caps: np.ndarray) -> np.ndarray:
    """Momentum as a user writes it: a ticker's sessions one after another."""
    lookback, skip, least = MOMENTUM
    out = np.full(len(k), np.nan)
    for i, now in enumerate(k):
        window = r[(k > now - lookback - skip) & (k <= now - skip)]
        window = window[~np.isnan(window)]
        if len(window) >= least and (window > -1).all():
            out[i] = np.prod(1 + window) - 1
    return out


register("momentum_python", lambda s, d: factors.CharacteristicModel((factors.size_factor(), factors.PythonFactor("MOM", python_momentum, sum(MOMENTUM[:2])))).exposures(prepared(s, d)).select("date", "ticker", "SIZE", "MOM"), 'SELECT date, ticker, size_x AS "SIZE", mom_x AS "MOM" FROM x', '"SIZE" "MOM"')
register(
    "exposures_dense",
    lambda s, d: MODEL.dense(prepared(s, d)),
    f"""SELECT date, ticker, CASE WHEN c > 0 THEN ln(c) END AS "SIZE", m AS "MOM" FROM (
      SELECT g.date, g.ticker, lag(market_cap) OVER (PARTITION BY g.ticker ORDER BY g.k) AS c,
             CASE WHEN count(ret) OVER m >= {MOMENTUM[2]} THEN exp(sum(ln(1 + ret)) OVER m) - 1 END AS m
      FROM (SELECT date, k, ticker FROM cal, (SELECT DISTINCT ticker FROM panel)) g LEFT JOIN p USING (date, ticker)
      WINDOW m AS (PARTITION BY g.ticker ORDER BY g.k ROWS BETWEEN {sum(MOMENTUM[:2]) - 1} PRECEDING AND {MOMENTUM[1]} PRECEDING))""",
    '"SIZE" "MOM"',
)
register("weights_sqrt_cap", lambda s, d: prepared(s, d).select("date", "ticker", weights.SquareRootCapWeights().column().alias("regression_weight")), "SELECT date, ticker, w AS regression_weight FROM x", "regression_weight", 6)
register("weights_equal", lambda s, d: prepared(s, d).select("date", "ticker", weights.EqualWeights().column().alias("regression_weight")), "SELECT date, ticker, 1.0::DOUBLE AS regression_weight FROM x", "regression_weight")
register("market_return", lambda s, d: beta.market_returns(prepared(s, d), members(s, d)), "SELECT date, sum(lagged_cap * ret) / sum(lagged_cap) AS market_return FROM p JOIN uni USING (date, ticker) WHERE lagged_cap > 0 GROUP BY date", "market_return")

BETA_MODEL = beta.RecursiveBeta(MODEL, *BETA)
BOOT = f"""
      m0 AS (SELECT panel.* FROM panel WHERE ticker IN (SELECT ticker FROM uni WHERE date = (SELECT min(date) FROM uni))),
      mc AS (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM m0)),
      ml AS (SELECT date, return_percent / 100 AS ret, CASE WHEN lag(k) OVER w = k - 1 THEN lag(market_cap) OVER w END AS c FROM m0 JOIN mc USING (date) WINDOW w AS (PARTITION BY ticker ORDER BY k)),
      proxy AS (SELECT date, sum(c * ret) / sum(c) AS g FROM ml WHERE c > 0 GROUP BY date),
      hist AS (SELECT p.*, g FROM p JOIN proxy USING (date) WHERE date < (SELECT min(date) FROM uni) AND lagged_cap > 0 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY k DESC) <= {BETA[0]}),
      boot AS (SELECT ticker, least(greatest(covar_pop(ret, g) / var_pop(g), -5), 5) AS initial_beta FROM hist GROUP BY ticker HAVING count(*) >= {BETA[1]} AND var_pop(g) > 0)"""
register("bootstrap_beta", lambda s, d: BETA_MODEL.bootstrap(prepared(s, d), members(s, d)), f"WITH {BOOT} SELECT * FROM boot", "initial_beta")
register("winsor_bounds", lambda s, d: sections(s, d).where(fit.all_finite(ORDER)).groupBy("date").agg(F.expr(f"percentile(SIZE, {WINSOR}D)").alias("size_low"), F.expr(f"percentile(SIZE, {1 - WINSOR}D)").alias("size_high")).where("size_low is not null"), "SELECT date, quantile_cont(size_x, 0.01::DOUBLE) AS size_low, quantile_cont(size_x, 0.99::DOUBLE) AS size_high FROM u0 GROUP BY date", "size_low size_high")
register("normalized_exposures", lambda s, d: fit.normalised(sections(s, d), ORDER, WINSOR, ()).select("date", "ticker", F.col("__z_0").alias("size_z"), F.col("__z_1").alias("mom_z")), "SELECT date, ticker, z1 AS size_z, z2 AS mom_z FROM u5", "size_z mom_z")
register("normalized_unscaled", lambda s, d: fit.normalised(sections(s, d), ORDER, WINSOR, ("SIZE",)).select("date", "ticker", F.col("__z_0").alias("size_z"), F.col("__z_1").alias("mom_z")), "SELECT date, ticker, x1 - c1 AS size_z, z2 AS mom_z FROM u5", "size_z mom_z")
register("sequential_fit_f", lambda s, d: fitted(s, d).factor_returns(), 'SELECT date, i AS "INTERCEPT", f1 AS "SIZE", f2 AS "MOM" FROM fr', '"INTERCEPT" "SIZE" "MOM"')
register("sequential_fit_epsilon", lambda s, d: fitted(s, d).specific_returns(), "SELECT date, ticker, eps AS specific_return FROM e", "specific_return")
register("sequential_fit_x", lambda s, d: fitted(s, d).exposures(), 'SELECT date, ticker, 1.0::DOUBLE AS "INTERCEPT", q1 AS "SIZE", q2 AS "MOM" FROM e', '"INTERCEPT" "SIZE" "MOM"')
register("sequential_fit_r", lambda s, d: fitted(s, d).returns(), 'SELECT date, ticker, ret AS "return" FROM e', '"return"')
register("fit_weights", lambda s, d: fitted(s, d).regression_weights(), "SELECT date, ticker, w AS regression_weight FROM e", "regression_weight", 6)
register("ols_fit", lambda s, d: fit.joint_ols(ORDER, WINSOR).fit(sections(s, d)).factor_returns(), 'SELECT date, any_value(a) AS "INTERCEPT", any_value((b1 * g22 - b2 * g12) / (g11 * g22 - g12 * g12)) AS "SIZE", any_value((b2 * g11 - b1 * g12) / (g11 * g22 - g12 * g12)) AS "MOM" FROM u6 GROUP BY date', '"INTERCEPT" "SIZE" "MOM"')
register("ols_fit_epsilon", lambda s, d: fit.joint_ols(ORDER, WINSOR).fit(sections(s, d)).specific_returns(), "SELECT date, ticker, eps AS specific_return FROM e", "specific_return")
register("kernel_fit_f", lambda s, d: fit.kernel_residualizer(ORDER, WINSOR).fit(sections(s, d)).factor_returns(), 'SELECT date, i AS "INTERCEPT", f1 AS "SIZE", f2 AS "MOM" FROM fr', '"INTERCEPT" "SIZE" "MOM"')
register("diagnostics", lambda s, d: fitted(s, d).diagnostics(), "SELECT date, count(*) AS n_observations, 3::INT AS rank, 1 - sum(w * eps * eps) / sum(w * (ret - a) ** 2) AS r_squared, sum(w * eps) / sum(w) AS residual_mean FROM e GROUP BY date", "r_squared residual_mean")
#: Residuals as ``disturbed`` has them.
OFF = "(SELECT * REPLACE (eps + ret / 1000 AS eps) FROM e)"
register("reconstruction", lambda s, d: validate.reconstruction_error(disturbed(s, d).rows, 2), f"SELECT max(abs(ret - a - f1 * q1 - f2 * q2 - eps)) AS max_error FROM {OFF}", "max_error")
register("orthogonality", lambda s, d: validate.moments(disturbed(s, d).rows, 2), f"SELECT date, abs(sum(w * eps) / sum(w)) AS m0, abs(sum(w * q1 * eps) / sum(w)) AS m1, abs(sum(w * q2 * eps) / sum(w)) AS m2 FROM {OFF} GROUP BY date", "m0 m1 m2", 10)
register(
    "stage_moments",
    lambda s, d: validate.stage_moments(fitted(s, d).rows.withColumn("return", F.col("return") + F.col("__q1") / 1000), 2),
    "SELECT date, abs(sum(w * (r - a)) / sum(w)) AS m0, abs(sum(w * q1 * (r - a - f1 * q1)) / sum(w)) AS m1, abs(sum(w * q2 * (r - a - f1 * q1 - f2 * q2)) / sum(w)) AS m2 FROM (SELECT *, ret + q2 / 1000 AS r FROM e) GROUP BY date",
    "m0 m1 m2",
    10,
)
register("finite_outputs", lambda s, d: validate.not_finite(with_holes(s, d)), """SELECT * FROM (VALUES ('X', 0), ('f', 0), ('regression_weights', 0), ('diagnostics', 0)) t("table", bad)
  UNION ALL SELECT 'epsilon', count(*) FILTER (ticker LIKE '%7') FROM e
  UNION ALL SELECT 'r', count(*) FILTER (ticker LIKE '%3') FROM e""")
register("passed_checks", lambda s, d: validate.reconstruction_error(fitted(s, d).rows, 2).select((F.col("max_error") <= 1e-12).alias("passed")), "SELECT max(abs(ret - a - f1 * q1 - f2 * q2 - eps)) <= 1e-12 AS passed FROM e")
register("coverage", lambda s, d: fitted(s, d).rows.agg(F.count_distinct("date").alias("fitted")).crossJoin(daily_universe(s, d).agg(F.count_distinct("date").alias("expected"))).withColumn("coverage", F.col("fitted") / F.col("expected")), "SELECT *, fitted / expected AS coverage FROM (SELECT count(DISTINCT date) AS fitted FROM e), (SELECT count(DISTINCT date) AS expected FROM uni)", "coverage")
register("turnover", lambda s, d: report.turnover(daily_universe(s, d, LIST)), """SELECT date, count(*) FILTER (b.ticker IS NULL) AS entered, count(*) AS members, count(*) FILTER (b.ticker IS NULL) / count(*) AS turnover
  FROM (SELECT date, ticker, dense_rank() OVER (ORDER BY date) AS k FROM uni) a LEFT JOIN (SELECT ticker, dense_rank() OVER (ORDER BY date) + 1 AS k FROM uni) b USING (ticker, k) WHERE k > 1 GROUP BY date""", "turnover", size=LIST)
register("autocorr", lambda s, d: report.autocorrelation(fitted(s, d).specific_returns(), "specific_return"), """SELECT ticker, count(*) AS pairs, corr(eps, prev) AS autocorrelation FROM (
  SELECT ticker, eps, CASE WHEN lag(k) OVER w = k - 1 THEN lag(eps) OVER w END AS prev FROM (SELECT *, dense_rank() OVER (ORDER BY date) AS k FROM e) WINDOW w AS (PARTITION BY ticker ORDER BY k)) WHERE prev IS NOT NULL GROUP BY ticker HAVING count(*) >= 60""", "autocorrelation")
register("mean_autocorr", lambda s, d: report.mean_autocorrelation(fitted(s, d).specific_returns(), "specific_return"), """SELECT count(autocorrelation) AS tickers, avg(autocorrelation) AS mean, quantile_cont(autocorrelation, 0.5::DOUBLE) AS median FROM (SELECT corr(eps, prev) AS autocorrelation FROM (
  SELECT ticker, eps, CASE WHEN lag(k) OVER w = k - 1 THEN lag(eps) OVER w END AS prev FROM (SELECT *, dense_rank() OVER (ORDER BY date) AS k FROM e) WINDOW w AS (PARTITION BY ticker ORDER BY k)) WHERE prev IS NOT NULL GROUP BY ticker HAVING count(*) >= 60)""", "mean median")
register("dispersion", lambda s, d: report.dispersion(fitted(s, d).rows), "SELECT date, stddev_pop(ret) AS raw, stddev_pop(eps) AS residual FROM e GROUP BY date", "raw residual")
register("cap_coverage", lambda s, d: report.cap_coverage(panel(s, d), (5, 20, 50)), "SELECT date, sum(market_cap) FILTER (r <= 5) / sum(market_cap) AS share_5, sum(market_cap) FILTER (r <= 20) / sum(market_cap) AS share_20, sum(market_cap) FILTER (r <= 50) / sum(market_cap) AS share_50 FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY market_cap DESC, ticker) AS r FROM panel WHERE market_cap > 0) GROUP BY date", "share_5 share_20 share_50")
register("stage_r2", lambda s, d: report.stage_r_squared(fitted(s, d).rows, ORDER), 'SELECT date, 1 - sum(w * (ret - a - f1 * q1) ** 2) / sum(w * (ret - a) ** 2) AS "r2_SIZE", 1 - sum(w * eps ** 2) / sum(w * (ret - a) ** 2) AS "r2_MOM" FROM e GROUP BY date', '"r2_SIZE" "r2_MOM"')
R2 = "(SELECT date, 1 - sum(w * eps * eps) / sum(w * (ret - a) ** 2) AS r_squared FROM e GROUP BY date)"
register("rolling_r2", lambda s, d: report.rolling_mean(fitted(s, d).diagnostics(), "r_squared", 21), f"SELECT date, r_squared, CASE WHEN count(*) OVER w = 21 THEN avg(r_squared) OVER w END AS mean FROM {R2} WINDOW w AS (ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)", "r_squared mean")
register("cumulative_f", lambda s, d: report.compounded(fitted(s, d).factor_returns(), "SIZE"), "SELECT date, sum(f1) OVER w AS cumulative, exp(sum(ln(1 + f1)) OVER w) - 1 AS growth FROM fr WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)", "cumulative growth")
register("factor_summary", lambda s, d: report.factor_summary(fitted(s, d).factor_returns(), ("INTERCEPT", *ORDER)), """SELECT factor, avg(v) AS mean, quantile_cont(v, 0.5::DOUBLE) AS median, quantile_cont(v, 0.05::DOUBLE) AS p05, quantile_cont(v, 0.95::DOUBLE) AS p95, max(v) AS largest, avg(v) * 252 AS annual_return, stddev_samp(v) * sqrt(252) AS annual_volatility
  FROM (SELECT 'INTERCEPT' AS factor, i AS v FROM fr UNION ALL SELECT 'SIZE', f1 FROM fr UNION ALL SELECT 'MOM', f2 FROM fr) GROUP BY factor""", "mean median p05 p95 largest annual_return annual_volatility")
register("table_profile", lambda s, d: report.profile(fitted(s, d).specific_returns()), "SELECT count(*) AS rows, count(DISTINCT date) AS dates, count(DISTINCT ticker) AS tickers FROM e")
register("observation_range", lambda s, d: fitted(s, d).diagnostics().agg(F.min("n_observations").alias("least"), F.max("n_observations").alias("most"), F.min("date").alias("first"), F.max("date").alias("last")), "SELECT min(n) AS least, max(n) AS most, min(date) AS first, max(date) AS last FROM (SELECT date, count(*) AS n FROM e GROUP BY date)")


def beta_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return BETA_MODEL.sections(ordered_rows(spark, sf_dir, BETA_MODEL), BETA_RESIDUALIZER)


BETA_RESIDUALIZER = fit.sequential_wls(BETA_ORDER, WINSOR, ("MKT",))
#: The recursion in SQL: a step a date over all members' state. The dates that were fitted are those with enough usable rows and dispersion.
BETA_SQL = f"""WITH RECURSIVE {BOOT},
  mr AS (SELECT date, sum(lagged_cap * ret) / sum(lagged_cap) AS g FROM p JOIN uni USING (date, ticker) WHERE lagged_cap > 0 GROUP BY date),
  days AS (SELECT date, row_number() OVER (ORDER BY date) AS j FROM (SELECT DISTINCT date FROM uni)),
  names AS (SELECT DISTINCT ticker FROM uni),
  use AS (SELECT u0.date, u0.ticker, u0.ret, u0.w FROM u0),
  inter AS (SELECT date, sum(w * ret) / sum(w) AS a, count(*) AS n FROM use GROUP BY date),
  mem AS (SELECT j, uni.ticker, x.ret, use.w AS uw, inter.a, coalesce(inter.n, 0) AS n, mr.g FROM uni JOIN days USING (date) LEFT JOIN x USING (date, ticker) LEFT JOIN use USING (date, ticker) LEFT JOIN inter USING (date) LEFT JOIN mr USING (date)),
  grid AS (SELECT days.j, names.ticker, mem.ticker IS NOT NULL AS member, mem.ret, mem.uw, mem.a, mem.n, mem.g FROM days, names LEFT JOIN mem ON mem.j = days.j AND mem.ticker = names.ticker),
  s AS (
    SELECT 1::BIGINT AS j, ticker, coalesce(initial_beta, 1.0) * 1e-4 AS nn, 1e-4::DOUBLE AS dd FROM names LEFT JOIN boot USING (ticker)
    UNION ALL
    SELECT j + 1, ticker,
      CASE WHEN upd THEN least(greatest(({BETA[2]} * nn + g * y) / ({BETA[2]} * dd + g * g), -5), 5) * ({BETA[2]} * dd + g * g) ELSE nn END,
      CASE WHEN upd THEN {BETA[2]} * dd + g * g ELSE dd END
    FROM (SELECT *, ret - a + c * g AS y, member AND ret IS NOT NULL AND g IS NOT NULL AND n > 4 AND spread > 0 AS upd FROM (
      SELECT *, sum(uw * bw) OVER () / sum(uw) OVER () AS c, max(CASE WHEN uw IS NOT NULL THEN bw END) OVER () - min(CASE WHEN uw IS NOT NULL THEN bw END) OVER () AS spread FROM (
        SELECT *, least(greatest(b, quantile_cont(CASE WHEN uw IS NOT NULL THEN b END, 0.01::DOUBLE) OVER ()), quantile_cont(CASE WHEN uw IS NOT NULL THEN b END, 0.99::DOUBLE) OVER ()) AS bw FROM (
          SELECT s.j, s.ticker, nn, dd, nn / dd AS b, member, ret, uw, a, max(n) OVER () AS n, g FROM s JOIN grid ON grid.j = s.j AND grid.ticker = s.ticker)))))
SELECT days.date, s.ticker, nn / dd AS beta FROM s JOIN days USING (j) JOIN mem ON mem.j = s.j AND mem.ticker = s.ticker"""


def fit_sql(rows: str, factors: Sequence[tuple[str, str, bool]]) -> str:
    """CTEs of a sequential weighted fit of ``rows`` (date, ticker, ret, w and factor columns), with coefficients i and f1... .

    ``factors``: name, column, scaled. Each step removes a factor's direction from the returns and from the factors after it.
    """
    n, date = range(1, len(factors) + 1), "OVER (PARTITION BY date)"
    low = ", ".join(f"least(greatest({c}, quantile_cont({c}, {WINSOR}::DOUBLE) {date}), quantile_cont({c}, {1 - WINSOR}::DOUBLE) {date}) AS x{j}" for j, (_, c, _) in zip(n, factors, strict=True))
    out = [
        f"g0 AS (SELECT date, ticker, ret, w, {low} FROM (SELECT *, count(*) {date} AS n FROM ({rows})) WHERE n > {len(factors) + 1})",
        "g1 AS (SELECT *, " + ", ".join(f"x{j} - sum(w * x{j}) {date} / sum(w) {date} AS y{j}" for j in n) + f", sum(w * ret) {date} / sum(w) {date} AS i FROM g0)",
        "s0 AS (SELECT date, ticker, ret, w, i, ret - i AS rest, " + ", ".join(f"y{j} / sqrt(sum(w * y{j} ** 2) {date} / sum(w) {date}) AS z{j}" if scaled else f"y{j} AS z{j}" for j, (_, _, scaled) in zip(n, factors, strict=True)) + " FROM g1)",
    ]
    for j in n:
        later = "".join(f", z{k} - sum(w * z{j} * z{k}) {date} / sum(w * z{j} ** 2) {date} * z{j} AS z{k}" for k in n if k > j)
        before = "".join(f", z{k}" for k in n if k <= j) + "".join(f", f{k}" for k in n if k < j)
        out.append(f"a{j} AS (SELECT *, sum(w * z{j} * rest) {date} / sum(w * z{j} ** 2) {date} AS f{j} FROM s{j - 1}), s{j} AS (SELECT date, ticker, ret, w, i, rest - f{j} * z{j} AS rest{before}, f{j}{later} FROM a{j})")
    return ", ".join(out)


#: The ordered fit without weights; at 12 digits, as means of few short decimals end at the eighth.
OLS_FIT = fit_sql("SELECT date, ticker, ret, 1 AS w, size_x, mom_x FROM u0", (("SIZE", "size_x", True), ("MOM", "mom_x", True)))
register("sequential_ols_f", lambda s, d: fit.sequential_ols(ORDER, WINSOR).fit(sections(s, d).where(fit.all_finite(ORDER)).withColumn("regression_weight", F.lit(1.0))).factor_returns(), f'WITH {OLS_FIT} SELECT date, any_value(i) AS "INTERCEPT", any_value(f1) AS "SIZE", any_value(f2) AS "MOM" FROM s2 GROUP BY date', '"INTERCEPT" "SIZE" "MOM"', 12)
BETA_FIT = fit_sql(f"SELECT u0.*, beta FROM u0 JOIN ({BETA_SQL}) USING (date, ticker)", (("MKT", "beta", False), ("SIZE", "size_x", True), ("MOM", "mom_x", True)))
register("recursive_beta", lambda s, d: beta_sections(s, d).select("date", "ticker", F.col("MKT").alias("beta")), BETA_SQL, "beta")
register("beta_fit_f", lambda s, d: BETA_RESIDUALIZER.fit(written(beta_sections(s, d), "sections")).factor_returns(), f'WITH {BETA_FIT} SELECT date, any_value(i) AS "INTERCEPT", any_value(f1) AS "MKT", any_value(f2) AS "SIZE", any_value(f3) AS "MOM" FROM s3 GROUP BY date', '"INTERCEPT" "MKT" "SIZE" "MOM"')


#: The scan's own fits, with the built-in residualizer and with one's own in its place.
for name, residualizer in (("beta_scan_f", BETA_RESIDUALIZER), ("beta_plugin_f", fit.kernel_residualizer(BETA_ORDER, WINSOR, unscaled=("MKT",)))):
    QUERIES[name] = lambda s, d, r=residualizer: rounded(BETA_MODEL.fit(ordered_rows(s, d, BETA_MODEL), r).factor_returns())
    ORACLE[name] = ORACLE["beta_fit_f"]

RVOL_MODEL = volatility.ResidualVolatility(factors.CharacteristicModel((factors.volatility_factor(12, 8),)), "VOL", 0.9)
RVOL_RESIDUALIZER = fit.sequential_wls(("RVOL",))
#: The same fold in SQL: a step a date over all names' variances, with the one-factor fit of the date.
RVOL_SQL = f"""WITH RECURSIVE
  days AS (SELECT date, row_number() OVER (ORDER BY date) AS j FROM (SELECT DISTINCT date FROM uni)),
  names AS (SELECT DISTINCT ticker FROM uni),
  mem AS (SELECT j, date, uni.ticker, ret, w, vol_x FROM uni JOIN days USING (date) LEFT JOIN x USING (date, ticker)),
  grid AS (SELECT days.j, days.date, names.ticker, mem.ticker IS NOT NULL AS member, ret, w, vol_x FROM days CROSS JOIN names LEFT JOIN mem ON mem.j = days.j AND mem.ticker = names.ticker),
  s AS (
    SELECT 0::BIGINT AS j, NULL::DATE AS date, ticker, NULL::DOUBLE AS v, NULL::DOUBLE AS read, NULL::DOUBLE AS eps, NULL::DOUBLE AS i, NULL::DOUBLE AS f, false AS member FROM names
    UNION ALL
    SELECT j, date, ticker, CASE WHEN use AND spread > 0 THEN {RVOL_MODEL.decay} * read ** 2 + (1 - {RVOL_MODEL.decay}) * (ret - i - f * z) ** 2 ELSE v END, read,
           CASE WHEN use AND spread > 0 THEN ret - i - f * z END, i, f, member
    FROM (SELECT *, sum(CASE WHEN use THEN w * z * (ret - i) END) OVER () / sum(CASE WHEN use THEN w * z * z END) OVER () AS f FROM (
      SELECT *, (read - c) / spread AS z FROM (
        SELECT *, sqrt(sum(CASE WHEN use THEN w * (read - c) ** 2 END) OVER () / sum(CASE WHEN use THEN w END) OVER ()) AS spread FROM (
          SELECT *, sum(CASE WHEN use THEN w * read END) OVER () / sum(CASE WHEN use THEN w END) OVER () AS c, sum(CASE WHEN use THEN w * ret END) OVER () / sum(CASE WHEN use THEN w END) OVER () AS i FROM (
            SELECT *, ready AND count(CASE WHEN ready THEN 1 END) OVER () > 2 AS use FROM (
              SELECT grid.j, grid.date, s.ticker, s.v, coalesce(sqrt(s.v), vol_x) AS read, grid.member, ret, w, coalesce(grid.member AND ret IS NOT NULL AND w > 0 AND coalesce(sqrt(s.v), vol_x) IS NOT NULL, false) AS ready
              FROM s JOIN grid ON grid.j = s.j + 1 AND grid.ticker = s.ticker))))))
  )"""
register("residual_volatility", lambda s, d: RVOL_MODEL.sections(ordered_rows(s, d, RVOL_MODEL), RVOL_RESIDUALIZER).select("date", "ticker", "RVOL"), f'{RVOL_SQL} SELECT date, ticker, read AS "RVOL" FROM s WHERE member', '"RVOL"')
register("residual_volatility_epsilon", lambda s, d: RVOL_MODEL.fit(ordered_rows(s, d, RVOL_MODEL), RVOL_RESIDUALIZER).specific_returns(), f"{RVOL_SQL} SELECT date, ticker, eps AS specific_return FROM s WHERE eps IS NOT NULL", "specific_return")


def two_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Betas of two models, the long universe and the short list, scanned side by side in one job."""
    rows = [ordered_rows(spark, sf_dir, BETA_MODEL, size).withColumn("names", F.lit(size)) for size in (SIZE, LIST)]
    return BETA_MODEL.scan(rows[0].unionByName(rows[1]), BETA_RESIDUALIZER, ("names",)).select("names", "date", "ticker", F.col("MKT").alias("beta"))


register("beta_two_models", two_models)
ORACLE["beta_two_models"] = " UNION ALL ".join(f"SELECT {size}::INT AS names, date, ticker, round(beta, 8) + 0.0 AS beta FROM (WITH {ctes(size).strip()} SELECT * FROM ({BETA_SQL}))" for size in (SIZE, LIST))


MONDAY = dt.date(1990, 1, 1)


def dated_by_day(spark: SparkSession, sf_dir: str, start: dt.date) -> tuple[FrameSource, calendar.AnalysisWindow]:
    """The panel with its weeks dated as business days, by which runs count history, and the window from ``start`` on."""
    own = source(spark, sf_dir).frame
    before = own.where(F.col("date") < F.lit(start)).agg(F.count_distinct("date")).first()[0]
    daily = calendar.with_ordinals(own).withColumn("date", F.date_add(F.lit(MONDAY), F.expr("cast((k - 1) div 5 * 7 + (k - 1) % 5 as int)"))).drop("k")
    return FrameSource(daily), calendar.AnalysisWindow(MONDAY + dt.timedelta(days=before // 5 * 7 + before % 5), dt.date(2100, 1, 1))


#: With some ten names, as at the smallest scale, a tenth of the weeks have too few usable rows for a fit.
CHECKS = (validate.CoverageValidation(0.8), validate.FiniteOutputValidation(), validate.ReconstructionValidation(), validate.OrthogonalityValidation(), validate.SequentialOrthogonalityValidation())


def whole_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run from source to checked tables: their rows and sums."""
    daily, window = dated_by_day(spark, sf_dir, WINDOW.start)
    result = run_pipeline(source=daily, window=window, universe_builder=universe.DailyTopUniverse(SIZE), factors=BETA_MODEL, weights=weights.SquareRootCapWeights(), residualizer=BETA_RESIDUALIZER)
    folder = working_folder(spark, "run")
    tables = {r.artifact: spark.read.parquet(r.path) for r in publish(result, folder, CHECKS).collect()}
    result.release()
    f, e = tables["f"], tables["epsilon"]
    return e.agg(F.count("*").alias("rows"), F.sum(F.abs("specific_return")).alias("residuals")).join(f.agg(F.count("*").alias("dates"), F.sum(F.abs("MKT")).alias("market"), F.sum(F.abs("MOM")).alias("momentum")))


register("whole_run", whole_run, f"WITH {BETA_FIT} SELECT * FROM (SELECT count(*) AS rows, sum(abs(rest)) AS residuals FROM s3), (SELECT count(*) AS dates, sum(abs(f2)) AS market, sum(abs(f3)) AS momentum FROM (SELECT date, any_value(f1) AS f2, any_value(f3) AS f3 FROM s3 GROUP BY date))", "residuals market momentum", 7)
register("padded_codes", lambda s, d: panel(s, d).select(F.expr("cast(cast(ticker as bigint) * 7919 as string)").alias("code")).distinct().select("code", padded_ticker(F.col("code")).alias("ticker")), f"SELECT code, {padded_sql('code')} AS ticker FROM (SELECT DISTINCT (ticker::BIGINT * 7919)::VARCHAR AS code FROM panel)")
def as_text(field: T.StructField) -> Column:
    """Times and lists as text, other columns as they are."""
    if isinstance(field.dataType, T.TimestampType):
        return F.date_format(field.name, "yyyy-MM-dd HH:mm:ss").alias(field.name)
    if isinstance(field.dataType, T.ArrayType):
        own = F.col(field.name)
        return F.array_join(F.transform(own, lambda v: v.cast("decimal(24,3)")) if isinstance(field.dataType.elementType, T.DoubleType) else own, " ").alias(field.name)
    return F.col(field.name)


register(
    "historical_events",
    lambda s, d: events.historical_events(daily_universe(s, d), prepared(s, d), prepared(s, d).select("date", "ticker", weights.SquareRootCapWeights().column().alias("regression_weight")), "TEST", "1w").select(*(as_text(c) for c in events.EVENT.fields)),
    """SELECT event_id, row_number() OVER (ORDER BY date, o, ticker) - 1 AS source_sequence, kind, 'TEST' AS market, '1w' AS interval, strftime(date, '%Y-%m-%d %H:%M:%S') AS as_of, strftime(date, '%Y-%m-%d %H:%M:%S') AS known_at, CASE WHEN o = 1 THEN strftime(date, '%Y-%m-%d %H:%M:%S') END AS effective_at, ticker, return_value, tickers, regression_weights FROM (
      SELECT 'TEST:1w:' || date || 'T00:00:00:open' AS event_id, date, 0 AS o, 'period_opened' AS kind, NULL AS ticker, NULL AS return_value, string_agg(ticker, ' ' ORDER BY ticker) AS tickers, string_agg(w::DECIMAL(24, 3)::VARCHAR, ' ' ORDER BY ticker) AS regression_weights FROM uni JOIN x USING (date, ticker) WHERE w > 0 GROUP BY date
      UNION ALL SELECT 'TEST:1w:' || date || 'T00:00:00:return:' || ticker, date, 1, 'return_observed', ticker, ret, NULL, NULL FROM uni JOIN x USING (date, ticker) WHERE w > 0 AND ret IS NOT NULL
      UNION ALL SELECT 'TEST:1w:' || date || 'T00:00:00:close', date, 2, 'period_closed', NULL, NULL, NULL, NULL FROM (SELECT DISTINCT date FROM uni))""",
    "return_value",
)
register("event_dedup", lambda s, d: events.deduplicated(s.read.parquet(f"{d}/events.parquet").select(F.concat("event_type", F.lit(":"), F.col("user_id").cast("string")).alias("event_id"), F.col("user_id").alias("content"), F.col("event_id").alias("offset"))))
ORACLE["event_dedup"] = "SELECT event_id, content, \"offset\" FROM (SELECT event_type || ':' || user_id AS event_id, user_id AS content, event_id AS \"offset\", row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS r FROM events) WHERE r = 1"
register("log_gaps", lambda s, d: events.gaps(s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("offset"))), None)
ORACLE["log_gaps"] = "SELECT \"offset\", prior FROM (SELECT event_id AS \"offset\", lag(event_id) OVER (ORDER BY event_id) AS prior FROM events) WHERE \"offset\" <> coalesce(prior, 0) + 1"
register("after_offset", lambda s, d: s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("offset"), "user_id").where("offset > 500"), None)
ORACLE["after_offset"] = "SELECT event_id AS \"offset\", user_id FROM events WHERE event_id > 500"


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history as logged events, replayed by a stream: final rows. Each year is a market of its own, so years run beside one another."""
    own, members = prepared(spark, sf_dir), daily_universe(spark, sf_dir)
    w = own.select("date", "ticker", weights.SquareRootCapWeights().column().alias("regression_weight"))
    history = events.with_frozen(events.historical_events(members, own, w, "TEST", "1w"), MODEL.exposures(own), ORDER)
    logged = history.withColumn("market", F.concat(F.lit("TEST"), F.year("as_of").cast("string"))).withColumn("offset", F.col("source_sequence") + 1)
    rows = written(logged, "events")
    folder = working_folder(spark, "replay")
    source = spark.readStream.schema(rows.schema).parquet(rows.inputFiles()[0].rsplit("/", 1)[0])
    finals = live.stream(source, [live.LiveModel("v1", RESIDUALIZER)], finals_only=True)
    query = finals.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(finals.schema).parquet(f"{folder}/rows")


def live_finals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a period, from the live results: coefficients and the fit's record."""
    one = replayed(spark, sf_dir).where("status = 'final'").groupBy(F.col("as_of").cast("date").alias("date")).agg(F.first("factor_returns").alias("f"), F.first("n_observations").cast("long").alias("n_observations"), F.first("rank").alias("rank"), F.first("r_squared").alias("r_squared"), F.first("centers").alias("c"), F.first("scales").alias("s"))
    return one.select("date", *(F.col("f")[i].alias(n) for i, n in enumerate(("INTERCEPT", *ORDER))), "n_observations", "rank", "r_squared", F.col("c")[0].alias("center_size"), F.col("s")[1].alias("scale_mom"))


register("live_finals", live_finals, """SELECT date, any_value(a) AS "INTERCEPT", any_value(f1) AS "SIZE", any_value(f2) AS "MOM", count(*) AS n_observations, 3::INT AS rank, 1 - sum(w * eps * eps) / sum(w * (ret - a) ** 2) AS r_squared, any_value(c1) AS center_size, any_value(s2) AS scale_mom FROM e GROUP BY date""", '"INTERCEPT" "SIZE" "MOM" r_squared center_size scale_mom')
