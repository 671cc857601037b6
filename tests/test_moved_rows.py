"""What leaves a task: universes, members and bootstraps move the rows they need, with the results of whole panels."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from test_fit import market

from crossfactor.operators.beta import RecursiveBeta
from crossfactor.operators.calendar import AnalysisWindow
from crossfactor.operators.factors import CharacteristicModel, long_term_reversal_factor, momentum_factor, size_factor
from crossfactor.operators.universe import DailyTopUniverse, leading
from crossfactor.operators.weights import SquareRootCapWeights
from crossfactor.plans import queries
from crossfactor.plans.pipeline import member_rows, prepared_panel, rows_read
from crossfactor.sources.market import FrameSource

MODEL = CharacteristicModel((size_factor(), momentum_factor(3, 1, 2), long_term_reversal_factor(2, 3, 1)))


@pytest.fixture(scope="module")
def inputs(spark):
    dates, panel = market(spark)
    window = AnalysisWindow(dates[15], dates[-1])
    return dates, panel, window, prepared_panel(panel).persist(), DailyTopUniverse(4).build(FrameSource(panel), window).persist()


def test_beta_fit_reads_written_sections(spark):
    """The fit reads its rows three times: the scan must not run with each."""
    frame = queries.QUERIES["beta_fit_f"](spark, "/root/testdata/sf0.001")
    assert "MapInArrow" not in frame._jdf.queryExecution().optimizedPlan().toString() and frame.count() > 0


@pytest.mark.parametrize("size", [1, 5, 40, 10_000])
def test_leading_rows_hold_the_ranks(spark, size):
    n = 400
    caps = [float((i * 7919) % 997) * 10.0 ** (i % 5) for i in range(n)] + [7e6] * 30 + [0.0, -0.0, -3.0, -3e9, 1e-300, float("inf"), float("-inf")]
    rows = [(dt.date(2020, 1, 1 + d), f"{i:06d}", c) for d in range(3) for i, c in enumerate(caps[d * 150 :])]
    panel = spark.createDataFrame(rows, "date date, ticker string, market_cap double")
    rank = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("market_cap"), "ticker"))
    ranked = lambda frame: {(r.date, r.ticker, r.r) for r in frame.withColumn("r", rank).where(F.col("r") <= size).select("date", "ticker", "r").collect()}
    few = leading(panel, size)
    assert ranked(few) == ranked(panel)
    assert size > 5 or few.count() < len(rows) / 4


def test_members_read_their_sessions_alone(inputs):
    _, _, _, panel, universe = inputs
    read = rows_read(panel, universe, MODEL.history_sessions)
    assert read.count() < panel.join(universe.select("ticker").distinct(), "ticker").count() < panel.count()
    rows = member_rows(panel, universe, MODEL, SquareRootCapWeights())
    whole = universe.select("date", "ticker").join(MODEL.exposures(panel).withColumn("regression_weight", SquareRootCapWeights().column()), ["date", "ticker"], "left")
    names = ("return", "lagged_cap", "regression_weight", *MODEL.names)
    a, b = ({(r.date, r.ticker): [r[c] for c in names] for r in frame.collect()} for frame in (rows, whole))
    assert a.keys() == b.keys() and len(a) > 0
    assert all(x == pytest.approx(y, abs=1e-12) if x is not None else y is None for k in a for x, y in zip(a[k], b[k], strict=True))
    assert all(any(v[i] is not None for v in a.values()) for i in range(len(names)))


def test_bootstrap_lags_the_rows_before_the_start_itself(inputs):
    """It takes no lags that the whole panel was sorted for, and later rows change nothing."""
    dates, _, _, panel, universe = inputs
    model = RecursiveBeta(MODEL, 10, 8, 0.9)
    unread = F.raise_error(F.lit("the whole panel was lagged")).cast("double")
    values = lambda frame: {r.ticker: r.initial_beta for r in frame.collect()}
    own = values(model.bootstrap(panel.withColumn("lagged_cap", unread), universe))
    assert len(own) > 0 and own == pytest.approx(values(model.bootstrap(panel.where(F.col("date") < F.lit(dates[15])), universe)), abs=1e-12)
