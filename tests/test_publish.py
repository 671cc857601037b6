"""Checks observed while tables are staged, momentum by running sums, Python factors, progress from Spark."""

from __future__ import annotations

import datetime as dt
import io
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_fit import market

from crossfactor.functions.columns import by_ticker, finite
from crossfactor.operators import factors, fit, validate
from crossfactor.operators.calendar import AnalysisWindow
from crossfactor.operators.universe import DailyTopUniverse
from crossfactor.operators.weights import SquareRootCapWeights
from crossfactor.plans.pipeline import Result, prepared_panel, run_pipeline
from crossfactor.progress import StreamProgress, TerminalProgress
from crossfactor.sources.artifacts import publish, write_csv
from crossfactor.sources.market import FrameSource

CHECKS = (validate.CoverageValidation(0.9), validate.FiniteOutputValidation(), validate.ReconstructionValidation(), validate.OrthogonalityValidation(), validate.SequentialOrthogonalityValidation())


@pytest.fixture(scope="module")
def result(spark):
    dates, panel = market(spark)
    model = factors.CharacteristicModel((factors.size_factor(), factors.momentum_factor(5, 1, 3)))
    return run_pipeline(source=FrameSource(panel), window=AnalysisWindow(dates[10], dates[-1]), universe_builder=DailyTopUniverse(15), factors=model, weights=SquareRootCapWeights(), residualizer=fit.sequential_wls(("SIZE", "MOM"), 0.01))



def test_tables_and_checks_come_of_the_same_jobs(result, spark, tmp_path):
    target = str(tmp_path / "out")
    manifest = {r.artifact: r.rows for r in publish(result, target, CHECKS, files=1).collect()}
    assert manifest == {"epsilon": 300, "r": 300, "X": 300, "f": 20}
    tables = {n: spark.read.parquet(f"{target}/{n}.parquet") for n in manifest}
    wanted = result.tables()
    for name, frame in tables.items():
        assert frame.columns == wanted[name].columns and frame.exceptAll(wanted[name]).isEmpty() and frame.count() == manifest[name]
    for check in CHECKS:
        assert check.validate(result).passed


def test_csv(result, spark, tmp_path):
    write_csv(result, str(tmp_path))
    f = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "f.csv"))
    assert f.columns == ["date", "INTERCEPT", "SIZE", "MOM"] and f.count() == 20


@pytest.mark.parametrize(
    ("change", "check", "message"),
    [
        (lambda: {"specific_return": F.when(F.col("ticker") == "000019", None).otherwise(F.col("specific_return"))}, validate.FiniteOutputValidation(), "not finite"),
        (lambda: {"return": F.col("return") + 1e-6}, validate.ReconstructionValidation(), "return_reconstruction"),
        (lambda: {"specific_return": F.col("specific_return") + F.col("__q1") / 1000}, validate.OrthogonalityValidation(), "residual_orthogonality"),
        (lambda: {"return": F.col("return") + F.col("__q1") / 1000}, validate.SequentialOrthogonalityValidation(), "sequential_orthogonality"),
        (lambda: {"specific_return": F.lit(float("nan"))}, validate.OrthogonalityValidation(), "inf"),
    ],
)
def test_failing_checks_leave_the_old_tables(result, spark, tmp_path, change, check, message):
    target = tmp_path / "out"
    publish(result, str(target), files=1)
    before = sorted(p.name for p in target.rglob("part-*"))
    broken = Result(fit.Fitted(result.fitted.rows.withColumns(change()), result.fitted.factors), result.universe)
    with pytest.raises(validate.ValidationError, match=message):
        publish(broken, str(target), (check,))
    observed = check.validate(broken)
    assert not observed.passed
    assert sorted(p.name for p in target.rglob("part-*")) == before and not list(target.glob(".staging*"))


def test_coverage_counts_dates_without_a_fit(result, tmp_path):
    few = Result(fit.Fitted(result.fitted.rows.where(F.dayofmonth("date") < 20), result.fitted.factors), result.universe)
    with pytest.raises(validate.ValidationError, match="of 20 dates"):
        publish(few, str(tmp_path / "out"), (validate.CoverageValidation(0.9),))


def framed_momentum(lookback, skip, least):
    """Momentum over a sliding frame, whose cost grows with the lookback."""
    frame = by_ticker().rangeBetween(-(lookback + skip - 1), -skip)
    r = F.col("return")
    valid = finite(r) & (r > -1)
    crash = F.when(r.isNotNull() & ~F.isnan(r) & (r <= -1), 1).otherwise(0)
    return F.when((F.count(F.when(valid, 1)).over(frame) >= least) & (F.max(crash).over(frame) == 0), F.expm1(F.sum(F.when(valid, F.log1p(r))).over(frame)))


@pytest.fixture(scope="module")
def long_panel(spark):
    """Names with gaps, nulls, infinities and crashes over 1,300 sessions."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(1300):
        date = dt.date(2000, 1, 1) + dt.timedelta(days=k)
        for i in range(12):
            if rng.random() < 0.95:
                r = rng.choice([rng.normal(scale=2), np.nan, np.inf, -100.0, -120.0], p=[0.996, 0.001, 0.001, 0.001, 0.001])
                rows.append((date, f"{i:06d}", None if rng.random() < 0.01 else float(r), 1e9))
    return prepared_panel(spark.createDataFrame(rows, "date date, ticker string, return_percent double, market_cap double")).persist()


@pytest.mark.parametrize("windows", [(12, 4, 8), (252, 21, 100), (1008, 252, 500), (1, 1, 1)])
def test_momentum_by_running_sums_is_the_frames(long_panel, windows):
    own = long_panel.select("date", "ticker", factors.momentum_factor(*windows).build().alias("a"), framed_momentum(*windows).alias("b"))
    row = own.agg(F.count("a").alias("a"), F.count("b").alias("b"), F.max(F.abs(F.col("a") - F.col("b")) / (1 + F.abs("b"))).alias("error"), F.count_if(F.col("a").isNull() != F.col("b").isNull()).alias("differ")).first()
    assert row.a == row.b > 0 and row.differ == 0 and row.error < 1e-12


def test_python_factors_beside_columns(long_panel):
    def last_valid(k, r, caps):
        out, held = np.full(len(k), np.nan), np.nan
        for i, x in enumerate(r):
            out[i] = held
            held = x if np.isfinite(x) else held
        return out

    model = factors.CharacteristicModel((factors.size_factor(), factors.PythonFactor("LAST", last_valid, 1), factors.reversal_factor()))
    got = model.exposures(long_panel)
    assert got.columns == [*long_panel.columns, "SIZE", "LAST", "REV"] and got.count() == long_panel.count()
    rows = [r for r in got.where("ticker = '000003'").orderBy("k").collect()]
    held = None
    for r in rows:
        assert r.LAST == held
        held = r["return"] if r["return"] is not None and np.isfinite(r["return"]) else held
    with pytest.raises(ValueError):
        factors.PythonFactor("", last_valid, 0)
    with pytest.raises(ValueError, match="dense"):
        model.dense(long_panel, largest=100)


def test_progress_of_tasks(spark):
    out = io.StringIO()
    progress = TerminalProgress(1, out, every=0.05, spark=spark)
    with progress.stage("Slow"):
        spark.range(0, 8, 1, 8).select(F.expr("java_method('java.lang.Thread', 'sleep', 300L)")).write.format("noop").mode("overwrite").save()
    said = out.getvalue()
    assert "of 8 tasks done" in said and "[1/1] Slow done" in said


def test_progress_of_streams(spark, tmp_path):
    out = io.StringIO()
    listener = StreamProgress(out)
    spark.streams.addListener(listener)
    try:
        query = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 50).option("numPartitions", 1).load().writeStream.format("noop").queryName("rates").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
        query.awaitTermination(60)
        ends = time.monotonic() + 30
        while "ended" not in out.getvalue() and time.monotonic() < ends:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert "rates: started" in out.getvalue() and "batch 0, 50 rows" in out.getvalue() and "ended" in out.getvalue()
