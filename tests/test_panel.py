"""Sources, calendar, universe, factors, weights: hand-made cases."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from crossfactor.functions.columns import padded_ticker
from crossfactor.operators import calendar, factors, universe, weights
from crossfactor.plans.pipeline import prepared_panel
from crossfactor.sources.market import PANEL, RAW, FrameSource, YearlyParquetSource, event_panel, require_unique, weekly_panel, write_yearly


def days(count: int, start: str = "2024-01-01") -> list[dt.date]:
    return [np.busday_offset(start, i, roll="forward").astype(dt.date) for i in range(count)]


def make(spark, rows):
    return spark.createDataFrame([(d, t, None if r is None else float(r), None if c is None else float(c)) for d, t, r, c in rows], PANEL)


def values(frame, column):
    return {(r["date"], r["ticker"]): r[column] for r in frame.collect()}


def test_lag_is_by_session_not_by_observation(spark):
    a, b, c = days(3)
    panel = make(spark, [(a, "A", 0, 100), (a, "B", 0, 400), (b, "A", 0, 900), (c, "A", 0, 1600), (c, "B", 0, 2500)])
    got = values(calendar.previous_session_values(panel, "market_cap"), "previous")
    assert got == {(a, "A"): None, (a, "B"): None, (b, "A"): 100, (c, "A"): 900, (c, "B"): None}


def test_fixed_universe_ignores_later_caps(spark):
    d = days(3)
    caps = {"A": [4, 1, 1], "B": [3, 1, 1], "C": [2, 1, 1000], "D": [1, 1000, 1000]}
    source = FrameSource(make(spark, [(d[i], t, 0, c[i]) for t, c in caps.items() for i in range(3)]))
    got = universe.FixedTopUniverse(3).build(source, calendar.AnalysisWindow(d[1], d[2])).collect()
    assert {(r.date, r.ticker) for r in got} == {(x, t) for x in d[1:] for t in "ABC"}
    with pytest.raises(ValueError):
        universe.FixedTopUniverse(3).build(source, calendar.AnalysisWindow(d[0], d[2]))
    with pytest.raises(ValueError):
        universe.FixedTopUniverse(0)


def test_daily_universe_uses_the_session_before(spark):
    d = days(3)
    caps = {"A": [1, 5, 9], "B": [3, 1, 9], "C": [2, 4, 9]}
    source = FrameSource(make(spark, [(d[i], t, 0, c[i]) for t, c in caps.items() for i in range(3)]))
    got = universe.DailyTopUniverse(2).build(source, calendar.AnalysisWindow(d[1], d[2])).collect()
    assert {(r.date, r.ticker) for r in got} == {(d[1], "B"), (d[1], "C"), (d[2], "A"), (d[2], "C")}


def test_root_cap_weights_lag(spark):
    a, b, c = days(3)
    panel = prepared_panel(make(spark, [(a, "A", 0, 100), (a, "B", 0, 400), (b, "A", 0, 900), (b, "B", 0, 1600), (c, "A", 0, 1), (c, "B", 0, 1)]))
    got = values(panel.select("date", "ticker", weights.SquareRootCapWeights().column().alias("w")), "w")
    assert got[(a, "A")] is None and (got[(b, "A")], got[(b, "B")], got[(c, "A")], got[(c, "B")]) == (10, 20, 30, 40)


def test_crash_poisons_momentum_and_missing_does_not(spark):
    d = days(8)
    rows = [(x, "CRASH", -100 if i == 2 else 1, 1) for i, x in enumerate(d)] + [(x, "MISSING", float("nan") if i == 2 else 1, 1) for i, x in enumerate(d)]
    rows += [(x, "INF", float("inf") if i == 2 else 1, 1) for i, x in enumerate(d)]
    model = factors.CharacteristicModel((factors.momentum_factor(3, 1, 2),))
    got = values(model.exposures(prepared_panel(make(spark, rows))), "MOM")
    assert got[(d[3], "CRASH")] is None
    assert math.isclose(got[(d[3], "MISSING")], 1.01**2 - 1) and math.isclose(got[(d[3], "INF")], 1.01**2 - 1)
    assert math.isclose(got[(d[6], "CRASH")], 1.01**3 - 1)


def test_same_day_return_does_not_move_exposure(spark):
    d = days(7)
    model = factors.CharacteristicModel((factors.size_factor(), factors.momentum_factor(3, 1, 3), factors.long_term_reversal_factor(3, 1, 3)))
    seen = []
    for last in (1, 90):
        rows = [(x, t, last if (i == 4 and t == "A") else i + 1, 100 + i) for i, x in enumerate(d) for t in "AB"]
        seen.append({(r.date, r.ticker): (r.SIZE, r.MOM, r.HML) for r in model.exposures(prepared_panel(make(spark, rows))).where(F.col("date") == F.lit(d[4])).collect()})
    assert seen[0] == seen[1]
    assert seen[0][(d[4], "A")][2] == -seen[0][(d[4], "A")][1]


def test_names_and_bounds():
    with pytest.raises(ValueError):
        factors.CharacteristicModel((factors.size_factor("A"), factors.size_factor("a")))
    with pytest.raises(ValueError):
        factors.Factor("Return", lambda: F.lit(1))
    with pytest.raises(ValueError):
        factors.momentum_factor(3, 1, 4)


def test_yearly_files(spark, tmp_path):
    for year in (2023, 2024):
        stamps = [dt.datetime(year, 3, 1 + i, 9) for i in range(5)]
        rows = [(s, code, 1.0, 2.0) for s in stamps for code in ("5930", "000660", "1234567")]
        spark.createDataFrame(rows, RAW).coalesce(1).write.parquet(str(tmp_path / f"marcap-{year}.parquet"))
    source = YearlyParquetSource(spark, str(tmp_path))
    assert source.latest_date() == dt.date(2024, 3, 5) and source.latest_date(dt.date(2024, 2, 1)) == dt.date(2023, 3, 5)
    assert [r.date for r in source.trading_dates(dt.date(2024, 3, 2), dt.date(2024, 3, 4)).collect()] == [dt.date(2024, 3, i) for i in (2, 3, 4)]
    got = source.load(dt.date(2023, 3, 5), dt.date(2024, 3, 1), spark.createDataFrame([("005930",), ("1234567",)], "ticker string"))
    assert sorted((r.date.year, r.ticker) for r in got.collect()) == [(2023, "005930"), (2023, "1234567"), (2024, "005930"), (2024, "1234567")]
    assert source.load(dt.date(1999, 1, 1), dt.date(1999, 2, 1)).schema.names == PANEL.names
    with pytest.raises(ValueError):
        source.latest_date(dt.date(2000, 1, 1))
    with pytest.raises(FileNotFoundError):
        YearlyParquetSource(spark, str(tmp_path / "none")).latest_date()
    plan = source.load(dt.date(2023, 3, 5), dt.date(2024, 3, 1))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(Date" in plan


def test_panel_as_yearly_files(spark, tmp_path):
    rows = [(dt.date(y, m, 1), t, None if t == "000002" else 1.5, float(m)) for y in (1999, 2000, 2001) for m in (1, 12) for t in ("000001", "000002", "1234567")]
    frame, folder = make(spark, rows), str(tmp_path / "years")
    write_yearly(frame, folder, "panel")
    assert sorted(p.name for p in (tmp_path / "years").iterdir() if not p.name.startswith(".")) == [f"panel-{y}.parquet" for y in (1999, 2000, 2001)]
    source = YearlyParquetSource(spark, folder, "panel")
    got = source.load(dt.date(1999, 12, 1), dt.date(2001, 1, 1))
    assert sorted(map(tuple, got.collect()), key=str) == sorted((r for r in rows if dt.date(1999, 12, 1) <= r[0] <= dt.date(2001, 1, 1)), key=str)
    with pytest.raises(FileExistsError):
        write_yearly(make(spark, [(dt.date(y, 1, 1), "A", 1.0, 1.0) for y in (2001, 2002)]), folder, "panel")
    assert sorted(source.paths()) == [1999, 2000, 2001] and source.load(dt.date(1999, 1, 1), dt.date(2002, 12, 31)).count() == len(rows)
    write_yearly(make(spark, []), folder, "panel")
    assert not [p for p in (tmp_path / "years").iterdir() if p.name.startswith(".staging")]


def test_padding_and_keys(spark):
    got = [r[0] for r in spark.createDataFrame([("1",), ("123456",), ("12345678",)], "c string").select(padded_ticker(F.col("c"))).collect()]
    assert got == ["000001", "123456", "12345678"]
    d = days(1)[0]
    with pytest.raises(ValueError):
        require_unique(make(spark, [(d, "A", 1, 1), (d, "A", 1, 1)]))


def test_windows_of_dates(spark):
    source = FrameSource(make(spark, [(dt.date(2024, 2, 29), "A", 1, 1)]))
    assert calendar.analysis_window(source, 1) == calendar.AnalysisWindow(dt.date(2023, 2, 28), dt.date(2024, 2, 29))
    assert calendar.history_start(dt.date(2024, 1, 1), 0) == dt.date(2024, 1, 1)
    assert calendar.history_start(dt.date(2024, 1, 8), 5) == dt.date(2023, 12, 25)


def test_panels_keep_long_keys_apart(spark, tmp_path):
    keys = spark.createDataFrame([(12,), (1234567,), (1234568,)], "k long")
    keys.selectExpr("timestamp'2024-01-01' as ts", "k as user_id", "1.0D as value").write.parquet(f"{tmp_path}/events.parquet")
    keys.selectExpr("date'2024-01-01' as l_shipdate", "k as l_suppkey", "1.0D as l_extendedprice", "0.1D as l_discount", "0.1D as l_tax").write.parquet(f"{tmp_path}/lineitem.parquet")
    for panel in (weekly_panel, event_panel):
        assert sorted(r.ticker for r in panel(spark, str(tmp_path)).collect()) == ["000012", "1234567", "1234568"]
