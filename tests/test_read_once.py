"""How often the kept panel is read, and what is done to each of its rows."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from test_fit import market

from crossfactor.operators.beta import RecursiveBeta
from crossfactor.operators.calendar import AnalysisWindow, sessions
from crossfactor.operators.factors import CharacteristicModel, momentum_factor, size_factor
from crossfactor.operators.universe import MAX_SENT, DailyTopUniverse, sent_if_small
from crossfactor.operators.weights import SquareRootCapWeights
from crossfactor.plans import queries
from crossfactor.plans.pipeline import member_rows, prepared_panel
from crossfactor.sources.market import FrameSource, weekly_panel
from crossfactor.sources.working import written

SMALL = "/root/testdata/sf0.001"


def kept_reads(frame: DataFrame) -> int:
    leaves = frame._jdf.queryExecution().withCachedData().collectLeaves()
    return sum(leaves.apply(i).nodeName().startswith("InMemoryRelation") for i in range(leaves.size()))


def test_scan_reads_the_calendar_once_made(spark):
    """The rows of members, and of the bootstrap the first members' calendar, their rows, and the history: no calendar of the whole panel with each."""
    assert 0 < kept_reads(queries.ordered_rows(spark, SMALL, queries.BETA_MODEL)) <= 4


def test_universe_reads_the_calendar_once(spark):
    """The counts, the leading rows, and the sessions."""
    source = queries.source(spark, SMALL)
    assert 0 < kept_reads(DailyTopUniverse(5).build(source, queries.WINDOW)) <= 3


def test_universe_of_a_given_calendar_reads_the_panel_twice(spark):
    """The counts and the leading rows: sessions and the snapshot before come from the calendar, with the same members."""
    frame = queries.source(spark, SMALL).frame
    days = written(sessions(frame), "calendar")
    own, whole = (DailyTopUniverse(5).build(FrameSource(frame, d), queries.WINDOW) for d in (days, None))
    assert kept_reads(own) == 2
    assert sorted(own.collect()) == sorted(whole.collect()) and own.count() > 0


def test_counted_members_are_sent_whatever_the_threshold(spark):
    """Under a low threshold the whole panel was shuffled and sorted to meet the members."""
    joins = lambda frame: [line for line in frame._jdf.queryExecution().sparkPlan().toString().splitlines() if "LeftSemi" in line]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = joins(queries.ordered_rows(spark, SMALL, queries.BETA_MODEL))
        members = queries.members(spark, SMALL).select("date", "ticker")
        many = joins(queries.prepared(spark, SMALL).join(sent_if_small(members, MAX_SENT + 1), ["date", "ticker"], "left_semi"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(found) >= 3 and all("BroadcastHashJoin" in line for line in found)
    assert len(many) == 1 and "SortMergeJoin" in many[0]


def test_kept_partitions_are_by_date(spark):
    """So batches that a range of dates does not touch are passed over."""
    parts = {}
    for date, part, _ in sorted(queries.source(spark, SMALL).frame.select("date", F.spark_partition_id(), F.monotonically_increasing_id()).collect(), key=lambda r: r[2]):
        parts.setdefault(part, []).append(date)
    assert sum(map(len, parts.values())) > 1000 and all(dates == sorted(dates) for dates in parts.values())


def test_a_count_changes_no_row(spark):
    dates, panel = market(spark)
    universe = DailyTopUniverse(4).build(FrameSource(panel), AnalysisWindow(dates[15], dates[-1])).persist()
    model = RecursiveBeta(CharacteristicModel((size_factor(), momentum_factor(3, 1, 2))), 10, 8, 0.9)
    rows = [sorted(member_rows(prepared_panel(panel), universe, model, SquareRootCapWeights(), None, count).collect(), key=lambda r: (r.date, r.ticker)) for count in (None, universe.count(), MAX_SENT + 1)]
    assert len(rows[0]) == universe.count() > 0
    for other in rows[1:]:
        assert [(r.date, r.ticker) for r in other] == [(r.date, r.ticker) for r in rows[0]]
        assert all(x == pytest.approx(y, abs=1e-12) if isinstance(x, float) else x == y for a, b in zip(other, rows[0], strict=True) for x, y in zip(a, b, strict=True))


def test_bootstrap_filters_by_the_start_as_it_reads(spark):
    frame = queries.BETA_MODEL.bootstrap(queries.prepared(spark, SMALL), queries.members(spark, SMALL))
    assert "NestedLoop" not in frame._jdf.queryExecution().sparkPlan().toString() and frame.count() > 0


def test_bootstrap_of_an_empty_universe_is_empty(spark):
    _, panel = market(spark)
    universe = spark.createDataFrame([], "date date, ticker string, in_universe boolean, member_rank int")
    assert RecursiveBeta(CharacteristicModel((size_factor(),)), 10, 8, 0.9).bootstrap(prepared_panel(panel), universe).count() == 0


def test_a_given_calendar_changes_no_row(spark):
    dates, panel = market(spark)
    universe = DailyTopUniverse(4).build(FrameSource(panel), AnalysisWindow(dates[15], dates[-1])).persist()
    model = RecursiveBeta(CharacteristicModel((size_factor(), momentum_factor(3, 1, 2))), 10, 8, 0.9)
    days = sessions(panel).persist()
    a, b = ({(r.date, r.ticker): r.asDict() for r in member_rows(prepared_panel(panel, days=d), universe, model, SquareRootCapWeights(), d).collect()} for d in (None, days))
    assert a.keys() == b.keys() and len(a) > 0
    assert all(a[key][c] == pytest.approx(b[key][c], abs=1e-12) for key in a for c in a[key] if isinstance(a[key][c], float)) and any(r["initial_beta"] is not None for r in a.values())


def test_weekly_panel_pads_a_group_once_and_keeps_keys_apart(spark, tmp_path):
    day = lambda *ymd: dt.datetime(*ymd)
    keys = [None, -1, 0, 7, 999_999, 1_000_000, 7_000_000]
    stamps = [day(1998, 1, 4, 23, 59, 59), day(1998, 1, 5), day(1998, 1, 11, 12), day(1969, 12, 28), day(1969, 12, 29), None]
    rows = [(k, 100.0 + i, 0.1, None if i == 2 else 0.05, s) for k in keys for i, s in enumerate(stamps)]
    items = spark.createDataFrame(rows, "l_suppkey long, l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp_ntz")
    items.write.parquet(f"{tmp_path}/lineitem.parquet")
    panel = weekly_panel(spark, str(tmp_path))
    aggregate, *below = panel._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert "lpad" in aggregate and "lpad" not in "".join(below)
    weeks = {dt.date(1997, 12, 29), dt.date(1998, 1, 5), dt.date(1969, 12, 22), dt.date(1969, 12, 29), None}
    found = panel.collect()
    assert {(r.date, r.ticker) for r in found} == {(w, t) for w in weeks for t in (None, "0000-1", "000000", "000007", "999999", "1000000", "7000000")}
    assert len(found) == 5 * len(keys)
    one = panel.where((F.col("ticker") == "000007") & (F.col("date") == F.lit(dt.date(1998, 1, 5)))).first()
    assert one.market_cap == pytest.approx((101 + 102) * 0.9) and one.return_percent == pytest.approx(-5)
