"""Market data sources: a protocol, yearly Parquet files, a DataFrame, and panels of the test tables."""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossfactor.functions.columns import padded_ticker

PANEL = T.StructType([T.StructField("date", T.DateType(), False), T.StructField("ticker", T.StringType(), False), T.StructField("return_percent", T.DoubleType()), T.StructField("market_cap", T.DoubleType())])
RAW = T.StructType([T.StructField("Date", T.TimestampNTZType()), T.StructField("Code", T.StringType()), T.StructField("ChangesRatio", T.DoubleType()), T.StructField("Marcap", T.DoubleType())])


class MarketDataSource(Protocol):
    """Where sessions and canonical rows come from. Bounds are calendar days, both included."""

    def latest_date(self, end: dt.date | None = None) -> dt.date: ...

    def trading_dates(self, start: dt.date, end: dt.date) -> DataFrame: ...

    def load(self, start: dt.date, end: dt.date, tickers: DataFrame | None = None) -> DataFrame: ...


@dataclass
class FrameSource:
    """A source over a DataFrame with the canonical columns. ``days`` has its dates, if they were made before: then sessions do not read the frame."""

    frame: DataFrame
    days: DataFrame | None = None

    @property
    def dates(self) -> DataFrame:
        return (self.frame if self.days is None else self.days).select("date")

    def within(self, rows: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
        return rows.where((F.col("date") >= F.lit(start)) & (F.col("date") <= F.lit(end)))

    def latest_date(self, end: dt.date | None = None) -> dt.date:
        rows = self.dates if end is None else self.dates.where(F.col("date") <= F.lit(end))
        found = rows.agg(F.max("date")).first()[0]
        if found is None:
            raise ValueError(f"no market data on or before {end}")
        return found

    def trading_dates(self, start: dt.date, end: dt.date) -> DataFrame:
        return self.within(self.dates, start, end).distinct().orderBy("date")

    def load(self, start: dt.date, end: dt.date, tickers: DataFrame | None = None) -> DataFrame:
        rows = self.within(self.frame, start, end).select("date", "ticker", "return_percent", "market_cap")
        return rows if tickers is None else rows.join(tickers.select("ticker").distinct(), "ticker", "left_semi").select("date", "ticker", "return_percent", "market_cap")


@dataclass
class YearlyParquetSource:
    """Files ``<prefix>-YYYY.parquet`` with Date, Code, ChangesRatio and Marcap.

    Years outside the range are not listed to Spark; the range predicate leaves the stored column
    bare, so it reaches the scan; tickers filter after padding, by a semi join.
    """

    spark: SparkSession
    directory: str
    prefix: str = "marcap"
    memo: dict[dt.date | None, dt.date] = field(default_factory=dict, repr=False)

    def paths(self) -> dict[int, str]:
        """Files by year, listed with the file system of the directory."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.directory)
        fs = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath() for s in fs.listStatus(hadoop)] if fs.exists(hadoop) else []
        found = {int(m[1]): str(p.toString()) for p in names if (m := re.fullmatch(rf"{re.escape(self.prefix)}-(\d{{4}})\.parquet", p.getName()))}
        if not found:
            raise FileNotFoundError(f"no {self.prefix}-YYYY.parquet in {self.directory}")
        return dict(sorted(found.items()))

    def scan(self, start: dt.date, end: dt.date) -> DataFrame | None:
        paths = [p for y, p in self.paths().items() if start.year <= y <= end.year]
        if not paths:
            return None
        rows = self.spark.read.schema(RAW).parquet(*paths)
        stamp = lambda d: F.lit(dt.datetime.combine(d, dt.time())).cast("timestamp_ntz")
        return rows.where((F.col("Date") >= stamp(start)) & (F.col("Date") < stamp(end + dt.timedelta(days=1))))

    def latest_date(self, end: dt.date | None = None) -> dt.date:
        if end not in self.memo:
            for year in sorted(self.paths(), reverse=True):
                if end is not None and year > end.year:
                    continue
                rows = self.scan(dt.date(year, 1, 1), min(end or dt.date.max, dt.date(year, 12, 31)))
                found = rows.agg(F.max("Date")).first()[0]
                if found is not None:
                    self.memo[end] = found.date()
                    break
            else:
                raise ValueError(f"no market data on or before {end}")
        return self.memo[end]

    def trading_dates(self, start: dt.date, end: dt.date) -> DataFrame:
        rows = self.scan(start, end)
        if rows is None:
            return self.spark.createDataFrame([], PANEL).select("date")
        return rows.select(F.to_date("Date").alias("date")).distinct().orderBy("date")

    def load(self, start: dt.date, end: dt.date, tickers: DataFrame | None = None) -> DataFrame:
        rows = self.scan(start, end)
        if rows is None:
            return self.spark.createDataFrame([], PANEL)
        rows = rows.select(F.to_date("Date").alias("date"), padded_ticker(F.col("Code")).alias("ticker"), F.col("ChangesRatio").alias("return_percent"), F.col("Marcap").alias("market_cap"))
        return rows if tickers is None else rows.join(tickers.select("ticker").distinct(), "ticker", "left_semi").select(*PANEL.names)


def write_yearly(panel: DataFrame, directory: str, prefix: str = "marcap") -> None:
    """Canonical rows as ``<prefix>-YYYY.parquet``, which ``YearlyParquetSource`` reads; written by one job.

    Parts follow the rows of a year, so a large year is many. A year that the directory has raises, and nothing is changed then.
    Rows without a date raise; an empty panel writes no year.
    """
    spark = panel.sparkSession
    day = F.when(F.col("date").isNull(), F.raise_error(F.lit("a row has no date")).cast("date")).otherwise(F.col("date"))
    rows = panel.select(day.cast("timestamp_ntz").alias("Date"), F.col("ticker").alias("Code"), F.col("return_percent").alias("ChangesRatio"), F.col("market_cap").alias("Marcap"))
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(directory).getFileSystem(spark._jsc.hadoopConfiguration())
    staging = f"{directory.rstrip('/')}/.staging-{uuid.uuid4().hex}"
    try:
        rows.withColumn("year", F.year("Date")).hint("rebalance", F.col("year")).write.partitionBy("year").parquet(staging)
        made = {str(s.getPath()): f"{prefix}-{int(m[1]):04d}.parquet" for s in fs.listStatus(at(staging)) if (m := re.fullmatch(r"year=(\d+)", s.getPath().getName()))}
        if have := sorted(name for name in made.values() if fs.exists(at(directory, name))):
            raise FileExistsError(f"{directory} has {', '.join(have)}")
        for path, name in made.items():
            if not fs.rename(at(path), at(directory, name)):
                raise OSError(f"{name} cannot be put into {directory}")
    finally:
        fs.delete(at(staging), True)


def require_unique(panel: DataFrame, keys: Sequence[str] = ("date", "ticker")) -> None:
    """Raise if a key repeats."""
    found = panel.groupBy(*keys).count().where("count > 1").head()
    if found is not None:
        raise ValueError(f"repeated key {tuple(found[k] for k in keys)}")


def weekly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main test panel: weeks and suppliers of ``lineitem``."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    day, net = F.trunc(F.col("l_shipdate").cast("date"), "week"), F.col("l_extendedprice").cast("double") * (1 - F.col("l_discount").cast("double"))
    # Whole numbers differ when padded: so they are grouped as they are, and padded once a group.
    rows = items.groupBy(day.alias("date"), "l_suppkey").agg((100 * (F.avg(F.col("l_tax").cast("double")) - F.avg(F.col("l_discount").cast("double")))).alias("return_percent"), F.sum(net).alias("market_cap"))
    return rows.select("date", padded_ticker(F.col("l_suppkey").cast("string")).alias("ticker"), "return_percent", "market_cap")


def event_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming test panel: days and users of ``events``."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.groupBy(F.to_date("ts").alias("date"), padded_ticker(F.col("user_id").cast("string")).alias("ticker"))
    return rows.agg((F.avg("value") / 10 - 5).alias("return_percent"), F.sum("value").alias("market_cap"))
