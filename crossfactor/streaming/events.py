"""Events of live periods: schema, validation, identity, history as events.

A period opens with frozen members and weights, observes returns, and closes; an explicit close is
the watermark. Rows are flat, with columns of other kinds null.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossfactor.functions.columns import finite

KINDS = ("period_opened", "return_observed", "period_closed")
EVENT = (
    T.StructType()
    .add("event_id", "string")
    .add("source_sequence", "long")
    .add("kind", "string")
    .add("market", "string")
    .add("interval", "string")
    .add("as_of", "timestamp")
    .add("known_at", "timestamp")
    .add("effective_at", "timestamp")
    .add("ticker", "string")
    .add("return_value", "double")
    .add("tickers", T.ArrayType(T.StringType()))
    .add("regression_weights", T.ArrayType(T.DoubleType()))
)
LOGGED = T.StructType([T.StructField("offset", T.LongType()), *EVENT.fields])


@dataclass(frozen=True)
class PeriodKey:
    market: str
    interval: str
    as_of: dt.datetime


@dataclass(frozen=True)
class Event:
    """One event; which fields are set depends on its kind."""

    event_id: str
    source_sequence: int
    kind: str
    key: PeriodKey
    known_at: dt.datetime
    effective_at: dt.datetime | None = None
    ticker: str | None = None
    return_value: float | None = None
    tickers: tuple[str, ...] | None = None
    regression_weights: tuple[float, ...] | None = None

    def __post_init__(self) -> None:
        if not self.event_id or not self.key.market or not self.key.interval or self.source_sequence < 0:
            raise ValueError("event_id, market and interval are required and the sequence is not negative")
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind {self.kind!r}")
        opened, observed = self.kind == "period_opened", self.kind == "return_observed"
        if opened != (self.tickers is not None) or opened != (self.regression_weights is not None) or observed != (self.ticker is not None) or observed != (self.return_value is not None) or observed != (self.effective_at is not None):
            raise ValueError(f"fields do not belong to {self.kind}")
        if opened:
            if not self.tickers or len(set(self.tickers)) != len(self.tickers) or len(self.tickers) != len(self.regression_weights):
                raise ValueError("tickers must be unique, not empty, and as many as the weights")
            if not all(math.isfinite(w) and w > 0 for w in self.regression_weights):
                raise ValueError("weights must be positive and finite")
        if observed:
            if not math.isfinite(self.return_value):
                raise ValueError("returns must be finite")
            if (self.effective_at.tzinfo is None) != (self.known_at.tzinfo is None):
                raise ValueError("timestamps must be of one form")
            if self.known_at < self.effective_at:
                raise ValueError("an event is not known before it is effective")

    def canonical(self) -> str:
        """Compact JSON with sorted keys: the content that decides whether two events are equal."""
        return json.dumps({k: v for k, v in asdict(self).items() if v is not None}, sort_keys=True, separators=(",", ":"), default=dt.datetime.isoformat)

    def digest(self) -> str:
        return hashlib.sha256(self.canonical().encode()).hexdigest()

    @classmethod
    def parse(cls, text: str | dict) -> Event:
        given = dict(json.loads(text) if isinstance(text, str) else text)
        key = given.pop("key")
        if unknown := set(given) - set(cls.__dataclass_fields__) | set(key) - {"market", "interval", "as_of"}:
            raise ValueError(f"unknown fields {sorted(unknown)}")
        for name in ("known_at", "effective_at"):
            if given.get(name) is not None:
                given[name] = dt.datetime.fromisoformat(given[name])
        for name in ("tickers", "regression_weights"):
            if given.get(name) is not None:
                given[name] = tuple(given[name])
        return cls(key=PeriodKey(key["market"], key["interval"], dt.datetime.fromisoformat(key["as_of"])), **given)

    def row(self) -> tuple:
        return (self.event_id, self.source_sequence, self.kind, self.key.market, self.key.interval, self.key.as_of, self.known_at, self.effective_at, self.ticker, self.return_value, None if self.tickers is None else list(self.tickers), None if self.regression_weights is None else list(self.regression_weights))


def historical_events(universe: DataFrame, returns: DataFrame, regression_weights: DataFrame, market: str, interval: str) -> DataFrame:
    """Finished returns as events, one period a date, in replay order by ``source_sequence``.

    Members with a positive finite weight open the period; their finite returns are observed in ticker order.
    Sequence numbers are counted within a date and shifted by the dates before, so no task sorts all rows.
    """
    members = universe.where("in_universe").select("date", "ticker")
    rows = members.join(returns.select("date", "ticker", "return"), ["date", "ticker"], "left").join(regression_weights, ["date", "ticker"], "left")
    w = F.col("regression_weight")
    eligible = finite(w) & (w > 0)
    days = rows.groupBy("date").agg(F.sort_array(F.collect_list(F.when(eligible, F.struct("ticker", "regression_weight")))).alias("__open"))
    seen = rows.where(eligible & finite(F.col("return")))
    prefix = F.concat(F.lit(f"{market}:{interval}:"), F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss"))
    stamp = F.col("date").cast("timestamp")
    none = lambda kind: F.lit(None).cast(kind)

    def event(frame: DataFrame, order: int, suffix, kind: str, effective, ticker, value, tickers, weights) -> DataFrame:
        return frame.select("date", F.lit(order).alias("__o"), F.concat(prefix, suffix).alias("event_id"), F.lit(kind).alias("kind"), F.lit(market).alias("market"), F.lit(interval).alias("interval"), stamp.alias("as_of"), stamp.alias("known_at"), effective.alias("effective_at"), ticker.alias("ticker"), value.alias("return_value"), tickers.alias("tickers"), weights.alias("regression_weights"))

    opened = event(days, 0, F.lit(":open"), KINDS[0], none("timestamp"), none("string"), none("double"), F.col("__open.ticker"), F.col("__open.regression_weight"))
    observed = event(seen, 1, F.concat(F.lit(":return:"), "ticker"), KINDS[1], stamp, F.col("ticker"), F.col("return"), none("array<string>"), none("array<double>"))
    closed = event(days, 2, F.lit(":close"), KINDS[2], none("timestamp"), none("string"), none("double"), none("array<string>"), none("array<double>"))
    counts = seen.groupBy("date").agg(F.count("*").alias("__n"))
    before = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)  # a row a session
    starts = days.select("date").join(counts, "date", "left").select("date", F.coalesce(F.sum(F.coalesce("__n", F.lit(0)) + 2).over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("date").orderBy("__o", "ticker")
    out = opened.unionByName(observed).unionByName(closed).withColumn("__r", F.row_number().over(inside)).join(F.broadcast(starts), "date")
    return out.withColumn("source_sequence", F.col("__start") + F.col("__r") - 1).select(*(F.col(f"`{c}`") for c in EVENT.names))


def with_frozen(events: DataFrame, values: DataFrame, names: Sequence[str]) -> DataFrame:
    """Events with a column ``inputs``: on opening rows, the values (date, ticker and names) of the period's tickers, in their order.

    It is what a live model reads at the opening, so a stream of these events needs no other table.
    """
    own = F.transform("tickers", lambda t: F.struct(F.col("as_of").cast("date").alias("date"), t.alias("ticker")))
    opened = events.where(F.col("kind") == KINDS[0]).select("event_id", F.posexplode(own).alias("__at", "__row")).select("event_id", "__at", "__row.date", "__row.ticker")
    nan = lambda n: F.coalesce(F.col(n).cast("double"), F.lit(float("nan")))
    rows = opened.join(values.select("date", "ticker", *names), ["date", "ticker"], "left").groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("__at", *(nan(n).alias(n) for n in names)))).alias("__rows"))
    columns = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.col("__rows").getField(n) for n in names)))
    return events.join(rows.select("event_id", columns.alias("inputs")), "event_id", "left").select(*events.columns, "inputs")


def deduplicated(events: DataFrame, content: str = "content") -> DataFrame:
    """The first row of each event_id by offset; equal content only, else it raises."""
    w = Window.partitionBy("event_id")
    clash = F.min(content).over(w) != F.max(content).over(w)
    rows = events.withColumn(content, F.when(clash, F.raise_error(F.concat(F.lit("conflicting content for event "), F.col("event_id"))).cast(events.schema[content].dataType)).otherwise(F.col(content)))
    return rows.withColumn("__r", F.row_number().over(w.orderBy("offset"))).where("__r = 1").drop("__r")


def gaps(log: DataFrame) -> DataFrame:
    """(offset, prior) where offsets do not follow one another from 1. Offsets of a range lag within it; ranges join at their ends."""
    w = Window.partitionBy(F.expr("offset div 100000")).orderBy("offset")
    own = log.select("offset", F.lag("offset").over(w).alias("prior"))
    block = F.expr("offset div 100000")
    ends = log.groupBy(block.alias("__b")).agg(F.max("offset").alias("__last"))
    over = Window.orderBy("__b")  # a row a block of 100,000 offsets
    ends = ends.select("__b", F.lag("__last").over(over).alias("__before"))
    joined = own.withColumn("__b", block).join(ends, "__b", "left")
    prior = F.coalesce("prior", "__before")
    return joined.select("offset", prior.alias("prior")).where(F.col("offset") != F.coalesce("prior", F.lit(0)) + 1)
