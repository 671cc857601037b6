"""Events of a stream once each: the first of an id wins, equal repeats go, others come out as rejected."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from crossfactor.streaming.events import EVENT
from crossfactor.streaming.live import ROCKS

#: Keys of the state; ids are rows of a key's map, so a batch makes few calls.
BUCKETS = 256


def content() -> F.Column:
    """A digest of all that an event says, but its id."""
    return F.sha2(F.to_json(F.struct(*(c for c in EVENT.names if c != "event_id"))), 256)


class FirstWins(StatefulProcessor):
    """Digests by event id, kept for ``ttl`` milliseconds, or for good."""

    def __init__(self, columns: list[str], ttl: int | None) -> None:
        self.columns, self.ttl = columns, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.digests = handle.getMapState("digests", "event_id string", "digest string", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values("offset", kind="stable")
        first: dict[str, str] = {}
        for i in batch["event_id"].unique():
            if self.digests.containsKey((i,)):
                first[i] = self.digests.getValue((i,))[0]
        known = set(first)
        for i, digest in zip(batch["event_id"], batch["content"], strict=True):
            first.setdefault(i, digest)
        for i in first.keys() - known:
            self.digests.updateValue((i,), (first[i],))
        clash = batch["content"] != batch["event_id"].map(first)
        fresh = ~batch["event_id"].isin(known) & ~batch["event_id"].duplicated()
        out = batch[fresh | clash]
        clash = clash[fresh | clash]
        yield out[self.columns].assign(status=clash.map({True: "rejected", False: "accepted"}), error=clash.map({True: "conflicting content", False: None}))

    def close(self) -> None:
        pass


def first_wins(events: DataFrame, ttl: int | None = None) -> DataFrame:
    """Rows (event_id, offset, content and more) with ``status`` and ``error``: each id's first row by offset, and rows with other content.

    Within a batch rows count by offset; a row that comes in a later batch is later. With ``ttl``, an id's digest goes that many
    milliseconds after it came, and the id is new again.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    schema = T.StructType([*events.schema.fields, T.StructField("status", T.StringType()), T.StructField("error", T.StringType())])
    keyed = events.withColumn("__bucket", F.pmod(F.xxhash64("event_id"), F.lit(BUCKETS)))
    return keyed.groupBy("__bucket").transformWithStateInPandas(FirstWins(events.columns, ttl), schema, "append", "processingTime" if ttl else "none")
