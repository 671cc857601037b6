"""What the operators of this subpackage share: inputs, the shared folder, working tables, size-checked joins, tables in workers."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a broadcast table may take in memory, and what a row takes there besides its values.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 64

#: Bytes of text that a Python worker holds as arrays at a time.
SLICE_BYTES = 1 << 20

T = TypeVar("T")

#: Folders of working tables that the innermost ``working_tables`` removes.
folders: ContextVar[list[tuple[str, bool]] | None] = ContextVar("folders", default=None)

#: What this Python worker keeps between tasks: one operator's tables at a time.
residents: dict[Hashable, object] = {}


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local master, where all run on one machine, may go without the setting.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="crossfactor-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def working_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that ``written`` makes inside are removed at the end, but lasting ones: those pass to the block around."""
    outer, own = folders.get(), []
    token = folders.set(own)
    try:
        yield
    finally:
        folders.reset(token)
        for path, lasting in own:
            if not lasting:
                remove(spark, path)
            elif outer is not None:
                outer.append((path, False))


def written(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends there.

    ``lasting`` tables outlive the innermost ``working_tables``; outside of any, all stay until the folder goes.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if (own := folders.get()) is not None:
        own.append((path, lasting))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, value_bytes: int) -> bool:
    """Whether ``df``, a written table with rows of at most ``value_bytes``, is counted to be within the broadcast bound."""
    rows = BROADCAST_BYTES // (ROW_BYTES + value_bytes)
    return df.limit(rows + 1).count() <= rows


def sized(df: DataFrame, value_bytes: int) -> DataFrame:
    """A broadcast hint if the rows are within the bound; else a sort-merge join, whose hot keys adaptive execution splits."""
    return F.broadcast(df) if small(df, value_bytes) else df.hint("merge")


def text_or_empty() -> F.Column:
    return F.coalesce(F.col("text"), F.lit(""))


def sampled(rate: float) -> F.Column:
    """Whether a row is in the share ``rate`` of rows, by a hash of its id and text: fine enough for shares of a trillionth, and repeated ids don't fill the sample."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) < F.lit(int(rate * (1 << 40)))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` is called so in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def resident(key: Hashable, make: Callable[[], T]) -> T:
    """This worker's object ``key``. A worker serves the tasks of many operators, so another key drops what is held."""
    if key not in residents:
        vacate()
        residents[key] = make()
    return residents[key]


class Kept:
    """A table of about ``limit`` bytes at most, in two generations: when the young one fills half of that, it becomes the old one, and what was old and not asked for since goes."""

    def __init__(self, limit: int, row_bytes: int = 120) -> None:
        self.limit, self.row_bytes, self.held = limit, row_bytes, 0
        self.young: dict = {}
        self.old: dict = {}

    def missing(self, keys: set) -> list:
        """The keys that are not in the table; the others are young from now on."""
        if self.held > self.limit // 2:
            self.old, self.young, self.held = self.young, {}, 0
        new = keys.difference(self.young)
        self.put({k: self.old[k] for k in new if k in self.old})
        return [k for k in new if k not in self.old]

    def put(self, values: dict) -> None:
        self.young.update(values)
        self.held += sum(map(len, values)) + sum(map(len, filter(None, values.values()))) + self.row_bytes * len(values)


def tidy(keeps: bool = False):
    """Of a function from batches to batches: one that returns its task's memory at the end and, unless it ``keeps`` a resident, drops what other operators left."""

    def decorate(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
        @functools.wraps(task)
        def tidied(batches: Iterator) -> Iterator:
            if not keeps:
                vacate()
            try:
                yield from task(batches)
            finally:
                give_back()

        return tidied

    return decorate


def vacate() -> None:
    """Drop what other operators keep in this worker."""
    if residents:
        residents.clear()
        give_back()


def give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
