"""Progress of a run or a stream on a terminal, or none."""

from __future__ import annotations

import sys
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Protocol, TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

from crossfactor.operators.report import profile

#: Rows of a table that a preview shows.
PREVIEW = 3


class Progress(Protocol):
    def stage(self, name: str): ...

    def update(self, text: str) -> None: ...

    def table(self, name: str, frame: DataFrame) -> None: ...

    def summary(self, text: str) -> None: ...


class NullProgress:
    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        yield

    def update(self, text: str) -> None:
        pass

    def table(self, name: str, frame: DataFrame) -> None:
        pass

    def summary(self, text: str) -> None:
        pass


def tasks_done(spark: SparkSession) -> str | None:
    """Tasks done of the stages that run now, and how many run; None between stages."""
    tracker = spark.sparkContext.statusTracker()
    found = [i for stage in tracker.getActiveStageIds() if (i := tracker.getStageInfo(stage)) is not None]
    if not found:
        return None
    failed = sum(i.numFailedTasks for i in found)
    return f"{sum(i.numCompletedTasks for i in found):,} of {sum(i.numTasks for i in found):,} tasks done, {sum(i.numActiveTasks for i in found):,} running" + (f", {failed:,} failed" if failed else "")


@contextmanager
def watched(spark: SparkSession | None, tell: Callable[[str], None], every: float) -> Iterator[None]:
    """While the block runs, tell how far Spark's tasks are, whenever that changes."""
    if spark is None:
        yield
        return
    over = threading.Event()

    def watch() -> None:
        last = None
        while not over.wait(every):
            now = tasks_done(spark)
            if now is not None and now != last:
                tell(now)
                last = now

    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()


class StreamProgress(StreamingQueryListener):
    """A line a micro-batch: its rows, rows a second, and rows of state; and one when a query ends."""

    def __init__(self, stream: TextIO | None = None) -> None:
        self.stream = stream or sys.stderr

    def onQueryStarted(self, event) -> None:  # noqa: N802
        print(f"{event.name or event.id}: started", file=self.stream, flush=True)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        held = sum(s.numRowsTotal for s in p.stateOperators)
        print(f"{p.name or p.id}: batch {p.batchId}, {p.numInputRows:,} rows, {p.processedRowsPerSecond:,.0f} rows/s, {held:,} rows of state", file=self.stream, flush=True)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        print(f"{event.id}: " + ("ended" if event.exception is None else f"failed: {event.exception.splitlines()[0]}"), file=self.stream, flush=True)


class TerminalProgress:
    """A line when a stage begins and ends, and at most one in ``every`` seconds within it; colors only on a terminal.

    ``previews`` shows of each stage's table the counts and the first rows, at the price of a job. With a session, a stage's
    lines also say how many of its tasks are done, as Spark's status tracker has it.
    """

    def __init__(self, total: int, stream: TextIO | None = None, color: bool | None = None, previews: bool = False, every: float = 0.5, spark: SparkSession | None = None) -> None:
        self.total, self.done, self.stream, self.spark = total, 0, stream or sys.stderr, spark
        self.previews, self.every, self.shown = previews, every, float("-inf")
        self.color = self.stream.isatty() if color is None else color

    def paint(self, text: str, code: int) -> str:
        return f"\x1b[{code}m{text}\x1b[0m" if self.color else text

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        self.done += 1
        label, began = f"[{self.done}/{self.total}] {name}", time.monotonic()
        print(self.paint(label, 36), file=self.stream, flush=True)
        try:
            with watched(self.spark, self.update, self.every):
                yield
        except BaseException:
            print(self.paint(f"{label} failed", 31), file=self.stream, flush=True)
            raise
        print(self.paint(f"{label} done in {time.monotonic() - began:.1f} s", 32), file=self.stream, flush=True)

    def update(self, text: str) -> None:
        now = time.monotonic()
        if now - self.shown >= self.every:
            self.shown = now
            print(f"  {text}", file=self.stream, flush=True)

    def table(self, name: str, frame: DataFrame) -> None:
        if self.previews:
            counts = ", ".join(f"{value:,} {what}" for what, value in profile(frame).first().asDict().items())
            rows = "\n".join("    " + ", ".join(f"{k}={v}" for k, v in row.asDict().items()) for row in frame.limit(PREVIEW).collect())
            print(f"  {name}: {counts}\n{rows}", file=self.stream, flush=True)

    def summary(self, text: str) -> None:
        print(text, file=self.stream, flush=True)
