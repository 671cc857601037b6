"""Working tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def temporary_folder() -> str:
    """One folder of this process, which goes with it."""
    path = tempfile.mkdtemp(prefix="crossfactor-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def working_folder(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; without the setting, in a temporary folder, which a local master alone can share."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = temporary_folder()
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet and read again: what several passes read is made once, and survives a lost executor."""
    path = working_folder(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
