"""The sink of a run: four Parquet tables and their manifest."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from crossfactor.operators.fit import INTERCEPT
from crossfactor.operators.validate import Validation, ValidationError, dates_table
from crossfactor.plans.pipeline import Result

NAMES = ("epsilon", "r", "X", "f")


def replace(spark: SparkSession, source: str, target: str) -> None:
    """Put a folder in the place of another of its file system. The old one goes only once the new one stands there, and comes back if that fails."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    new, place, old = path(source), path(target), path(f"{target}.old-{uuid.uuid4().hex}")
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    had = fs.exists(place)
    if had and not fs.rename(place, old):
        raise OSError(f"cannot set {target} aside")
    if not fs.rename(new, place):
        if had:
            fs.rename(old, place)
        raise OSError(f"cannot move {source} to {target}")
    if had:
        fs.delete(old, True)


def write_artifacts(result: Result, directory: str, files: int | None = None) -> DataFrame:
    """Write all tables to a staging folder, then move each; returns (artifact, rows, path).

    ``files`` merges a table's files, for small runs; large ones keep a file a task.
    """
    tables, rows = result.tables(), []
    staging = f"{directory}/.staging-{uuid.uuid4().hex}"
    spark = result.universe.sparkSession
    try:
        for name in NAMES:
            out = tables[name] if files is None else tables[name].coalesce(files)
            out.write.option("compression", "zstd").parquet(f"{staging}/{name}.parquet")
        for name in NAMES:
            replace(spark, f"{staging}/{name}.parquet", f"{directory}/{name}.parquet")
            rows.append((name, spark.read.parquet(f"{directory}/{name}.parquet").count(), f"{directory}/{name}.parquet"))
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(staging)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return spark.createDataFrame(rows, "artifact string, rows long, path string")


def observed(frame: DataFrame, checks: Sequence[Validation], place: str, count: int) -> tuple[DataFrame, Observation]:
    """The frame, and what the checks ask of it, by check and metric, once it has been written; also its rows."""
    seen = Observation(f"{place}-{uuid.uuid4().hex}")
    metrics = [c.alias(f"{i}.{name}") for i, check in enumerate(checks) for name, c in getattr(check, place)(count).items()]
    return frame.observe(seen, F.count("*").alias("rows"), *metrics), seen


def publish(result: Result, directory: str, checks: Sequence[Validation] = (), files: int | None = None) -> DataFrame:
    """Stage all tables, check them by what their own jobs observed, and put them in their places; returns (artifact, rows, path).

    There is a job a table: that of the residuals observes the rows, that of the coefficients the dates. If a check fails it
    raises ValidationError, and the tables of before stay.
    """
    fitted, count = result.fitted, len(result.fitted.factors)
    spark, staging = result.universe.sparkSession, f"{directory}/.staging-{uuid.uuid4().hex}"
    rows, by_row = observed(fitted.rows, checks, "over_rows", count)
    dates, by_date = observed(dates_table(fitted.rows, result.universe, count), checks, "over_dates", count)
    terms = [F.col(f"__f{j}").alias(x) for j, x in enumerate((INTERCEPT, *fitted.factors))]
    tables = {"epsilon": rows.select("date", "ticker", "specific_return"), "r": fitted.returns(), "X": fitted.exposures(), "f": dates.where("fitted").select("date", *terms)}
    path = spark._jvm.org.apache.hadoop.fs.Path(staging)
    try:

        def stage(name: str) -> None:
            out = tables[name] if files is None else tables[name].coalesce(files)
            out.write.option("compression", "zstd").parquet(f"{staging}/{name}.parquet")

        with ThreadPoolExecutor(len(NAMES)) as pool:  # the jobs share the cluster
            list(pool.map(stage, NAMES))
        found: list[dict[str, float | None]] = [{} for _ in checks]
        for metric, value in (by_row.get | by_date.get).items():
            if "." in metric:
                place, name = metric.split(".", 1)
                found[int(place)][name] = value
        judged = [check.judge(values) for check, values in zip(checks, found, strict=True)]
        if failures := [j for j in judged if not j.passed]:
            raise ValidationError(failures)
        counts = dict.fromkeys(NAMES, by_row.get["rows"])
        counts["f"] = spark.read.parquet(f"{staging}/f.parquet").count()
        for name in NAMES:
            replace(spark, f"{staging}/{name}.parquet", f"{directory}/{name}.parquet")
    finally:
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return spark.createDataFrame([(name, counts[name], f"{directory}/{name}.parquet") for name in NAMES], "artifact string, rows long, path string")


def write_csv(result: Result, directory: str) -> None:
    """The same tables as CSV."""
    for name in NAMES:
        result.tables()[name].write.option("header", True).csv(f"{directory}/{name}.csv")
