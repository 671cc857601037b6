"""Checks of a run's outputs. Each is one or two aggregates; failures raise before anything is written.

A check also names metrics over the fitted rows and over the table of dates, which ``publish`` observes in the very jobs that
stage the tables, and judges them before the tables go to their places.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import TYPE_CHECKING, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossfactor.functions.columns import finite

if TYPE_CHECKING:
    from crossfactor.plans.pipeline import Result


@dataclass(frozen=True)
class ValidationResult:
    name: str
    passed: bool
    message: str
    metrics: dict[str, float] = field(default_factory=dict)


class Validation(Protocol):
    def validate(self, result: Result) -> ValidationResult: ...

    def over_rows(self, count: int) -> dict[str, Column]:
        """Aggregates over the fitted rows of ``count`` factors."""
        ...

    def over_dates(self, count: int) -> dict[str, Column]:
        """Aggregates over the table of dates."""
        ...

    def judge(self, found: dict[str, float | None]) -> ValidationResult: ...


class ValidationError(ValueError):
    def __init__(self, failures: list[ValidationResult]) -> None:
        self.failures = failures
        super().__init__("; ".join(f"{f.name}: {f.message}" for f in failures))


def numeric(frame: DataFrame) -> list[str]:
    return [f.name for f in frame.schema.fields if isinstance(f.dataType, T.NumericType)]


def count_not_finite(frame: DataFrame) -> DataFrame:
    """(bad,): values of numeric columns that are null, NaN or infinite."""
    counts = [F.count_if(~finite(F.col(c).cast("double"))) for c in numeric(frame)]
    out = counts[0]
    for c in counts[1:]:
        out = out + c
    return frame.agg(out.alias("bad"))


def not_finite(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, bad): a row a table, in one job."""
    counts = [count_not_finite(frame).select(F.lit(name).alias("table"), "bad") for name, frame in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def reconstruction_error(rows: DataFrame, count: int) -> DataFrame:
    """(max_error,): the largest difference between a return and its parts."""
    rest = F.col("return") - F.col("__f0") - F.col("specific_return")
    for j in range(count):
        rest = rest - F.col(f"__f{j + 1}") * F.col(f"__q{j}")
    return rows.agg(F.max(F.abs(rest)).alias("max_error"))


def moments(rows: DataFrame, count: int) -> DataFrame:
    """Weighted moments of residuals with each term, by date."""
    w, e = F.col("regression_weight"), F.col("specific_return")
    terms = [F.lit(1.0), *(F.col(f"__q{j}") for j in range(count))]
    return rows.groupBy("date").agg(*(F.abs(F.sum(w * x * e) / F.sum(w)).alias(f"m{j}") for j, x in enumerate(terms)))


def stage_moments(rows: DataFrame, count: int) -> DataFrame:
    """Weighted moments of what is left after each removal with the term removed, by date."""
    w, rest = F.col("regression_weight"), F.col("return") - F.col("__f0")
    out = [F.abs(F.sum(w * rest) / F.sum(w)).alias("m0")]
    for j in range(count):
        q = F.col(f"__q{j}")
        rest = rest - F.col(f"__f{j + 1}") * q
        out.append(F.abs(F.sum(w * q * rest) / F.sum(w)).alias(f"m{j + 1}"))
    return rows.groupBy("date").agg(*out)


def largest(by_date: DataFrame) -> float:
    """The largest value of all columns but the date; infinite if there is none or one is not a number."""
    columns = [c for c in by_date.columns if c != "date"]
    row = by_date.agg(F.max(F.greatest(*columns)) if len(columns) > 1 else F.max(columns[0]), F.count_if(F.array_contains(F.array(*(F.isnan(c) | F.col(c).isNull() for c in columns)), True))).first()
    return float("inf") if row[0] is None or row[1] else float(row[0])


def dates_table(rows: DataFrame, universe: DataFrame, count: int) -> DataFrame:
    """A row a universe date: ``fitted``, the fit's coefficients and record, moments ``m`` and stage moments ``s``; null where no fit was."""
    w, e, rest = F.col("regression_weight"), F.col("specific_return"), F.col("return") - F.col("__f0")
    total, spread = F.sum(w), F.sum(w * rest * rest)
    out = [F.first(f"__f{j}").alias(f"__f{j}") for j in range(count + 1)]
    out += [F.count("*").alias("n_observations"), F.when(spread > 0, 1 - F.try_divide(F.sum(w * e * e), spread)).alias("r_squared"), F.try_divide(F.sum(w * e), total).alias("residual_mean")]
    out += [F.abs(F.sum(w * e) / total).alias("m0"), F.abs(F.sum(w * rest) / total).alias("s0")]
    for j in range(count):
        q = F.col(f"__q{j}")
        rest = rest - F.col(f"__f{j + 1}") * q
        out += [F.abs(F.sum(w * q * e) / total).alias(f"m{j + 1}"), F.abs(F.sum(w * q * rest) / total).alias(f"s{j + 1}")]
    found = rows.groupBy("date").agg(*out).withColumn("fitted", F.lit(True))
    return universe.where("in_universe").select("date").distinct().join(found, "date", "left")


def bad(columns: Sequence[Column]) -> Column:
    """How many values of the columns are not finite."""
    total = F.lit(0)
    for c in columns:
        total = total + F.when(finite(c), 0).otherwise(1)
    return F.sum(total)


def worst(columns: Sequence[Column], given: Column) -> dict[str, Column]:
    """The largest value where ``given`` holds, and how many are no numbers."""
    top = F.greatest(*columns) if len(columns) > 1 else columns[0]
    return {"max_error": F.max(F.when(given, top)), "bad": bad([F.when(~given, 0.0).otherwise(c) for c in columns])}


@dataclass(frozen=True)
class CoverageValidation:
    minimum_date_coverage: float

    def __post_init__(self) -> None:
        if not 0 <= self.minimum_date_coverage <= 1:
            raise ValueError("coverage must be in [0, 1]")

    def validate(self, result: Result) -> ValidationResult:
        fitted = result.fitted.rows.select("date").distinct().count()
        expected = result.universe.where("in_universe").select("date").distinct().count()
        return self.judge({"fitted": fitted, "expected": expected})

    def over_rows(self, count: int) -> dict[str, Column]:
        return {}

    def over_dates(self, count: int) -> dict[str, Column]:
        return {"fitted": F.count("fitted"), "expected": F.count("*")}

    def judge(self, found: dict[str, float | None]) -> ValidationResult:
        fitted, expected = found["fitted"], found["expected"]
        share = fitted / expected if expected else 0.0
        return ValidationResult("regression_coverage", share >= self.minimum_date_coverage, f"{fitted} of {expected} dates", {"coverage": share, "fitted": fitted, "expected": expected})


@dataclass(frozen=True)
class FiniteOutputValidation:
    def validate(self, result: Result) -> ValidationResult:
        return self.judge({row["table"]: int(row["bad"]) for row in not_finite(result.tables()).collect()})

    def over_rows(self, count: int) -> dict[str, Column]:
        names = {"epsilon": ["specific_return"], "r": ["return"], "X": [f"__q{j}" for j in range(count)], "regression_weights": ["regression_weight"]}
        return {table: bad(list(map(F.col, columns))) for table, columns in names.items()}

    def over_dates(self, count: int) -> dict[str, Column]:
        own = lambda c: F.when(F.col("fitted").isNull(), 0.0).otherwise(F.col(c))
        return {"f": bad([own(f"__f{j}") for j in range(count + 1)]), "diagnostics": bad([own("r_squared"), own("residual_mean")])}

    def judge(self, found: dict[str, float | None]) -> ValidationResult:
        values = {k: int(v or 0) for k, v in found.items()}
        return ValidationResult("finite_outputs", not any(values.values()), f"{sum(values.values())} values are not finite", {k: float(v) for k, v in values.items()})


@dataclass(frozen=True)
class Tolerance:
    tolerance: float = 1e-12
    name = ""

    def __post_init__(self) -> None:
        if not self.tolerance > 0:
            raise ValueError("tolerance must be positive")

    def error(self, result: Result) -> float:
        raise NotImplementedError

    def validate(self, result: Result) -> ValidationResult:
        return self.judge({"max_error": self.error(result), "bad": 0})

    def over_rows(self, count: int) -> dict[str, Column]:
        return {}

    def over_dates(self, count: int) -> dict[str, Column]:
        return {}

    def judge(self, found: dict[str, float | None]) -> ValidationResult:
        error = float("inf") if found["max_error"] is None or found["bad"] else float(found["max_error"])
        return ValidationResult(self.name, error <= self.tolerance, f"largest {error:.3g}, allowed {self.tolerance:.3g}", {"max_error": error})


@dataclass(frozen=True)
class ReconstructionValidation(Tolerance):
    name = "return_reconstruction"

    def error(self, result: Result) -> float:
        return largest(reconstruction_error(result.fitted.rows, len(result.fitted.factors)))

    def over_rows(self, count: int) -> dict[str, Column]:
        rest = F.col("return") - F.col("__f0") - F.col("specific_return")
        for j in range(count):
            rest = rest - F.col(f"__f{j + 1}") * F.col(f"__q{j}")
        return worst([F.abs(rest)], F.lit(True))


@dataclass(frozen=True)
class OrthogonalityValidation(Tolerance):
    name = "residual_orthogonality"

    def error(self, result: Result) -> float:
        return largest(moments(result.fitted.rows, len(result.fitted.factors)))

    def over_dates(self, count: int) -> dict[str, Column]:
        return worst([F.col(f"m{j}") for j in range(count + 1)], F.col("fitted").isNotNull())


@dataclass(frozen=True)
class SequentialOrthogonalityValidation(Tolerance):
    name = "sequential_orthogonality"

    def error(self, result: Result) -> float:
        return largest(stage_moments(result.fitted.rows, len(result.fitted.factors)))

    def over_dates(self, count: int) -> dict[str, Column]:
        return worst([F.col(f"s{j}") for j in range(count + 1)], F.col("fitted").isNotNull())
