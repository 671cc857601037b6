"""Cross-sectional weighted regressions of every date, as partial aggregates by date.

Rows are filtered, exposures winsorized at exact quantiles, centered and scaled with weights. Two aggregates by date make
a table of a row a date: first ranges, then weighted moments about values near the mean, so that little cancels. There the
Gram matrix is factorized as LDL' in scalar columns, and the table goes back to the rows by a broadcast, as dates are
bounded. So rows are never moved: sums leave each task as one row a date, and only an exact quantile brings a date's
distinct values together. The rows are read three times; a caller keeps or writes them first.

Ordered removal uses the orthogonal basis, the joint fit the exposures themselves; residuals agree. Dates without
enough rows, spread or independent factors drop out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossfactor.functions.columns import finite
from crossfactor.operators.calendar import MAX_SESSIONS
from crossfactor.operators.factors import check_names
from crossfactor.operators.kernel import COLLAPSE, Fit, usable
from crossfactor.operators.kernel import fit as fit_one

INTERCEPT = "INTERCEPT"


def all_finite(factors: Sequence[str]) -> Column:
    """The rows that a regression uses."""
    out = finite(F.col("return")) & finite(F.col("regression_weight")) & (F.col("regression_weight") > 0)
    for name in factors:
        out = out & finite(F.col(name))
    return out


def bounded(dates: DataFrame) -> DataFrame:
    """A table of a row a date, held to ``MAX_SESSIONS``: so it may be broadcast."""
    number = F.row_number().over(Window.orderBy("date"))
    ok = F.when(number <= MAX_SESSIONS, F.lit(True)).otherwise(F.raise_error(F.lit(f"more than {MAX_SESSIONS} dates")).cast("boolean"))
    return dates.withColumn("__ok", ok).where("__ok").drop("__ok")


def with_dates(rows: DataFrame, dates: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(dates), "date")


def ranges_of(rows: DataFrame, factors: Sequence[str], winsor: float, uniform: bool) -> DataFrame:
    """By date: ``__lo_i`` and ``__hi_i``, the bounds of winsorized values or the extremes, and ``__ref_i``, a value near the mean within them.

    An exact percentile brings a date's distinct values together; all else is summed on the way.
    """
    w, out = F.col("regression_weight"), [F.count("*").alias("__n"), F.avg("return").alias("__ref")]
    for i, x in enumerate(factors):
        ends = F.expr(f"percentile(`{x}`, array({winsor}D, {1 - winsor}D))") if winsor > 0 else F.array(F.min(x), F.max(x))
        out += [ends.alias(f"__e_{i}"), F.avg(x).alias(f"__m_{i}")]
    found = rows.groupBy("date").agg(*out, F.min(w).alias("__least"), F.max(w).alias("__most"))
    if uniform:
        even = F.when(F.col("__least") < F.col("__most"), F.raise_error(F.lit("weights must be uniform")).cast("boolean")).otherwise(F.lit(True))
        found = found.withColumn("__even", even).where("__even")
    found = found.where(F.col("__n") > 1 + len(factors))
    low, high = (lambda i: F.col(f"__e_{i}")[0]), (lambda i: F.col(f"__e_{i}")[1])
    columns = [c for i in range(len(factors)) for c in (low(i).alias(f"__lo_{i}"), high(i).alias(f"__hi_{i}"), F.least(F.greatest(F.col(f"__m_{i}"), low(i)), high(i)).alias(f"__ref_{i}"))]
    return bounded(found.select("date", "__ref", *columns))


def clipped(x: str, i: int) -> Column:
    return F.least(F.greatest(F.col(x), F.col(f"__lo_{i}")), F.col(f"__hi_{i}"))


def moments_of(rows: DataFrame, factors: Sequence[str], unscaled: Sequence[str]) -> DataFrame:
    """By date: weighted sums about the reference values, on the way, then centers ``__c_i``, scales ``__s_i``, the Gram matrix ``__g_k_j`` of scaled values and ``__b_j``, its right side, as scalars.

    ``rows`` have the columns of ``ranges_of``. Dates without spread in a factor drop out.
    """
    n, w = range(len(factors)), F.col("regression_weight")
    u, v = [clipped(x, i) - F.col(f"__ref_{i}") for i, x in enumerate(factors)], F.col("return") - F.col("__ref")
    ends = [f"__{kind}_{i}" for kind in ("lo", "hi", "ref") for i in n]
    sums = [F.sum(w).alias("__w"), F.sum(w * v).alias("__v"), F.first("__ref").alias("__ref"), *(F.first(c).alias(c) for c in ends)]
    sums += [F.sum(w * u[i]).alias(f"__m_{i}") for i in n] + [F.sum(w * u[i] * v).alias(f"__mv_{i}") for i in n]
    sums += [F.sum(w * u[i] * u[j]).alias(f"__mm_{i}_{j}") for i in n for j in range(i + 1)]
    m, total = (lambda i: F.col(f"__m_{i}")), F.col("__w")
    centered = lambda i, j: F.col(f"__mm_{i}_{j}") - m(i) * m(j) / total
    out = rows.groupBy("date").agg(*sums)
    out = out.withColumns({"__a": F.col("__ref") + F.col("__v") / total} | {f"__c_{i}": F.col(f"__ref_{i}") + m(i) / total for i in n} | {f"__s_{i}": F.sqrt(F.greatest(centered(i, i), F.lit(0.0)) / total) for i in n})
    for i in n:
        out = out.where(finite(F.col(f"__s_{i}")) & (F.col(f"__s_{i}") > 0))
    flat = {f"__s_{i}": F.lit(1.0) for i, x in enumerate(factors) if x in unscaled}
    out = out.withColumns(flat) if flat else out
    s = lambda i: F.col(f"__s_{i}")
    gram = {f"__g_{i}_{j}": centered(i, j) / (s(i) * s(j)) for i in n for j in range(i + 1)}
    return out.withColumns(gram | {f"__b_{i}": (F.col(f"__mv_{i}") - m(i) * F.col("__v") / total) / s(i) for i in n})


def factorized(dates: DataFrame, count: int) -> DataFrame:
    """Columns ``__d_j`` and ``__l_k_j`` of each date's Gram matrix; collapsed dates drop out."""
    g, d, low = (lambda k, j: F.col(f"__g_{k}_{j}")), (lambda j: F.col(f"__d_{j}")), (lambda k, j: F.col(f"__l_{k}_{j}"))
    for j in range(count):
        pivot = g(j, j)
        for m in range(j):
            pivot = pivot - low(j, m) * low(j, m) * d(m)
        dates = dates.withColumn(f"__d_{j}", pivot).where(d(j) > COLLAPSE * F.greatest(F.lit(1.0), g(j, j)))
        below = {}
        for k in range(j + 1, count):
            value = g(k, j)
            for m in range(j):
                value = value - low(k, m) * low(j, m) * d(m)
            below[f"__l_{k}_{j}"] = F.try_divide(value, d(j))
        dates = dates.withColumns(below) if below else dates
    return dates


def normalised(panel: DataFrame, factors: Sequence[str], winsor: float, unscaled: Sequence[str]) -> DataFrame:
    """Usable rows of estimable dates with ``__z``, ``__c`` and ``__s`` columns: values, centers, scales."""
    rows = panel.where(all_finite(factors))
    dates = moments_of(with_dates(rows, ranges_of(rows, factors, winsor, False)), factors, unscaled)
    return standardised(with_dates(rows, dates), factors)


def standardised(rows: DataFrame, factors: Sequence[str]) -> DataFrame:
    return rows.withColumns({f"__z_{i}": F.try_divide(clipped(x, i) - F.col(f"__c_{i}"), F.col(f"__s_{i}")) for i, x in enumerate(factors)})


def FIT_FIELDS(count: int) -> tuple[str, ...]:  # noqa: N802
    """The columns of a fit of ``count`` factors beside date, ticker, return and regression_weight."""
    n = range(count)
    return ("specific_return", "__f0", *(f"__f{j + 1}" for j in n), *(f"__q{j}" for j in n), *(f"__center{j}" for j in n), *(f"__scale{j}" for j in n))


class OwnFit(Protocol):
    """A residualizer: all dates at once on Spark, or one date's arrays."""

    factor_order: tuple[str, ...]

    def fit(self, panel: DataFrame) -> Fitted: ...

    def fit_date(self, returns: np.ndarray, exposures: np.ndarray, weights: np.ndarray) -> Fit | None: ...


@dataclass(frozen=True)
class Fitted:
    """The rows of all fits, lazily; the output tables are projections of them."""

    rows: DataFrame
    factors: tuple[str, ...]

    @property
    def terms(self) -> tuple[str, ...]:
        return (INTERCEPT, *self.factors)

    def specific_returns(self) -> DataFrame:
        return self.rows.select("date", "ticker", "specific_return")

    def returns(self) -> DataFrame:
        return self.rows.select("date", "ticker", "return")

    def exposures(self) -> DataFrame:
        return self.rows.select("date", "ticker", F.lit(1.0).alias(INTERCEPT), *(F.col(f"__q{i}").alias(x) for i, x in enumerate(self.factors)))

    def factor_returns(self) -> DataFrame:
        first = [F.first(f"__f{i}").alias(x) for i, x in enumerate(self.terms)]
        return self.rows.groupBy("date").agg(*first)

    def regression_weights(self) -> DataFrame:
        return self.rows.select("date", "ticker", "regression_weight")

    def diagnostics(self) -> DataFrame:
        w, e = F.col("regression_weight"), F.col("specific_return")
        spread = F.sum(w * (F.col("return") - F.col("__f0")) ** 2)
        return self.rows.groupBy("date").agg(
            F.count("*").alias("n_observations"),
            F.lit(len(self.terms)).alias("rank"),
            F.when(spread > 0, 1 - F.try_divide(F.sum(w * e * e), spread)).alias("r_squared"),
            F.try_divide(F.sum(w * e), F.sum(w)).alias("residual_mean"),
        )


@dataclass(frozen=True)
class Residualizer:
    """A weighted fit of every date; ``sequential`` removes factors in order, else all jointly.

    ``uniform`` demands one weight a date, as the ordered unweighted fit does, and uses 1 for it.
    """

    factor_order: tuple[str, ...]
    winsor_quantile: float = 0.0
    unscaled_factors: tuple[str, ...] = ()
    sequential: bool = True
    uniform: bool = False
    scaled: tuple[bool, ...] = field(init=False, default=())

    def __post_init__(self) -> None:
        names = self.factor_order
        if not names or any(not n or n == INTERCEPT for n in names):
            raise ValueError("factor names must not be empty or the intercept's")
        check_names(names)
        if not set(self.unscaled_factors) <= set(names):
            raise ValueError("unscaled factors must be among the factors")
        if not 0 <= self.winsor_quantile < 0.5:
            raise ValueError("winsor_quantile must be in [0, 0.5)")
        object.__setattr__(self, "scaled", tuple(n not in self.unscaled_factors for n in names))

    def fit(self, panel: DataFrame) -> Fitted:
        """Fit the rows of a panel with date, ticker, return, regression_weight and the factors."""
        if missing := set(self.factor_order) - set(panel.columns):
            raise ValueError(f"missing factors: {sorted(missing)}")
        names, count = self.factor_order, len(self.factor_order)
        rows = panel.select("date", "ticker", "return", "regression_weight", *names).where(all_finite(names))
        ranges = ranges_of(rows, names, self.winsor_quantile, self.uniform)
        if self.uniform:
            rows = rows.withColumn("regression_weight", F.lit(1.0))
        dates = factorized(moments_of(with_dates(rows, ranges), names, self.unscaled_factors), count)
        low = lambda k, j: F.col(f"__l_{k}_{j}")
        for j in range(count):
            moment = F.col(f"__b_{j}")
            for k in range(j):
                moment = moment - low(j, k) * F.col(f"__m_{k}")
            dates = dates.withColumn(f"__m_{j}", moment).withColumn(f"__t_{j}", F.try_divide(F.col(f"__m_{j}"), F.col(f"__d_{j}")))
        for j in range(count - 1, -1, -1):
            value = F.col(f"__t_{j}")
            for k in range(j + 1, count):
                value = value - low(k, j) * F.col(f"__u_{k}")
            dates = dates.withColumn(f"__u_{j}", value)
        # All that a row needs of its date.
        n = range(count)
        needed = ["__a", *(f"__{c}_{i}" for c in ("lo", "hi", "c", "s", "t", "u") for i in n), *(f"__l_{k}_{j}" for j in n for k in range(j + 1, count))]
        rows = standardised(with_dates(rows, dates.select("date", *needed)), names)
        for j in n if self.sequential else ():
            basis = F.col(f"__z_{j}")
            for k in range(j):
                basis = basis - low(j, k) * F.col(f"__o_{k}")
            rows = rows.withColumn(f"__o_{j}", basis)
        taken = [F.col(f"__t_{j}" if self.sequential else f"__u_{j}") for j in n]
        shown = [F.col(f"__o_{j}" if self.sequential else f"__z_{j}") for j in n]
        rest = F.col("return") - F.col("__a")
        for f, q in zip(taken, shown, strict=True):
            rest = rest - f * q
        out = [F.col("date"), F.col("ticker"), F.col("return"), F.col("regression_weight"), rest.alias("specific_return"), F.col("__a").alias("__f0")]
        out += [f.alias(f"__f{j + 1}") for j, f in enumerate(taken)] + [q.alias(f"__q{j}") for j, q in enumerate(shown)]
        out += [F.col(f"__c_{j}").alias(f"__center{j}") for j in range(count)] + [F.col(f"__s_{j}").alias(f"__scale{j}") for j in range(count)]
        return Fitted(rows.select(*out), names)


    def fit_date(self, returns: np.ndarray, exposures: np.ndarray, weights: np.ndarray) -> Fit | None:
        """The same fit of one date, in NumPy; columns in the order of the factors."""
        if self.uniform:
            used = weights[usable(returns, exposures, weights)]
            if len(used) and np.ptp(used) > 0:
                raise ValueError("weights must be uniform")
            weights = np.where(weights > 0, 1.0, weights)
        found = fit_one(returns, exposures, weights, self.winsor_quantile, self.scaled, self.sequential)
        return None if found is None else replace(found, names=self.factor_order)


def joint_ols(factors: Sequence[str], winsor_quantile: float = 0.0, unscaled: Sequence[str] = ()) -> Residualizer:
    return Residualizer(tuple(factors), winsor_quantile, tuple(unscaled), sequential=False)


def sequential_ols(factors: Sequence[str], winsor_quantile: float = 0.0, unscaled: Sequence[str] = ()) -> Residualizer:
    return Residualizer(tuple(factors), winsor_quantile, tuple(unscaled), uniform=True)


def sequential_wls(factors: Sequence[str], winsor_quantile: float = 0.0, unscaled: Sequence[str] = ()) -> Residualizer:
    return Residualizer(tuple(factors), winsor_quantile, tuple(unscaled))


@dataclass(frozen=True)
class GroupedResidualizer:
    """A residualizer of one's own: a function of one date's returns, exposures in the order of the factors, and weights.

    It returns None, or a Fit with coefficients (intercept first), the rows' places, their basis and residuals, centers and scales.
    """

    factor_order: tuple[str, ...]
    run: Callable[[np.ndarray, np.ndarray, np.ndarray], Fit | None]

    def fit_date(self, returns: np.ndarray, exposures: np.ndarray, weights: np.ndarray) -> Fit | None:
        found = self.run(returns, exposures, weights)
        return None if found is None else replace(found, names=self.factor_order)

    def fit(self, panel: DataFrame) -> Fitted:
        names, fit_date = self.factor_order, self.fit_date
        fields = FIT_FIELDS(len(names))
        rows = panel.select("date", "ticker", "return", "regression_weight", *names)
        schema = T.StructType([*rows.schema.fields[:4], *(T.StructField(f, T.DoubleType()) for f in fields)])

        def one(group: pd.DataFrame) -> pd.DataFrame:
            found = fit_date(group["return"].to_numpy(float), group[list(names)].to_numpy(float), group["regression_weight"].to_numpy(float))
            base = group[["date", "ticker", "return", "regression_weight"]]
            if found is None:
                return base.iloc[:0].assign(**dict.fromkeys(fields, 0.0))
            values = (found.residuals, *found.coefficients, *found.basis.T, *found.centers, *found.scales)
            return base.iloc[found.rows].assign(**dict(zip(fields, values, strict=True)))

        return Fitted(rows.groupBy("date").applyInPandas(one, schema), names)


def kernel_residualizer(factors: Sequence[str], winsor: float = 0.0, sequential: bool = True, unscaled: Sequence[str] = ()) -> GroupedResidualizer:
    """The NumPy kernel as a plug-in; also a second opinion on the windows."""
    names = tuple(factors)
    return GroupedResidualizer(names, lambda r, x, w: fit_one(r, x, w, winsor, [n not in unscaled for n in names], sequential))
