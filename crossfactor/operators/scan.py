"""A fold by date over sorted partitions, for models whose exposures depend on the fits of earlier dates.

The scan reads a date's rows at a time from a sorted partition. It asks the prepared model for the date's exposures, fits the
date with the residualizer that was given, built in or one's own, hands the model that very fit, and puts out exposures
and the fit's rows together, so nothing is fitted twice. It holds one date and the model's state; the sort spills. Dates of
one model are serial by nature; models and markets, named by ``key`` columns, scan beside one another.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from crossfactor.operators.factors import FactorModel, check_names
from crossfactor.operators.fit import FIT_FIELDS, Fitted, OwnFit
from crossfactor.operators.kernel import Fit


@dataclass(frozen=True)
class Day:
    """The members' rows of one date."""

    date: object
    tickers: list[str]
    returns: np.ndarray
    weights: np.ndarray
    table: pa.Table

    def __getitem__(self, column: str) -> np.ndarray:
        return self.table[column].to_numpy()


class PreparedModel(Protocol):
    """State between dates. Dates come in order; ``update`` gets None for a date that could not be fitted.

    Live periods keep the state by ticker: ``state`` gives the rows of some tickers and ``restore`` takes them.
    """

    def exposures(self, day: Day) -> dict[str, np.ndarray]: ...

    def update(self, day: Day, fit: Fit | None) -> None: ...

    def state(self, tickers: Sequence[str]) -> np.ndarray: ...

    def restore(self, tickers: Sequence[str], rows: np.ndarray) -> None: ...


class Slots:
    """Places of tickers in arrays of state, in order of their first appearance."""

    def __init__(self, tickers: Sequence[str] = ()) -> None:
        self.places = {t: i for i, t in enumerate(tickers)}

    def of(self, tickers: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each ticker's place, and which tickers are new."""
        before = len(self.places)
        at = np.fromiter((self.places.setdefault(t, len(self.places)) for t in tickers), np.int64, len(tickers))
        return at, at >= before


class OrderedModel:
    """A factor model with relational base factors and factors of a prepared model.

    A model names its ``base``, the factors ``own`` and the columns ``inputs`` that its prepared model reads besides return,
    weight and base factors; it makes those columns (``with_inputs``) and a fresh prepared model (``prepare``).
    """

    base: FactorModel
    inputs: tuple[str, ...] = ()

    @property
    def passes(self) -> int:
        return 1

    @property
    def own(self) -> tuple[str, ...]:
        raise NotImplementedError

    def with_inputs(self, members: DataFrame, panel: DataFrame, universe: DataFrame) -> DataFrame:
        return members

    def prepare(self) -> PreparedModel:
        raise NotImplementedError

    @property
    def names(self) -> tuple[str, ...]:
        return (*self.base.names, *self.own)

    @property
    def history_business_days(self) -> int:
        return self.base.history_business_days

    @property
    def history_sessions(self) -> int:
        return self.base.history_sessions

    def exposures(self, panel: DataFrame) -> DataFrame:
        return self.base.exposures(panel)

    def scan(self, rows: DataFrame, residualizer: OwnFit, key: Sequence[str] = ()) -> DataFrame:
        """``rows`` (key, date, ticker, return, regression_weight, base factors, inputs) with all exposures and, where a row is in a fit, the fit's columns."""
        check_names(self.names)
        order = tuple(residualizer.factor_order)
        read = dict.fromkeys((*key, "date", "ticker", "return", "regression_weight", *self.base.names, *self.inputs))
        rows = rows.select(*read)
        shown = (*key, "date", "ticker", "return", "regression_weight", *self.base.names)
        doubles = [T.StructField(c, T.DoubleType()) for c in (*self.own, *FIT_FIELDS(len(order)))]
        schema = T.StructType([*(rows.schema[c] for c in shown), *doubles])
        dealt = rows.repartition(*key) if key else rows.repartition(1)
        return dealt.sortWithinPartitions(*key, "date", "ticker").mapInArrow(scanner(self, residualizer, shown, tuple(key)), schema)

    def sections(self, rows: DataFrame, residualizer: OwnFit) -> DataFrame:
        return self.scan(rows, residualizer).select("date", "ticker", "return", "regression_weight", *self.names)

    def fit(self, rows: DataFrame, residualizer: OwnFit) -> Fitted:
        """The scan's own fits, dealt by date again, as checks and sinks need no order."""
        if missing := set(residualizer.factor_order) - set(self.names):
            raise ValueError(f"missing factors: {sorted(missing)}")
        out = self.scan(rows, residualizer)
        names = FIT_FIELDS(len(residualizer.factor_order))
        rows = out.where(out.specific_return.isNotNull()).select("date", "ticker", "return", "regression_weight", *names)
        return Fitted(rows.repartition("date"), tuple(residualizer.factor_order))


def fit_columns(found: Fit | None, count: int, rows: int) -> list[pa.Array]:
    """The columns of FIT_FIELDS: values on the fit's rows, null on others."""
    if found is None:
        return [pa.nulls(rows, pa.float64())] * len(FIT_FIELDS(count))
    outside = np.ones(rows, bool)
    outside[found.rows] = False

    def spread(values: np.ndarray | float) -> pa.Array:
        out = np.zeros(rows)
        out[found.rows] = values
        return pa.array(out, mask=outside)

    return [spread(v) for v in (found.residuals, *found.coefficients, *found.basis.T, *found.centers, *found.scales)]


def scanner(model: OrderedModel, residualizer: OwnFit, shown: Sequence[str], key: tuple[str, ...]):
    order = tuple(residualizer.factor_order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, prepared = None, None
        for name, part in equal_runs(batches, (*key, "date")):
            if prepared is None or name[:-1] != current:
                current, prepared = name[:-1], model.prepare()
            day = Day(name[-1], part["ticker"].to_pylist(), part["return"].to_numpy(), part["regression_weight"].to_numpy(), part)
            own = prepared.exposures(day)
            table = np.column_stack([own[n] if n in own else day[n] for n in order])
            found = residualizer.fit_date(day.returns, table, day.weights)
            prepared.update(day, found)
            columns = [*(part[c] for c in shown), *(pa.array(np.asarray(own[n], float), from_pandas=True) for n in model.own), *fit_columns(found, len(order), len(day.tickers))]
            yield from pa.table(columns, names=[*shown, *model.own, *FIT_FIELDS(len(order))]).combine_chunks().to_batches()

    return run


def equal_runs(batches: Iterator[pa.RecordBatch], columns: Sequence[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Neighbouring rows with equal values of ``columns``, and those values, over the bounds of batches."""
    name, held = None, []
    for batch in batches:
        ends = sorted(set().union(*(pc.run_end_encode(batch[c]).run_ends.to_pylist() for c in columns)))
        for begin, end in zip([0, *ends[:-1]], ends, strict=True):
            own = tuple(batch[c][begin].as_py() for c in columns)
            if held and own != name:
                yield name, pa.Table.from_batches(held)
                held = []
            name = own
            held.append(batch.slice(begin, end - begin))
    if held:
        yield name, pa.Table.from_batches(held)
