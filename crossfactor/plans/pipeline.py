"""A whole run: universe, panel, factors, weights, fits, validations."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossfactor.functions.columns import percentage_return, previous_session
from crossfactor.operators.calendar import AnalysisWindow, history_start, sessions, with_ordinals
from crossfactor.operators.factors import FactorModel
from crossfactor.operators.fit import Fitted, OwnFit
from crossfactor.operators.universe import UniverseBuilder, sent_if_small
from crossfactor.operators.validate import Validation, ValidationError, ValidationResult
from crossfactor.operators.weights import WeightModel
from crossfactor.progress import NullProgress, Progress
from crossfactor.sources.market import MarketDataSource, require_unique


@dataclass(frozen=True)
class Result:
    fitted: Fitted
    universe: DataFrame
    validations: list[ValidationResult] = field(default_factory=list)

    def release(self) -> None:
        """Free what the run kept, once its tables are written."""
        self.fitted.rows.unpersist()
        self.universe.unpersist()

    def tables(self) -> dict[str, DataFrame]:
        f = self.fitted
        return {"epsilon": f.specific_returns(), "r": f.returns(), "X": f.exposures(), "f": f.factor_returns(), "diagnostics": f.diagnostics(), "regression_weights": f.regression_weights()}


def prepared_panel(panel: DataFrame, returns: Callable[[], Column] = percentage_return, days: DataFrame | None = None) -> DataFrame:
    """The panel with ``k``, ``return`` and ``lagged_cap``; ``days`` is its calendar, if made before."""
    own = with_ordinals(panel, days).withColumn("return", returns())
    return own.withColumn("lagged_cap", previous_session(F.col("market_cap")))


def rows_read(panel: DataFrame, universe: DataFrame, sessions_back: int, days: DataFrame | None = None, count: int | None = None) -> DataFrame:
    """The panel's rows of members, and of their tickers in so many sessions before, with ``lagged_cap`` made of them.

    So windows by ticker sort what members read and not the whole panel. A small universe is sent to the panel, if ``count`` gives its rows.
    """
    # A row a session: the calendar's bound.
    ahead = F.max("date").over(Window.orderBy("k").rangeBetween(0, sessions_back))
    days = (panel.select("date", "k").distinct() if days is None else days).select("date", ahead.alias("__until"))
    members = universe.where("in_universe").select(F.col("ticker").alias("__member"), F.col("date").alias("__at"))
    reads = (F.col("ticker") == F.col("__member")) & F.col("__at").between(F.col("date"), F.col("__until"))
    rows = panel.drop("lagged_cap").join(F.broadcast(days), "date").join(sent_if_small(members, count), reads, "left_semi").drop("__until")
    return rows.withColumn("lagged_cap", previous_session(F.col("market_cap")))


def member_rows(panel: DataFrame, universe: DataFrame, model: FactorModel, weights: WeightModel, days: DataFrame | None = None, count: int | None = None) -> DataFrame:
    """Members of each date with return, weight, lagged cap, relational exposures and the model's inputs.

    ``count`` is the number of the universe's rows, if it was counted before. Exposures and weights are made of the sessions that model and weights say they need.
    """
    read = rows_read(panel, universe, max(1, model.history_sessions, weights.history_business_days), days, count)
    rows = model.exposures(read).withColumn("regression_weight", weights.column())
    columns = [c for c in rows.columns if c not in panel.columns]
    members = universe.where("in_universe").select("date", "ticker")
    # The rows before leave first: the left join moves members alone.
    rows = rows.select("date", "ticker", "return", "lagged_cap", *columns).join(sent_if_small(members, count), ["date", "ticker"], "left_semi")
    return model.with_inputs(members.join(rows, ["date", "ticker"], "left"), panel, universe)


def cross_sections(panel: DataFrame, universe: DataFrame, model: FactorModel, weights: WeightModel, residualizer: OwnFit) -> DataFrame:
    """Members of each date with return, weight and all exposures."""
    return model.sections(member_rows(panel, universe, model, weights), residualizer)


def run_pipeline(
    *,
    source: MarketDataSource,
    window: AnalysisWindow,
    universe_builder: UniverseBuilder,
    factors: FactorModel,
    weights: WeightModel,
    residualizer: OwnFit,
    validations: Sequence[Validation] = (),
    returns: Callable[[], Column] = percentage_return,
    progress: Progress | None = None,
) -> Result:
    """Run all stages; raises ValidationError, with nothing written, if a check fails.

    The universe and the panel are read once and kept while the fits are made; the result keeps the fitted rows.
    """
    if set(residualizer.factor_order) != set(factors.names):
        raise ValueError(f"the residualizer's factors {residualizer.factor_order} are not the model's {factors.names}")
    steps = progress or NullProgress()
    held: list[DataFrame] = []

    def kept(frame: DataFrame) -> DataFrame:
        held.append(frame.persist())
        return frame

    try:
        with steps.stage("Build universe"):
            universe = kept(universe_builder.build(source, window))
            count = universe.count()  # joins with it know its size
            steps.table("universe", universe)
        with steps.stage("Load market data"):
            days = max(factors.history_business_days, weights.history_business_days)
            loaded = kept(source.load(history_start(window.start, days), window.end, universe.select("ticker").distinct()))
            require_unique(loaded)
            steps.table("panel", loaded)
        with steps.stage("Prepare factors"):
            days = kept(sessions(loaded))
            panel = prepared_panel(loaded, returns, days)  # not kept: its readers take few of its rows, and lag those
        with steps.stage("Residualize returns"):
            rows = member_rows(panel, universe, factors, weights, days, count)
            fitted = factors.fit(kept(rows) if factors.passes > 1 else rows, residualizer)
            # Checks and sinks read the fitted rows; counting them completes the cache, as what it was made of is released.
            fitted = Fitted(kept(fitted.rows), fitted.factors)
            if fitted.rows.count() == 0:
                raise ValueError("no dates had enough valid observations")
            steps.table("fitted", fitted.specific_returns())
        result = Result(fitted, universe)
        with steps.stage("Validate outputs"):
            found = []
            for check in validations:
                found.append(check.validate(result))
                steps.update(f"{found[-1].name}: {found[-1].message}")
        if failures := [f for f in found if not f.passed]:
            raise ValidationError(failures)
    except BaseException:
        for frame in held:
            frame.unpersist()
        raise
    for frame in held:
        if frame is not universe and frame is not fitted.rows:
            frame.unpersist()
    return Result(fitted, universe, found)
