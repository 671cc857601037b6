"""The ordered scan: any prepared model beside any residualizer."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_fit import market

from crossfactor.operators import fit, kernel, validate
from crossfactor.operators.beta import RecursiveBeta
from crossfactor.operators.calendar import AnalysisWindow
from crossfactor.operators.factors import CharacteristicModel, momentum_factor, size_factor, volatility_factor
from crossfactor.operators.scan import OrderedModel
from crossfactor.operators.universe import DailyTopUniverse
from crossfactor.operators.volatility import ResidualVolatility
from crossfactor.operators.weights import SquareRootCapWeights
from crossfactor.plans.pipeline import cross_sections, member_rows, prepared_panel, run_pipeline
from crossfactor.sources.market import FrameSource

ORDER = ("MKT", "SIZE", "MOM")
BASE = CharacteristicModel((size_factor(), momentum_factor(5, 1, 3)))
BETA = RecursiveBeta(BASE, 10, 8, 0.9)


@pytest.fixture(scope="module")
def inputs(spark):
    dates, panel = market(spark)
    window = AnalysisWindow(dates[15], dates[-1])
    return panel, window, prepared_panel(panel).persist(), DailyTopUniverse(15).build(FrameSource(panel), window).persist()


def by_row(frame, *columns):
    return {(r.date, r.ticker): np.array([r[c] for c in columns]) for r in frame.collect()}


def test_plugin_residualizer_moves_the_beta(inputs):
    _, _, panel, members = inputs
    rows = member_rows(panel, members, BETA, SquareRootCapWeights())
    own = fit.sequential_wls(ORDER, 0.05, ("MKT",))
    plugin = fit.kernel_residualizer(ORDER, 0.05, unscaled=("MKT",))
    a, b = (by_row(cross_sections(panel, members, BETA, SquareRootCapWeights(), r), *ORDER) for r in (own, plugin))
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]).max() for k in a) < 1e-12
    names = ("specific_return", "__f0", "__f1", "__f2", "__f3", "__q0", "__center0", "__scale2")
    scanned, windows = by_row(BETA.fit(rows, plugin).rows, *names), by_row(own.fit(BETA.sections(rows, own)).rows, *names)
    assert scanned.keys() == windows.keys() and max(abs(scanned[k] - windows[k]).max() for k in scanned) < 1e-12
    # Another residualizer's fit gives other betas.
    other = by_row(BETA.sections(rows, fit.kernel_residualizer(ORDER, 0.2, unscaled=("MKT",))), *ORDER)
    assert max(abs(a[k] - other[k]).max() for k in a) > 1e-6


def test_run_with_models_and_residualizers_of_ones_own(inputs, spark, tmp_path):
    panel, window, _, _ = inputs
    log = str(tmp_path / "calls")

    def counted(r, x, w):
        with open(log, "a") as file:
            file.write("x")
        return kernel.fit(r, x, w, 0.01, [False, True, True])

    run = dict(source=FrameSource(panel), window=window, universe_builder=DailyTopUniverse(15), weights=SquareRootCapWeights())
    checks = (validate.CoverageValidation(0.9), validate.FiniteOutputValidation(), validate.ReconstructionValidation(), validate.OrthogonalityValidation(), validate.SequentialOrthogonalityValidation())
    result = run_pipeline(**run, factors=BETA, residualizer=fit.GroupedResidualizer(ORDER, counted), validations=checks)
    with open(log) as file:
        assert len(file.read()) == 15  # once a date, by the scan itself
    built_in = run_pipeline(**run, factors=BETA, residualizer=fit.sequential_wls(ORDER, 0.01, ("MKT",)))
    a, b = by_row(result.fitted.specific_returns(), "specific_return"), by_row(built_in.fitted.specific_returns(), "specific_return")
    assert a.keys() == b.keys() and max(abs(a[k] - b[k])[0] for k in a) < 1e-12


def test_residual_volatility_follows_the_fits(inputs):
    _, _, panel, members = inputs
    model = ResidualVolatility(CharacteristicModel((size_factor(), volatility_factor(8, 5))), "VOL", 0.8)
    rows = member_rows(panel, members, model, SquareRootCapWeights()).withColumn("VOL", F.when(F.col("ticker") != "000019", F.col("VOL")))
    residualizer = fit.sequential_wls(("RVOL", "SIZE"), 0.0)
    got = by_row(model.sections(rows, residualizer), "RVOL")
    state, wanted = {}, {}
    for _, day in sorted(rows.toPandas().groupby("date")):
        day = day.sort_values("ticker")
        x = np.array([state.get(t, v) for t, v in zip(day.ticker, day.VOL, strict=True)])
        found = kernel.fit(day["return"].to_numpy(), np.column_stack([x, day.SIZE]), day.regression_weight.to_numpy(), 0.0, [True, True])
        wanted |= {(d, t): v for d, t, v in zip(day.date, day.ticker, x, strict=True)}
        for place, e in zip(found.rows, found.residuals, strict=True):
            state[day.ticker.iloc[place]] = np.sqrt(0.8 * x[place] ** 2 + 0.2 * e**2)
    assert got.keys() == wanted.keys() and len(state) > 10
    assert all(v[0] is None if np.isnan(wanted[k]) else abs(v[0] - wanted[k]) < 1e-13 for k, v in got.items())
    for bad in ({"decay": 1.0}, {"seed": "NONE"}, {"name": "size"}):
        with pytest.raises(ValueError):
            ResidualVolatility(**{"base": model.base, "seed": "VOL", "decay": 0.8} | bad)


def test_models_scan_beside_one_another(inputs):
    """A counter as a model of one's own: it sees dates in order, fitted or not, and starts anew with each key."""
    _, _, panel, members = inputs

    class Counter:
        def __init__(self):
            self.seen = []

        def exposures(self, day):
            self.seen.append(day.date)
            assert self.seen == sorted(self.seen)
            return {"N": len(self.seen) + np.arange(len(day.tickers)) % 3.0}

        def update(self, day, found):
            assert found is None or found.names == ("N", "SIZE")

    @dataclass(frozen=True)
    class Counting(OrderedModel):
        base: CharacteristicModel = BASE

        @property
        def own(self):
            return ("N",)

        def prepare(self):
            return Counter()

    rows = member_rows(panel, members, Counting(), SquareRootCapWeights())
    both = rows.withColumn("model", F.lit("a")).unionByName(rows.where("date > '2024-01-25'").withColumn("model", F.lit("b")))
    got = Counting().scan(both, fit.sequential_wls(("N", "SIZE")), ("model",))
    first = {r.model: r.least for r in got.groupBy("model").agg(F.min("N").alias("least")).collect()}
    assert first == {"a": 1.0, "b": 1.0} and got.where("specific_return is not null").count() > 0
    with pytest.raises(ValueError, match="missing"):
        Counting().fit(rows, fit.sequential_wls(("OTHER",)))
