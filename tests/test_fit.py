"""Regressions, validations, beta, live periods."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crossfactor.operators import fit, kernel, validate
from crossfactor.operators.beta import BetaState, RecursiveBeta
from crossfactor.operators.calendar import AnalysisWindow
from crossfactor.operators.factors import CharacteristicModel, momentum_factor, size_factor
from crossfactor.operators.universe import DailyTopUniverse
from crossfactor.operators.weights import EqualWeights, SquareRootCapWeights
from crossfactor.plans.pipeline import run_pipeline
from crossfactor.sources.artifacts import write_artifacts
from crossfactor.sources.market import PANEL, FrameSource

NAMES = ("A", "B", "C")


def section(rows=40, seed=3, dates=2):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(dates):
        x = rng.normal(size=(rows, 3))
        x[:, 1] += 0.5 * x[:, 0]
        w = np.geomspace(1, 16, rows)
        r = 0.01 + x @ [0.02, -0.03, 0.01] + rng.normal(scale=0.01, size=rows)
        out += [(dt.date(2024, 1, 1 + k), f"{i:03d}", *map(float, (r[i], w[i], *x[i]))) for i in range(rows)]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "date date, ticker string, return double, regression_weight double, A double, B double, C double")


@pytest.mark.parametrize("winsor", [0.0, 0.05])
@pytest.mark.parametrize("sequential", [True, False])
def test_windows_agree_with_kernel_and_lstsq(spark, winsor, sequential):
    rows = section()
    got = fit.Residualizer(NAMES, winsor, ("B",), sequential).fit(frame(spark, rows)).rows.orderBy("date", "ticker").toPandas()
    for date, part in pd.DataFrame(rows, columns=["date", "ticker", "r", "w", *NAMES]).groupby("date"):
        own = got[got["date"] == date]
        found = kernel.fit(part.r.to_numpy(), part[list(NAMES)].to_numpy(), part.w.to_numpy(), winsor, [True, False, True], sequential)
        np.testing.assert_allclose(own.specific_return, found.residuals, atol=1e-14)
        np.testing.assert_allclose(own[["__f0", "__f1", "__f2", "__f3"]].iloc[0], found.coefficients, atol=1e-13)
        x = part[list(NAMES)].to_numpy()
        if winsor:
            x = np.clip(x, *np.quantile(x, [winsor, 1 - winsor], axis=0))
        root = np.sqrt(part.w.to_numpy())[:, None]
        design = np.column_stack([np.ones(len(x)), x])
        beta = np.linalg.lstsq(root * design, root[:, 0] * part.r.to_numpy(), rcond=None)[0]
        np.testing.assert_allclose(own.specific_return, part.r - design @ beta, atol=1e-13)


def test_order_changes_attribution_only(spark):
    data = frame(spark, section())
    a = fit.sequential_wls(NAMES).fit(data).rows.orderBy("date", "ticker").toPandas()
    b = fit.sequential_wls(NAMES[::-1]).fit(data).rows.orderBy("date", "ticker").toPandas()
    np.testing.assert_allclose(a.specific_return, b.specific_return, atol=1e-14)
    assert abs(a["__f1"] - b["__f3"]).max() > 1e-4


def test_bad_rows_and_dates_drop(spark):
    rows = section(dates=1)
    bad = [(rows[0][0], "INF", float("inf"), 1.0, 0.0, 0.0, 0.0), (rows[0][0], "NUL", 0.1, 1.0, None, 0.0, 0.0), (rows[0][0], "NEG", 0.1, -1.0, 0.0, 0.0, 0.0)]
    few = [(dt.date(2024, 2, 1), str(i), 0.1 * i, 1.0, float(i), float(i * i), 1.0 / (i + 1)) for i in range(4)]
    flat = [(dt.date(2024, 2, 2), str(i), 0.1 * i, 1.0, 1.0, float(i), float(i * i)) for i in range(20)]
    collapsed = [(dt.date(2024, 2, 3), str(i), 0.1 * i, 1.0, float(i), float(2 * i), float(i * i)) for i in range(20)]
    got = fit.sequential_wls(NAMES).fit(frame(spark, rows + bad + few + flat + collapsed)).rows
    assert got.count() == 40 and got.select("date").distinct().count() == 1


def test_uniform_weights_are_enforced(spark):
    with pytest.raises(Exception, match="uniform"):
        fit.sequential_ols(NAMES).fit(frame(spark, section())).rows.count()
    same = frame(spark, section()).withColumn("regression_weight", F.lit(3.0))
    assert fit.sequential_ols(NAMES).fit(same).rows.count() == 80


def test_bad_residualizers():
    for bad in ({"factor_order": ()}, {"factor_order": ("A", "a")}, {"factor_order": ("INTERCEPT",)}, {"factor_order": ("A",), "unscaled_factors": ("B",)}, {"factor_order": ("A",), "winsor_quantile": 0.5}):
        with pytest.raises(ValueError):
            fit.Residualizer(**bad)


def market(spark, count=30, names=20, seed=19):
    rng = np.random.default_rng(seed)
    betas, caps = np.linspace(0.4, 1.6, names), np.geomspace(1e8, 1e10, names)
    dates = [np.busday_offset("2024-01-01", i).astype(dt.date) for i in range(count)]
    rows = []
    for d in dates:
        r = betas * rng.normal(scale=0.01) + rng.normal(scale=0.01, size=names)
        caps = caps * (1 + r)
        rows += [(d, f"{i:06d}", float(100 * r[i]), float(caps[i])) for i in range(names)]
    return dates, spark.createDataFrame(rows, PANEL)


def test_pipeline_and_artifacts(spark, tmp_path):
    dates, panel = market(spark)
    model = CharacteristicModel((size_factor(), momentum_factor(5, 1, 3)))
    checks = (validate.CoverageValidation(0.9), validate.FiniteOutputValidation(), validate.ReconstructionValidation(), validate.OrthogonalityValidation(), validate.SequentialOrthogonalityValidation())
    run = dict(source=FrameSource(panel), window=AnalysisWindow(dates[10], dates[-1]), universe_builder=DailyTopUniverse(15), factors=model, weights=SquareRootCapWeights(), residualizer=fit.sequential_wls(("SIZE", "MOM"), 0.01))
    result = run_pipeline(**run, validations=checks)
    assert [v.passed for v in result.validations] == [True] * 5
    manifest = {r.artifact: r.rows for r in write_artifacts(result, str(tmp_path / "out"), 1).collect()}
    assert manifest == {"epsilon": 300, "r": 300, "X": 300, "f": 20}
    assert spark.read.parquet(str(tmp_path / "out" / "X.parquet")).columns == ["date", "ticker", "INTERCEPT", "SIZE", "MOM"]
    with pytest.raises(validate.ValidationError, match="reconstruction"):
        run_pipeline(**run, validations=(validate.ReconstructionValidation(1e-300),))
    with pytest.raises(ValueError, match="no dates"):
        run_pipeline(**run | {"universe_builder": DailyTopUniverse(2)})
    with pytest.raises(ValueError, match="factors"):
        run_pipeline(**run | {"residualizer": fit.sequential_wls(("SIZE",))})


def test_beta_update_is_the_closed_form():
    model = RecursiveBeta(CharacteristicModel((size_factor(),)), 5, 3, 0.97)
    state = BetaState(model, np.array([1.0, 1.0, 2.0]))
    state.update(np.array([0, 1, 2]), np.array([0.02, np.nan, 0.02]), 0.02, 0.005, 1.0)
    y, d = 0.02 - 0.005 + 0.02, 0.97e-4 + 0.0004
    assert np.allclose(state.read(np.arange(3)), [(0.97e-4 + 0.02 * y) / d, 1.0, (0.97e-4 * 2 + 0.02 * y) / d])
    before = state.read(np.arange(3)).copy()
    state.update(np.arange(3), np.zeros(3), np.nan, 0.0, 1.0)
    assert (state.read(np.arange(3)) == before).all()
    with pytest.raises(ValueError):
        RecursiveBeta(CharacteristicModel((size_factor(),)), 5, 3, 1.0)


def test_equal_weights_run(spark):
    dates, panel = market(spark)
    model = CharacteristicModel((size_factor(),))
    result = run_pipeline(source=FrameSource(panel), window=AnalysisWindow(dates[10], dates[-1]), universe_builder=DailyTopUniverse(15), factors=model, weights=EqualWeights(), residualizer=fit.sequential_ols(("SIZE",)))
    assert result.fitted.rows.count() == 300
