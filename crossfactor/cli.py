"""Command line: ``python -m crossfactor.cli DATA_DIR --config run.toml``."""

from __future__ import annotations

import argparse
import time
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from crossfactor import config as c
from crossfactor.operators import factors, fit, universe, validate, weights
from crossfactor.operators.beta import RecursiveBeta
from crossfactor.operators.calendar import analysis_window
from crossfactor.plans.pipeline import run_pipeline
from crossfactor.progress import TerminalProgress
from crossfactor.sources.artifacts import publish
from crossfactor.sources.market import YearlyParquetSource

#: Options that override the configuration: flag, key, type.
OVERRIDES = (
    ("--years", "run.years", int),
    ("--end-date", "run.end_date", str),
    ("--output", "output.directory", str),
    ("--universe", "universe.method", str),
    ("--universe-size", "universe.size", int),
    ("--factor-order", "factors.order", lambda s: s.split(",")),
    ("--momentum-lookback", "factors.momentum.lookback_days", int),
    ("--momentum-skip", "factors.momentum.skip_days", int),
    ("--momentum-min-periods", "factors.momentum.min_periods", int),
    ("--value-lookback", "factors.value.lookback_days", int),
    ("--value-skip", "factors.value.skip_days", int),
    ("--value-min-periods", "factors.value.min_periods", int),
    ("--beta", "factors.market_beta.enabled", lambda s: s.lower() in ("1", "true", "yes", "on")),
    ("--beta-lookback", "factors.market_beta.lookback_days", int),
    ("--beta-min-periods", "factors.market_beta.min_periods", int),
    ("--beta-decay", "factors.market_beta.decay", float),
    ("--method", "regression.method", str),
    ("--winsor-quantile", "regression.winsor_quantile", float),
    ("--minimum-date-coverage", "validation.minimum_date_coverage", float),
    ("--tolerance", "validation.tolerance", float),
)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="crossfactor")
    out.add_argument("data_dir")
    out.add_argument("--config", required=True)
    out.add_argument("--previews", action="store_true", help="show the first rows of each stage's table")
    for flag, key, kind in OVERRIDES:
        out.add_argument(flag, dest=key, type=kind)
    return out


def models(config: c.Config) -> tuple[factors.FactorModel, weights.WeightModel, fit.Residualizer]:
    f = config.factors
    value, momentum = (tuple(vars(w).values()) for w in (f.value, f.momentum))
    model: factors.FactorModel = factors.CharacteristicModel((factors.size_factor(), factors.long_term_reversal_factor(*value), factors.momentum_factor(*momentum)))
    if f.market_beta.enabled:
        model = RecursiveBeta(model, f.market_beta.lookback_days, f.market_beta.min_periods, f.market_beta.decay)
    unscaled = ("MKT",) if f.market_beta.enabled else ()
    if config.regression.method == "ols":
        return model, weights.EqualWeights(), fit.sequential_ols(f.order, config.regression.winsor_quantile, unscaled)
    return model, weights.SquareRootCapWeights(), fit.sequential_wls(f.order, config.regression.winsor_quantile, unscaled)


def size_text(count: float) -> str:
    for unit in ("B", "KiB", "MiB", "GiB"):
        if count < 1024:
            return f"{count:.1f} {unit}"
        count /= 1024
    return f"{count:.1f} TiB"


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser()
    given = vars(args.parse_args(argv))
    try:
        config = c.overridden(c.load(given["config"]), {key: given[key] for _, key, _ in OVERRIDES})
    except (OSError, ValueError) as error:
        args.error(str(error))
    spark = spark or SparkSession.builder.appName("crossfactor").getOrCreate()
    began, progress = time.monotonic(), TerminalProgress(6, previews=given["previews"], spark=spark)
    source = YearlyParquetSource(spark, given["data_dir"])
    window = analysis_window(source, config.run.years, config.run.end_date)
    model, weight, residualizer = models(config)
    tolerance = config.validation.tolerance
    result = run_pipeline(
        source=source,
        window=window,
        universe_builder=(universe.FixedTopUniverse if config.universe.method == "fixed" else universe.DailyTopUniverse)(config.universe.size),
        factors=model,
        weights=weight,
        residualizer=residualizer,
        progress=progress,
    )
    checks = (validate.CoverageValidation(config.validation.minimum_date_coverage), validate.FiniteOutputValidation(), validate.ReconstructionValidation(tolerance), validate.OrthogonalityValidation(tolerance), validate.SequentialOrthogonalityValidation(tolerance))
    with progress.stage("Check and write artifacts"):
        manifest = publish(result, config.output.directory, checks)
    days = result.fitted.diagnostics().agg(F.count("*").alias("dates"), F.sum("n_observations").alias("rows"), F.min("n_observations").alias("least"), F.max("n_observations").alias("most"), F.min("date").alias("first"), F.max("date").alias("last")).first()
    result.release()
    seconds = time.monotonic() - began
    progress.summary("\n".join(f"{r.artifact}: {r.rows:,} rows in {r.path}" for r in manifest.collect()))
    progress.summary(f"{days.dates:,} dates {days.first} to {days.last}, {days.least:,} to {days.most:,} names; {days.dates / seconds:.1f} fits/s, {days.rows / seconds:,.0f} rows/s, {size_text(days.rows * 8 * (2 + len(model.names)) / seconds)}/s")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
