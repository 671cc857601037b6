"""Configuration, overrides, progress, the command line, and the entry without the llm folders."""

from __future__ import annotations

import datetime as dt
import io
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from crossfactor import cli, config
from crossfactor.progress import TerminalProgress
from crossfactor.sources.market import RAW

TOML = """
[run]
years = 1
[output]
directory = "{out}"
[universe]
method = "daily"
size = 8
[factors]
order = ["SIZE", "HML", "MOM"]
momentum = {{ lookback_days = 5, skip_days = 1, min_periods = 3 }}
value = {{ lookback_days = 10, skip_days = 2, min_periods = 6 }}
market_beta = {{ enabled = false, lookback_days = 10, min_periods = 5, decay = 0.97 }}
[regression]
method = "sqrt-cap-wls"
winsor_quantile = 0.01
[validation]
minimum_date_coverage = 0.9
tolerance = 1e-12
"""


def written(tmp_path: Path) -> str:
    path = tmp_path / "run.toml"
    path.write_text(TOML.format(out=tmp_path / "out"))
    return str(path)


def test_config(tmp_path):
    given = config.load(written(tmp_path))
    own = config.overridden(given, {"universe.size": 5, "run.end_date": "2024-05-01", "run.years": None})
    assert own.universe.size == 5 and own.run.end_date == dt.date(2024, 5, 1) and own.run.years == 1
    for key, value in (("universe.extra", 1), ("universe.method", "all"), ("factors.order", ["SIZE"]), ("regression.winsor_quantile", 0.5), ("factors.momentum.min_periods", 6), ("validation.tolerance", 0), ("factors.market_beta.decay", 1.0)):
        with pytest.raises(config.ConfigError):
            config.overridden(given, {key: value})


def test_progress():
    out = io.StringIO()
    steps = TerminalProgress(2, out)
    with steps.stage("one"):
        pass
    with pytest.raises(KeyError), steps.stage("two"):
        raise KeyError
    assert "[1/2] one done" in out.getvalue() and "[2/2] two failed" in out.getvalue() and "\x1b" not in out.getvalue()


def test_command_line(spark, tmp_path, capsys):
    rng = np.random.default_rng(5)
    for year in (2023, 2024):
        rows = []
        for i in range(120):
            day = np.busday_offset(f"{year}-01-02", i).astype(dt.datetime)
            rows += [(dt.datetime(day.year, day.month, day.day), f"{k}", float(rng.normal()), float(rng.uniform(1e6, 1e7))) for k in range(12)]
        spark.createDataFrame(rows, RAW).coalesce(1).write.parquet(str(tmp_path / "data" / f"marcap-{year}.parquet"))
    assert cli.main([str(tmp_path / "data"), "--config", written(tmp_path), "--universe-size", "9"], spark) == 0
    assert "fits/s" in capsys.readouterr().err
    assert spark.read.parquet(str(tmp_path / "out" / "epsilon.parquet")).groupBy("date").count().agg({"count": "max"}).first()[0] == 9
    with pytest.raises(SystemExit):
        cli.main([str(tmp_path / "data"), "--config", written(tmp_path), "--tolerance", "-1"], spark)


def test_entry_without_llm(tmp_path):
    root = Path(__file__).parent.parent
    shutil.copytree(root / "crossfactor", tmp_path / "crossfactor", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(k.startswith('op1_') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=100)
