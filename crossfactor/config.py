"""Run configuration: TOML sections, checked strictly; unknown keys are errors."""

from __future__ import annotations

import dataclasses
import datetime as dt
import tomllib
from dataclasses import dataclass, field
from pathlib import Path


class ConfigError(ValueError):
    pass


def check(ok: bool, message: str) -> None:
    if not ok:
        raise ConfigError(message)


@dataclass(frozen=True)
class Run:
    years: int
    end_date: dt.date | None = None

    def __post_init__(self) -> None:
        check(self.years > 0, "run.years must be positive")
        if isinstance(self.end_date, str):
            object.__setattr__(self, "end_date", dt.date.fromisoformat(self.end_date))


@dataclass(frozen=True)
class Output:
    directory: str


@dataclass(frozen=True)
class Universe:
    method: str
    size: int

    def __post_init__(self) -> None:
        check(self.method in ("fixed", "daily"), "universe.method must be fixed or daily")
        check(self.size > 0, "universe.size must be positive")


@dataclass(frozen=True)
class Window:
    lookback_days: int
    skip_days: int
    min_periods: int

    def __post_init__(self) -> None:
        check(min(self.lookback_days, self.skip_days, self.min_periods) > 0, "windows must be positive")
        check(self.min_periods <= self.lookback_days, "a window has no room for so many min_periods")


@dataclass(frozen=True)
class MarketBeta:
    enabled: bool
    lookback_days: int
    min_periods: int
    decay: float

    def __post_init__(self) -> None:
        check(min(self.lookback_days, self.min_periods) > 0, "windows must be positive")
        check(self.min_periods <= self.lookback_days, "a window has no room for so many min_periods")
        check(0 < self.decay < 1, "decay must be in (0, 1)")


@dataclass(frozen=True)
class Factors:
    order: tuple[str, ...]
    momentum: Window
    value: Window
    market_beta: MarketBeta

    def __post_init__(self) -> None:
        object.__setattr__(self, "order", tuple(self.order))
        expected = {"SIZE", "HML", "MOM"} | ({"MKT"} if self.market_beta.enabled else set())
        check(len(self.order) == len(expected) and set(self.order) == expected, f"factors.order is to name each of {sorted(expected)} once")


@dataclass(frozen=True)
class Regression:
    method: str
    winsor_quantile: float

    def __post_init__(self) -> None:
        check(self.method in ("ols", "sqrt-cap-wls"), "regression.method must be ols or sqrt-cap-wls")
        check(0 <= self.winsor_quantile < 0.5, "winsor_quantile must be in [0, 0.5)")


@dataclass(frozen=True)
class Checks:
    minimum_date_coverage: float
    tolerance: float

    def __post_init__(self) -> None:
        check(0 < self.minimum_date_coverage <= 1, "minimum_date_coverage must be in (0, 1]")
        check(self.tolerance > 0, "tolerance must be positive")


@dataclass(frozen=True)
class Config:
    run: Run
    output: Output
    universe: Universe
    factors: Factors
    regression: Regression
    validation: Checks = field(default=None)


SECTIONS = {Config: {"run": Run, "output": Output, "universe": Universe, "factors": Factors, "regression": Regression, "validation": Checks}, Factors: {"momentum": Window, "value": Window, "market_beta": MarketBeta}}


def build(kind: type, given: dict, place: str = "") -> object:
    """A section from a table, and its sections in turn."""
    check(isinstance(given, dict), f"{place or 'the configuration'} must be a table")
    names = {f.name for f in dataclasses.fields(kind)}
    check(not (extra := set(given) - names), f"unknown keys in {place or 'the configuration'}: {sorted(extra)}")
    needed = {f.name for f in dataclasses.fields(kind) if f.default is dataclasses.MISSING or kind is Config}
    check(not (missing := needed - set(given)), f"missing keys in {place or 'the configuration'}: {sorted(missing)}")
    inner = SECTIONS.get(kind, {})
    try:
        return kind(**{k: build(inner[k], v, f"{place}.{k}".strip(".")) if k in inner else v for k, v in given.items()})
    except TypeError as error:
        raise ConfigError(f"{place}: {error}") from error


def load(path: str | Path) -> dict:
    with open(path, "rb") as file:
        return tomllib.load(file)


def overridden(given: dict, changes: dict[str, object]) -> Config:
    """The configuration with dotted keys replaced where a value is given, checked again."""

    def copied(table: dict) -> dict:
        return {k: copied(v) if isinstance(v, dict) else v for k, v in table.items()}

    out = copied(given)
    for key, value in changes.items():
        if value is None:
            continue
        *path, last = key.split(".")
        table = out
        for part in path:
            table = table.setdefault(part, {})
        table[last] = value
    return build(Config, out)
