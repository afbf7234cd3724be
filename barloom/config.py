"""Settings with checked values; read from YAML where that package is present."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any

IMPUTATION = ("forward_fill", "backward_fill", "linear", "midpoint", "drop")
BIN_MODES = ("lifecycle", "tts", "tts_hours", "event_aligned", "calendar")


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass
class Cleaning:
    min_observations: int = 50
    winsorize_limits: tuple[float, float] = (0.01, 0.01)
    max_spread_pct: float = 0.50
    min_price: float = 1
    max_price: float = 99
    max_gap_minutes: int = 60  # stored only
    imputation_method: str = "forward_fill"
    drop_zero_volume_only: bool = False

    def __post_init__(self) -> None:
        self.winsorize_limits = tuple(self.winsorize_limits)
        self.imputation_method = self.imputation_method.lower()
        _need(self.min_observations >= 0, "min_observations must not be negative")
        _need(all(0 <= x <= 0.5 for x in self.winsorize_limits), "winsorize_limits must lie in 0..0.5")
        _need(0 < self.max_spread_pct <= 1, "max_spread_pct must lie in (0, 1]")
        _need(0 <= self.min_price < self.max_price, "prices must satisfy 0 <= min_price < max_price")
        _need(self.max_gap_minutes > 0, "max_gap_minutes must be positive")
        _need(self.imputation_method in IMPUTATION, f"imputation_method must be one of {IMPUTATION}")


@dataclass
class Rolling:
    short: int = 5
    medium: int = 15
    long: int = 60

    def __post_init__(self) -> None:
        _need(0 < self.short <= self.medium <= self.long, "windows must be positive and in order")


@dataclass
class Features:
    rolling: Rolling = field(default_factory=Rolling)
    min_periods: int = 3
    annualization_factor: int = 525_600
    volume_ma_window: int = 20


@dataclass
class Normalization:
    spread: str = "zscore"
    volume: str = "percentile"
    depth: str = "minmax"
    volatility: str = "zscore"
    price: str = "minmax"
    default: str = "zscore"


@dataclass
class Binning:
    mode: str = "lifecycle"
    n_bins: int = 50
    lifecycle_bins: int = 100  # stored only
    event_window_hours_pre: int = 24
    event_window_hours_post: int = 4

    def __post_init__(self) -> None:
        self.mode = self.mode.lower()
        _need(self.mode in BIN_MODES, f"mode must be one of {BIN_MODES}")
        for k in ("n_bins", "lifecycle_bins", "event_window_hours_pre", "event_window_hours_post"):
            _need(getattr(self, k) > 0, f"{k} must be positive")


@dataclass
class Alignment:
    pre_event_minutes: int = 60
    post_event_minutes: int = 30
    interpolation_grid_minutes: int = 1
    grid_hours_pre: int = 24
    grid_hours_post: int = 4

    def __post_init__(self) -> None:
        for f in fields(self):
            _need(getattr(self, f.name) > 0, f"{f.name} must be positive")


@dataclass
class Surges:
    volume_threshold: float = 2.0
    volatility_threshold: float = 2.0
    lookback_window: int = 30

    def __post_init__(self) -> None:
        for f in fields(self):
            _need(getattr(self, f.name) > 0, f"{f.name} must be positive")


@dataclass
class Regimes:
    frozen_volume: float = 0.1
    thin_spread: float = 0.15
    active_zscore: float = 1.5
    burst_k: float = 2.5
    burst_volume: float = 1.5
    drift_ratio: float = 0.90
    drift_spread: float = 0.05
    drift_spread_quantile: float = 0.05
    drift_volume_quantile: float = 0.25
    drift_volatility_quantile: float = 0.25
    window: int = 20
    frozen_on_zero_return: bool = True


@dataclass
class Settings:
    categories: list[str] = field(default_factory=lambda: ["Sports", "Politics", "Economics", "Weather", "Culture"])
    cleaning: Cleaning = field(default_factory=Cleaning)
    features: Features = field(default_factory=Features)
    normalization: Normalization = field(default_factory=Normalization)
    binning: Binning = field(default_factory=Binning)
    alignment: Alignment = field(default_factory=Alignment)
    surges: Surges = field(default_factory=Surges)
    regimes: Regimes = field(default_factory=Regimes)


def build(kind: type, values: dict[str, Any]):
    """A settings class from nested dicts; unknown keys are ignored."""
    out = {}
    for f in fields(kind):
        if f.name in values:
            default = getattr(kind(), f.name)
            out[f.name] = build(type(default), values[f.name] or {}) if is_dataclass(default) else values[f.name]
    return kind(**out)


def load_settings(path: str | Path | None = None) -> Settings:
    """Settings from a YAML file with this module's section names, or the defaults."""
    if path is None:
        return Settings()
    import yaml

    return build(Settings, yaml.safe_load(Path(path).read_text()) or {})
