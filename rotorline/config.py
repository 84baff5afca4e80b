"""Typed configuration (frozen dataclasses) and its YAML loader."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, fields, replace
from typing import Any

# --- Fixed values -----------------------------------------------------------
# Aggregations a resample configuration may name.
RESAMPLE_AGGREGATES = ("mean", "max", "min", "median", "sum", "first", "last", "count", "std")
QUALITY_STEPS = ("label", "clean", "filter", "resample")
SEASON_MONTHS = {
    "winter": (12, 1, 2),
    "spring": (3, 4, 5),
    "summer": (6, 7, 8),
    "autumn": (9, 10, 11),
}
# What a system file must say, by section.
REQUIRED = {
    "root": ("system_name", "data_root", "output_dir", "file_pattern", "date_format", "pump_ids", "columns", "detectors"),
    "columns": ("expected_source_count", "exclude_indices", "clean_names", "timestamp_col", "speed_col", "current_col", "temp_cols", "prox_cols"),
    "quality": (
        "timestep_seconds", "speed_on_threshold", "min_consecutive_operational", "sensors", "frozen_tolerance", "frozen_period_seconds",
        "variability_threshold", "rolling_window_samples", "rolling_min_periods", "cleaning", "output_dir", "dashboard_output",
    ),
    "quality.resample": ("target_interval", "value_agg", "quality_agg"),
    "quality.sensors": ("min_value", "max_value"),
}
# What a system file means where it says nothing; the other thresholds are those of ``Thresholds``.
FILE_THRESHOLDS = {
    "min_period_duration": 600.0, "speed_on_threshold": 100.0, "gap_merge_threshold": 30.0, "pressure_off_absolute_threshold": 5.0,
    "pressure_off_rebound_threshold": 4.0, "frozen_sensor_min_samples": 10,
}
FILE_SELECTOR = {"min_normal_duration_minutes": 120.0, "max_periods_per_day": 2}
# Date fields of file names, as the configuration writes them and as Spark reads them.
DATE_FIELDS = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%j": "DDD", "%b": "MMM", "%H": "HH", "%M": "mm", "%S": "ss"}
# ---------------------------------------------------------------------------


class ConfigError(ValueError):
    """A configuration value is missing or not allowed."""


@dataclass(frozen=True)
class SensorRule:
    min_value: float | None = None
    max_value: float | None = None
    check_constant: bool = False
    check_falldown: bool = False


@dataclass(frozen=True)
class ResampleRule:
    target_seconds: int = 300
    value_agg: str = "mean"
    quality_agg: str = "max"
    other_agg: str = "first"

    def __post_init__(self) -> None:
        for name in (self.value_agg, self.quality_agg, self.other_agg):
            if name not in RESAMPLE_AGGREGATES:
                raise ConfigError(f"unknown aggregation '{name}', expected one of {RESAMPLE_AGGREGATES}")
        if self.target_seconds <= 0:
            raise ConfigError("target_seconds must be positive")


@dataclass(frozen=True)
class QualityConfig:
    sensors: dict[str, SensorRule]
    timestep_seconds: int = 300
    frozen_tolerance: float = 1e-6
    frozen_period_seconds: int = 3600
    variability_threshold: float = 0.15
    rolling_window_samples: int = 6
    rolling_min_periods: int = 3
    missing_code: str = "first"
    sentinel_value: float | None = None
    sentinel_column_threshold: int = 0
    codes_to_null: tuple[int, ...] = (3, 4, 5)
    drop_quality_columns: bool = True
    speed_col: str = "speed"
    speed_on_threshold: float = 500.0
    min_consecutive_operational: int = 3
    resample: ResampleRule | None = field(default_factory=ResampleRule)

    def __post_init__(self) -> None:
        if self.missing_code not in ("first", "all"):
            raise ConfigError("missing_code must be 'first' or 'all'")
        if not self.sensors:
            raise ConfigError("at least one sensor rule is required")


@dataclass(frozen=True)
class Columns:
    speed: str = "speed"
    current: str = "motor_current"
    pressure: str | None = "outlet_pressure"
    pressure_off: str | None = None
    temps: tuple[str, ...] = ()
    baseline_extra: tuple[str, ...] = ()
    vibrations: tuple[str, ...] = ()

    @property
    def baseline_channels(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(self.temps + self.baseline_extra))


@dataclass(frozen=True)
class Thresholds:
    min_period_duration: float = 900.0
    speed_on_threshold: float = 500.0
    gap_merge_threshold: float = 600.0
    ramp_exclude_seconds: float = 300.0
    anomaly_sigma: float = 3.0
    vibration_spike_factor: float = 2.0
    pressure_off_absolute_threshold: float = 10.0
    pressure_off_rebound_threshold: float = 8.0
    pressure_off_extended_sigma: float = 2.5
    off_state_sigma: float = 4.0
    frozen_sensor_std_threshold: float = 0.01
    frozen_sensor_min_samples: int = 5
    outlet_pressure_variability_cap: float = 0.0
    min_detectors_for_abnormal: int = 1
    absolute_temp_limits: dict[str, float] = field(default_factory=dict)
    # Spans the source cadence makes sensible; coarse data needs wider ones.
    off_window_seconds: float = 1800.0
    near_period_seconds: float = 300.0
    extended_min_points: int = 6
    extended_absolute_floor: float = 4.5
    extended_rebound: float = 3.5


@dataclass(frozen=True)
class SelectorRule:
    min_normal_duration_minutes: float = 60.0
    max_periods_per_day: int = 3
    exclude_reasons: tuple[str, ...] = ()


@dataclass(frozen=True)
class SystemConfig:
    pump_ids: tuple[int, ...] = (1, 2, 3, 4)
    columns: Columns = field(default_factory=Columns)
    thresholds: Thresholds = field(default_factory=Thresholds)
    detectors: tuple[str, ...] = ()
    selector: SelectorRule = field(default_factory=SelectorRule)
    file_pattern: str = r"^pump_(\d+)_(\d{4}-\d{2}-\d{2}).*\.csv$"
    excluded_source_columns: tuple[int, ...] = ()
    clean_names: tuple[str, ...] = ()
    examples: dict[str, tuple[tuple[str, int], ...]] = field(default_factory=dict)
    # Columns found by header instead of position: source name -> own name.
    supplementary_columns: dict[str, str] = field(default_factory=dict)
    expected_source_count: int | None = None
    timestamp_col: str = "timestamp"
    date_format: str = "%Y-%m-%d"
    name: str = ""
    data_root: str | None = None
    output_dir: str | None = None
    custom_detectors_dir: str | None = None

    def __post_init__(self) -> None:
        try:
            groups = re.compile(self.file_pattern).groups
        except re.error as error:
            raise ConfigError(f"file_pattern is not a regular expression: {error}") from error
        if groups < 2:
            raise ConfigError("file_pattern needs two groups: pump and date")
        if not self.pump_ids:
            raise ConfigError("pump_ids must not be empty")

    @property
    def source_count(self) -> int:
        """Columns of a file as the plant writes it: the core ones and those left out."""
        return self.expected_source_count or len(self.clean_names) + len(self.excluded_source_columns)

    @property
    def spark_date_format(self) -> str:
        return re.sub("%.", lambda m: DATE_FIELDS.get(m[0], m[0]), self.date_format)


def _pick(cls: type, raw: dict[str, Any], rename: dict[str, str] | None = None) -> dict[str, Any]:
    """Keyword arguments of ``cls`` found in ``raw``; lists become tuples."""
    rename = rename or {}
    out = {}
    for spec in fields(cls):
        key = rename.get(spec.name, spec.name)
        if key in raw and raw[key] is not None:
            value = raw[key]
            out[spec.name] = tuple(value) if isinstance(value, list) else value
    return out


_INTERVAL = re.compile(r"^\s*(\d+)\s*(s|sec|min|t|h)\s*$", re.IGNORECASE)


def interval_seconds(text: str | int) -> int:
    """'5min' -> 300, '30s' -> 30, plain numbers are seconds."""
    if isinstance(text, int):
        return text
    match = _INTERVAL.match(text)
    if not match:
        raise ConfigError(f"cannot read interval '{text}'")
    scale = {"s": 1, "sec": 1, "min": 60, "t": 60, "h": 3600}[match.group(2).lower()]
    return int(match.group(1)) * scale


def _section(value: Any, name: str) -> dict[str, Any]:
    """A mapping with all keys that the section must have; nothing counts as empty."""
    value = {} if value is None else value
    if not isinstance(value, dict):
        raise ConfigError(f"'{name}' must be a mapping")
    missing = [key for key in REQUIRED.get(name, ()) if key not in value]
    if missing:
        raise ConfigError(f"missing required key '{missing[0]}' in '{name}'")
    return value


def _examples(raw: Any) -> dict[str, tuple[tuple[str, int], ...]]:
    out = {}
    for kind, rows in _section(raw, "examples").items():
        if not isinstance(rows, list) or not all(isinstance(r, dict) and {"date", "pump"} <= r.keys() for r in rows):
            raise ConfigError(f"examples.{kind} must list mappings with date and pump")
        out[kind] = tuple((str(r["date"]), int(r["pump"])) for r in rows)
    return out


def load_config(path: str) -> tuple[SystemConfig, QualityConfig | None]:
    """Read one YAML file into the system configuration and, when present, the quality rules.

    Relative folders are taken from the file's own. Where no pressure column for the OFF state is named, it is the
    pressure column.
    """
    import yaml

    with open(path, encoding="utf-8") as handle:
        raw = _section(yaml.safe_load(handle), "root")
    columns_raw = _section(raw["columns"], "columns")
    columns = Columns(**_pick(Columns, {"pressure_off_col": columns_raw.get("pressure_col"), **{k: v for k, v in columns_raw.items() if v is not None}}, {
        "speed": "speed_col", "current": "current_col", "pressure": "pressure_col",
        "pressure_off": "pressure_off_col", "temps": "temp_cols",
        "baseline_extra": "baseline_extra_cols", "vibrations": "prox_cols",
    }))
    if columns_raw.get("pressure_col") is None:
        columns = replace(columns, pressure=None)
    clean = tuple(columns_raw["clean_names"])
    for key in ("timestamp_col", "speed_col", "current_col"):
        if columns_raw[key] not in clean:
            raise ConfigError(f"'{key}' names '{columns_raw[key]}', which is not in columns.clean_names")
    if not isinstance(raw["detectors"], list):
        raise ConfigError("'detectors' must be a list")
    base = os.path.dirname(os.path.abspath(path))
    folder = lambda key: None if raw.get(key) is None else os.path.normpath(os.path.join(base, os.path.expanduser(str(raw[key]))))
    try:
        thresholds = Thresholds(**_typed(Thresholds, {**FILE_THRESHOLDS, **_section(raw.get("thresholds"), "thresholds")}))
    except (TypeError, ValueError) as error:
        raise ConfigError(f"thresholds: {error}") from error
    system = SystemConfig(
        pump_ids=tuple(int(p) for p in raw["pump_ids"]),
        columns=columns,
        thresholds=thresholds,
        detectors=tuple(str(d) for d in raw["detectors"]),
        selector=SelectorRule(**_pick(SelectorRule, {**FILE_SELECTOR, **_section(raw.get("data_selector"), "data_selector")})),
        file_pattern=str(raw["file_pattern"]),
        excluded_source_columns=tuple(columns_raw["exclude_indices"] or ()),
        clean_names=clean,
        examples=_examples(raw.get("examples")),
        supplementary_columns={str(k): str(v) for k, v in _section(columns_raw.get("supplementary_columns"), "columns.supplementary_columns").items()},
        expected_source_count=int(columns_raw["expected_source_count"]),
        timestamp_col=str(columns_raw["timestamp_col"]),
        date_format=str(raw["date_format"]),
        name=str(raw["system_name"]),
        data_root=folder("data_root"), output_dir=folder("output_dir"), custom_detectors_dir=folder("custom_detectors_dir"),
    )
    return system, _quality_from(raw["quality"], system) if raw.get("quality") is not None else None


def _typed(cls: type, raw: dict[str, Any]) -> dict[str, Any]:
    """``_pick`` with numbers made of what the file has for them."""
    kinds = {f.name: type(f.default) for f in fields(cls) if isinstance(f.default, int | float)}
    return {k: kinds[k](v) if k in kinds else v for k, v in _pick(cls, raw).items()}


def _quality_from(raw: Any, system: SystemConfig) -> QualityConfig:
    raw = _section(raw, "quality")
    sensors = {}
    for name, rule in _section(raw["sensors"], "quality.sensors_").items():
        if name not in system.clean_names:
            raise ConfigError(f"sensor '{name}' is not in columns.clean_names")
        sensors[name] = SensorRule(**_pick(SensorRule, _section(rule, "quality.sensors")))
    cleaning = _section(raw["cleaning"], "quality.cleaning")
    rule = None
    if raw.get("resample") is not None:
        resample = _section(raw["resample"], "quality.resample")
        rule = ResampleRule(interval_seconds(resample["target_interval"]), resample["value_agg"], resample["quality_agg"])
    return QualityConfig(**{
        **_typed(QualityConfig, raw), "sensors": sensors, "speed_col": system.columns.speed,
        "codes_to_null": tuple(int(code) for code in cleaning.get("codes_to_nan") or ()),
        "drop_quality_columns": bool(cleaning.get("drop_quality_columns", True)), "resample": rule,
    })
