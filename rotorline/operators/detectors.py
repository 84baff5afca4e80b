"""Period detectors: predicates over one wide row per period and its pump's baseline.

A detector is a function ``(f, base, cfg) -> Column`` giving the reason string when
it fires and NULL otherwise. ``f`` reads a feature, ``base`` a baseline statistic.
All detectors of a configuration are evaluated in one projection.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotorline.config import SystemConfig, Thresholds
from rotorline.operators.periods import COARSE_SECONDS, HIGH_RATE_SECONDS, WINDINGS

Detector = Callable[["Features", "Baseline", SystemConfig], Column]

# --- Fixed values -----------------------------------------------------------
TINY_STD = 1e-6
SPEED_FLOOR = 50.0
RATIO_SIGMA = 3.0
VARIABILITY_SIGMA = 3.0
OFF_VARIABILITY_FLOOR = 3.0
REBOUND_BAND = 1.5
EXTENDED_BAND = 2.0
RESPONSE_NOISE = 2.0
MIN_SPEED = 100.0
VARIABILITY_FACTOR = 2.5
DEFICIT_SIGNALS = (("total_fw_flow", 1.0), ("npsh_pressure", 1.0), ("filter_diff_pressure", 1.5))
CRITICAL = "temp_absolute_limit"
# ---------------------------------------------------------------------------


class Features:
    """Named access to the feature columns; a feature that does not exist reads NULL."""

    def __init__(self, columns: Iterable[str]):
        self.columns = set(columns)

    def __call__(self, name: str) -> Column:
        return F.col(name) if name in self.columns else F.lit(None).cast("double")

    def has(self, channel: str) -> bool:
        return f"mean_{channel}" in self.columns


class Baseline:
    """Baseline statistics of the period's pump out of the ``base`` map."""

    def stat(self, key: str, part: str) -> Column:
        return F.try_element_at(F.col("base"), F.lit(key))[part]

    def median(self, key: str) -> Column:
        return self.stat(key, "median")

    def std(self, key: str, floor: float = TINY_STD) -> Column:
        return F.greatest(F.coalesce(self.stat(key, "robust_std"), F.lit(floor)), F.lit(floor))


def _fires(test: Column, reason: str | Column) -> Column:
    return F.when(test, F.lit(reason) if isinstance(reason, str) else reason)


def _listed(prefix: str, marks: list[Column]) -> Column:
    hits = F.array_compact(F.array(*marks)) if marks else F.array().cast("array<string>")
    return F.when(F.size(hits) > 0, F.concat(F.lit(prefix), F.array_join(hits, ",")))


def speed_stability(f: Features, base: Baseline, cfg: SystemConfig) -> Column:
    speed = cfg.columns.speed
    limit = F.greatest(cfg.thresholds.anomaly_sigma * base.std("speed"), F.lit(SPEED_FLOOR))
    return _fires((f(f"cnt_{speed}") >= 2) & (f(f"std_{speed}") > limit), "speed_stability")


def current_anomaly(f: Features, base: Baseline, cfg: SystemConfig) -> Column:
    current, limit = cfg.columns.current, cfg.thresholds.anomaly_sigma * base.std("current")
    shifted = F.abs(f(f"mean_{current}") - base.median("current")) > limit
    return _fires((f(f"cnt_{current}") >= 2) & (shifted | (f(f"std_{current}") > limit)), "current_anomaly")


def current_speed_ratio(f: Features, base: Baseline, cfg: SystemConfig) -> Column:
    away = F.abs(f("mean_ratio") - base.median("ratio")) > RATIO_SIGMA * base.std("ratio")
    return _fires((f("cnt_ratio") >= 2) & away, "current_speed_ratio")


def pressure_on(f: Features, base: Baseline, cfg: SystemConfig) -> Column:
    p = cfg.columns.pressure
    away = F.abs(f(f"mean_{p}") - base.median("pressure_on")) > cfg.thresholds.anomaly_sigma * base.std("pressure_on")
    return _fires((f(f"cnt_{p}") >= 2) & away, "pressure_on")


def pressure_off(f: Features, base: Baseline, cfg: SystemConfig) -> Column:
    th = cfg.thresholds
    std, normal = base.std("pressure_off"), base.median("pressure_off")
    away = F.abs(f("off_before_mean") - normal)
    limit = F.greatest(base.median("pressure_off_var") + base.std("pressure_off_var"), F.lit(OFF_VARIABILITY_FLOOR))
    restless = (f("n_off") >= 2) & (f("off_std") > limit)
    back = F.abs(f("off_after_mean") - normal) <= REBOUND_BAND * std
    rise = f("off_after_mean") - f("off_before_mean") > th.pressure_off_rebound_threshold
    rebound = (f("n_off_after") >= 2) & rise & back
    sure = away > 2 * th.anomaly_sigma * std
    evidence = F.coalesce(restless, F.lit(False)) | F.coalesce(rebound, F.lit(False)) | sure
    shifted = (away > th.anomaly_sigma * std) & (away > th.pressure_off_absolute_threshold)
    return _fires((f("n_off_before") >= 2) & shifted & evidence, "pressure_off")


def pressure_off_variability(f: Features, base: Baseline, cfg: SystemConfig) -> Column:
    limit = base.median("pressure_off_var") + VARIABILITY_SIGMA * base.std("pressure_off_var")
    return _fires((f("n_off") >= 2) & (f("off_std") > limit), "pressure_off_variability")


def pressure_off_extended(f: Features, base: Baseline, cfg: SystemConfig) -> Column:
    th = cfg.thresholds
    std, normal = base.std("pressure_off"), base.median("pressure_off")
    points = F.greatest(F.floor(3600.0 / F.col("interval_s")), F.lit(th.extended_min_points))
    away = F.abs(f("off_extended_mean") - normal)
    shifted = (away > th.pressure_off_extended_sigma * std) & (away > th.extended_absolute_floor)
    after = f("off_after_extended_mean")
    rebound = (after - f("off_extended_mean") > th.extended_rebound) & (F.abs(after - normal) <= EXTENDED_BAND * std)
    sure = away > 2 * th.pressure_off_extended_sigma * std
    enough = (f("n_off_extended") >= points) & (f("n_off_after_extended") >= 2) & after.isNotNull()
    return _fires(enough & shifted & (rebound | sure), "pressure_off_extended")


def temperatures(f: Features, base: Baseline, cfg: SystemConfig) -> Column:
    marks = []
    for c in cfg.columns.temps:
        if f.has(c):
            limit = base.median(f"mean:{c}") + cfg.thresholds.anomaly_sigma * base.std(f"mean:{c}", 0.01)
            marks.append(F.when(f(f"mean_{c}") > limit, F.lit(c)))
    return _listed("temp_elevated:", marks)


def vibration(f: Features, base: Baseline, cfg: SystemConfig) -> Column:
    marks = []
    for c in cfg.columns.vibrations:
        if f.has(c):
            seen = f(f"cnt_{c}") >= 2
            spike = f(f"max_{c}") > cfg.thresholds.vibration_spike_factor * base.stat(f"vib_max:{c}", "q95")
            limit = base.median(f"vib:{c}") + cfg.thresholds.anomaly_sigma * base.std(f"vib:{c}", 0.005)
            marks += [F.when(seen & spike, F.lit(f"{c}_spike")), F.when(seen & (f(f"mean_{c}") > limit), F.lit(f"{c}_mean"))]
    return _listed("vibration:", marks)


def off_state_current(f: Features, base: Baseline, cfg: SystemConfig) -> Column:
    away = F.abs(f("median_off_current") - base.median("current_off"))
    limit = cfg.thresholds.off_state_sigma * base.std("current_off")
    return _fires((f("n_off") >= 2) & (away > limit), "off_state_current")


def pressure_response(f: Features, base: Baseline, cfg: SystemConfig) -> Column:
    response = f(f"mean_{cfg.columns.pressure_off}") - f("off_before_mean")
    fast = F.col("interval_s") <= HIGH_RATE_SECONDS
    normal = F.when(fast, base.median("response_fast")).otherwise(base.median("response_slow"))
    spread = F.when(fast, base.std("response_fast", 0.5)).otherwise(base.std("response_slow", 0.5))
    off = F.abs(response - normal) > cfg.thresholds.anomaly_sigma * spread
    drop = response < -RESPONSE_NOISE * base.std("pressure_off", 0.5)
    return _fires((f("n_off_before") >= 2) & normal.isNotNull() & (off | drop), "pressure_response")


def temp_absolute_limit(f: Features, base: Baseline, cfg: SystemConfig) -> Column:
    limits = cfg.thresholds.absolute_temp_limits
    return _listed(f"{CRITICAL}:", [F.when(f(f"max_{c}") > v, F.lit(c)) for c, v in limits.items() if f.has(c)])


def differential_pressure(f: Features, base: Baseline, cfg: SystemConfig) -> Column:
    spread = base.stat("mean:outlet_pressure", "robust_std")
    limit = cfg.thresholds.anomaly_sigma * F.greatest(spread, F.lit(0.5))
    return _fires((f("cnt_head") >= 2) & spread.isNotNull() & (f("std_head") > limit), "differential_pressure")


def filter_condition(f: Features, base: Baseline, cfg: SystemConfig) -> Column:
    c = "filter_diff_pressure"
    limit = base.median(f"mean:{c}") + cfg.thresholds.anomaly_sigma * base.std(f"mean:{c}", 0.01)
    return _fires((f(f"cnt_{c}") >= 2) & (f(f"mean_{c}") > limit), "filter_condition")


def flow_anomaly(f: Features, base: Baseline, cfg: SystemConfig) -> Column:
    c = next((name for name in ("flow", "total_fw_flow") if f.has(name)), None)
    if c is None:
        return F.lit(None).cast("string")
    speed = base.median("speed")
    away = F.abs(f(f"mean_{c}_per_speed") - base.median(f"mean:{c}") / speed)
    limit = cfg.thresholds.anomaly_sigma * F.greatest(base.std(f"mean:{c}", 0.01) / speed, F.lit(1e-6))
    enough = (f(f"cnt_{c}") >= 2) & (f(f"cnt_{c}_per_speed") >= 2) & (speed > MIN_SPEED)
    return _fires(enough & (away > limit), "flow_anomaly:flow_speed_ratio")


def frequency_anomaly(f: Features, base: Baseline, cfg: SystemConfig) -> Column:
    mean = f("mean_frequency")
    limit = cfg.thresholds.anomaly_sigma * base.std("mean:frequency", 0.01)
    away = F.coalesce(F.abs(mean - base.median("mean:frequency")) > limit, F.lit(False))
    return _fires((f("cnt_frequency") >= 2) & ((mean < 1.0) | away), "frequency_anomaly")


def hydraulic_deficit(f: Features, base: Baseline, cfg: SystemConfig) -> Column:
    low = F.lit(True)
    for c, k in DEFICIT_SIGNALS:
        if not f.has(c):
            return F.lit(None).cast("string")
        key = "pressure_on" if c == "npsh_pressure" else f"mean:{c}"
        low = low & (f(f"cnt_{c}") >= 2) & (f(f"mean_{c}") < base.median(key) - k * base.std(key, 0.001))
    return _fires(low, "hydraulic_deficit")


def outlet_pressure(f: Features, base: Baseline, cfg: SystemConfig) -> Column:
    c, th = "outlet_pressure", cfg.thresholds
    mean, std, n = f(f"mean_{c}"), f(f"std_{c}"), f(f"cnt_{c}")
    normal, spread = base.median(f"mean:{c}"), base.std(f"mean:{c}", 0.0)
    speed, speed0 = f(f"mean_{cfg.columns.speed}"), base.median("speed")
    scaled = F.abs(mean / (speed * speed) - normal / (speed0 * speed0)) > th.anomaly_sigma * F.greatest(
        spread / (speed0 * speed0), F.lit(1e-9)
    )
    plain = F.abs(mean - normal) > th.anomaly_sigma * F.greatest(spread, F.lit(0.01))
    by_speed = F.coalesce((speed > MIN_SPEED) & (speed0 > MIN_SPEED), F.lit(False))
    shift = F.when(by_speed, scaled).otherwise(plain)
    var0 = base.median(f"var:{c}")
    restless = (var0 > 0) & ((std > var0 + th.anomaly_sigma * base.std(f"var:{c}", 0.01)) | (std > VARIABILITY_FACTOR * var0))
    cap = th.outlet_pressure_variability_cap
    capped = std > cap if cap > 0 else F.lit(False)
    frozen = (n >= th.frozen_sensor_min_samples) & (std < th.frozen_sensor_std_threshold)
    marks = F.array_compact(F.array(
        F.when(shift, f"{c}:mean_shift"),
        F.when(F.coalesce(restless, F.lit(False)) | capped, f"{c}:variability"),
        F.when(frozen, f"{c}:frozen"),
    ))
    return F.when((n >= 2) & (F.size(marks) > 0), F.array_join(marks, ";"))


def winding_temp_imbalance(f: Features, base: Baseline, cfg: SystemConfig) -> Column:
    pairs = []
    for c in WINDINGS:
        if f"wmean_{c}" in f.columns:
            z = (f(f"wmean_{c}") - base.median(f"mean:{c}")) / base.std(f"mean:{c}", 0.01)
            short = c.replace("motor_", "").replace("_winding_temp", "")
            pairs.append(F.struct(F.lit(short).alias("name"), F.when(f(f"wcnt_{c}") >= 2, F.abs(z)).alias("z")))
    if len(pairs) < 2:
        return F.lit(None).cast("string")
    usable = F.filter(F.array(*pairs), lambda p: p["z"].isNotNull())
    sigma = cfg.thresholds.anomaly_sigma
    high = F.filter(usable, lambda p: p["z"] > sigma)
    uneven = (F.size(high) > 0) & (F.size(high) < F.size(usable))
    names = F.array_join(F.transform(high, lambda p: p["name"]), ",")
    return F.when((F.size(usable) >= 2) & uneven, F.concat(F.lit("winding_temp_imbalance:"), names))


def outlier_vote(f: Features, base: Baseline, cfg: SystemConfig) -> Column:
    """Unanimous vote of three outlier models; the votes are joined per period beforehand."""
    votes = [f(f"vote_{m}").cast("int") for m in ("lof", "forest", "mahalanobis")]
    return _fires(votes[0] + votes[1] + votes[2] >= 3, "ml_ensemble")


BUILT_IN: dict[str, Detector] = {
    "speed_stability": speed_stability,
    "current_anomaly": current_anomaly,
    "current_speed_ratio": current_speed_ratio,
    "pressure_on": pressure_on,
    "pressure_off": pressure_off,
    "pressure_off_variability": pressure_off_variability,
    "pressure_off_extended": pressure_off_extended,
    "temperatures": temperatures,
    "temp_absolute_limit": temp_absolute_limit,
    "vibration": vibration,
    "off_state_current": off_state_current,
    "pressure_response": pressure_response,
}
_PLUGGED: dict[str, Detector] = {}


def register_detector(name: str, detector: Detector) -> None:
    """Add a detector. A built-in of the same name keeps precedence."""
    if not isinstance(name, str) or not callable(detector):
        raise TypeError("a detector needs a string name and a callable")
    if name in BUILT_IN:
        warnings.warn(f"detector '{name}' is built in; the built-in takes precedence", RuntimeWarning, stacklevel=2)
    elif name in _PLUGGED and _PLUGGED[name] is not detector:
        warnings.warn(f"detector '{name}' replaces an earlier one", RuntimeWarning, stacklevel=2)
    _PLUGGED[name] = detector


for _name, _detector in {
    "differential_pressure": differential_pressure,
    "filter_condition": filter_condition,
    "flow_anomaly": flow_anomaly,
    "frequency_anomaly": frequency_anomaly,
    "hydraulic_deficit": hydraulic_deficit,
    "outlet_pressure": outlet_pressure,
    "winding_temp_imbalance": winding_temp_imbalance,
    "ml_ensemble": outlier_vote,
}.items():
    register_detector(_name, _detector)


def resolve(names: Iterable[str]) -> dict[str, Detector]:
    """Detectors in configuration order; unknown names are skipped with a warning."""
    found = {}
    for name in names:
        detector = BUILT_IN.get(name) or _PLUGGED.get(name)
        if detector is None:
            warnings.warn(f"detector '{name}' not found, skipped", RuntimeWarning, stacklevel=2)
        else:
            found[name] = detector
    return found


def with_baseline(features: DataFrame, baseline: DataFrame) -> DataFrame:
    """Inner join: pumps without a baseline are skipped. Spark broadcasts it when it is small."""
    return features.join(baseline, "pump_id")


def detect(joined: DataFrame, cfg: SystemConfig, name: str) -> DataFrame:
    """One detector's reason per period."""
    reason = resolve([name])[name](Features(joined.columns), Baseline(), cfg)
    return joined.select("pump_id", "date", "period_id", reason.alias("reason"))


def insufficient_data() -> Column:
    needed = F.when(F.col("interval_s") >= COARSE_SECONDS, 2).otherwise(10)
    return F.when(F.col("n_steady") < needed, F.lit("insufficient_data"))


def categories(reasons: Column) -> Column:
    return F.array_distinct(F.transform(reasons, lambda r: F.regexp_extract(r, "^[^:;]*", 0)))


def classify(joined: DataFrame, cfg: SystemConfig) -> DataFrame:
    """All configured detectors: ``reasons`` and ``classification`` per period (reasons blank when normal)."""
    f, base = Features(joined.columns), Baseline()
    marks = [insufficient_data(), *[d(f, base, cfg) for d in resolve(cfg.detectors).values()]]
    out = joined.withColumn("_all", F.array_compact(F.array(*marks)))
    kinds = categories(F.col("_all"))
    th: Thresholds = cfg.thresholds
    bad = (F.size("_all") > 0) & ((F.size(kinds) >= th.min_detectors_for_abnormal) | F.array_contains(kinds, CRITICAL))
    out = out.withColumn("classification", F.when(bad, "abnormal").otherwise("normal"))
    reasons = F.when(bad, F.col("_all")).otherwise(F.array().cast("array<string>"))
    return out.withColumn("reasons", reasons).drop("_all")
