"""Sensor views over the given tables, shared by the registered queries.

``events`` is the measurement log: the event type is the sensor, a machine ("pump")
is a block of forty users, so the fleet grows with the data and every statistic per
machine stays the same size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rotorline.config import Columns, QualityConfig, ResampleRule, SelectorRule, SensorRule, SystemConfig, Thresholds
from rotorline.functions.formulas import season_of
from rotorline.functions.series import SEG
from rotorline.operators.features import fill_with_mean, norm_params, normalize, params_struct, smooth
from rotorline.operators.quality import bucket_start
from rotorline.operators.scoring import SpeedLine, residuals, window_error
from rotorline.session import materialize

STEP = 3 * 3600
USERS_PER_PUMP = 40
SENSORS = {
    "click": "speed", "view": "flow", "purchase": "outlet_pressure", "error": "motor_current", "signup": "de_bearing_temp",
}
CHANNELS = ["speed", "flow", "outlet_pressure", "motor_current", "de_bearing_temp"]
OUTPUTS = ["flow", "outlet_pressure", "de_bearing_temp"]
FILLED = ["flow", "outlet_pressure", "motor_current", "de_bearing_temp"]
HISTORY = 3

QUALITY = QualityConfig(
    sensors={
        "speed": SensorRule(0, 4000, True, True),
        "outlet_pressure": SensorRule(0, 60, True, True),
        "flow": SensorRule(0, 120, False, True),
        "motor_current": SensorRule(0, 100, False, True),
        "de_bearing_temp": SensorRule(5, 100, True, False),
    },
    timestep_seconds=STEP,
    frozen_tolerance=8.0,
    frozen_period_seconds=2 * STEP,
    variability_threshold=0.15,
    rolling_window_samples=3,
    rolling_min_periods=2,
    speed_on_threshold=500.0,
    min_consecutive_operational=2,
    resample=ResampleRule(2 * STEP, "mean", "max", "first"),
)
SYSTEM = SystemConfig(
    columns=Columns(
        speed="speed", current="motor_current", pressure="outlet_pressure", pressure_off="outlet_pressure",
        temps=("de_bearing_temp", "motor_current", "motor_u_winding_temp_1", "motor_u_winding_temp_2", "motor_u_winding_temp_3"),
        baseline_extra=("flow", "outlet_pressure", "filter_diff_pressure", "frequency", "total_fw_flow"),
        vibrations=("de_vibration", "nde_vibration"),
    ),
    thresholds=Thresholds(
        speed_on_threshold=500.0, gap_merge_threshold=float(STEP), ramp_exclude_seconds=5400.0, anomaly_sigma=1.0,
        vibration_spike_factor=1.0, pressure_off_absolute_threshold=10.0, pressure_off_rebound_threshold=8.0,
        pressure_off_extended_sigma=0.5, off_state_sigma=1.0, frozen_sensor_std_threshold=2.0, frozen_sensor_min_samples=2,
        outlet_pressure_variability_cap=60.0, min_detectors_for_abnormal=2,
        absolute_temp_limits={"de_bearing_temp": 95.0, "motor_u_winding_temp_1": 220.0},
        off_window_seconds=2.0 * STEP, near_period_seconds=300.0, extended_min_points=2,
    ),
    detectors=(
        "speed_stability", "current_speed_ratio", "temperatures", "vibration", "outlet_pressure", "flow_anomaly",
        "winding_temp_imbalance", "temp_absolute_limit",
    ),
    selector=SelectorRule(min_normal_duration_minutes=540.0, max_periods_per_day=3, exclude_reasons=("insufficient_data", "vibration", "flow_anomaly")),
)
EXTRA = ("npsh_pressure",)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long measurements: event_id, pump_id, user_id, date, ts, sensor, value."""
    e = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    return e.select(
        "event_id", (F.expr(f"user_id div {USERS_PER_PUMP}") + 1).cast("int").alias("pump_id"), "user_id",
        ts.cast("date").alias("date"), ts.alias("ts"), F.col("event_type").alias("sensor"), "value",
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide readings per machine and three-hour bucket; a slow bucket counts as stopped."""
    grouped = raw(spark, sf_dir).groupBy("pump_id", bucket_start("ts", STEP).alias("ts"))
    wide = grouped.agg(*[F.round(F.avg(F.when(F.col("sensor") == s, F.col("value"))), 6).alias(c) for s, c in SENSORS.items()])
    speed = F.when(F.col("speed") < 20, 0.0).otherwise(F.col("speed") * 20)
    return wide.select("pump_id", F.col("ts").cast("date").alias("date"), "ts", speed.alias("speed"), *CHANNELS[1:])


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of buckets in which the speed sensor reported: a series with time gaps."""
    return readings(spark, sf_dir).where(F.col("speed").isNotNull())


def machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings plus the channels only some plants have, derived from the measured ones."""
    r = readings(spark, sf_dir)
    return r.withColumns({
        "inlet_pressure": F.col("motor_current") * 0.5,
        "filter_diff_pressure": F.col("de_bearing_temp") / 10.0,
        "total_fw_flow": F.col("flow"),
        "npsh_pressure": F.col("outlet_pressure"),
        "frequency": F.col("speed") / 20.0,
        "motor_u_winding_temp_1": F.col("motor_current") * 2.0,
        "motor_u_winding_temp_2": F.col("de_bearing_temp") * 2.0,
        "motor_u_winding_temp_3": F.col("flow") * 2.0,
        "de_vibration": F.col("flow") / 100.0,
        "nde_vibration": F.col("outlet_pressure") / 100.0,
    })


def label_of(date: Column, pump: Column) -> Column:
    return F.when((F.dayofmonth(date) + pump) % 3 == 0, "abnormal").otherwise("normal")


def shifted_season(date: Column, pump: Column) -> Column:
    """Season of the date moved by three months per pump, so that all four occur in one month of data."""
    return season_of(F.add_months(date, (pump % 4) * 3))


def tagged(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "label": label_of(F.col("date"), F.col("pump_id")), "season": shifted_season(F.col("date"), F.col("pump_id")),
    })


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled readings for plans that read them several times: the raw table is scanned once."""
    return materialize(tagged(readings(spark, sf_dir)))


def predicted(spark: SparkSession, sf_dir: str, g: DataFrame | None = None) -> DataFrame:
    r = g if g is not None else grid(spark, sf_dir)
    return SpeedLine("speed", OUTPUTS).fit(r).transform(r)


def residual_rows(spark: SparkSession, sf_dir: str, g: DataFrame | None = None) -> DataFrame:
    """Complete residual rows; calibration and scoring both read them, so they are written once."""
    return materialize(residuals(predicted(spark, sf_dir, g), OUTPUTS))


def smoothed_rows(spark: SparkSession, sf_dir: str, g: DataFrame | None = None) -> DataFrame:
    """Filled (training mean of normal rows) and smoothed channels of days with at least five rows."""
    r = g if g is not None else grid(spark, sf_dir)
    means = params_struct(norm_params(r.where(F.col("label") == "normal"), FILLED), FILLED).scalar()
    held = r.withColumn("_m", means)
    filled = fill_with_mean(held, FILLED, {c: F.col("_m")[c]["mean"] for c in FILLED}).drop("_m")
    return smooth(filled, FILLED)


def scaled_rows(spark: SparkSession, sf_dir: str, g: DataFrame | None = None) -> DataFrame:
    s = materialize(smoothed_rows(spark, sf_dir, g))
    return normalize(s, norm_params(s.where(F.col("label") == "normal"), FILLED), FILLED, "z-score")


def windows(spark: SparkSession, sf_dir: str, g: DataFrame | None = None) -> DataFrame:
    """Level 2 window errors: mean squared distance from the normal centre over three rows."""
    z = scaled_rows(spark, sf_dir, g).withColumns({f"recon_{c}": F.lit(0.0) for c in FILLED})
    return window_error(z, FILLED, HISTORY).select(*SEG, "ts", "label", "season", "error")


def days(df: DataFrame, carry: Sequence[str] = ("label",)) -> DataFrame:
    return df.select(*SEG, *carry).distinct()
