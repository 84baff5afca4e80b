"""Two-level scoring: residual distance per step, window error with smoothing, day results."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rotorline.functions.formulas import (
    channel_health,
    channel_z,
    mahalanobis,
    rank_status,
    severity,
    status_of,
    status_rank,
)
from rotorline.functions.series import SEG, TS, ema, last_rows, ordered

# --- Fixed values -----------------------------------------------------------
FEATURE_Z_LIMIT = 3.0
STD_FLOOR = 1e-12
SUSTAINED_ALARM_SHARE = 0.02
TOP_STEPS = 5
ALPHA = 0.3
LOW_HEALTH = 50.0
# ---------------------------------------------------------------------------


class Scorer(Protocol):
    """Any model that fills the predictor or reconstruction slot."""

    def fit(self, df: DataFrame) -> Scorer: ...

    def transform(self, df: DataFrame) -> DataFrame: ...


class SpeedLine:
    """Per-pump straight line of each output on one condition (two aggregates per channel, no solver)."""

    def __init__(self, condition: str, outputs: Sequence[str]):
        self.condition, self.outputs, self.lines = condition, list(outputs), None

    def fit(self, df: DataFrame) -> SpeedLine:
        x = F.col(self.condition)
        aggs = []
        for c in self.outputs:
            aggs += [F.regr_slope(F.col(c), x).alias(f"_k_{c}"), F.regr_intercept(F.col(c), x).alias(f"_b_{c}")]
        self.lines = df.groupBy("pump_id").agg(*aggs)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        joined = df.join(self.lines, "pump_id", "left")
        predicted = {f"pred_{c}": F.col(f"_k_{c}") * F.col(self.condition) + F.col(f"_b_{c}") for c in self.outputs}
        return joined.withColumns(predicted).drop(*[f"_{p}_{c}" for c in self.outputs for p in ("k", "b")])


class LinearConditions:
    """Spark ML linear regression per output on the padded history of the conditions and the pump indicators."""

    def __init__(self, conditions: Sequence[str], outputs: Sequence[str], history: int = 3):
        self.conditions, self.outputs, self.history, self.models = list(conditions), list(outputs), history, {}

    def _features(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        from rotorline.operators.features import padded_history

        hist = padded_history(df, self.conditions, self.history, out="_hist")
        return hist.withColumn("_x", array_to_vector("_hist")).drop("_hist")

    def fit(self, df: DataFrame) -> LinearConditions:
        from pyspark.ml.regression import LinearRegression

        data = self._features(df.dropna(subset=self.conditions))
        for c in self.outputs:
            rows = data.where(F.col(c).isNotNull())
            fitter = LinearRegression(featuresCol="_x", labelCol=c, predictionCol=f"pred_{c}", regParam=1e-6)
            self.models[c] = fitter.fit(rows)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = self._features(df.dropna(subset=self.conditions))
        for model in self.models.values():
            out = model.transform(out)
        return out.drop("_x")


def score_with(df: DataFrame, score: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """Plug-in scorer over Arrow batches; no grouping is needed, so partitions stay as they are."""
    return df.mapInPandas(score, schema)


def residuals(df: DataFrame, channels: Sequence[str], keep_incomplete: bool = False) -> DataFrame:
    """``res_<channel>`` = actual - predicted; rows with any NULL dropped."""
    out = df.withColumns({f"res_{c}": F.col(c) - F.col(f"pred_{c}") for c in channels})
    return out if keep_incomplete else out.dropna(subset=[f"res_{c}" for c in channels])


def dropped_rows(df: DataFrame, channels: Sequence[str], by: Sequence[str] = ("pump_id",)) -> DataFrame:
    """Rows scored and rows dropped for a NULL, per group."""
    gap = residuals(df, channels, keep_incomplete=True)
    whole_row = F.lit(True)
    for c in channels:
        whole_row = whole_row & F.col(f"res_{c}").isNotNull()
    return gap.groupBy(*by).agg(
        F.count(F.when(whole_row, 1)).alias("n_scored"), F.count(F.when(~whole_row, 1)).alias("n_dropped")
    )


def pump_from_name(column: Column | None, file_name: Column) -> Column:
    """Pump id from its column, else from the file name."""
    named = F.regexp_extract(F.lower(file_name), r"pump[_-]?(\d+)", 1)
    parsed = F.expr("try_cast(null as int)") if column is None else column
    return F.coalesce(parsed, F.when(named != "", named.cast("int")))


def deltas(channels: Sequence[str], mean: Column) -> dict[str, Column]:
    return {c: F.col(f"res_{c}") - mean[c] for c in channels}


def distance(channels: Sequence[str], mean: Column, inverse: Column) -> Column:
    """Distance of the residual vector; channels are addressed by name, never by position."""
    return mahalanobis(deltas(channels, mean), inverse)


def feature_scores(channels: Sequence[str], mean: Column, std: Column) -> Column:
    rows = []
    for c in channels:
        z = (F.col(f"res_{c}") - mean[c]) / F.greatest(std[c], F.lit(STD_FLOOR))
        rows.append(F.struct(
            F.lit(c).alias("feature"), F.col(c).alias("actual"), F.col(f"pred_{c}").alias("predicted"),
            F.col(f"res_{c}").alias("residual"), z.alias("z"), (F.abs(z) > FEATURE_Z_LIMIT).alias("is_anomalous"),
        ))
    return F.array(*rows)


def score_steps(res: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Level 1 per step. ``res`` carries the resolved threshold block (mean_vec, std_vec, cov_inv, warning, alarm)."""
    d = distance(channels, F.col("mean_vec"), F.col("cov_inv"))
    out = res.withColumn("distance", d).withColumn(
        "feature_scores", feature_scores(channels, F.col("mean_vec"), F.col("std_vec"))
    )
    alarm = F.greatest(F.col("alarm"), F.col("warning"))
    return out.withColumn("alarm", alarm).withColumn("status", status_of(F.col("distance"), F.col("warning"), F.col("alarm")))


def level1_days(steps: DataFrame, top: int = TOP_STEPS) -> DataFrame:
    """Day results: an alarm day needs the peak above alarm and 2 % of steps in alarm."""
    days = steps.groupBy(*SEG).agg(
        F.avg("distance").alias("day_mean"), F.max("distance").alias("day_max"),
        F.avg((status_rank(F.col("status")) >= 1).cast("double")).alias("share_warning"),
        F.avg((F.col("status") == "ALARM").cast("double")).alias("share_alarm"),
        F.count(F.lit(1)).alias("n_steps"), F.max("warning").alias("warning"), F.max("alarm").alias("alarm"),
    )
    peak = F.col("day_max")
    status = (
        F.when((peak >= F.col("alarm")) & (F.col("share_alarm") >= SUSTAINED_ALARM_SHARE), "ALARM")
        .when(peak >= F.col("warning"), "WARNING")
        .otherwise("NORMAL")
    )
    return days.withColumn("status", status).withColumn("severity", severity(peak, F.col("alarm")))


def top_steps(steps: DataFrame, k: int = TOP_STEPS) -> DataFrame:
    w = Window.partitionBy(*SEG).orderBy(F.desc("distance"), TS)
    return steps.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def channel_healths(res: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Long (segment, ts, channel, health, z) from ``per_feature`` statistics of the threshold block."""
    cells = []
    for c in channels:
        stat = F.col("per_feature")[c]
        mean, std, p99 = stat["mean_residual"], stat["std_residual"], stat["p99_abs"]
        r = F.col(f"res_{c}")
        cells.append(F.struct(
            F.lit(c).alias("channel"), channel_health(r, std, p99, mean).alias("health"), channel_z(r, std, mean).alias("z")
        ))
    return res.select(*SEG, TS, F.explode(F.array(*cells)).alias("_c")).select(*SEG, TS, "_c.*")


def channel_health_days(healths: DataFrame) -> DataFrame:
    return healths.groupBy(*SEG, "channel").agg(
        F.avg("health").alias("mean_health"), F.min("health").alias("min_health"),
        F.avg("z").alias("mean_z"), F.max("z").alias("max_z"),
        F.count(F.when(F.col("health") < LOW_HEALTH, 1)).alias("n_low"),
    )


def window_error(df: DataFrame, channels: Sequence[str], history: int, keys: Sequence[str] = SEG, ts: str = TS,
                 skip_first: bool = True, absolute: bool = False) -> DataFrame:
    """Mean squared (or absolute) gap between ``<channel>`` and ``recon_<channel>`` over the last ``history`` rows.

    The mean over a window is the rolling mean of the row means, so no window array is built.
    """
    gap = [F.col(c) - F.col(f"recon_{c}") for c in channels]
    cells = [F.abs(g) if absolute else g * g for g in gap]
    w = ordered(keys, ts)
    out = df.withColumn("_row", sum(cells[1:], cells[0]) / len(cells)).withColumn("_i", F.row_number().over(w))
    out = out.withColumn("error", F.avg("_row").over(last_rows(w, history)))
    return out.where(F.col("_i") > (history if skip_first else history - 1)).drop("_row", "_i")


def array_error(x: Column, recon: Column, absolute: bool = False) -> Column:
    """Error of one flattened window against its reconstruction."""
    gap = F.zip_with(x, recon, lambda a, b: F.abs(a - b) if absolute else (a - b) * (a - b))
    return F.aggregate(gap, F.lit(0.0), lambda s, v: s + v) / F.size(x)


def smooth_errors(windows: DataFrame, seed: str = "first", training_mean: Column | None = None,
                  alpha: float = ALPHA, keys: Sequence[str] = SEG) -> DataFrame:
    """``smoothed`` per segment; the seed is the first error (batch) or the training mean (stream)."""
    if seed not in ("first", "training_mean"):
        raise ValueError("seed must be 'first' or 'training_mean'")
    start = training_mean if seed == "training_mean" else None
    return ema(windows, "error", "smoothed", keys, alpha=alpha, seed=start)


def level2_days(windows: DataFrame) -> DataFrame:
    """Window status on the smoothed error, day status on the mean raw error.

    ``windows`` carries warning, alarm, window_warning and window_alarm.
    """
    marked = windows.withColumn(
        "window_status", status_of(F.col("smoothed"), F.col("window_warning"), F.col("window_alarm"), strict=False)
    )
    days = marked.groupBy(*SEG).agg(
        F.avg("error").alias("day_error"), F.count(F.lit(1)).alias("n_windows"),
        F.avg((status_rank(F.col("window_status")) >= 1).cast("double")).alias("share_warning"),
        F.avg((F.col("window_status") == "ALARM").cast("double")).alias("share_alarm"),
        F.max("warning").alias("warning"), F.max("alarm").alias("alarm"),
    )
    day = F.col("day_error")
    out = days.withColumn("status", status_of(day, F.col("warning"), F.col("alarm"), strict=False))
    return out.withColumn("severity", severity(day, F.col("alarm")))


def apply_seasonal_days(days: DataFrame, seasonal: DataFrame) -> DataFrame:
    """Season override of day thresholds (season, pump_id, s_warning, s_alarm, s_fallback); day level only."""
    joined = days.join(seasonal, ["season", "pump_id"], "left")
    use = F.coalesce(~F.col("s_fallback"), F.lit(False))
    out = joined.withColumns({
        "warning": F.when(use, F.col("s_warning")).otherwise(F.col("warning")),
        "alarm": F.when(use, F.col("s_alarm")).otherwise(F.col("alarm")),
    })
    day = F.col("day_error")
    return out.withColumns({
        "status": status_of(day, F.col("warning"), F.col("alarm"), strict=False), "severity": severity(day, F.col("alarm")),
    }).drop("s_warning", "s_alarm", "s_fallback")


def step_table(l1_steps: DataFrame, l2_windows: DataFrame, labels: DataFrame, min_rows: int = 5) -> DataFrame:
    """Both levels per step of labelled days: step index per day, missing level 2 NULL, short days skipped."""
    w = ordered()
    sized = l1_steps.withColumns({
        "_rows": F.count(F.lit(1)).over(Window.partitionBy(*SEG)), "step": F.row_number().over(w) - 1,
    }).where(F.col("_rows") >= min_rows)
    second = l2_windows.select(*SEG, TS, F.col("smoothed").alias("l2"))
    joined = sized.select(*SEG, TS, "step", F.col("distance").alias("l1")).join(second, [*SEG, TS], "left")
    return joined.join(labels, list(SEG))


def worst(statuses: Column) -> Column:
    """Worst of a status column under aggregation."""
    return rank_status(F.max(status_rank(statuses)))
