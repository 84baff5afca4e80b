"""Drift, seasons, recalibration decisions and run summaries on the append-only day log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rotorline.config import SEASON_MONTHS
from rotorline.functions.formulas import season_of
from rotorline.functions.series import SEG

# --- Fixed values -----------------------------------------------------------
ROLLING_DAYS = 30
MIN_NORMAL_DAYS = 15
DRIFT_WARNING, DRIFT_CRITICAL = 0.15, 0.30
QUARTER_MONTHS = (1, 4, 7, 10)
QUARTER_DAYS = 85
APPLY_ABOVE = 0.05
MIN_SEASON_DAYS = 10
SIGMA = 2.0
METRICS = {"l1_mahalanobis": "l1_mean", "l2_smoothed_mse": "l2_mean"}
# ---------------------------------------------------------------------------


def is_normal(status: Column) -> Column:
    return F.lower(F.trim(status)) == "normal"


def _tail(log: DataFrame, rows: int) -> DataFrame:
    """Newest ``rows`` normal days per pump; the window keeps that many rows per task before the shuffle."""
    newest = Window.partitionBy("pump_id").orderBy(F.desc("date"))
    normal = log.where(is_normal(F.col("day_status")))
    return normal.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= rows).drop("_k")


def rolling_stats(log: DataFrame, rows: int = ROLLING_DAYS) -> DataFrame:
    tail = _tail(log, rows).groupBy("pump_id").agg(
        F.avg("l1_mean").alias("l1_rolling_mean"), F.avg("l2_mean").alias("l2_rolling_mean")
    )
    days = log.where(is_normal(F.col("day_status"))).groupBy("pump_id").agg(
        F.count(F.lit(1)).alias("n_normal_days"), F.max("date").alias("last_date")
    )
    return days.join(tail, "pump_id")


def drift_percent(rolling: Column, training: Column) -> Column:
    zero = F.abs(training) <= 1e-8
    still = F.abs(rolling - training) <= 1e-8 + 1e-5 * F.abs(training)
    none = F.when(F.abs(rolling) <= 1e-8, 0.0).otherwise(float("inf"))
    return F.when(zero, F.when(still, 0.0).otherwise(none)).otherwise(F.try_divide(rolling - training, training))


def drift(log: DataFrame, training: DataFrame, rows: int = ROLLING_DAYS) -> DataFrame:
    """Alerts per pump and metric: rolling mean of normal days against the training mean.

    ``training``: metric, training_mean. Pumps with fewer than 15 normal days are quiet.
    """
    stats = rolling_stats(log, rows).where(F.col("n_normal_days") >= MIN_NORMAL_DAYS)
    cells = F.array(
        F.struct(F.lit("l1_mahalanobis").alias("metric"), F.col("l1_rolling_mean").alias("rolling_mean")),
        F.struct(F.lit("l2_smoothed_mse").alias("metric"), F.col("l2_rolling_mean").alias("rolling_mean")),
    )
    long = stats.select("pump_id", "last_date", F.explode(cells).alias("_c")).select("pump_id", "last_date", "_c.*")
    out = long.where(F.col("rolling_mean").isNotNull()).join(training, "metric")
    out = out.withColumn("drift", drift_percent(F.col("rolling_mean"), F.col("training_mean")))
    size = F.abs("drift")
    level = F.when(size >= DRIFT_CRITICAL, "CRITICAL").when(size >= DRIFT_WARNING, "WARNING")
    return out.withColumn("level", level).where(F.col("level").isNotNull())


def recalibration_reason(today: Column, last: Column, n_alerts: Column, after_maintenance: Column) -> Column:
    due = F.month(today).isin(*QUARTER_MONTHS) & (last.isNull() | (F.datediff(today, last) > QUARTER_DAYS))
    return F.when(after_maintenance, "post_maintenance").when(n_alerts > 0, "drift_alert").when(due, "quarterly").otherwise("none")


def compare_thresholds(old: DataFrame, new: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Outer comparison by pump and metric; the change is infinite when the old value is missing or 0 and
    the new one is not."""
    def long(df: DataFrame, name: str) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics if m in df.columns])
        return df.select("pump_id", F.explode(cells).alias("_c")).select("pump_id", "_c.*").where(F.col(name).isNotNull())

    both = long(old, "old").join(long(new, "new"), ["pump_id", "metric"], "full_outer")
    no_old = F.col("old").isNull() | (F.abs("old") <= 1e-8)
    no_new = F.col("new").isNull() | (F.abs("new") <= 1e-8)
    change = F.when(no_old, F.when(no_new, 0.0).otherwise(float("inf"))).otherwise((F.col("new") - F.col("old")) / F.col("old"))
    return both.withColumn("pct_change", change)


def should_apply(comparison: DataFrame, above: float = APPLY_ABOVE) -> DataFrame:
    big = F.coalesce(F.abs("pct_change") > above, F.lit(False))
    return comparison.agg(F.coalesce(F.bool_or(big), F.lit(False)).cast("int").alias("apply"))


def with_log_season(log: DataFrame) -> DataFrame:
    """Season label of the log, derived from the date when empty."""
    text = F.lower(F.coalesce("season", F.lit("")))
    return log.withColumn("season", F.when(text == "", season_of(F.col("date"))).otherwise(text))


def seasonal_stats(log: DataFrame) -> DataFrame:
    normal = with_log_season(log).where(is_normal(F.col("day_status")) & F.col("l1_mean").isNotNull())
    return normal.groupBy("pump_id", "season").agg(
        F.avg("l1_mean").alias("l1_avg"), F.stddev_pop("l1_mean").alias("l1_std"),
        F.avg("l2_mean").alias("l2_avg"), F.stddev_pop("l2_mean").alias("l2_std"), F.count(F.lit(1)).alias("n_days"),
    )


def seasonal_deviation(stats: DataFrame, stored: DataFrame | None = None, sigma: float = SIGMA) -> DataFrame:
    """z of each season mean against the stored baseline of (pump, season), else against the spread of the
    pump's season means. At least ten days; ``deviates_l1``/``deviates_l2`` at two sigma."""
    pump = Window.partitionBy("pump_id")
    out = stats.withColumns({
        "_m1": F.avg("l1_avg").over(pump), "_s1": F.stddev_pop("l1_avg").over(pump),
        "_m2": F.avg("l2_avg").over(pump), "_s2": F.stddev_pop("l2_avg").over(pump),
    })
    if stored is not None:
        base = stored.select("pump_id", "season", F.struct("l1_mean", "l1_std", "l2_mean", "l2_std").alias("_b"))
        out = out.join(base, ["pump_id", "season"], "left")
        for n in ("1", "2"):
            out = out.withColumns({
                f"_m{n}": F.when(F.col("_b").isNull(), F.col(f"_m{n}")).otherwise(F.col(f"_b.l{n}_mean")),
                f"_s{n}": F.when(F.col("_b").isNull(), F.col(f"_s{n}")).otherwise(F.col(f"_b.l{n}_std")),
            })
        out = out.drop("_b")
    z = {f"z_l{n}": F.when(F.col(f"_s{n}") > 0, (F.col(f"l{n}_avg") - F.col(f"_m{n}")) / F.col(f"_s{n}")) for n in ("1", "2")}
    out = out.where(F.col("n_days") >= MIN_SEASON_DAYS).withColumns(z)
    return out.withColumns({
        f"deviates_l{n}": F.coalesce(F.abs(f"z_l{n}") >= sigma, F.lit(False)).cast("int") for n in ("1", "2")
    }).drop("_m1", "_s1", "_m2", "_s2")


def seasonal_report(stats: DataFrame) -> DataFrame:
    """All pumps and seasons, dashes where there is no data."""
    seasons = F.explode(F.array(*[F.lit(s) for s in SEASON_MONTHS]))
    every = stats.select("pump_id").distinct().select("pump_id", seasons.alias("season"))
    joined = every.join(stats, ["pump_id", "season"], "left")

    def text(c: str) -> Column:
        return F.coalesce(F.format_string("%.6f", F.col(c)), F.lit("-"))

    shown = {c: F.when(F.col(c).isNull(), "-").otherwise(text(c)) for c in ("l1_avg", "l1_std", "l2_avg", "l2_std")}
    return joined.withColumns(shown).fillna(0, ["n_days"])


def quality_summary(stats: DataFrame) -> DataFrame:
    """Segments, rows and skips per pump and in total (pump_id NULL). Counts the reasons as produced."""
    def n(reason: str) -> Column:
        return F.count(F.when(F.col("skip_reason") == reason, 1))

    return stats.groupingSets([["pump_id"], []], "pump_id").agg(
        F.count(F.lit(1)).alias("n_segments"), F.sum("written").alias("n_written"),
        F.sum("input_rows").alias("input_rows"), F.sum("output_rows").alias("output_rows"),
        F.sum("sentinel_rows").alias("sentinel_rows"), n("all_frozen").alias("skipped_frozen"),
        n("no_rows_after_steps").alias("skipped_empty"),
    )


def code_summary(counts: DataFrame) -> DataFrame:
    """Bad cells per code and sensor with both subtotals; ``counts``: sensor, code, n_cells."""
    bad = counts.where(F.col("code") > 0)
    return bad.groupingSets([["sensor", "code"], ["sensor"], ["code"], []], "sensor", "code").agg(F.sum("n_cells").alias("n_cells"))


def day_log(l1_days: DataFrame, l2_days: DataFrame, status: DataFrame) -> DataFrame:
    """Rows to append to the day log."""
    one = l1_days.select(*SEG, F.col("day_mean").alias("l1_mean"))
    two = l2_days.select(*SEG, F.col("day_smoothed").alias("l2_mean"))
    out = one.join(two, list(SEG), "left").join(status.select(*SEG, F.col("status").alias("day_status")), list(SEG))
    return out.withColumn("season", season_of(F.col("date")))


def record_recalibration(records: DataFrame, path: str) -> None:
    """Append recalibrations: (pump_id, date, reason, applied)."""
    records.select("pump_id", "date", "reason", "applied").write.mode("append").parquet(path)


def recalibration_history(spark: SparkSession, path: str) -> DataFrame:
    """All recorded recalibrations; ``is_last`` marks the newest of each pump."""
    history = spark.read.parquet(path)
    last = history.groupBy("pump_id").agg(F.max("date").alias("_last"))
    return history.join(last, "pump_id").withColumn("is_last", F.col("date") == F.col("_last")).drop("_last")
