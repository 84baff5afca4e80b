"""Level fusion, window ensembles and the alarm rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotorline.functions.asof import asof_join
from rotorline.functions.formulas import combined_severity, fuse, fusion_reason, rank_status, severity, status_rank
from rotorline.functions.series import SEG, TS, ordered, runs, so_far

# --- Fixed values -----------------------------------------------------------
MIN_CONSECUTIVE = 2
RATE_LIMIT_SECONDS = 3600
MIN_SESSION_STEPS = 3
MIN_ALERT_STEPS = 3
# ---------------------------------------------------------------------------


def fuse_days(level1: DataFrame, level2: DataFrame) -> DataFrame:
    """Full outer join of day results (status, severity per side).

    A day only level 2 knows gets a NORMAL zero row for level 1; a missing level 2 stays NULL.
    """
    one = level1.select(*SEG, F.col("status").alias("status_1"), F.col("severity").alias("severity_1"))
    two = level2.select(*SEG, F.col("status").alias("status_2"), F.col("severity").alias("severity_2"))
    out = one.join(two, list(SEG), "full_outer").withColumns({
        "status_1": F.coalesce("status_1", F.lit("NORMAL")), "severity_1": F.coalesce("severity_1", F.lit(0.0)),
    })
    return out.withColumns({
        "status": fuse(F.col("status_1"), F.col("status_2")),
        "severity": combined_severity(F.col("severity_1"), F.col("severity_2")),
        "reasoning": fusion_reason(F.col("status_1"), F.col("status_2")),
    })


def overall(days: DataFrame) -> DataFrame:
    """Worst status and highest severity; NORMAL and 0 without days."""
    return days.agg(
        F.coalesce(rank_status(F.max(status_rank(F.col("status")))), F.lit("NORMAL")).alias("overall_status"),
        F.coalesce(F.max("severity"), F.lit(0.0)).alias("overall_severity"),
        F.count(F.lit(1)).alias("n_days"),
    )


def align_windows(windows: DataFrame, steps: DataFrame, reach_seconds: float) -> DataFrame:
    """Level 1 step at or before each window end, within the window; none gives NORMAL and 0."""
    right = steps.select(*SEG, TS, F.col("distance").alias("l1_distance"), F.col("status").alias("l1_status"))
    joined = asof_join(windows, right, SEG, ["l1_distance", "l1_status"], reach_seconds, direction="backward")
    return joined.withColumns({
        "l1_distance": F.coalesce("l1_distance", F.lit(0.0)), "l1_status": F.coalesce("l1_status", F.lit("NORMAL")),
    })


def window_ensemble(aligned: DataFrame, level1_days: DataFrame) -> DataFrame:
    """Fused status and severity per window. ``aligned`` has window_status, smoothed, alarm (day level 2)."""
    day = level1_days.select(*SEG, F.col("day_max").alias("_peak"), F.col("severity").alias("_sev"))
    out = aligned.join(day, list(SEG), "left")
    share = F.when(F.col("_peak") > 0, F.col("_sev") * F.col("l1_distance") / F.col("_peak")).otherwise(0.0)
    return out.withColumns({
        "ensemble_status": fuse(F.col("l1_status"), F.col("window_status")),
        "ensemble_severity": combined_severity(share, severity(F.col("smoothed"), F.col("alarm"))),
    }).drop("_peak", "_sev")


def spike_filter(steps: DataFrame, status: str = "status", n: int = MIN_CONSECUTIVE, keys: Sequence[str] = SEG) -> DataFrame:
    """``filtered_status``: an anomaly shows from the ``n``-th consecutive anomalous step on."""
    hot = runs(steps, {"_hot": F.col(status).isin("WARNING", "ALARM")}, keys)
    shown = F.when(~F.col("_hot") | (F.col("_hot_pos") >= n), F.col(status)).otherwise("NORMAL")
    return hot.withColumn("filtered_status", shown).drop("_rn", "_hot_len")


def rate_limit(filtered: DataFrame, seconds_between: int = RATE_LIMIT_SECONDS, n: int = MIN_CONSECUTIVE,
               status: str = "status", keys: Sequence[str] = SEG) -> DataFrame:
    """``alert_fired``: the first shown ALARM of a run, then again once ``seconds_between`` have passed
    since the last one fired. Sequential by nature: a fold over the alarm times of one run of one segment."""
    eligible = F.col("_hot") & (F.col("_hot_pos") >= n) & (F.col(status) == "ALARM")
    times = filtered.where(eligible).groupBy(*keys, "_hot_run").agg(
        F.sort_array(F.collect_list(F.unix_micros(TS))).alias("_times")
    )
    gap = int(seconds_between * 1_000_000)
    fired = F.aggregate(
        "_times",
        F.array().cast("array<bigint>"),
        lambda seen, t: F.when(
            (F.size(seen) == 0) | (t - F.element_at(seen, -1) >= gap), F.array_append(seen, t)
        ).otherwise(seen),
    )
    alerts = times.select(*keys, F.explode(fired).alias("_at"))
    alerts = alerts.select(*keys, F.timestamp_micros("_at").alias(TS), F.lit(1).alias("_fired"))
    out = filtered.join(alerts, [*keys, TS], "left")
    return out.withColumn("alert_fired", F.coalesce("_fired", F.lit(0))).drop("_fired", "_hot", "_hot_run", "_hot_pos")


def session_counter(steps: DataFrame, status: str = "filtered_status", flag_at: int = MIN_SESSION_STEPS,
                    keys: Sequence[str] = SEG) -> DataFrame:
    hit = F.col(status).isin("WARNING", "ALARM").cast("int")
    out = steps.withColumn("session_alert_steps", F.sum(hit).over(so_far(ordered(keys))))
    return out.withColumn("session_flagged", (F.col("session_alert_steps") >= flag_at).cast("int"))


def day_flags(steps: DataFrame, status: str = "filtered_status", k: int = MIN_ALERT_STEPS) -> DataFrame:
    """Day flagged by ``k`` or more alert steps, consecutive or not."""
    n = F.count(F.when(F.col(status).isin("WARNING", "ALARM"), 1))
    days = steps.groupBy(*SEG).agg(F.count(F.lit(1)).alias("n_steps"), n.alias("n_alert_steps"))
    return days.withColumn("flagged", (F.col("n_alert_steps") >= k).cast("int"))
