"""Operation periods, steady state and the robust per-pump baseline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rotorline.config import SystemConfig
from rotorline.functions.ordered import quantiles_of, running_totals
from rotorline.functions.series import SEG, TS, backwards, ordered, plus_seconds, seconds, so_far, whole

# --- Fixed values -----------------------------------------------------------
MAD_SCALE = 1.4826
HIGH_RATE_SECONDS = 30.0
COARSE_SECONDS = 240.0
STEADY_MIN_SECONDS = 120.0
# Smallest spread a robust statistic may have, by kind of statistic.
STD_FLOOR = {"response_fast": 0.5, "response_slow": 0.5, "mean": 0.01, "var": 0.01, "vib": 0.005}
# ---------------------------------------------------------------------------

PERIOD = ("pump_id", "date", "period_id")


def mark_periods(df: DataFrame, cfg: SystemConfig, keys: Sequence[str] = SEG, ts: str = TS) -> DataFrame:
    """Rows with the operation period that each one opens or closes, if any.

    ON runs are merged over short gaps and kept when long enough. A run opens a period unless the gap to the ON row
    before it is short, so runs are numbered by a running sum over the rows. Adds ``_us``, ``interval_s``, ``_opens`` and
    ``_closes`` (true on the first and last row of a period that counts) and, on the opening row only, ``_p``: its
    start, end, duration_seconds, n_rows and the ON row before it. One exchange, no join, no list.
    """
    th = cfg.thresholds
    df = df.withColumn("_us", F.unix_micros(ts))
    w = ordered(keys, "_us")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumns({
        "_on": F.coalesce(F.col(cfg.columns.speed) > th.speed_on_threshold, F.lit(False)),
        "_gap": seconds(ts) - seconds(F.lag(ts).over(w)),
        "_rn": F.row_number().over(w),
    })
    usual = F.median("_gap").over(whole(keys))
    out = out.withColumns({
        "interval_s": F.when(usual > 0, usual).otherwise(5.0),
        "_was_on": F.coalesce(F.lag("_on").over(w), F.lit(False)),
        "_last_on": F.last(F.when(F.col("_on"), F.col(ts)), ignorenulls=True).over(before),
    })
    pause = seconds(ts) - seconds("_last_on") - F.col("interval_s")
    opens = F.col("_on") & ~F.col("_was_on") & (F.col("_last_on").isNull() | (pause > th.gap_merge_threshold))
    out = out.withColumn("_open", opens).withColumn("_no", F.sum(F.col("_open").cast("int")).over(so_far(w)))
    own = Window.partitionBy(*keys, "_no")
    on_ts, on_rn = F.when(F.col("_on"), F.col(ts)), F.when(F.col("_on"), F.col("_rn"))
    out = out.withColumns({
        "_start": F.min(on_ts).over(own), "_end": F.max(on_ts).over(own), "_end_rn": F.max(on_rn).over(own),
        "_rows": F.max(on_rn).over(own) - F.min(on_rn).over(own) + 1,
    })
    duration = seconds("_end") - seconds("_start") + F.col("interval_s")
    needed = F.when(
        F.col("interval_s") >= COARSE_SECONDS, F.greatest(F.lit(th.min_period_duration), F.col("interval_s") * 3.0)
    ).otherwise(th.min_period_duration)
    entry = F.struct(
        F.col("_start").alias("start"), F.col("_end").alias("end"), duration.alias("duration_seconds"),
        F.col("_rows").alias("n_rows"), F.col("_last_on").alias("on_before"),
    )
    counts = F.coalesce((F.col("_no") > 0) & (duration >= needed), F.lit(False))
    out = out.withColumns({
        "_opens": F.col("_open") & counts, "_closes": counts & (F.col("_rn") == F.col("_end_rn")), "_p": F.when(F.col("_open") & counts, entry),
    })
    return out.drop("_on", "_gap", "_rn", "_was_on", "_last_on", "_open", "_no", "_start", "_end", "_end_rn", "_rows")


def detect_periods(df: DataFrame, cfg: SystemConfig, keys: Sequence[str] = SEG, ts: str = TS) -> DataFrame:
    """One row per period: ``start``, ``end``, ``duration_seconds``, ``n_rows`` (rows between start and end,
    merged gaps included) and the segment's ``interval_s``."""
    opened = mark_periods(df.select(*keys, ts, cfg.columns.speed), cfg, keys, ts).where("_opens")
    number = F.row_number().over(ordered(keys, "_us"))
    return opened.select(*keys, number.alias("period_id"), "_p.*", "interval_s").drop("on_before")


def period_rows(df: DataFrame, cfg: SystemConfig, keys: Sequence[str] = SEG, ts: str = TS) -> DataFrame:
    """Each period with the rows of its segment up to ``off_window_seconds`` after it and the flags detectors need.

    A row belongs to the period it lies in, to the OFF windows around it, and to the stretch after the last ON row before
    the next period. Periods do not overlap, so these are the periods from one number to another, and both numbers are
    counts of openings and closings up to a time. The opening row brings the period's own values to the others.
    """
    th, speed = cfg.thresholds, F.col(cfg.columns.speed)
    p_off = cfg.columns.pressure_off
    marked = mark_periods(df, cfg, keys, ts)
    margin, window = int(th.near_period_seconds * 1e6), int(th.off_window_seconds * 1e6)

    def up_to(flag: str, offset_us: int) -> Column:
        return F.coalesce(F.sum(F.col(flag).cast("int")).over(ordered(keys, "_us").rangeBetween(Window.unboundedPreceding, offset_us)), F.lit(0))

    following = backwards(keys, "_us").rowsBetween(Window.unboundedPreceding, -1)
    marked = marked.withColumns({
        "_begun": up_to("_opens", 0), "_near": up_to("_opens", margin) - up_to("_closes", -margin - 1) > 0,
        "_low": up_to("_closes", -window - 1) + 1, "_high": up_to("_opens", window),
    }).withColumn("_next", F.last("_p", ignorenulls=True).over(following))
    apart = (speed == 0) & ~F.col("_near")
    pressure = F.col(p_off) if p_off in df.columns else F.lit(None).cast("double")
    since_on = F.col("_next.on_before").isNull() | (F.col("_us") >= F.unix_micros("_next.on_before") + margin)
    marked = marked.withColumns({
        "segment_pressure_off": F.avg(F.when(apart, pressure)).over(whole(keys)),
        "segment_current_off": F.avg(F.when(apart, F.col(cfg.columns.current))).over(whole(keys)),
        "segment_off_rows": F.count(F.when(apart, 1)).over(whole(keys)),
        "_high": F.when(F.col("_next").isNotNull() & since_on, F.greatest("_high", F.col("_begun") + 1)).otherwise(F.col("_high")),
    })
    joined = marked.where("_low <= _high").withColumn("period_id", F.explode(F.sequence("_low", "_high")))
    opening = F.when(F.col("_opens") & (F.col("_begun") == F.col("period_id")), F.col("_p"))
    joined = joined.withColumn("_p", F.max(opening).over(Window.partitionBy(*keys, "period_id")))
    joined = joined.select("*", *[f"_p.{c}" for c in ("start", "end", "duration_seconds", "n_rows")], F.col("_p.on_before").alias("_last_on")).drop(
        "_us", "_opens", "_closes", "_p", "_begun", "_near", "_low", "_high", "_next")
    t, start, end = F.col(ts), F.col("start"), F.col("end")
    inside = (t >= start) & (t <= end)
    steady_from, steady_to = plus_seconds(start, th.ramp_exclude_seconds), plus_seconds(end, -th.ramp_exclude_seconds)
    per = Window.partitionBy(*keys, "period_id")
    stopped = F.coalesce(speed == 0, F.lit(False))
    out = joined.withColumns({
        "_in": inside,
        "_cand": inside & (t >= steady_from) & (t <= steady_to),
        "off_before": (t >= plus_seconds(start, -th.off_window_seconds)) & (t < start) & stopped,
        "off_after": (t > end) & stopped,
        "_wide": (seconds(steady_to) - seconds(steady_from)) >= STEADY_MIN_SECONDS,
    })
    out = out.withColumns({
        "_pos": F.sum(F.col("_in").cast("int")).over(so_far(per.orderBy(ts))) - 1,
        "_n_in": F.sum(F.col("_in").cast("int")).over(per),
        "_has_cand": F.max(F.col("_cand").cast("int")).over(per) == 1,
    })
    low = F.floor(F.col("_n_in") * 0.25)
    high = F.greatest(F.ceil(F.col("_n_in") * 0.75), F.least(F.col("_n_in"), low + 1))
    middle = F.col("_in") & (F.col("_pos") >= low) & (F.col("_pos") < high)
    quiet = F.coalesce(speed, F.lit(0.0)) == 0
    since = F.col("_last_on").isNull() | (t >= plus_seconds(F.col("_last_on"), th.near_period_seconds))
    return out.withColumns({
        "steady": F.when(F.col("_wide") & F.col("_has_cand"), F.col("_cand")).otherwise(middle),
        "off_extended": quiet & (t < start) & since,
        "off_after_extended": quiet & (t > end),
    }).drop("_in", "_cand", "_wide", "_pos", "_n_in", "_has_cand", "_last_on")


def _when(flag: str, value: Column) -> Column:
    return F.when(F.col(flag), value)


def period_features(df: DataFrame, cfg: SystemConfig, extra: Sequence[str] = (), keys: Sequence[str] = SEG,
                    ts: str = TS) -> DataFrame:
    """One wide row per period: everything the baseline and the detectors read.

    ``mean_/std_/max_/cnt_<channel>`` over steady rows, plus OFF-state aggregates.
    """
    c, th = cfg.columns, cfg.thresholds
    channels = list(dict.fromkeys(
        [c.speed, c.current, *([c.pressure] if c.pressure else []), *c.baseline_channels, *c.vibrations, *extra]
    ))
    channels = [name for name in channels if name in df.columns]
    rows = period_rows(df, cfg, keys, ts)
    speed, current = F.col(c.speed), F.col(c.current)
    aggs: list[Column] = [F.sum(F.col("steady").cast("int")).alias("n_steady")]
    for name in channels:
        v = _when("steady", F.col(name))
        aggs += [F.avg(v).alias(f"mean_{name}"), F.stddev_pop(v).alias(f"std_{name}"),
                 F.max(v).alias(f"max_{name}"), F.count(v).alias(f"cnt_{name}")]
    ratio = F.when(F.col("steady") & (F.abs(speed) > 1e-6), current / speed)
    aggs += [F.avg(ratio).alias("mean_ratio"), F.count(ratio).alias("cnt_ratio")]
    for flow in ("flow", "total_fw_flow"):
        if flow in df.columns:
            r = F.when(F.col("steady") & (speed > 100), F.col(flow) / speed)
            aggs += [F.avg(r).alias(f"mean_{flow}_per_speed"), F.count(r).alias(f"cnt_{flow}_per_speed")]
    if {"outlet_pressure", "inlet_pressure"} <= set(df.columns):
        head = _when("steady", F.col("outlet_pressure") - F.col("inlet_pressure"))
        aggs += [F.stddev_pop(head).alias("std_head"), F.count(head).alias("cnt_head")]
    for name in WINDINGS:
        if name in df.columns:
            v = F.when(F.col("steady") & (F.col(name) <= WINDING_LIMIT), F.col(name))
            aggs += [F.avg(v).alias(f"wmean_{name}"), F.count(v).alias(f"wcnt_{name}")]
    p_off = c.pressure_off if c.pressure_off in df.columns else None
    any_off = F.col("off_before") | F.col("off_after")
    aggs += [
        F.sum(F.col("off_before").cast("int")).alias("n_off_before"),
        F.sum(F.col("off_after").cast("int")).alias("n_off_after"),
        F.sum(any_off.cast("int")).alias("n_off"),
        F.median(F.when(any_off, current)).alias("median_off_current"),
        F.max("segment_pressure_off").alias("segment_pressure_off"),
        F.max("segment_current_off").alias("segment_current_off"),
        F.max("segment_off_rows").alias("segment_off_rows"),
    ]
    if p_off:
        p = F.col(p_off)
        aggs += [
            F.avg(_when("off_before", p)).alias("off_before_mean"),
            F.avg(_when("off_after", p)).alias("off_after_mean"),
            F.stddev_pop(F.when(any_off, p)).alias("off_std"),
            F.sum(F.col("off_extended").cast("int")).alias("n_off_extended"),
            F.avg(_when("off_extended", p)).alias("off_extended_mean"),
            F.sum(F.col("off_after_extended").cast("int")).alias("n_off_after_extended"),
            F.avg(_when("off_after_extended", p)).alias("off_after_extended_mean"),
        ]
        if p_off not in channels:
            aggs.append(F.avg(_when("steady", p)).alias(f"mean_{p_off}"))
    grouped = rows.groupBy(*keys, "period_id", "start", "end", "duration_seconds", "n_rows", "interval_s")
    return grouped.agg(*aggs)


# Winding channels and the reading above which a winding sensor is broken.
WINDINGS = (
    "motor_u_winding_temp", "motor_v_winding_temp", "motor_w_winding_temp",
    "motor_u_winding_temp_1", "motor_u_winding_temp_2", "motor_u_winding_temp_3",
)
WINDING_LIMIT = 200.0


def off_statistics(features: DataFrame, keys: Sequence[str] = SEG) -> DataFrame:
    """Per segment with periods: mean OFF pressure and current, away from every period."""
    first = features.where((F.col("period_id") == 1) & (F.col("segment_off_rows") > 0))
    return first.select(
        *keys, F.col("segment_pressure_off").alias("pressure_off"), F.col("segment_current_off").alias("current_off")
    )


def _observations(features: DataFrame, cfg: SystemConfig) -> DataFrame:
    """Long (pump_id, kind, name, value): one row per thing the baseline learns from."""
    c = cfg.columns

    def obs(kind: str, name: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), value.cast("double").alias("value"))

    have = set(features.columns)
    fast = F.col("interval_s") <= HIGH_RATE_SECONDS
    items = [obs("speed", "", F.col(f"mean_{c.speed}")), obs("current", "", F.col(f"mean_{c.current}"))]
    ratio = F.when(F.abs(F.col(f"mean_{c.speed}")) > 1e-6, F.col(f"mean_{c.current}") / F.col(f"mean_{c.speed}"))
    items.append(obs("ratio", "", ratio))
    if c.pressure and f"mean_{c.pressure}" in have:
        items.append(obs("pressure_on", "", F.col(f"mean_{c.pressure}")))
    if "off_std" in have:
        items.append(obs("pressure_off_var", "", F.when(F.col("n_off") >= 2, F.col("off_std"))))
        response = F.when(F.col("n_off_before") >= 2, F.col(f"mean_{c.pressure}") - F.col("off_before_mean"))
        items += [obs("response_fast", "", F.when(fast, response)), obs("response_slow", "", F.when(~fast, response))]
    for name in c.baseline_channels:
        if f"mean_{name}" in have:
            items += [obs("mean", name, F.col(f"mean_{name}")), obs("var", name, F.col(f"std_{name}"))]
    for name in c.vibrations:
        if f"mean_{name}" in have:
            items += [obs("vib", name, F.col(f"mean_{name}")), obs("vib_max", name, F.col(f"max_{name}"))]
    # OFF values belong to the segment: its first period speaks for it.
    first = F.col("period_id") == 1
    items += [
        obs("pressure_off", "", F.when(first, F.col("segment_pressure_off"))),
        obs("current_off", "", F.when(first, F.col("segment_current_off"))),
    ]
    long = features.select("pump_id", F.explode(F.array(*items)).alias("_obs")).select("pump_id", "_obs.*")
    return long.where(F.col("value").isNotNull())


def robust(df: DataFrame, keys: Sequence[str], value: str, floor: Column | float = 0.0) -> DataFrame:
    """Median and 1.4826*MAD (not below ``floor``) per group, with quartile and 95th percentile.

    The values are ranked once, in ranges, whatever the size of a group; the deviations are those of the ranked points,
    each as often as it occurs, and are ranked the same way.
    """
    points = running_totals(df, keys, value, {"n": F.lit(1)})
    centre = quantiles_of(points, keys, value, {"median": 0.5, "q25": 0.25, "q95": 0.95}, count="n_obs")
    off = points.select(*keys, value, "n").join(centre.select(*keys, "median"), list(keys)).withColumn("_off", F.abs(F.col(value) - F.col("median")))
    spread = quantiles_of(running_totals(off, keys, "_off", {"n": F.col("n")}), keys, "_off", {"_mad": 0.5}).withColumn("_mad", F.col("_mad") * MAD_SCALE)
    return centre.join(spread, list(keys)).withColumn("robust_std", F.greatest(F.col("_mad"), floor if isinstance(floor, Column) else F.lit(float(floor)))).drop("_mad")


def baseline_long(features: DataFrame, cfg: SystemConfig) -> DataFrame:
    """Baseline as (pump_id, kind, name, median, robust_std, q25, q95, n_obs)."""
    floor = F.lit(0.0)
    for kind, value in STD_FLOOR.items():
        floor = F.when(F.col("kind") == kind, value).otherwise(floor)
    return robust(_observations(features, cfg), ["pump_id", "kind", "name"], "value", floor)


def baseline_wide(long: DataFrame) -> DataFrame:
    """One row per pump: ``base`` maps ``kind`` or ``kind:name`` to its statistics."""
    key = F.when(F.col("name") == "", F.col("kind")).otherwise(F.concat_ws(":", "kind", "name"))
    entry = F.struct(key.alias("k"), F.struct("median", "robust_std", "q25", "q95").alias("v"))
    return long.groupBy("pump_id").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("base"))


def compute_baseline(df: DataFrame, cfg: SystemConfig, exclude: DataFrame | None = None,
                     extra: Sequence[str] = ()) -> DataFrame:
    """Baseline of every pump, from any root, without the segments listed in ``exclude``."""
    rows = df.join(exclude.select(*SEG).distinct(), list(SEG), "left_anti") if exclude is not None else df
    return baseline_long(period_features(rows, cfg, extra), cfg)


def refine_baseline(df: DataFrame, cfg: SystemConfig, abnormal: DataFrame, min_segments: int = 50) -> DataFrame:
    """One refinement pass: leave out abnormal segments where at least ``min_segments`` per pump remain."""
    every = df.select(*SEG).distinct()
    bad = abnormal.select(*SEG).distinct()
    kept = every.join(bad, list(SEG), "left_anti").groupBy("pump_id").agg(F.count(F.lit(1)).alias("_kept"))
    excluded = bad.join(kept.where(F.col("_kept") >= min_segments), "pump_id", "left_semi")
    return compute_baseline(df, cfg, excluded)
