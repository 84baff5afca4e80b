"""Quality labels, cleaning, operational filter and resampling.

Every step partitions by (pump_id, date), so the whole chain after the first
exchange is sorts and projections.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rotorline.config import QUALITY_STEPS, QualityConfig, SensorRule
from rotorline.functions.series import SEG, TS, last_rows, ordered, runs, seconds, whole
from rotorline.session import materialize

# --- Fixed values -----------------------------------------------------------
OK, MISSING, NULL, OUT_OF_RANGE, FALL_DOWN, FROZEN = 0, 1, 2, 3, 4, 5
CODE_NAMES = {0: "OK", 1: "Missing", 2: "Null", 3: "Out of range", 4: "Fall down", 5: "Frozen"}
GAP_BLOCK = 4096
# ---------------------------------------------------------------------------

AGGREGATES = {
    "mean": F.avg, "max": F.max, "min": F.min, "median": F.median, "sum": F.sum, "count": F.count, "std": F.stddev_samp,
}


def nan_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The only place NaN is handled: sources call it, operators see NULL."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def first_per_timestamp(df: DataFrame, arrival: str, keys: Sequence[str] = SEG, ts: str = TS) -> DataFrame:
    """Row hygiene: drop rows without time, keep the first arrival per timestamp.

    An aggregate, so duplicates are merged before the shuffle; a timestamp repeated
    a billion times costs one row per map task.
    """
    rest = [c for c in df.columns if c not in (*keys, ts)]
    kept = df.where(F.col(ts).isNotNull()).groupBy(*keys, ts).agg(
        F.min_by(F.struct(*rest), arrival).alias("_row")
    )
    return kept.select(*keys, ts, "_row.*")


def fill_gaps(df: DataFrame, step_seconds: int, keys: Sequence[str] = SEG, ts: str = TS) -> DataFrame:
    """Insert every missing point of the grid ``min..max`` as a NULL row (``inserted``).

    Off-grid rows stay. The points between two rows are generated from the row
    before the gap: no join, and the segment partitioning is kept for what follows.
    """
    step = int(step_seconds * 1_000_000)
    values = [c for c in df.columns if c not in (*keys, ts)]
    t = F.unix_micros(ts)
    out = df.withColumn("_t0", F.min(t).over(whole(keys))).withColumn("_t", t)
    out = out.withColumn("_next", F.lead("_t").over(ordered(keys, ts)))
    first_k = F.floor((F.col("_t") - F.col("_t0")) / step) + 1
    last_k = F.ceil((F.col("_next") - F.col("_t0")) / step) - 1
    # The row itself, then its gap in blocks, so that no array is longer than a block however long the gap.
    own = F.array(F.struct(F.lit(0).cast("bigint").alias("lo"), F.lit(0).cast("bigint").alias("hi"), F.lit(False).alias("inserted")))
    blocks = F.transform(
        F.when(last_k >= first_k, F.sequence(first_k, last_k, F.lit(GAP_BLOCK).cast("bigint"))).otherwise(F.array().cast("array<bigint>")),
        lambda k: F.struct(k.alias("lo"), F.least(k + (GAP_BLOCK - 1), last_k).alias("hi"), F.lit(True).alias("inserted")))
    out = out.withColumn("_piece", F.explode(F.concat(own, blocks)))
    out = out.withColumn("_k", F.explode(F.sequence(F.col("_piece.lo"), F.col("_piece.hi"))))
    inserted = F.col("_piece.inserted")
    t = F.when(inserted, F.col("_t0") + F.col("_k") * step).otherwise(F.col("_t"))
    out = out.withColumn("_point", F.struct(t.alias("t"), inserted.alias("inserted")))
    inserted = F.col("_point.inserted")
    return out.select(
        *keys,
        F.timestamp_micros("_point.t").alias(ts),
        inserted.alias("inserted"),
        *[F.when(~inserted, F.col(c)).alias(c) for c in values],
    )


def out_of_range(value: Column, rule: SensorRule) -> Column:
    low = value < rule.min_value if rule.min_value is not None else F.lit(False)
    high = value > rule.max_value if rule.max_value is not None else F.lit(False)
    return low | high


def fall_down(value: Column, rule: SensorRule, threshold: float, frame, min_periods: int) -> Column:
    """Rolling sample deviation over the frame, relative to the sensor range."""
    if not rule.check_falldown or rule.min_value is None or rule.max_value is None:
        return F.lit(False)
    span = abs(rule.max_value - rule.min_value)
    if span <= 0:
        return F.lit(False)
    enough = F.count(value).over(frame) >= min_periods
    return enough & (F.abs(F.stddev_samp(value).over(frame) / span) > threshold)


def _codes(df: DataFrame, cfg: QualityConfig, channels: list[str], frames: dict[str, object],
           frozen_rows: dict[str, int], keys: Sequence[str], ts: str) -> DataFrame:
    w = ordered(keys, ts)
    still = {
        f"_still_{c}": (F.abs(F.col(c) - F.lag(c).over(w)) < cfg.frozen_tolerance)
        for c in channels
        if cfg.sensors[c].check_constant
    }
    out = runs(df, still, keys, ts) if still else df
    codes = {}
    for place, c in enumerate(channels):
        value, rule = F.col(c), cfg.sensors[c]
        gap_code = MISSING if (place == 0 or cfg.missing_code == "all") else NULL
        base = F.when(F.col("inserted"), gap_code).when(value.isNull(), NULL).otherwise(OK)
        graded = [
            F.when(out_of_range(value, rule), OUT_OF_RANGE),
            F.when(fall_down(value, rule, cfg.variability_threshold, frames[c], cfg.rolling_min_periods), FALL_DOWN),
        ]
        if rule.check_constant:
            graded.append(F.when(F.col(f"_still_{c}") & (F.col(f"_still_{c}_len") >= frozen_rows[c]), FROZEN))
        any_value = F.count(c).over(whole(keys)) > 0
        codes[f"{c}_quality"] = F.when(any_value, F.greatest(base, *graded)).otherwise(base).cast("tinyint")
    out = out.withColumns(codes)
    return out.drop(*[c for c in out.columns if c.startswith("_still_") or c == "_rn"])


def label(df: DataFrame, cfg: QualityConfig, keys: Sequence[str] = SEG, ts: str = TS) -> DataFrame:
    """Gap fill, then one ``<channel>_quality`` code per configured channel that exists."""
    channels = [c for c in cfg.sensors if c in df.columns]
    grid = fill_gaps(df, cfg.timestep_seconds, keys, ts) if channels else df.withColumn("inserted", F.lit(False))
    needed = max(1, int(cfg.frozen_period_seconds / cfg.timestep_seconds))
    frame = last_rows(ordered(keys, ts), cfg.rolling_window_samples)
    return _codes(grid, cfg, channels, {c: frame for c in channels}, {c: needed for c in channels}, keys, ts)


def label_by_time(df: DataFrame, cfg: QualityConfig, window_seconds: int, keys: Sequence[str] = SEG,
                  ts: str = TS) -> DataFrame:
    """As ``label`` with a time frame ``(t - window_seconds, t]`` for the fall-down test."""
    channels = [c for c in cfg.sensors if c in df.columns]
    grid = fill_gaps(df, cfg.timestep_seconds, keys, ts)
    needed = max(1, int(cfg.frozen_period_seconds / cfg.timestep_seconds))
    micros = int(window_seconds * 1_000_000)
    frame = Window.partitionBy(*keys).orderBy(F.unix_micros(ts)).rangeBetween(-(micros - 1), 0)
    return _codes(grid, cfg, channels, {c: frame for c in channels}, {c: needed for c in channels}, keys, ts)


def sentinel_hits(columns: Sequence[str], value: float) -> Column:
    """How many columns are within rtol 1e-5 / atol 1e-8 of the sentinel."""
    close = [F.coalesce((F.abs(F.col(c) - value) <= 1e-8 + 1e-5 * abs(value)).cast("int"), F.lit(0)) for c in columns]
    return sum(close[1:], close[0])


def is_sentinel(df: DataFrame, columns: Sequence[str], value: float | None, threshold: int) -> Column:
    present = [c for c in columns if c in df.columns]
    if value is None or threshold > len(columns) or not present:
        return F.lit(False)
    if threshold <= 0:
        return F.lit(True)
    return sentinel_hits(present, value) >= threshold


def clean(df: DataFrame, cfg: QualityConfig) -> DataFrame:
    """Sentinel rows and bad codes become NULL; quality columns are dropped if configured."""
    sensors = [c for c in cfg.sensors if c in df.columns]
    out = df.withColumn("sentinel", is_sentinel(df, list(cfg.sensors), cfg.sentinel_value, cfg.sentinel_column_threshold))
    fixed = {}
    for c in sensors:
        bad = F.col("sentinel")
        if f"{c}_quality" in df.columns and cfg.codes_to_null:
            bad = bad | F.col(f"{c}_quality").isin(*cfg.codes_to_null)
        fixed[c] = F.when(~bad, F.col(c))
    out = out.withColumns(fixed)
    if cfg.drop_quality_columns:
        out = out.drop(*[c for c in out.columns if c.endswith("_quality")])
    return out


def _biggest_step(df: DataFrame, channels: Sequence[str], keys: Sequence[str], ts: str) -> DataFrame:
    """Per segment and channel: non-null count and largest change between successive non-null values."""
    before = ordered(keys, ts).rowsBetween(Window.unboundedPreceding, -1)
    steps = df.withColumns({
        f"_d_{c}": F.abs(F.col(c) - F.last(c, ignorenulls=True).over(before)) for c in channels
    })
    aggs = []
    for c in channels:
        aggs += [F.count(c).alias(f"_n_{c}"), F.max(f"_d_{c}").alias(f"_m_{c}")]
    return steps.groupBy(*keys).agg(*aggs)


def all_frozen(df: DataFrame, channels: Sequence[str], tolerance: float, keys: Sequence[str] = SEG,
               ts: str = TS, empty_counts: bool = False) -> DataFrame:
    """Per segment ``is_frozen``: no channel with two or more values ever changes.

    ``empty_counts=False``: at least one channel must have been checked.
    ``empty_counts=True``: channels without two values count as frozen too.
    """
    channels = [c for c in channels if c in df.columns]
    stats = _biggest_step(df, channels, keys, ts)
    checked = [F.col(f"_n_{c}") > 1 for c in channels]
    moving = [(F.col(f"_n_{c}") > 1) & (F.col(f"_m_{c}") >= tolerance) for c in channels]
    any_moving, any_checked = moving[0], checked[0]
    for m, k in zip(moving[1:], checked[1:]):
        any_moving, any_checked = any_moving | m, any_checked | k
    frozen = ~any_moving if empty_counts else (~any_moving & any_checked)
    return stats.select(*keys, frozen.alias("is_frozen"))


def operational(df: DataFrame, speed: str, threshold: float, min_rows: int, keys: Sequence[str] = SEG,
                ts: str = TS) -> DataFrame:
    """Keep rows in runs of ``speed >= threshold`` of at least ``min_rows``; ``run`` numbers them per segment."""
    flagged = runs(df, {"_on": F.col(speed) >= threshold}, keys, ts)
    kept = flagged.where(F.col("_on") & (F.col("_on_len") >= max(1, min_rows)))
    numbered = kept.withColumn("run", F.dense_rank().over(Window.partitionBy(*keys).orderBy("_on_run")))
    return numbered.drop("_on", "_on_run", "_on_pos", "_on_len", "_rn")


def bucket_start(ts: str | Column, seconds_: int) -> Column:
    micros = int(seconds_ * 1_000_000)
    t = F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)
    return F.timestamp_micros(F.floor(t / micros) * micros)


def aggregate_for(name: str, column: str, ts: str = TS) -> Column:
    if name == "first":
        return F.min_by(column, F.when(F.col(column).isNotNull(), F.col(ts)))
    if name == "last":
        return F.max_by(column, F.when(F.col(column).isNotNull(), F.col(ts)))
    return AGGREGATES[name](column)


def resample(df: DataFrame, rules: dict[str, str], bucket_seconds: int, keys: Sequence[str] = SEG, ts: str = TS,
             empty_buckets: bool = True) -> DataFrame:
    """Left-closed, left-labelled buckets; ``rules`` names the aggregation per column.

    With ``empty_buckets`` the buckets between the first and last one appear as NULL rows.
    """
    out = df.withColumn("_b", bucket_start(ts, bucket_seconds)).groupBy(*keys, "_b").agg(
        *[aggregate_for(how, c, ts).alias(c) for c, how in rules.items()]
    ).withColumnRenamed("_b", ts)
    if empty_buckets:
        out = fill_gaps(out, bucket_seconds, keys, ts).drop("inserted")
    return out


def resample_rules(df: DataFrame, cfg: QualityConfig, keys: Sequence[str] = SEG, ts: str = TS) -> dict[str, str]:
    rule = cfg.resample
    out = {}
    for c in df.columns:
        if c in (*keys, ts, "inserted", "sentinel", "run"):
            continue
        if c in cfg.sensors:
            out[c] = rule.value_agg
        elif c.endswith("_quality"):
            out[c] = rule.quality_agg
        else:
            out[c] = rule.other_agg
    return out


def run_steps(df: DataFrame, cfg: QualityConfig, steps: Sequence[str] = QUALITY_STEPS) -> DataFrame:
    """Any subset of label, clean, filter, resample in that order."""
    unknown = set(steps) - set(QUALITY_STEPS)
    if unknown:
        raise ValueError(f"unknown steps: {sorted(unknown)}")
    out = df
    if "label" in steps:
        out = label(out, cfg)
    if "clean" in steps:
        out = clean(out, cfg)
    if "filter" in steps:
        out = operational(out, cfg.speed_col, cfg.speed_on_threshold, cfg.min_consecutive_operational)
    if "resample" in steps and cfg.resample is not None:
        out = resample(out, resample_rules(out, cfg), cfg.resample.target_seconds)
    return out


def code_counts(labelled: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cells per sensor and code."""
    codes = [c for c in labelled.columns if c.endswith("_quality")]
    pairs = F.explode(F.array(*[F.struct(F.lit(c.removesuffix("_quality")).alias("sensor"), F.col(c).alias("code")) for c in codes]))
    return labelled.select(*by, pairs.alias("_p")).groupBy(*by, "_p.sensor", "_p.code").agg(F.count(F.lit(1)).alias("n_cells"))


def segment_statistics(df: DataFrame, cfg: QualityConfig, steps: Sequence[str] = QUALITY_STEPS) -> DataFrame:
    """One row per segment: rows in and out, sentinel rows, bad cells, skip reason.

    The input is read once: what is counted and the remaining steps start from the labelled rows, which are stored.
    """
    labelled = materialize(label(df, cfg))
    sensors = [c for c in cfg.sensors if c in df.columns]
    given = labelled.where(~F.col("inserted")).select(*df.columns)
    frozen = all_frozen(given, sensors, cfg.frozen_tolerance)
    bad = sum((F.sum((F.col(f"{c}_quality") > 0).cast("int")) for c in sensors[1:]),
              F.sum((F.col(f"{sensors[0]}_quality") > 0).cast("int")))
    sentinel = is_sentinel(labelled, list(cfg.sensors), cfg.sentinel_value, cfg.sentinel_column_threshold)
    seen = labelled.groupBy(*SEG).agg(
        F.sum((~F.col("inserted")).cast("int")).alias("input_rows"),
        F.sum(F.col("inserted").cast("int")).alias("inserted_rows"),
        F.sum(sentinel.cast("int")).alias("sentinel_rows"),
        bad.alias("bad_cells"),
    )
    rest = run_steps(labelled, cfg, [s for s in steps if s != "label"]) if "label" in steps else run_steps(given, cfg, steps)
    left = rest.groupBy(*SEG).agg(F.count(F.lit(1)).alias("_out"))
    joined = seen.join(frozen, list(SEG)).join(left, list(SEG), "left")
    rows_out = F.when(F.col("is_frozen"), 0).otherwise(F.coalesce("_out", F.lit(0)))
    reason = F.when(F.col("is_frozen"), "all_frozen").when(rows_out == 0, "no_rows_after_steps")
    return joined.select(
        *SEG, "input_rows", "inserted_rows", "sentinel_rows", "bad_cells",
        rows_out.alias("output_rows"), reason.alias("skip_reason"), (rows_out > 0).cast("int").alias("written"),
    )


def median_gap(df: DataFrame, keys: Sequence[str] = SEG, ts: str = TS, fallback: float = 5.0) -> DataFrame:
    """Sampling interval of a segment: median gap, ``fallback`` when there is none or it is not positive."""
    gaps = df.withColumn("_gap", seconds(ts) - seconds(F.lag(ts).over(ordered(keys, ts))))
    med = F.median("_gap")
    return gaps.groupBy(*keys).agg(F.when(med > 0, med).otherwise(fallback).alias("interval_s"))


def modal_gap(df: DataFrame, keys: Sequence[str] = SEG, ts: str = TS) -> DataFrame:
    """Most frequent gap in whole seconds, the smallest on ties; at least 1; 60 with fewer than two rows."""
    gaps = df.withColumn("_gap", F.floor(seconds(ts) - seconds(F.lag(ts).over(ordered(keys, ts)))))
    counts = gaps.groupBy(*keys, "_gap").agg(F.count("_gap").alias("_n"))
    best = F.max_by("_gap", F.struct("_n", -F.col("_gap")))
    return counts.groupBy(*keys).agg(F.coalesce(F.greatest(best, F.lit(1)), F.lit(60)).alias("timestep_s"))


def resample_dense(df: DataFrame, columns: Sequence[str], bucket_seconds: int, dense_below: float, how: str = "first",
                   keys: Sequence[str] = SEG, ts: str = TS) -> DataFrame:
    """Resample only segments of at least three rows whose median gap is below ``dense_below`` seconds.

    Rows with every column NULL are dropped from resampled segments. Gaps, their median and the count are windows of the
    segment and the buckets lie inside it: one scan, one exchange.
    """
    gaps = df.withColumn("_gap", seconds(ts) - seconds(F.lag(ts).over(ordered(keys, ts))))
    usual, rows = F.median("_gap").over(whole(keys)), F.count(F.lit(1)).over(whole(keys))
    interval = F.when(usual > 0, usual).otherwise(5.0)
    tagged = gaps.withColumn("_dense", (rows >= 3) & (interval < dense_below))
    some = F.coalesce(*[F.col(c) for c in columns]).isNotNull()
    at = F.when(F.col("_dense"), bucket_start(ts, bucket_seconds)).otherwise(F.col(ts))
    out = tagged.withColumn("_at", at).groupBy(*keys, "_at", "_dense").agg(
        *[aggregate_for(how, c, ts).alias(c) for c in columns]
    )
    return out.where(some | ~F.col("_dense")).withColumnRenamed("_at", ts).drop("_dense")


def stable_span(df: DataFrame, speed: str = "speed", share: float = 0.9, min_rows: int = 10,
                keys: Sequence[str] = SEG, ts: str = TS) -> DataFrame:
    """Trim to the span between the first and last row at ``share`` of the segment's peak speed."""
    peak = F.max(speed).over(whole(keys))
    out = df.withColumn("_fast", F.coalesce(F.col(speed) >= share * peak, F.lit(False)) & (peak > 0))
    out = out.withColumns({
        "_n": F.sum(F.col("_fast").cast("int")).over(whole(keys)),
        "_from": F.min(F.when(F.col("_fast"), F.col(ts))).over(whole(keys)),
        "_to": F.max(F.when(F.col("_fast"), F.col(ts))).over(whole(keys)),
    })
    keep = (F.col("_n") < min_rows) | F.col(ts).between(F.col("_from"), F.col("_to"))
    return out.where(keep).drop("_fast", "_n", "_from", "_to")
