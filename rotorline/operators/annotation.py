"""Annotation run, validation, train/test selection and annotation reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rotorline.config import SelectorRule, SystemConfig
from rotorline.functions.ordered import running_totals
from rotorline.operators.detectors import classify, with_baseline
from rotorline.operators.periods import (
    baseline_long,
    baseline_wide,
    compute_baseline,
    period_features,
)
from rotorline.session import materialize

ANNOTATION = ("date", "pump_id", "period_start", "period_end", "duration_minutes", "classification", "reasons")


def annotate(df: DataFrame, cfg: SystemConfig, baseline_root: DataFrame | None = None,
             exclude: DataFrame | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """Two passes: baseline per pump, then every period classified."""
    # One row per period, read by the baseline and by the detectors: written once, so the
    # readings are scanned once.
    features = materialize(period_features(df, cfg, extra))
    if baseline_root is None and exclude is None:
        base = baseline_long(features, cfg)
    else:
        base = compute_baseline(baseline_root if baseline_root is not None else df, cfg, exclude, extra)
    judged = classify(with_baseline(features, baseline_wide(base)), cfg)
    return as_annotations(judged)


def as_annotations(judged: DataFrame) -> DataFrame:
    return judged.select(
        "date",
        "pump_id",
        F.date_format("start", "HH:mm").alias("period_start"),
        F.date_format("end", "HH:mm").alias("period_end"),
        F.round(F.col("duration_seconds") / 60.0, 1).alias("duration_minutes"),
        "classification",
        "reasons",
    )


def validate(annotations: DataFrame, expected: DataFrame) -> DataFrame:
    """``expected`` (date, pump_id, expected): correct when that class occurs among the day's periods."""
    seen = annotations.groupBy("date", "pump_id").agg(F.collect_set("classification").alias("_seen"))
    joined = expected.join(seen, ["date", "pump_id"], "left")
    hit = F.coalesce(F.array_contains("_seen", F.col("expected")), F.lit(False))
    return joined.select("date", "pump_id", "expected", hit.cast("int").alias("correct"), F.size(F.coalesce("_seen", F.array().cast("array<string>"))).alias("n_classes"))


def changed_to_abnormal(first: DataFrame, second: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Rows that turn from normal to abnormal between two annotation runs, counted per pump."""
    a = first.select(*keys, F.col(label).alias("_one"))
    b = second.select(*keys, F.col(label).alias("_two"))
    turned = a.join(b, list(keys)).where((F.col("_one") == "normal") & (F.col("_two") == "abnormal"))
    return turned.groupBy("pump_id").agg(F.count(F.lit(1)).alias("n_changed"))


def select_days(annotations: DataFrame, rule: SelectorRule) -> DataFrame:
    """Manifest of train and test days: (date, pump_id, n_periods, min/max duration, reasons, selection)."""
    abnormal = F.col("classification") == "abnormal"
    named = abnormal & (F.size("reasons") > 0)
    excluded = F.lit(False)
    if rule.exclude_reasons:
        allowed = F.array(*[F.lit(r) for r in rule.exclude_reasons])
        tokens = F.flatten(F.transform("reasons", lambda r: F.split(r, ";")))
        excluded = F.forall(tokens, lambda t: F.array_contains(allowed, F.substring_index(t, ":", 1)))
    days = annotations.groupBy("date", "pump_id").agg(
        F.count(F.lit(1)).alias("n_periods"),
        F.bool_or(abnormal).alias("_bad"),
        F.bool_and(F.col("classification") == "normal").alias("_good"),
        F.min("duration_minutes").alias("min_duration"),
        F.max("duration_minutes").alias("max_duration"),
        F.count(F.when(named, 1)).alias("_named"),
        F.count(F.when(named & ~excluded, 1)).alias("_other"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.size("reasons") > 0, F.array_join("reasons", ";")))), ";").alias("_text"),
    )
    dismissed = (F.col("_named") > 0) & (F.col("_other") == 0) if rule.exclude_reasons else F.lit(False)
    test = F.col("_bad") & ~dismissed
    train = (
        ~F.col("_bad") & F.col("_good") & (F.col("n_periods") <= rule.max_periods_per_day)
        & (F.col("min_duration") >= rule.min_normal_duration_minutes)
    )
    chosen = F.when(test, "test").when(train, "train")
    return days.withColumn("selection", chosen).where(F.col("selection").isNotNull()).select(
        "date", "pump_id", "n_periods",
        F.when(train, F.col("min_duration")).alias("min_duration"),
        F.when(train, F.col("max_duration")).alias("max_duration"),
        F.when(test, F.col("_text")).alias("reasons"),
        "selection",
    )


def rows_of(df: DataFrame, manifest: DataFrame, selection: str) -> DataFrame:
    """Readings of the selected days (no file lookup)."""
    return df.join(manifest.where(F.col("selection") == selection), ["date", "pump_id"], "left_semi")


def excluded_days(df: DataFrame, manifest: DataFrame) -> DataFrame:
    return df.select("date", "pump_id").distinct().join(manifest, ["date", "pump_id"], "left_anti")


def summary(annotations: DataFrame) -> DataFrame:
    """Totals, date range and per-pump counts; the row without pump is the total."""
    abnormal = F.count(F.when(F.col("classification") == "abnormal", 1))
    return annotations.groupingSets([["pump_id"], []], "pump_id").agg(
        F.count(F.lit(1)).alias("n_periods"), abnormal.alias("n_abnormal"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    )


def base_reasons(reasons: Column) -> Column:
    """Base tokens of all reasons: split at ';', cut at ':', trimmed, blanks removed."""
    tokens = F.flatten(F.transform(reasons, lambda r: F.split(r, ";")))
    bases = F.transform(tokens, lambda t: F.trim(F.substring_index(t, ":", 1)))
    return F.filter(bases, lambda b: b != "")


def reason_frequency(annotations: DataFrame) -> DataFrame:
    """Count of reason tokens over abnormal periods, most frequent first, then by name."""
    bad = annotations.where(F.col("classification") == "abnormal")
    return bad.select(F.explode(base_reasons(F.col("reasons"))).alias("reason")).groupBy("reason").agg(
        F.count(F.lit(1)).alias("n")
    ).orderBy(F.desc("n"), "reason")


def error_examples(annotations: DataFrame, per_reason: int = 3) -> DataFrame:
    """Up to ``per_reason`` abnormal periods per base reason.

    First the earliest row of each pump (by its first appearance), then rows spread
    evenly over the date order, then the earliest left. A reason may cover a third of
    all periods, so places are not taken in one window: the places before a (reason,
    day, pump) come from the distributed running totals, the place inside it from its
    few periods, and only candidates reach the final ordering.
    """
    bad = annotations.where(F.col("classification") == "abnormal").select(
        "date", "pump_id", "period_start", "period_end",
        F.explode(F.array_distinct(base_reasons(F.col("reasons")))).alias("reason"),
    )
    bad = materialize(bad).withColumn("_order", F.datediff("date", F.lit("1970-01-01").cast("date")) * float(2**31) + F.col("pump_id"))
    totals = running_totals(bad, ["reason"], "_order", {"c": F.lit(1)})
    offsets = totals.select("reason", "_order", (F.col("cum_c") - F.col("c")).alias("_off"), F.col("all_c").alias("_n"))
    inside = Window.partitionBy("reason", "date", "pump_id").orderBy("period_start")
    placed = bad.withColumn("_in_day", F.row_number().over(inside) - 1)
    ranked = placed.join(offsets, ["reason", "_order"]).withColumn("_idx", F.col("_in_day") + F.col("_off")).drop("_order")

    firsts = ranked.groupBy("reason", "pump_id").agg(F.min("_idx").alias("_idx"))
    # Only the first few pumps of a reason can be picked: a bounded per-task top-k before the window.
    heads = _smallest(firsts, "reason", "_idx", per_reason).withColumn("_first", F.lit(True))
    spread = [F.bround(F.lit(float(i)) * (F.col("_n") - 1) / (per_reason - 1)).cast("long") for i in range(per_reason)]
    if per_reason == 1:
        spread = [F.floor(F.col("_n") / 2).cast("long")]
    wanted = F.when(F.col("_n") <= per_reason, F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).otherwise(F.array(*spread))
    order = F.array_position(wanted, F.col("_idx").cast("long"))
    pool = ranked.join(heads.select("reason", "_idx", "_first"), ["reason", "_idx"], "left")
    pool = pool.withColumn("_spread", order).where(
        F.col("_first") | (F.col("_spread") > 0) | (F.col("_idx") < 2 * per_reason)
    )
    priority = F.struct(
        F.when(F.col("_first"), 0).when(F.col("_spread") > 0, 1).otherwise(2).alias("a"),
        F.when(F.col("_first"), F.col("_idx")).when(F.col("_spread") > 0, F.col("_spread")).otherwise(F.col("_idx")).alias("b"),
    )
    pick = Window.partitionBy("reason").orderBy(priority)
    return pool.withColumn("pick", F.row_number().over(pick)).where(F.col("pick") <= per_reason).select(
        "reason", "pick", "date", "pump_id", "period_start", "period_end"
    )


def _smallest(df: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """The ``k`` rows with the smallest ``order`` per key. Spark keeps k rows per task before the shuffle
    (window group limit)."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")
