"""Evaluation of scores, thresholds and alarm policies on labelled days."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rotorline.functions.formulas import binomial_at_least_three, health, season_of, severity
from rotorline.functions.ordered import auc_of, best_f1, exact_quantiles, roc_table, running_totals, youden
from rotorline.functions.series import SEG, so_far
from rotorline.operators.calibration import unpivot

# --- Fixed values -----------------------------------------------------------
ABNORMAL, NORMAL = "abnormal", "normal"
FAULT_TOP = 3
ALPHA_GRID = tuple(round(0.05 * i, 2) for i in range(13))
HEALTH_WEIGHTS = tuple(round(0.4 + 0.05 * i, 2) for i in range(9))
MULTIPLIER_RANGE = (0.70, 1.30)
RECOVER_AT_LEAST = 10
GATES = {"fa_pp": 3.0, "subset_fa_pp": 5.0, "recovered": 10}
HOLDOUT = {"fa_cut_pp": 5.0, "overfit_pp": 3.0}
# ---------------------------------------------------------------------------


def is_bad(label: str = "label") -> Column:
    return F.col(label) == ABNORMAL


def day_means(scored: DataFrame, score: str, carry: Sequence[str] = ()) -> DataFrame:
    return scored.groupBy(*SEG, *carry).agg(F.avg(score).alias("score"))


def roc(df: DataFrame, keys: Sequence[str] = (), score: str = "score") -> DataFrame:
    return roc_table(_scope(df, keys), _keys(keys), score, is_bad())


def _keys(keys: Sequence[str]) -> list[str]:
    return list(keys) or ["all_rows"]


def _scope(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df if keys else df.withColumn("all_rows", F.lit(1))


def auc(df: DataFrame, keys: Sequence[str] = (), score: str = "score") -> DataFrame:
    out = auc_of(roc(df, keys, score), _keys(keys))
    return out if keys else out.drop("all_rows")


def youden_threshold(df: DataFrame, keys: Sequence[str] = (), score: str = "score") -> DataFrame:
    out = youden(roc(df, keys, score), _keys(keys))
    return out if keys else out.drop("all_rows")


def f1_threshold(df: DataFrame, keys: Sequence[str] = (), score: str = "score") -> DataFrame:
    out = best_f1(roc(df, keys, score), _keys(keys))
    return out if keys else out.drop("all_rows")


def at_threshold(df: DataFrame, threshold: Column, score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts, precision, recall, F1 (0 when undefined) and the mean-score ratio."""
    hit, bad = F.col(score) >= threshold, is_bad()
    c = df.groupBy(*by).agg(
        F.count(F.when(hit & bad, 1)).alias("tp"), F.count(F.when(hit & ~bad, 1)).alias("fp"),
        F.count(F.when(~hit & bad, 1)).alias("fn"), F.count(F.when(~hit & ~bad, 1)).alias("tn"),
        F.avg(F.when(bad, F.col(score))).alias("mean_abnormal"), F.avg(F.when(~bad, F.col(score))).alias("mean_normal"),
    )
    zero = F.lit(0.0)
    return c.withColumns({
        "precision": F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), zero),
        "recall": F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), zero),
        "f1": F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), zero),
        "score_ratio": F.coalesce("mean_abnormal", zero) / F.greatest(F.coalesce("mean_normal", F.lit(1e-8)), F.lit(1e-12)),
    })


def verdict_calibration(delta_auc: Column, delta_ratio: Column) -> Column:
    return (
        F.when((delta_auc > 0.002) & (delta_ratio > 0.1), "IMPROVEMENT")
        .when((delta_auc < -0.002) & (delta_ratio < -0.1), "REGRESSION")
        .otherwise("NEUTRAL")
    )


def verdict_weights(delta_auc: Column) -> Column:
    return (
        F.when(delta_auc > 0.005, "IMPROVEMENT").when(delta_auc < -0.002, "NO_CHANGE")
        .when(F.abs(delta_auc) <= 0.005, "MARGINAL").otherwise("NO_CHANGE")
    )


def over_grid(days: DataFrame, name: str, grid: Sequence[float], score: Column) -> DataFrame:
    """One score per day and grid value. Days are already aggregated; the grid is a short literal."""
    spread = days.withColumn(name, F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    return spread.withColumn("score", score)


def grid_metrics(days: DataFrame, name: str, grid: Sequence[float], score: Column) -> DataFrame:
    """AUC and F1-optimal metrics per grid value; the best value by AUC is marked (the first on ties)."""
    scored = over_grid(days, name, grid, score)
    table = roc(scored, [name])
    metrics = auc_of(table, [name]).join(best_f1(table, [name]), name)
    first = Window.orderBy(F.desc(F.round("auc_roc", 9)), name)
    return metrics.withColumn("is_best", (F.row_number().over(first) == 1).cast("int"))


def newly_caught(days: DataFrame, name: str, grid: Sequence[float], score: Column) -> DataFrame:
    """Abnormal days missed at grid value 0 and caught at a larger one, each under its own F1 threshold."""
    scored = over_grid(days, name, grid, score)
    limits = best_f1(roc(scored, [name]), [name]).select(name, "threshold")
    bad = scored.where(is_bad()).join(limits, name)
    missed = bad.where((F.col(name) == 0) & (F.col("score") < F.col("threshold"))).select(*SEG)
    caught = bad.where((F.col(name) >= 0.01) & (F.col("score") >= F.col("threshold")))
    return caught.join(missed, list(SEG), "left_semi").select(*SEG, name)


def pair_score(alpha: Column, one: Column, two: Column) -> Column:
    return alpha * one + (1.0 - alpha) * two


def fusion_score(alpha: Column, one: Column, two: Column) -> Column:
    second = F.coalesce(two, one)
    return F.greatest(one, second) + alpha * F.least(one, second)


def fusion_sweep(days: DataFrame, alphas: Sequence[float] = ALPHA_GRID, weights: Sequence[float] = HEALTH_WEIGHTS) -> DataFrame:
    """AUC per alpha; the health weight never enters the score, so it is only spread over the output."""
    scored = over_grid(days, "alpha", alphas, fusion_score(F.col("alpha"), F.col("s1"), F.col("s2")))
    per_alpha = auc_of(roc(scored, ["alpha"]), ["alpha"]).withColumn("auc_roc", F.round("auc_roc", 4))
    best = Window.orderBy(F.desc("auc_roc"), "alpha")
    marked = per_alpha.withColumn("is_best", (F.row_number().over(best) == 1).cast("int"))
    return marked.withColumn("health_weight", F.explode(F.array(*[F.lit(float(w)) for w in weights])))


def day_inputs(l1_days: DataFrame, l2_days: DataFrame, labels: DataFrame) -> DataFrame:
    """Fused inputs per day: severities s1, s2 and healths h1, h2; only days level 1 knows.

    Both sides carry ``value``, ``alarm`` and ``mean``.
    """
    def side(df: DataFrame, n: int) -> DataFrame:
        v, a, m = F.col("value"), F.col("alarm"), F.col("mean")
        return df.select(*SEG, severity(v, a).alias(f"s{n}"), health(v, m, a).alias(f"h{n}"))

    return side(l1_days, 1).join(side(l2_days, 2), list(SEG), "left").join(labels, list(SEG))


# --- fault isolation --------------------------------------------------------


def channel_z_days(normal: DataFrame, abnormal: DataFrame, channels: Sequence[str]) -> DataFrame:
    """z of the day-mean residual of abnormal days against the pump's normal mean and sample deviation."""
    stats = unpivot(normal, channels, ["pump_id"]).groupBy("pump_id", "channel").agg(
        F.avg("value").alias("mu"), F.greatest(F.stddev_samp("value"), F.lit(1e-12)).alias("sigma")
    )
    days = unpivot(abnormal, channels, list(SEG)).groupBy(*SEG, "channel").agg(F.avg("value").alias("day_mean"))
    return days.join(stats, ["pump_id", "channel"]).withColumn("z", (F.col("day_mean") - F.col("mu")) / F.col("sigma"))


def top_channels(z_days: DataFrame, k: int = FAULT_TOP) -> DataFrame:
    w = Window.partitionBy(*SEG).orderBy(F.desc(F.abs(F.round("z", 9))), "channel")
    return z_days.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def _ranked(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("n_days"), "channel")
    return counts.withColumn("rank", F.row_number().over(w))


def fault_ranking(top: DataFrame, channels: Mapping[str, str], per_pump: bool = False) -> DataFrame:
    """Days each channel is in the top, with share and failure mode.

    Overall every channel appears (0 kept); per pump only channels that occur.
    """
    by = ["pump_id"] if per_pump else []
    scoped = top if per_pump else top.withColumn("scope", F.lit(1))
    by = by or ["scope"]
    days = scoped.select(*by, *[k for k in SEG if k not in by]).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("_all"))
    counts = scoped.groupBy(*by, "channel").agg(F.count(F.lit(1)).alias("n_days"))
    if not per_pump:
        names = F.explode(F.array(*[F.lit(c) for c in channels]))
        counts = days.select(*by, names.alias("channel")).join(counts, [*by, "channel"], "left").fillna(0, ["n_days"])
    mode = F.create_map(*[F.lit(x) for pair in channels.items() for x in pair])
    out = _ranked(counts, by).join(days, by)
    out = out.withColumns({
        "pct": F.round(100.0 * F.col("n_days") / F.col("_all"), 1),
        "failure_mode": F.coalesce(F.try_element_at(mode, F.col("channel")), F.lit("unknown")),
    })
    return out.drop("_all") if per_pump else out.drop("_all", "scope")


def dominant_mode(ranking: DataFrame, top: int = 5) -> DataFrame:
    """Most frequent failure mode among the leading channels; the mode seen first wins ties."""
    lead = ranking.where(F.col("rank") <= top)
    modes = lead.groupBy("failure_mode").agg(F.count(F.lit(1)).alias("n_channels"), F.min("rank").alias("_first"))
    best = modes.agg(F.max_by(F.struct("failure_mode", "n_channels"), F.struct("n_channels", -F.col("_first"))).alias("_m"))
    return best.select("_m.*")


# --- thresholds on both levels ---------------------------------------------


def step_histogram(steps: DataFrame, thresholds: DataFrame, multipliers: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Steps per day by how many warning multipliers each level exceeds.

    An alert is ``l1 >= w1*m1`` or ``l2 >= w2*m2``, so these counts answer every grid point: the steps are
    aggregated once (map-side) to at most (n+1)^2 cells per day instead of once per grid point.
    ``thresholds``: pump_id, l1_warning, l2_warning (and alarms).
    """
    ms = sorted(float(m) for m in multipliers)

    def passed(score: str, base: str) -> Column:
        tests = [F.coalesce((F.col(score) >= F.col(base) * m).cast("int"), F.lit(0)) for m in ms]
        return sum(tests[1:], tests[0])

    joined = steps.join(thresholds.select("pump_id", "l1_warning", "l2_warning"), "pump_id")
    return joined.groupBy(*by, *SEG, "label", passed("l1", "l1_warning").alias("b1"), passed("l2", "l2_warning").alias("b2")).agg(
        F.count(F.lit(1)).alias("n")
    )


def day_alerts(hist: DataFrame, multipliers: Sequence[float], min_steps: int, by: Sequence[str] = ()) -> DataFrame:
    """Flagged days for each (l1, l2) warning multiplier pair, from a summed-area table per day.

    A day has one row per cell of the grid, (n+1)^2 of them. Running sums along one axis and then the other give the
    steps that stay below both multipliers of a cell; the rest of the day's steps are alerts.
    """
    ms = sorted(float(m) for m in multipliers)
    width = len(ms) + 1
    cell = (F.col("b1") * width + F.col("b2")).cast("int")
    day = [*by, *SEG, "label"]
    days = hist.groupBy(*day).agg(F.map_from_entries(F.collect_list(F.struct(cell, "n"))).alias("_n"), F.sum("n").alias("_all"))
    dense = days.select("*", F.explode(F.sequence(F.lit(0), F.lit(width * width - 1))).alias("_c")).withColumns({
        "i": F.floor(F.col("_c") / width).cast("int"), "j": F.col("_c") % width, "n": F.coalesce(F.try_element_at("_n", "_c"), F.lit(0))})
    dense = dense.withColumn("n", F.sum("n").over(so_far(Window.partitionBy(*day, "i").orderBy("j"))))
    dense = dense.withColumn("n", F.sum("n").over(so_far(Window.partitionBy(*day, "j").orderBy("i"))))
    mult = F.array(*[F.lit(m) for m in ms])
    return dense.where((F.col("i") < len(ms)) & (F.col("j") < len(ms))).select(
        *day, F.element_at(mult, F.col("i") + 1).alias("l1_mult"), F.element_at(mult, F.col("j") + 1).alias("l2_mult"),
        (F.col("_all") - F.col("n") >= min_steps).cast("int").alias("flagged"))


def rates(flags: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """False-alarm and detection rates overall (pump_id NULL) and per pump, per ``by`` group."""
    bad = is_bad()
    agg = [
        F.count(F.when(~bad, 1)).alias("n_normal"), F.count(F.when(bad, 1)).alias("n_abnormal"),
        F.sum(F.when(~bad, F.col("flagged")).otherwise(0)).alias("n_false"),
        F.sum(F.when(bad, F.col("flagged")).otherwise(0)).alias("n_detected"),
    ]
    sets = [[*by, "pump_id"], [*by]]
    out = flags.groupingSets(sets, *by, "pump_id").agg(*agg)
    return out.withColumns({
        "fa_rate": F.coalesce(F.try_divide(F.col("n_false"), F.col("n_normal")), F.lit(0.0)),
        "detection_rate": F.coalesce(F.try_divide(F.col("n_detected"), F.col("n_abnormal")), F.lit(0.0)),
    })


def evaluate_thresholds(steps: DataFrame, thresholds: DataFrame, min_steps: int) -> DataFrame:
    hist = step_histogram(steps, thresholds, [1.0])
    return rates(day_alerts(hist, [1.0], min_steps).drop("l1_mult", "l2_mult"))


def multiplier_grid(n: int) -> list[float]:
    low, high = MULTIPLIER_RANGE
    return [low] if n == 1 else [low + (high - low) * i / (n - 1) for i in range(n)]


def multiplier_search(steps: DataFrame, thresholds: DataFrame, resolution: int, min_steps: int) -> DataFrame:
    """Grid over (l1 warn, l1 alarm, l2 warn, l2 alarm) multipliers.

    Alarm multipliers matter only for the order check warn < alarm on every pump, so n^2 warning pairs are
    evaluated and the valid alarm multipliers joined afterwards. Kept: combinations where no pump detects
    less than under multiplier 1.
    """
    grid = multiplier_grid(resolution)
    hist = step_histogram(steps, thresholds, grid)
    metrics = rates(day_alerts(hist, grid, min_steps), ["l1_mult", "l2_mult"])
    base = evaluate_thresholds(steps, thresholds, min_steps).where(F.col("pump_id").isNotNull())
    base = base.select("pump_id", F.col("detection_rate").alias("_base"))
    per_pump = metrics.where(F.col("pump_id").isNotNull()).join(base, "pump_id")
    kept = per_pump.groupBy("l1_mult", "l2_mult").agg(F.bool_and(F.col("detection_rate") >= F.col("_base")).alias("_ok"))
    good = metrics.where(F.col("pump_id").isNull()).join(kept.where("_ok"), ["l1_mult", "l2_mult"])
    for level in ("l1", "l2"):
        # The order must hold for the pump with the largest warning/alarm ratio.
        tightest = thresholds.agg(F.max(F.col(f"{level}_warning") / F.col(f"{level}_alarm")).alias("_r"))
        pairs = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(a).alias("a")) for w in grid for a in grid])
        allowed = tightest.select("_r", F.explode(pairs).alias("_p")).where(F.col("_p.w") * F.col("_r") < F.col("_p.a"))
        allowed = allowed.select(F.col("_p.w").alias(f"{level}_mult"), F.col("_p.a").alias(f"{level}_alarm_mult"))
        good = good.join(allowed, f"{level}_mult")
    return good.select(
        "l1_mult", "l1_alarm_mult", "l2_mult", "l2_alarm_mult", "fa_rate", "n_false", "detection_rate"
    ).orderBy("fa_rate", "l1_mult", "l2_mult", "l1_alarm_mult", "l2_alarm_mult")


def holdout_check(opt: DataFrame, holdout: DataFrame, thresholds: DataFrame, best: tuple[float, float], min_steps: int) -> DataFrame:
    """Multipliers against the baseline on held-out days, with the acceptance rule.

    Both sets of days and both pairs of multipliers are cells of one histogram: one pass over the steps.
    """
    m1, m2 = (float(m) for m in best)
    ms = sorted({1.0, m1, m2})
    steps = opt.withColumn("_held", F.lit(False)).unionByName(holdout.withColumn("_held", F.lit(True)))
    flags = day_alerts(step_histogram(steps, thresholds, ms, ["_held"]), ms, min_steps, ["_held"])
    pair = lambda a, b: (F.col("l1_mult") == a) & (F.col("l2_mult") == b)
    kinds = F.array_compact(F.array(F.when(pair(m1, m2), F.lit("new")), F.when(pair(1.0, 1.0), F.lit("base"))))
    table = rates(flags.withColumn("_kind", F.explode(kinds)), ["_held", "_kind"])

    def value(name: str, held: bool, kind: str) -> Column:
        return F.max(F.when((F.col("_held") == held) & (F.col("_kind") == kind), F.col(name)))

    wide = table.groupBy("pump_id").agg(
        value("fa_rate", True, "new").alias("new"), value("fa_rate", True, "base").alias("base"), value("fa_rate", False, "new").alias("opt_new"),
        value("fa_rate", False, "base").alias("opt_base"), value("detection_rate", True, "new").alias("new_det"), value("detection_rate", True, "base").alias("base_det"))
    everyone = F.col("pump_id").isNull()
    out = wide.agg(
        *[F.max(F.when(everyone, F.col(c))).alias(c) for c in ("new", "base", "opt_new", "opt_base", "new_det")],
        F.count(F.when(~everyone & (F.col("new_det") < F.col("base_det")), 1)).alias("pumps_worse"))
    cut = (F.col("base") - F.col("new")) * 100.0
    gap = F.abs((F.col("opt_base") - F.col("opt_new")) * 100.0 - cut)
    accepted = (cut >= HOLDOUT["fa_cut_pp"]) & (F.col("pumps_worse") == 0) & (gap < HOLDOUT["overfit_pp"])
    return out.select(
        F.col("new").alias("fa_rate"), F.col("base").alias("baseline_fa_rate"), cut.alias("fa_cut_pp"),
        F.col("new_det").alias("detection_rate"), "pumps_worse", gap.alias("overfit_gap_pp"), accepted.cast("int").alias("accepted"),
    )


def against_baseline(flags: DataFrame, baseline: DataFrame, fa_delta: float, detection_tolerance: float) -> DataFrame:
    """Rates next to a baseline table (pump_id NULL = overall) and whether each gate holds."""
    now = rates(flags)
    table = baseline.select(F.col("pump_id").alias("_pump"), "base_fa", "base_det")
    joined = now.join(table, F.equal_null(F.col("pump_id"), F.col("_pump")), "left").drop("_pump")
    fa_ok = F.col("fa_rate") <= F.col("base_fa") + fa_delta
    det_ok = F.col("base_det") - F.col("detection_rate") <= detection_tolerance
    gate = F.when(F.col("pump_id").isNull(), fa_ok).otherwise(det_ok)
    return joined.withColumn("gate_ok", F.coalesce(gate, F.lit(True)).cast("int"))


# --- max-z policies ---------------------------------------------------------


def policy_flags(steps: DataFrame, subset_pump: int, limits: DataFrame, subset_limit: Column, k: int = 3) -> DataFrame:
    """Day flags under four policies: distance; plus the subset max-z for one pump; distance or max-z; max-z only.

    ``steps``: distance, warning, max_z, subset_z; ``limits``: pump_id, z_limit.
    """
    joined = steps.join(limits, "pump_id", "left")
    far = F.col("distance") >= F.col("warning")
    high = F.coalesce(F.col("max_z") >= F.col("z_limit"), F.lit(False))
    sub = (F.col("pump_id") == subset_pump) & F.coalesce(F.col("subset_z") >= subset_limit, F.lit(False))
    tests = {"baseline": far, "policy1": far | sub, "policy2": far | high, "policy3": high}
    return joined.groupBy(*SEG, "label").agg(
        *[(F.count(F.when(t, 1)) >= k).cast("int").alias(name) for name, t in tests.items()]
    )


def policy_metrics(flags: DataFrame, subset_pump: int) -> DataFrame:
    """False alarms, detections and recovered misses per policy, with the acceptance gates."""
    policies = ("baseline", "policy1", "policy2", "policy3")
    cells = F.array(*[F.struct(F.lit(p).alias("policy"), F.col(p).alias("flag")) for p in policies])
    long = flags.select("pump_id", "label", F.col("baseline").alias("_base"), F.explode(cells).alias("_c")).select("*", "_c.*")
    bad, sub, hit = is_bad(), F.col("pump_id") == subset_pump, F.col("flag") == 1

    def n(test: Column) -> Column:
        return F.count(F.when(test, 1))

    m = long.groupBy("policy").agg(
        n(~bad).alias("n_normal"), n(bad).alias("n_abnormal"), n(~bad & hit).alias("n_fa"), n(bad & hit).alias("n_det"),
        n(~bad & sub).alias("s_normal"), n(~bad & sub & hit).alias("s_fa"),
        n(bad & sub & hit & (F.col("_base") == 0)).alias("recovered"),
    )
    m = m.withColumns({
        "fa_rate": F.round(F.col("n_fa") / F.greatest("n_normal", F.lit(1)), 4),
        "det_rate": F.round(F.col("n_det") / F.greatest("n_abnormal", F.lit(1)), 4),
        "s_fa_rate": F.round(F.col("s_fa") / F.greatest("s_normal", F.lit(1)), 4),
    })
    base = m.where(F.col("policy") == "baseline")
    out = m.withColumns({"_fa": base.select("fa_rate").scalar(), "_sfa": base.select("s_fa_rate").scalar()})
    accepted = (
        (F.col("recovered") >= GATES["recovered"])
        & (F.round((F.col("fa_rate") - F.col("_fa")) * 100, 6) <= GATES["fa_pp"])
        & (F.round((F.col("s_fa_rate") - F.col("_sfa")) * 100, 6) <= GATES["subset_fa_pp"])
    )
    return out.withColumn("accepted", accepted.cast("int")).drop("_fa", "_sfa")


def z_sweep(days: DataFrame, thresholds: Sequence[float], floor: int = RECOVER_AT_LEAST) -> DataFrame:
    """Missed and detected days whose peak z reaches each threshold; ``recommended`` marks the highest
    threshold that still recovers ``floor`` missed days. ``days``: grp (missed/detected), peak_z."""
    spread = days.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    over, missed = F.col("peak_z") >= F.col("threshold"), F.col("grp") == "missed"
    table = spread.groupBy("threshold").agg(
        F.count(F.when(missed & over, 1)).alias("recovered"), F.count(F.when(missed, 1)).alias("n_missed"),
        F.count(F.when(~missed & over, 1)).alias("detected_above"),
    )
    best = F.max(F.when(F.col("recovered") >= floor, F.col("threshold"))).over(Window.partitionBy())
    share = F.round(100.0 * F.col("recovered") / F.greatest("n_missed", F.lit(1)), 1)
    return table.withColumns({"pct_recovered": share, "recommended": F.coalesce(F.col("threshold") == best, F.lit(False)).cast("int")})


def normal_exceed_rate(threshold: float, n_channels: int) -> float:
    """P(max of n independent |z| > threshold) for standard normal z; a scalar computed once."""
    inside = 2.0 * NormalDist().cdf(threshold) - 1.0
    return 1.0 - inside**n_channels


def normal_max_threshold(n_channels: int, share: float = 0.95) -> float:
    return NormalDist().inv_cdf((1.0 + share ** (1.0 / n_channels)) / 2.0)


def expected_false_days(days: DataFrame, rate: float) -> DataFrame:
    """Expected false-alarm days: sum over normal days of P(three or more steps exceed)."""
    normal = days.where(F.col("label") == NORMAL)
    p = binomial_at_least_three(F.col("n_steps"), F.lit(rate))
    return normal.groupBy("pump_id").agg(F.count(F.lit(1)).alias("n_days"), F.sum(p).alias("expected_days"))


def day_profile(days: DataFrame, steps: DataFrame, score: str, group: str) -> DataFrame:
    """mean/max/p50/p95 of a score per group of days and per day, with the gap to the warning."""
    tagged = steps.join(days.select(*SEG, group), list(SEG))
    keys = [group, *SEG]
    q = exact_quantiles(tagged, keys, score, {"p50": 0.5, "p95": 0.95})
    m = tagged.groupBy(*keys).agg(
        F.avg(score).alias("mean"), F.max(score).alias("max"), (F.max("warning") - F.max(score)).alias("gap_to_warning")
    )
    return m.join(q, keys)


def benchmark_table(runs: DataFrame, order: str) -> DataFrame:
    """Last run per model, failed models left out, ranked by AUC; winners by AUC, F1, time and per type."""
    rest = [c for c in runs.columns if c != "model"]
    last = runs.groupBy("model").agg(F.max_by(F.struct(*rest), order).alias("_r")).select("model", "_r.*")
    ok = last.where(F.col("error").isNull())
    rank = Window.orderBy(F.desc("auc_roc"), "model")
    kind = Window.partitionBy("model_type").orderBy(F.desc("auc_roc"), "model")
    return ok.withColumns({
        "rank": F.row_number().over(rank),
        "best_f1": (F.row_number().over(Window.orderBy(F.desc("f1"), "model")) == 1).cast("int"),
        "fastest": (F.row_number().over(Window.orderBy("seconds", "model")) == 1).cast("int"),
        "best_of_type": (F.row_number().over(kind) == 1).cast("int"),
    })


def trial_table(trials: DataFrame, top: int = 15) -> DataFrame:
    """Successful trials ranked by F1, AUC, ratio: the top ones (a report, so the limit is the feature)."""
    ok = trials.where(F.col("state") == "ok").orderBy(F.desc("f1"), F.desc("auc_roc"), F.desc("ratio"), "trial").limit(top)
    w = Window.orderBy(F.desc("f1"), F.desc("auc_roc"), F.desc("ratio"), "trial")
    return ok.withColumn("place", F.row_number().over(w))


def run_summary(errors: DataFrame) -> DataFrame:
    """Mean of per-variable errors for normal and abnormal rows and their ratio.

    ``errors``: label, channel, mse.
    """
    per_var = errors.groupBy("label", "channel").agg(F.avg("mse").alias("mse"))
    out = per_var.agg(
        F.avg(F.when(~is_bad(), F.col("mse"))).alias("normal_mse"), F.avg(F.when(is_bad(), F.col("mse"))).alias("abnormal_mse")
    )
    return out.withColumn("val_ratio", F.try_divide(F.col("abnormal_mse"), F.col("normal_mse")))


def with_season(days: DataFrame) -> DataFrame:
    return days.withColumn("season", season_of(F.col("date")))


def cumulative(df: DataFrame, value: str) -> DataFrame:
    """Cumulative share of a value, exact at any size."""
    t = running_totals(df.withColumn("_all", F.lit(1)), ["_all"], value, {"n": F.lit(1)})
    return t.select(value, (F.col("cum_n") / F.col("all_n")).alias("share"))
