"""Threshold calibration. Scopes (global, pump, season, season+pump) are a column, so each
statistic is one aggregate over all scopes; quantiles go through the distributed
order statistics because the global scope holds every row."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotorline.functions.ordered import exact_quantiles, nth_smallest
from rotorline.operators.scoring import deltas
from rotorline.session import materialize

# --- Fixed values -----------------------------------------------------------
RIDGE = 1e-6
MIN_SAMPLES = 30
MIN_WINDOW_SAMPLES = 10
MIN_DAYS = 3
GLOBAL = -1
ALL_YEAR = "all"
P_WARNING, P_ALARM = 0.95, 0.99
CALIBRATED_RATIO = (0.3, 3.0)
# ---------------------------------------------------------------------------

SCOPE = ("scope_season", "scope_pump")


def with_scopes(df: DataFrame, seasonal: bool = False) -> DataFrame:
    """Copy each row into the scopes it belongs to. Aggregates over scopes combine before the shuffle."""
    pairs = [(F.lit(ALL_YEAR), F.lit(GLOBAL)), (F.lit(ALL_YEAR), F.col("pump_id"))]
    if seasonal:
        pairs += [(F.col("season"), F.lit(GLOBAL)), (F.col("season"), F.col("pump_id"))]
    scopes = F.array(*[F.struct(s.alias("scope_season"), p.cast("int").alias("scope_pump")) for s, p in pairs])
    return df.withColumn("_scope", F.explode(scopes)).select("*", "_scope.*").drop("_scope")


def unpivot(df: DataFrame, channels: Sequence[str], keys: Sequence[str], prefix: str = "res_") -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"{prefix}{c}").alias("value")) for c in channels])
    return df.select(*keys, F.explode(cells).alias("_c")).select(*keys, "_c.*")


def with_blocks(df: DataFrame, blocks: DataFrame, columns: Sequence[str], seasonal: bool = False) -> DataFrame:
    """Each row with the blocks of its scopes in ``_scopes`` (array of scope and ``block``), without copying the row.

    The global block is a scalar, those of the seasons are a map of four; only pumps are joined.
    """
    block = F.struct(*columns).alias("block")
    everywhere, all_year = F.col("scope_pump") == GLOBAL, F.col("scope_season") == ALL_YEAR
    one = blocks.where(everywhere & all_year).select(block).scalar()
    by_pump = blocks.where(~everywhere & all_year).select(F.col("scope_pump").alias("pump_id"), F.struct(*columns).alias("_pump"))
    out = df.join(by_pump, "pump_id", "left")

    def entry(season: Column, pump: Column, value: Column) -> Column:
        return F.struct(season.alias("scope_season"), pump.cast("int").alias("scope_pump"), value.alias("block"))

    parts = [entry(F.lit(ALL_YEAR), F.lit(GLOBAL), one), entry(F.lit(ALL_YEAR), F.col("pump_id"), F.col("_pump"))]
    if seasonal:
        seasons = blocks.where(everywhere & ~all_year).agg(F.map_from_entries(F.collect_list(F.struct("scope_season", block)))).scalar()
        both = blocks.where(~everywhere & ~all_year).select(F.col("scope_season").alias("season"), F.col("scope_pump").alias("pump_id"), F.struct(*columns).alias("_both"))
        out = out.join(both, ["season", "pump_id"], "left")
        parts += [entry(F.col("season"), F.lit(GLOBAL), F.try_element_at(seasons, F.col("season"))), entry(F.col("season"), F.col("pump_id"), F.col("_both"))]
    return out.withColumn("_scopes", F.array(*parts)).drop("_pump", "_both")


def scope_moments(df: DataFrame, channels: Sequence[str], seasonal: bool = False) -> DataFrame:
    """What ``covariance`` gives, for every scope, in one pass over the rows.

    The rows are aggregated by pump (and season) only; scopes are merged from these small rows by the rule for pooled
    means and products: products about the pooled mean are those about the own means plus the means' own spread.
    """
    keys = ["pump_id", "season"] if seasonal else ["pump_id"]
    r = {c: F.col(f"res_{c}") for c in channels}
    pairs = [(a, b) for i, a in enumerate(channels) for b in channels[i:]]
    fine = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("k"), *[F.avg(r[c]).alias(f"m_{c}") for c in channels], *[(F.covar_pop(r[a], r[b]) * F.count(F.lit(1))).alias(f"c_{a}__{b}") for a, b in pairs])
    scoped = with_scopes(fine, seasonal)
    pooled = {c: F.sum(F.col("k") * F.col(f"m_{c}")) / F.sum("k") for c in channels}
    merged = scoped.groupBy(*SCOPE).agg(F.sum("k").alias("n"), *[pooled[c].alias(f"_m_{c}") for c in channels])
    around = scoped.join(merged, list(SCOPE))
    off = {c: F.col(f"m_{c}") - F.col(f"_m_{c}") for c in channels}
    products = around.groupBy(*SCOPE, "n", *[f"_m_{c}" for c in channels]).agg(
        *[F.sum(F.col(f"c_{a}__{b}") + F.col("k") * off[a] * off[b]).alias(f"_c_{a}__{b}") for a, b in pairs])
    return products.select(
        *SCOPE, "n", *[f"_m_{c}" for c in channels], *[F.sqrt(F.greatest(F.col(f"_c_{c}__{c}"), F.lit(0.0)) / F.col("n")).alias(f"_s_{c}") for c in channels],
        *[F.when(F.col("n") > 1, F.col(f"_c_{a}__{b}") / (F.col("n") - 1)).alias(f"cov_{a}__{b}") for a, b in pairs])


def feature_statistics(df: DataFrame, channels: Sequence[str], seasonal: bool = False, blocks: DataFrame | None = None) -> DataFrame:
    """Per scope and channel: mean, population deviation, p95/p99 of |r| and of |z| (0 for a constant channel).

    ``blocks``: rows with ``mean_vec`` and ``std_vec`` per scope, where they are known already.
    """
    by = [*SCOPE, "channel"]
    blocks = materialize(invert(scope_moments(df, channels, seasonal), channels).select(*SCOPE, "n", "mean_vec", "std_vec")) if blocks is None else blocks
    cells = F.array(*[F.struct(F.lit(c).alias("channel"), F.col("mean_vec")[c].alias("mean_residual"), F.col("std_vec")[c].alias("std_residual")) for c in channels])
    moments = blocks.select(*SCOPE, "n", F.explode(cells).alias("_c")).select(*SCOPE, "_c.*", "n")

    def measured(scope: Column) -> list[Column]:
        """Both numbers of each channel of a row, under one scope."""
        out = []
        for c in channels:
            r, mean, std = F.col(f"res_{c}"), scope["block"]["mean_vec"][c], scope["block"]["std_vec"][c]
            z = F.when(std < 1e-12, 0.0).otherwise(F.abs((r - mean) / std))
            out += [F.struct(scope["scope_season"].alias("scope_season"), scope["scope_pump"].alias("scope_pump"), F.lit(c).alias("channel"), F.lit(k).alias("kind"), x.alias("x"))
                    for k, x in (("r", F.abs(r)), ("z", z))]
        return out

    held = with_blocks(df, blocks, ["mean_vec", "std_vec"], seasonal)
    both = held.select(F.explode(F.flatten(F.transform("_scopes", lambda scope: F.array(*measured(scope))))).alias("_k")).select("_k.*")
    q = exact_quantiles(both, [*by, "kind"], "x", {"p95": P_WARNING, "p99": P_ALARM})
    wide = q.groupBy(*by).agg(
        F.max(F.when(F.col("kind") == "r", F.col("p95"))).alias("p95_abs"),
        F.max(F.when(F.col("kind") == "r", F.col("p99"))).alias("p99_abs"),
        F.max(F.when(F.col("kind") == "z", F.col("p95"))).alias("z_warning"),
        F.max(F.when(F.col("kind") == "z", F.col("p99"))).alias("z_alarm"),
    )
    return moments.join(wide, by)


def covariance(scoped: DataFrame, channels: Sequence[str], keys: Sequence[str] = SCOPE) -> DataFrame:
    """One pass: mean vector, deviations and the upper triangle of the sample covariance per scope."""
    r = {c: F.col(f"res_{c}") for c in channels}
    aggs: list[Column] = [F.count(F.lit(1)).alias("n")]
    for c in channels:
        aggs += [F.avg(r[c]).alias(f"_m_{c}"), F.stddev_pop(r[c]).alias(f"_s_{c}")]
    for i, a in enumerate(channels):
        for b in channels[i:]:
            aggs.append(F.covar_samp(r[a], r[b]).alias(f"cov_{a}__{b}"))
    return scoped.groupBy(*keys).agg(*aggs)


def _pair(a: str, b: str, channels: Sequence[str]) -> str:
    one, two = sorted((a, b), key=list(channels).index)
    return f"cov_{one}__{two}"


def invert(cov: DataFrame, channels: Sequence[str], ridge: float = RIDGE, condition: bool = False) -> DataFrame:
    """Add ``mean_vec``, ``std_vec``, ``cov_inv`` (structs by channel name) to covariance rows.

    One small matrix per scope; scopes are rows, inverted where they live.
    A scope with fewer than two samples has no covariance and gets the identity.
    """
    names = list(channels)
    k = len(names)
    vec = ",".join(f"`{c}`:double" for c in names)
    mat = ",".join(f"`{c}`:struct<{vec}>" for c in names)
    flat = F.array(*[F.col(_pair(a, b, names)) for a in names for b in names])

    @F.pandas_udf(f"inv array<double>, cond double")
    def pinv(cells: pd.Series) -> pd.DataFrame:
        stack = np.array([np.array([np.nan if v is None else v for v in c], dtype=float) for c in cells]).reshape(-1, k, k)
        stack = np.where(np.isfinite(stack).all(axis=(1, 2), keepdims=True), stack, np.eye(k))
        stack = stack + ridge * np.eye(k)
        inverse = np.linalg.pinv(stack, hermitian=True)
        return pd.DataFrame({"inv": [m.ravel().tolist() for m in inverse], "cond": np.linalg.cond(stack)})

    out = cov.withColumn("_i", pinv(flat))
    rows = [
        F.struct(*[F.col("_i.inv")[i * k + j].alias(b) for j, b in enumerate(names)]).alias(a)
        for i, a in enumerate(names)
    ]
    out = out.withColumn("cov_inv", F.struct(*rows).cast(f"struct<{mat}>"))
    if condition:
        out = out.withColumn("condition_number", F.col("_i.cond"))
    out = out.withColumns({
        "mean_vec": F.struct(*[F.col(f"_m_{c}").alias(c) for c in names]),
        "std_vec": F.struct(*[F.col(f"_s_{c}").alias(c) for c in names]),
    })
    return out.drop("_i", *[f"_m_{c}" for c in names], *[f"_s_{c}" for c in names])


def diagonal_inverse(channels: Sequence[str], std_vec: Column) -> Column:
    """Inverse built from per-channel deviations, for blocks published without a covariance."""
    rows = []
    for a in channels:
        var = F.greatest(std_vec[a] * std_vec[a], F.lit(1e-12))
        rows.append(F.struct(*[(1.0 / var if a == b else F.lit(0.0)).alias(b) for b in channels]).alias(a))
    return F.struct(*rows)


def distance_thresholds(distances: DataFrame, keys: Sequence[str] = SCOPE, value: str = "distance") -> DataFrame:
    """warning = p95, alarm = p99, with mean, population deviation and n."""
    q = exact_quantiles(distances, keys, value, {"warning": P_WARNING, "alarm": P_ALARM})
    m = distances.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))
    return m.join(q, list(keys))


def calibrate(res: DataFrame, channels: Sequence[str], seasonal: bool = False,
              min_samples: int = MIN_SAMPLES, features: bool = True) -> DataFrame:
    """Threshold blocks per scope: distances under the scope's own covariance, fallback to the scope's
    parent (global of the same season) when it has fewer than ``min_samples`` rows.

    The pump blocks publish no covariance: scoring them uses the diagonal inverse.
    ``features=False`` leaves out the per-channel statistics (only channel health reads them).
    """
    from rotorline.operators.scoring import distance

    # One row per scope, read by the distances and by the result; one number per sample and scope, read by the moments
    # and the quantiles: both are written once.
    blocks = materialize(invert(scope_moments(res, channels, seasonal), channels))
    held = with_blocks(res, blocks, ["mean_vec", "cov_inv"], seasonal)
    far = F.transform("_scopes", lambda s: F.struct(
        s["scope_season"].alias("scope_season"), s["scope_pump"].alias("scope_pump"), distance(channels, s["block"]["mean_vec"], s["block"]["cov_inv"]).alias("distance")))
    th = distance_thresholds(materialize(held.select(F.explode(far).alias("_d")).select("_d.*")))
    full = blocks.select(*SCOPE, "mean_vec", "std_vec", "cov_inv").join(th, list(SCOPE))
    if features:
        stats = feature_statistics(res, channels, seasonal, blocks)
        parts = F.struct("mean_residual", "std_residual", "p95_abs", "p99_abs", "z_warning", "z_alarm")
        named = stats.groupBy(*SCOPE).agg(*[F.max(F.when(F.col("channel") == c, parts)).alias(c) for c in channels])
        full = full.join(named.select(*SCOPE, F.struct(*channels).alias("per_feature")), list(SCOPE))
    is_pump = F.col("scope_pump") != GLOBAL
    full = full.withColumn(
        "cov_inv", F.when(is_pump, diagonal_inverse(channels, F.col("std_vec"))).otherwise(F.col("cov_inv"))
    )
    return _fall_back(full, min_samples)


_BLOCK = ("mean_vec", "std_vec", "cov_inv", "warning", "alarm", "mean", "std", "per_feature")


def _fall_back(full: DataFrame, min_samples: int) -> DataFrame:
    names = [c for c in _BLOCK if c in full.columns]
    parent = full.where(F.col("scope_pump") == GLOBAL).select("scope_season", *[F.col(c).alias(f"_g_{c}") for c in names])
    weak = (F.col("scope_pump") != GLOBAL) & (F.col("n") < min_samples)
    out = full.join(parent, "scope_season").withColumn("fallback", weak)
    return out.withColumns({
        c: F.when(F.col("fallback"), F.col(f"_g_{c}")).otherwise(F.col(c)) for c in names
    }).drop(*[f"_g_{c}" for c in names])


def resolve_blocks(keys: DataFrame, blocks: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Threshold block of each (pump_id, season): seasonal pump (not flagged), seasonal global, pump (not
    flagged), global. Resolved once per distinct key; data joins the result once."""
    def level(name: str, test: Column, flagged: bool) -> DataFrame:
        picked = blocks.where(test & (~F.col("fallback") if flagged else F.lit(True)))
        return picked.select("scope_season", "scope_pump", F.struct(*columns).alias(name))

    season_named, is_global = F.col("scope_season") != ALL_YEAR, F.col("scope_pump") == GLOBAL
    out = keys.select("pump_id", "season").distinct()
    steps = (
        ("_b1", season_named & ~is_global, True, ["season", "pump_id"]),
        ("_b2", season_named & is_global, False, ["season"]),
        ("_b3", ~season_named & ~is_global, True, ["pump_id"]),
    )
    for name, test, flagged, on in steps:
        side = level(name, test, flagged)
        if "season" in on:
            side = side.withColumnRenamed("scope_season", "season")
        if "pump_id" in on:
            side = side.withColumnRenamed("scope_pump", "pump_id")
        out = out.join(side.select(*on, name), on, "left")
    out = out.withColumn("_b4", level("_b4", ~season_named & is_global, False).select("_b4").scalar())
    chosen = F.coalesce("_b1", "_b2", "_b3", "_b4")
    source = (
        F.when(F.col("_b1").isNotNull(), "season_pump").when(F.col("_b2").isNotNull(), "season")
        .when(F.col("_b3").isNotNull(), "pump").otherwise("global")
    )
    return out.withColumn("_b", chosen).select("pump_id", "season", source.alias("block_source"), "_b.*")


def resolve_stream_blocks(keys: DataFrame, blocks: DataFrame, level: int) -> DataFrame:
    """Streaming lookups. Level 1: pump (not flagged) else global. Level 2: same, and a seasonal pump block
    (not flagged) replaces warning/alarm while the mean stays the non-seasonal one. The alarm never lies
    below the warning."""
    plain = blocks.where(F.col("scope_season") == ALL_YEAR)
    pump = plain.where((F.col("scope_pump") != GLOBAL) & ~F.col("fallback")).select(
        F.col("scope_pump").alias("pump_id"), F.struct("warning", "alarm", "mean").alias("_p")
    )
    everyone = plain.where(F.col("scope_pump") == GLOBAL).select(F.struct("warning", "alarm", "mean")).scalar()
    out = keys.select("pump_id", "season").distinct()
    out = out.join(pump, "pump_id", "left").withColumn("_t", F.coalesce(F.col("_p"), everyone))
    if level == 2:
        seasonal = blocks.where(
            (F.col("scope_season") != ALL_YEAR) & (F.col("scope_pump") != GLOBAL) & ~F.col("fallback")
        ).select(F.col("scope_season").alias("season"), F.col("scope_pump").alias("pump_id"), F.struct("warning", "alarm").alias("_s"))
        out = out.join(seasonal, ["season", "pump_id"], "left")
        warning, alarm = F.coalesce("_s.warning", "_t.warning"), F.coalesce("_s.alarm", "_t.alarm")
    else:
        warning, alarm = F.col("_t.warning"), F.col("_t.alarm")
    return out.select("pump_id", "season", warning.alias("warning"), F.greatest(alarm, warning).alias("alarm"), F.col("_t.mean").alias("mean"))


def contributions(scored: DataFrame, channels: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Share of each channel in the squared distance: mean and p95. ``scored`` carries mean_vec and cov_inv."""
    d = deltas(channels, F.col("mean_vec"))
    parts = {}
    for a in channels:
        terms = [F.col("cov_inv")[a][b] * d[b] for b in channels]
        parts[f"part_{a}"] = d[a] * sum(terms[1:], terms[0])
    long = unpivot(scored.withColumns(parts), channels, keys, prefix="part_")
    by = [*keys, "channel"]
    mean = long.groupBy(*by).agg(F.avg("value").alias("contribution_mean"))
    return mean.join(exact_quantiles(long, by, "value", {"contribution_p95": P_WARNING}), by)


def most_correlated(cov: DataFrame, channels: Sequence[str], keys: Sequence[str], top: int = 3) -> DataFrame:
    """The ``top`` most correlated other channels from covariance rows (|r|, ties by channel order reversed)."""
    rows = []
    for i, a in enumerate(channels):
        for j, b in enumerate(channels):
            if a != b:
                denom = F.sqrt(F.col(_pair(a, a, channels))) * F.sqrt(F.col(_pair(b, b, channels)))
                r = F.when(denom > 1e-12, F.abs(F.col(_pair(a, b, channels)) / denom)).otherwise(0.0)
                rows.append(F.struct(F.lit(a).alias("channel"), F.lit(b).alias("other"), r.alias("r"), F.lit(-j).alias("o")))
    long = cov.select(*keys, F.explode(F.array(*rows)).alias("_x")).select(*keys, "_x.*")
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("r")).alias("r"), "o", "other"))), 1, top)
    return long.groupBy(*keys, "channel").agg(F.array_join(F.transform(best, lambda x: x["other"]), ",").alias("top_correlated"))


def window_thresholds(windows: DataFrame) -> DataFrame:
    """Reconstruction thresholds per scope from window errors (``error`` raw, ``smoothed``).

    A pump scope needs ten windows; its day values need three days.
    """
    scoped = with_scopes(windows)
    raw = exact_quantiles(scoped, SCOPE, "error", {"warning": P_WARNING, "alarm": P_ALARM})
    soft = exact_quantiles(scoped, SCOPE, "smoothed", {"window_warning": P_WARNING, "window_alarm": P_ALARM})
    day_rows = windows.groupBy("pump_id", "date").agg(F.avg("error").alias("day_error"))
    days = exact_quantiles(with_scopes(day_rows), SCOPE, "day_error", {"day_warning": P_WARNING, "day_alarm": P_ALARM})
    n_days = with_scopes(day_rows).groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("n_days"))
    m = scoped.groupBy(*SCOPE).agg(
        F.avg("error").alias("mean"), F.stddev_pop("error").alias("std"), F.count("error").alias("n")
    )
    out = m.join(raw, list(SCOPE)).join(soft, list(SCOPE)).join(days, list(SCOPE)).join(n_days, list(SCOPE))
    enough = (F.col("scope_pump") == GLOBAL) | (F.col("n_days") >= MIN_DAYS)
    out = out.where((F.col("scope_pump") == GLOBAL) | (F.col("n") >= MIN_WINDOW_SAMPLES))
    return out.withColumns({
        "mean_plus_2sigma": F.col("mean") + 2 * F.col("std"),
        "mean_plus_3sigma": F.col("mean") + 3 * F.col("std"),
        "day_warning": F.when(enough, F.col("day_warning")),
        "day_alarm": F.when(enough, F.col("day_alarm")),
    })


def calibration_check(p99: Column, reference: Column) -> Column:
    ratio = p99 / (reference + 1e-12)
    low, high = CALIBRATED_RATIO
    return F.when((ratio > low) & (ratio < high), "GOOD").otherwise("CHECK")


def recalibrate(windows: DataFrame, previous: DataFrame) -> DataFrame:
    """New thresholds from stored scores; the previous Youden value of a scope is kept."""
    required = {"pump_id", "date", "error", "smoothed"} - set(windows.columns)
    if required:
        raise ValueError(f"stored scores lack {sorted(required)}")
    kept = previous.select(*SCOPE, "youden")
    return window_thresholds(windows).join(kept, list(SCOPE), "left")


def conformal_rank(n: Column, alpha: float) -> Column:
    return F.least(F.ceil(F.round((1.0 - alpha) * (n + 1), 9)), n)


def conformal_coverage(n: Column, alpha: float) -> Column:
    return F.ceil(F.round((1.0 - alpha) * (n + 1), 9)) / (n + 1)


def conformal_quantile(scores: DataFrame, keys: Sequence[str], value: str, alpha: float) -> DataFrame:
    """The min(ceil((1-alpha)(n+1)), n)-th smallest score per group."""
    out = nth_smallest(scores, keys, value, conformal_rank(F.col("all_n"), alpha), "conformal")
    return out.withColumn("coverage", conformal_coverage(F.col("n"), alpha)).drop("rank")


def conformal_blocks(distances: DataFrame, alpha: float = 0.05, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """Per pump on distances under the global covariance; small pumps take the global block."""
    scoped = with_scopes(distances)
    q = conformal_quantile(scoped, SCOPE, "distance", alpha)
    parent = q.where(F.col("scope_pump") == GLOBAL).select(
        "scope_season", F.col("conformal").alias("_c"), F.col("coverage").alias("_v")
    )
    weak = (F.col("scope_pump") != GLOBAL) & (F.col("n") < min_samples)
    out = q.join(parent, "scope_season").withColumn("fallback", weak)
    return out.select(
        *SCOPE, F.when(weak, F.col("_c")).otherwise(F.col("conformal")).alias("conformal"), "n",
        F.when(weak, F.col("_v")).otherwise(F.col("coverage")).alias("coverage"), "fallback",
    )


def merge_conformal(thresholds: DataFrame, blocks: DataFrame) -> DataFrame:
    """Add the conformal fields to matching blocks; every other column and row stays as it is."""
    extra = blocks.select(*SCOPE, F.struct("conformal", "coverage", F.col("n").alias("n_calibration")).alias("conformal_quantile"))
    return thresholds.join(extra, list(SCOPE), "left")


def scale_thresholds(thresholds: DataFrame, warning_factor: float, alarm_factor: float) -> DataFrame:
    return thresholds.withColumns({
        "warning": F.col("warning") * warning_factor, "alarm": F.col("alarm") * alarm_factor,
    })


def max_z(channels: Sequence[str], mean: Column, std: Column) -> Column:
    zs = [F.abs((F.col(f"res_{c}") - mean[c]) / F.greatest(std[c], F.lit(1e-12))) for c in channels]
    return F.array_max(F.array(*zs))


def max_z_thresholds(steps: DataFrame, subset_pump: int) -> DataFrame:
    """p95 of the per-step max |z| per pump (``max_z``) and of the subset max for one pump (``subset_z``)."""
    kinds = F.array(
        F.struct(F.lit("all").alias("kind"), F.col("max_z").alias("x")),
        F.struct(F.lit("subset").alias("kind"), F.when(F.col("pump_id") == subset_pump, F.col("subset_z")).alias("x")),
    )
    long = steps.select("pump_id", F.explode(kinds).alias("_k")).select("pump_id", "_k.*").where(F.col("x").isNotNull())
    return exact_quantiles(long, ["kind", "pump_id"], "x", {"threshold": P_WARNING})


def refit(res: DataFrame, channels: Sequence[str], ridge: float) -> DataFrame:
    """Global refit with a chosen ridge: matrix, mean and condition number."""
    scoped = res.withColumns({"scope_season": F.lit(ALL_YEAR), "scope_pump": F.lit(GLOBAL)})
    return invert(covariance(scoped, channels), channels, ridge, condition=True)


def replace_global(thresholds: DataFrame, fitted: DataFrame) -> DataFrame:
    """Put the refitted matrix and mean in the global block, keep everything else."""
    new = fitted.select(*SCOPE, F.col("cov_inv").alias("_inv"), F.col("mean_vec").alias("_mu"))
    out = thresholds.join(new, list(SCOPE), "left")
    return out.withColumns({
        "cov_inv": F.coalesce("_inv", "cov_inv"), "mean_vec": F.coalesce("_mu", "mean_vec"),
    }).drop("_inv", "_mu")
