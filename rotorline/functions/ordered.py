"""Exact order statistics over groups of any size.

``percentile`` and a plain ranking window hold one group in one task. Here equal
values are first merged (map-side combine), then the points are range-partitioned by
(group, value) and stored once. Running sums are taken inside (group, partition), and
the totals of the partitions before are added. A group with a third of all rows is
spread over many tasks; one value with a third of all rows is one point. There is one
plan for every size: Spark draws the ranges, and their number follows its settings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rotorline.session import materialize


def running_totals(df: DataFrame, keys: Sequence[str], value: str, sums: dict[str, Column]) -> DataFrame:
    """One row per (keys, value): ``<name>`` (sum at the value), ``cum_<name>`` (sum up
    to and including it, ascending) and ``all_<name>`` (sum of the group)."""
    keys = list(keys)
    merged = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(*[F.sum(expr).alias(name) for name, expr in sums.items()])
    # Stored with its range number, which a later recomputation could draw otherwise.
    points = materialize(merged.repartitionByRange(*keys, value).withColumn("_slot", F.spark_partition_id()))
    totals = points.groupBy(*keys, "_slot").agg(*[F.sum(name).alias(f"_t_{name}") for name in sums])
    every = Window.partitionBy(*keys)
    below = every.orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_slot").alias("_k_slot"),
        *[(F.sum(f"_t_{name}").over(below) - F.col(f"_t_{name}")).alias(f"_o_{name}") for name in sums],
        *[F.sum(f"_t_{name}").over(every).alias(f"all_{name}") for name in sums],
    )
    inside = Window.partitionBy(*keys, "_slot").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    local = points.select("*", *[F.sum(name).over(inside).alias(f"_l_{name}") for name in sums])
    same = F.col("_slot") == F.col("_k_slot")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return local.join(offsets, same).select(
        *keys,
        value,
        *sums,
        *[(F.col(f"_l_{name}") + F.col(f"_o_{name}")).alias(f"cum_{name}") for name in sums],
        *[f"all_{name}" for name in sums],
    )


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], count: str | None = None) -> DataFrame:
    """Linear-interpolation quantiles (position ``p*(n-1)``) per group: one row per group. ``count`` names the number of values."""
    return quantiles_of(running_totals(df, keys, value, {"n": F.lit(1)}), keys, value, probs, count)


def quantiles_of(ranked: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], count: str | None = None) -> DataFrame:
    """The same from points that ``running_totals`` has ranked by their number ``n``."""
    first, last = F.col("cum_n") - F.col("n"), F.col("cum_n") - 1

    def at(position: Column) -> Column:
        return F.max(F.when((position >= first) & (position <= last), F.col(value).cast("double")))

    parts = []
    for name, p in probs.items():
        spot = F.lit(float(p)) * (F.col("all_n") - 1)
        parts.append(at(F.floor(spot)).alias(f"_lo_{name}"))
        parts.append(at(F.ceil(spot)).alias(f"_hi_{name}"))
        parts.append(F.max(spot - F.floor(spot)).alias(f"_w_{name}"))
    picked = ranked.groupBy(*keys).agg(*parts, *([F.max("all_n").alias(count)] if count else []))
    return picked.select(
        *keys,
        *([count] if count else []),
        *[
            (F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * F.col(f"_w_{name}")).alias(name)
            for name in probs
        ],
    )


def nth_smallest(df: DataFrame, keys: Sequence[str], value: str, rank: Column, out: str) -> DataFrame:
    """The ``rank``-th smallest value (1-based). ``rank`` may use ``all_n``, the group size."""
    ranked = running_totals(df, keys, value, {"n": F.lit(1)})
    wanted = ranked.withColumn("_rank", rank)
    hit = (F.col("_rank") > F.col("cum_n") - F.col("n")) & (F.col("_rank") <= F.col("cum_n"))
    return wanted.groupBy(*keys).agg(
        F.max(F.when(hit, F.col(value))).alias(out), F.max("all_n").alias("n"), F.max("_rank").alias("rank")
    )


def roc_table(df: DataFrame, keys: Sequence[str], score: str, label: Column) -> DataFrame:
    """Per distinct score: positives and negatives at or above it, and the group totals."""
    ranked = running_totals(df, keys, score, {"pos": F.when(label, 1).otherwise(0), "neg": F.when(label, 0).otherwise(1)})
    return ranked.select(
        *keys,
        F.col(score).alias("score"),
        "pos",
        "neg",
        (F.col("all_pos") - F.col("cum_pos") + F.col("pos")).alias("tp"),
        (F.col("all_neg") - F.col("cum_neg") + F.col("neg")).alias("fp"),
        (F.col("cum_neg") - F.col("neg")).alias("neg_below"),
        F.col("all_pos").alias("p"),
        F.col("all_neg").alias("n"),
    )


def auc_of(roc: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rank-sum area under the curve with ties counted half; null without both classes."""
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") * 0.5))
    return roc.groupBy(*keys).agg(
        F.try_divide(wins, (F.max("p") * F.max("n")).cast("double")).alias("auc_roc"),
        F.max("p").alias("n_pos"),
        F.max("n").alias("n_neg"),
    )


def _rate(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def _at_best(roc: DataFrame, keys: Sequence[str], goal: Column, prefer_high_score: bool) -> DataFrame:
    tie = F.col("score") if prefer_high_score else -F.col("score")
    best = roc.withColumn("_goal", goal).groupBy(*keys).agg(
        F.max_by(F.struct("score", "tp", "fp", "p", "n", "_goal"), F.struct("_goal", tie)).alias("_b")
    )
    return best.select(*keys, "_b.*")


def youden(roc: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Threshold with the largest TPR-FPR; the higher score on ties, as a curve read from the top."""
    goal = F.round(_rate(F.col("tp"), F.col("p")) - _rate(F.col("fp"), F.col("n")), 12)
    best = _at_best(roc, keys, goal, prefer_high_score=True)
    return best.select(*keys, F.col("score").alias("threshold"), F.col("_goal").alias("youden_j"), *_prf())


def best_f1(roc: DataFrame, keys: Sequence[str]) -> DataFrame:
    """F1-optimal threshold over the observed scores; the lowest score on ties."""
    f1 = _rate(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("p") - F.col("tp"))
    best = _at_best(roc, keys, F.round(f1, 12), prefer_high_score=False)
    return best.select(*keys, F.col("score").alias("threshold"), *_prf())


def _prf() -> list[Column]:
    tp, fp, p = F.col("tp"), F.col("fp"), F.col("p")
    return [
        _rate(tp, tp + fp).alias("precision"),
        _rate(tp, p).alias("recall"),
        _rate(2 * tp, tp + fp + p).alias("f1"),
    ]
