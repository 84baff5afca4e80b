"""Feature preparation: fills, smoothing, normalisation, history windows, splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rotorline.functions.formulas import season_of
from rotorline.functions.series import SEG, TS, last_rows, ordered, whole

# --- Fixed values -----------------------------------------------------------
# Second-order polynomial smoothing over five rows, in units of 1/35.
SMOOTH_INTERIOR = (-3, 12, 17, 12, -3)
SMOOTH_FIRST = (31, 9, -3, -5, 3)
SMOOTH_SECOND = (9, 13, 12, 6, -5)
SMOOTH_SCALE = 35.0
MIN_SEGMENT_ROWS = 5
# ---------------------------------------------------------------------------


def upgrade_columns(inputs: Sequence[str], outputs: Sequence[str], renamed: dict[str, Sequence[str]],
                    id_columns: Sequence[str]) -> tuple[list[str], list[str]]:
    """Old column lists to new ones: one old name may expand to several; ids leave the outputs."""
    def expand(names: Sequence[str]) -> list[str]:
        return list(dict.fromkeys(new for name in names for new in renamed.get(name, (name,))))

    return expand(inputs), [c for c in expand(outputs) if c not in id_columns]


def forward_fill_clean(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = SEG, ts: str = TS,
                       min_rows: int = MIN_SEGMENT_ROWS) -> DataFrame:
    """Fill one step forward, drop rows still incomplete, drop segments left with fewer than ``min_rows``."""
    w = ordered(keys, ts)
    filled = df.withColumns({c: F.coalesce(F.col(c), F.lag(c).over(w)) for c in columns}).dropna(subset=list(columns))
    sized = filled.withColumn("_rows", F.count(F.lit(1)).over(whole(keys)))
    return sized.where(F.col("_rows") >= min_rows).drop("_rows")


def fill_with_mean(df: DataFrame, columns: Sequence[str], means: dict[str, Column], keys: Sequence[str] = SEG,
                   ts: str = TS) -> DataFrame:
    """Fill one step forward, one step back, then with the training mean."""
    w = ordered(keys, ts)
    ahead = df.withColumns({c: F.coalesce(F.col(c), F.lag(c).over(w)) for c in columns})
    return ahead.withColumns({c: F.coalesce(F.col(c), F.lead(c).over(w), means[c]) for c in columns})


def one_hot(column: str, ids: Sequence[int], prefix: str) -> dict[str, Column]:
    return {f"{prefix}{i}": (F.col(column) == i).cast("int") for i in ids}


def from_one_hot(ids: Sequence[int], prefix: str) -> Column:
    """Id of the first largest indicator."""
    flags = F.array(*[F.col(f"{prefix}{i}") for i in ids])
    return F.element_at(F.array(*[F.lit(i) for i in ids]), F.array_position(flags, F.array_max(flags)).cast("int"))


def smooth(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = SEG, ts: str = TS) -> DataFrame:
    """Polynomial smoothing per segment as weighted neighbours; segments under five rows are dropped."""
    w = ordered(keys, ts)
    out = df.withColumns({"_i": F.row_number().over(w), "_n": F.count(F.lit(1)).over(whole(keys))})
    out = out.where(F.col("_n") >= MIN_SEGMENT_ROWS)

    def near(c: str, offset: int) -> Column:
        if offset == 0:
            return F.col(c)
        return F.lead(c, offset).over(w) if offset > 0 else F.lag(c, -offset).over(w)

    def weigh(c: str, weights: Sequence[int], offsets: Sequence[int]) -> Column:
        terms = [near(c, o) * float(k) for k, o in zip(weights, offsets)]
        return sum(terms[1:], terms[0]) / SMOOTH_SCALE

    smoothed = {}
    for c in columns:
        smoothed[c] = (
            F.when(F.col("_i") == 1, weigh(c, SMOOTH_FIRST, (0, 1, 2, 3, 4)))
            .when(F.col("_i") == 2, weigh(c, SMOOTH_SECOND, (-1, 0, 1, 2, 3)))
            .when(F.col("_i") == F.col("_n") - 1, weigh(c, SMOOTH_SECOND, (1, 0, -1, -2, -3)))
            .when(F.col("_i") == F.col("_n"), weigh(c, SMOOTH_FIRST, (0, -1, -2, -3, -4)))
            .otherwise(weigh(c, SMOOTH_INTERIOR, (-2, -1, 0, 1, 2)))
        )
    return out.withColumns(smoothed).drop("_i", "_n")


def norm_params(df: DataFrame, columns: Sequence[str], id_columns: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """Mean, population deviation, min and max per column (long); id columns get max 1."""
    aggs = []
    for c in columns:
        v = F.col(c)
        top = F.lit(1.0) if c in id_columns else F.max(v).cast("double")
        aggs.append(F.struct(
            F.lit(c).alias("channel"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
            F.min(v).cast("double").alias("min"), top.alias("max"),
        ).alias(f"_s_{c}"))
    row = df.groupBy(*by).agg(*aggs)
    return row.select(*by, F.explode(F.array(*[F.col(f"_s_{c}") for c in columns])).alias("_p")).select(*by, "_p.*")


def params_struct(params: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Parameters as one wide row (``_norm``: struct keyed by channel) per ``by`` group."""
    parts = [
        F.max(F.when(F.col("channel") == c, F.struct("mean", "std", "min", "max"))).alias(c) for c in columns
    ]
    wide = params.groupBy(*by).agg(*parts)
    return wide.select(*by, F.struct(*columns).alias("_norm"))


def _spread(p: Column, method: str) -> tuple[Column, Column]:
    if method == "z-score":
        return p["mean"], p["std"]
    if method == "min-max":
        return p["min"], p["max"] - p["min"]
    raise ValueError(f"unknown normalisation '{method}'")


def normalize(df: DataFrame, params: DataFrame, columns: Sequence[str], method: str = "min-max") -> DataFrame:
    """Scale columns; a zero range gives 0. The parameters are one row, read as a scalar subquery."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not in the data: {missing}")
    holder = params_struct(params, columns).scalar()
    out = df.withColumn("_norm", holder)
    scaled = {}
    for c in columns:
        base, span = _spread(F.col("_norm")[c], method)
        scaled[c] = F.when(span == 0, F.lit(0.0) * F.col(c)).otherwise(F.try_divide(F.col(c) - base, span))
    return out.withColumns(scaled).drop("_norm")


def denormalize(df: DataFrame, params: DataFrame, columns: Sequence[str], method: str = "min-max") -> DataFrame:
    out = df.withColumn("_norm", params_struct(params, columns).scalar())
    back = {}
    for c in columns:
        base, span = _spread(F.col("_norm")[c], method)
        back[c] = F.col(c) * span + base
    return out.withColumns(back).drop("_norm")


def padded_history(df: DataFrame, columns: Sequence[str], length: int, keys: Sequence[str] = SEG,
                   ts: str = TS, out: str = "window") -> DataFrame:
    """The last ``length`` rows including the current one, padded with the segment's first row; time-major."""
    w = ordered(keys, ts)
    first = w.rowsBetween(Window.unboundedPreceding, 0)
    cells = []
    for k in range(length - 1, -1, -1):
        for c in columns:
            cells.append(F.coalesce(F.lag(c, k).over(w), F.first(c).over(first)) if k else F.col(c))
    return df.withColumn(out, F.array(*[c.cast("double") for c in cells]))


def full_history(df: DataFrame, columns: Sequence[str], length: int, keys: Sequence[str] = SEG, ts: str = TS,
                 skip_first: bool = True, out: str = "window") -> DataFrame:
    """Full windows of ``length`` rows, flattened time-major.

    ``skip_first`` leaves out the first full window of a segment (batch rule);
    otherwise windows start at row ``length`` (streaming rule).
    """
    w = ordered(keys, ts)
    rows = F.collect_list(F.array(*[F.col(c).cast("double") for c in columns])).over(last_rows(w, length))
    placed = df.withColumns({"_i": F.row_number().over(w), "_rows": rows})
    keep = F.col("_i") > (length if skip_first else length - 1)
    return placed.where(keep).withColumn(out, F.flatten("_rows")).drop("_i", "_rows")


def hash_order(columns: Sequence[str], seed: int) -> Column:
    """60 bits of the MD5 sum of the columns' texts and the seed: an order that any SQL engine can repeat."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def split_days(days: DataFrame, shares: dict[str, float], strata: Sequence[str], seed: int = 42,
               segment: Sequence[str] = SEG) -> DataFrame:
    """Whole days to named parts by hash order inside each stratum.

    Ranks come from a per-stratum hash cut: the ``k``-th part ends at its share of the
    stratum. A stratum may be huge, so the order is taken by ``running_totals``.
    """
    from rotorline.functions.ordered import running_totals

    keyed = days.select(*segment, *[s for s in strata if s not in segment]).distinct().withColumn(
        "_h", hash_order(segment, seed)
    )
    ranked = running_totals(keyed, strata, "_h", {"n": F.lit(1)})
    place = (F.col("cum_n") - F.col("n")) / F.col("all_n")
    edge, part = 0.0, None
    for name, share in shares.items():
        edge += share
        part = F.when(place < edge - 1e-12, name) if part is None else part.when(place < edge - 1e-12, name)
    part = part.otherwise(list(shares)[-1])
    return keyed.join(ranked.select(*strata, "_h", part.alias("part")), [*strata, "_h"]).drop("_h")


def sample_rows(df: DataFrame, n: int, order_by: Sequence[str], by: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """At most ``n`` rows (per ``by`` group), chosen by hash order: repeatable and independent of partitioning.

    Spark keeps ``n`` rows per task before the shuffle.
    """
    hashed = df.withColumn("_h", hash_order(order_by, seed))
    if not by:
        return hashed.orderBy("_h", *order_by).limit(n).drop("_h")
    w = Window.partitionBy(*by).orderBy("_h", *order_by)
    return hashed.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k", "_h")


def balance_weights(df: DataFrame, by: str = "pump_id") -> DataFrame:
    """Weight 1/count per group. The counts are a small aggregate joined back, not a window over the group."""
    counts = df.groupBy(by).agg((F.lit(1.0) / F.count(F.lit(1))).alias("weight"))
    return df.join(counts, by)


def with_season(df: DataFrame, date: str = "date") -> DataFrame:
    return df.withColumn("season", season_of(F.col(date)))


def history_datasets(df: DataFrame, columns: Sequence[str], lengths: Sequence[int], train: Column,
                     fraction: float | None = None, seed: int = 42, method: str = "min-max",
                     keys: Sequence[str] = SEG, ts: str = TS) -> DataFrame:
    """Windowed data sets for several history lengths from one load.

    ``train`` marks training rows: parameters are fitted on them only. An optional
    fraction of training windows is kept without replacement (by hash); weights are
    recomputed after sampling.
    """
    params = norm_params(df.where(train), columns)
    scaled = normalize(df.withColumn("is_train", train), params, columns, method)
    parts = [
        full_history(scaled, columns, h, keys, ts).withColumn("history", F.lit(h)) for h in lengths
    ]
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    if fraction is not None:
        share = F.pmod(F.xxhash64(*keys, ts, "history", F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0
        every = every.where(~F.col("is_train") | (share < fraction))
    counts = every.groupBy("history", "is_train", "pump_id").agg((F.lit(1.0) / F.count(F.lit(1))).alias("weight"))
    return every.join(counts, ["history", "is_train", "pump_id"])
