"""Window building blocks for ordered segments.

A segment is one pump-day. Readings sit on a time grid of at least one second
inside it (``rotorline.operators.quality.first_per_timestamp``), so a segment
holds 86 400 rows at most however many raw rows one pump has. Every helper here
partitions by the segment keys, so a chain of them needs a single exchange.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SEG = ("pump_id", "date")
TS = "ts"


def ordered(keys: Sequence[str] = SEG, ts: str = TS) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(ts)


def backwards(keys: Sequence[str] = SEG, ts: str = TS) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(F.col(ts).desc())


def whole(keys: Sequence[str] = SEG) -> WindowSpec:
    return Window.partitionBy(*keys)


def so_far(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def last_rows(window: WindowSpec, n: int) -> WindowSpec:
    return window.rowsBetween(-(n - 1), Window.currentRow)


def seconds(ts: str | Column) -> Column:
    """Epoch seconds with fraction."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(column) / F.lit(1e6)


def plus_seconds(ts: Column, amount: Column | float) -> Column:
    amount = amount if isinstance(amount, Column) else F.lit(float(amount))
    return F.timestamp_micros(F.unix_micros(ts) + (amount * 1e6).cast("long"))


def gap_seconds(keys: Sequence[str] = SEG, ts: str = TS) -> Column:
    """Seconds since the previous row of the segment."""
    return seconds(ts) - seconds(F.lag(ts).over(ordered(keys, ts)))


def runs(df: DataFrame, flags: dict[str, Column], keys: Sequence[str] = SEG, ts: str = TS) -> DataFrame:
    """Maximal runs of true flags, for any number of flags at once.

    For each name adds ``<name>`` (never null), ``<name>_run`` (the position of
    the break before the run, constant inside it), ``<name>_pos`` (1-based place
    in the run) and ``<name>_len``. Costs one ascending and one descending sort
    for all flags together; no per-run partitioning.
    """
    asc, desc = so_far(ordered(keys, ts)), so_far(backwards(keys, ts))
    out = df.withColumn("_rn", F.row_number().over(ordered(keys, ts)))
    out = out.withColumn("_n", F.count(F.lit(1)).over(whole(keys)))
    out = out.withColumns({name: F.coalesce(flag, F.lit(False)) for name, flag in flags.items()})

    def breaks(name: str) -> Column:
        return F.when(~F.col(name), F.col("_rn"))

    out = out.withColumns({
        f"{name}_run": F.coalesce(F.last(breaks(name), ignorenulls=True).over(asc), F.lit(0)) for name in flags
    })
    out = out.withColumns({
        f"_{name}_next": F.coalesce(F.last(breaks(name), ignorenulls=True).over(desc), F.col("_n") + 1)
        for name in flags
    })
    extra = {}
    for name in flags:
        extra[f"{name}_pos"] = F.when(F.col(name), F.col("_rn") - F.col(f"{name}_run"))
        extra[f"{name}_len"] = F.when(F.col(name), F.col(f"_{name}_next") - F.col(f"{name}_run") - 1)
    return out.withColumns(extra).drop("_n", *[f"_{name}_next" for name in flags])


def affine_prefix(df: DataFrame, keys: Sequence[str], order: str, rounds: int, mul: str = "_mul", add: str = "_add") -> DataFrame:
    """Replaces the maps x -> mul*x + add by the compositions of all maps of the group up to each row.

    Doubling: after round j a row holds the composition of the last 2**j maps, so ``rounds`` of them suffice for
    2**rounds rows a group. All rounds share one sort; factors that underflow are zeros, which is right.
    """
    w = ordered(keys, order)
    for j in range(rounds):
        before = F.coalesce(F.lag(add, 2**j).over(w), F.lit(0.0))
        df = df.withColumns({
            add: F.col(add) + F.col(mul) * before, mul: F.col(mul) * F.coalesce(F.lag(mul, 2**j).over(w), F.lit(1.0)),
        })
    return df


# --- Fixed values -----------------------------------------------------------
DAY_ROWS = 86_400  # a segment's readings are at least a second apart
DAYS = 1 << 16  # of one pump
# ---------------------------------------------------------------------------


def ema(
    df: DataFrame,
    value: str,
    out: str,
    keys: Sequence[str] = SEG,
    ts: str = TS,
    alpha: float = 0.3,
    seed: Column | None = None,
    block_rows: int | None = None,
    long_series: bool = False,
) -> DataFrame:
    """Exponential moving average ``e[t] = alpha*x[t] + (1-alpha)*e[t-1]``.

    ``seed`` replaces the first value of the series (``None`` keeps it). A row is an affine map of the state before it,
    and maps compose. Inside a block the composition is a scaled running sum; a block is as long as the decay allows
    before its powers leave double precision. The blocks of a day compose by ``affine_prefix``; with ``long_series`` the
    group is a whole pump and its days compose the same way, so no task ever holds more than a day's rows, a day's
    blocks or a pump's days, and no list is collected.
    """
    decay = 1.0 - alpha
    first = seed if seed is not None else F.col(value)
    if decay <= 0.0:
        return df.withColumn(out, F.when(F.row_number().over(ordered(keys, ts)) == 1, first).otherwise(F.col(value)).cast("double"))
    if block_rows is None:
        block_rows = DAY_ROWS if decay >= 1.0 else max(1, min(DAY_ROWS, int(600 / -math.log(decay))))
    day_keys = [*keys, "date"] if long_series and "date" not in keys else list(keys)
    inner = [*day_keys, "_block"]
    scan = df.withColumn("_pos", F.row_number().over(ordered(day_keys, ts)) - 1)
    scan = scan.withColumn("_block", (F.col("_pos") / block_rows).cast("int"))
    place = F.col("_pos") % block_rows
    scan = scan.withColumn("_scaled", F.col(value) * alpha * F.pow(F.lit(1.0 / decay), place)).withColumns({
        "_local": F.sum("_scaled").over(so_far(ordered(inner, ts))) * F.pow(F.lit(decay), place), "_reach": F.pow(F.lit(decay), place + 1),
    })
    # The state before the first row that makes the first result what it must be.
    origin = F.coalesce((first - F.col(value) * alpha) / decay, F.lit(0.0))
    ends = scan.groupBy(*inner).agg(
        F.max_by("_local", "_pos").alias("_add"), F.max_by("_reach", "_pos").alias("_mul"), F.min_by(origin.cast("double"), "_pos").alias("_origin"))
    ends = affine_prefix(ends, day_keys, "_block", math.ceil(math.log2(DAY_ROWS / block_rows + 1)))
    w = ordered(day_keys, "_block")
    if day_keys != list(keys):
        days = ends.groupBy(*day_keys).agg(*[F.max_by(c, "_block").alias(c) for c in ("_add", "_mul")], F.min_by("_origin", "_block").alias("_origin"))
        days = affine_prefix(days, keys, "date", int(math.log2(DAYS)))
        d = ordered(keys, "date")
        before = F.lag("_mul").over(d) * F.first("_origin").over(d) + F.lag("_add").over(d)
        ends = ends.drop("_origin").join(days.select(*day_keys, F.coalesce(before, F.col("_origin")).alias("_origin")), day_keys)
    start = F.first("_origin").over(w)
    carry = ends.select(*inner, F.coalesce(F.lag("_mul").over(w) * start + F.lag("_add").over(w), start).alias("_carry"))
    result = F.col("_local") + F.col("_reach") * F.col("_carry")
    return scan.join(carry, inner).withColumn(out, result).drop("_pos", "_block", "_scaled", "_local", "_reach", "_carry")
