"""As-of joins without a nested loop.

Both sides are put in one time-ordered stream and the right value is carried along
it. The tolerance bounds how far a match can lie, so time is cut into slots at
least as wide as the tolerance and only right rows near a slot edge are copied into
the neighbour slot. Windows run per (keys, slot): a key that holds a third of all
rows is spread over its slots.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    tolerance_seconds: float,
    ts: str = "ts",
    direction: str = "nearest",
    matched_ts: str | None = None,
    slot_seconds: float | None = None,
) -> DataFrame:
    """Keep every left row; add ``values`` of the matching right row.

    ``nearest`` takes the closer neighbour and on a tie the earlier one;
    ``backward`` takes the last right row at or before the left row. Several right
    rows at one time count as their first (smallest) row.
    """
    if direction not in ("nearest", "backward"):
        raise ValueError("direction must be 'nearest' or 'backward'")
    keys, values = list(keys), list(values)
    width = int(max(slot_seconds or 4 * tolerance_seconds, tolerance_seconds, 60.0) * 1e6)
    reach = int(tolerance_seconds * 1e6)
    left_columns = left.columns

    micros = F.unix_micros(F.col(ts))
    lhs = left.select(
        "*", micros.alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(_value_type(right, values)).alias("_r")
    ).withColumn("_slot", F.floor(F.col("_t") / width))
    rhs = (
        right.where(F.col(ts).isNotNull())
        .groupBy(*keys, ts)
        .agg(F.min(F.struct(*values)).alias("_v"))
        .select(*keys, micros.alias("_t"), F.struct(micros.alias("t"), F.col("_v").alias("v")).alias("_r"))
    )
    # The slots whose left rows can reach this right row.
    low, high = F.floor((F.col("_t") - reach) / width), F.floor((F.col("_t") + reach) / width)
    rhs = rhs.withColumn("_slot", F.explode(F.sequence(low, high))).withColumn("_side", F.lit(0))

    both = lhs.unionByName(rhs, allowMissingColumns=True)
    # Right rows come first at equal times, so an exact match is seen from both sides.
    before = Window.partitionBy(*keys, "_slot").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_prev", F.last("_r", ignorenulls=True).over(before))
    gap_before = F.col("_t") - F.col("_prev.t")
    if direction == "backward":
        chosen = F.when(gap_before <= reach, F.col("_prev"))
    else:
        after = (
            Window.partitionBy(*keys, "_slot")
            .orderBy(F.col("_t").desc(), "_side")
            .rowsBetween(Window.unboundedPreceding, 0)
        )
        out = out.withColumn("_next", F.last("_r", ignorenulls=True).over(after))
        gap_after = F.col("_next.t") - F.col("_t")
        earlier = (gap_before <= reach) & (gap_after.isNull() | (gap_before <= gap_after))
        chosen = F.when(earlier, F.col("_prev")).when(gap_after <= reach, F.col("_next"))
    out = out.where(F.col("_side") == 1).withColumn("_hit", chosen)
    added = [F.col(f"_hit.v.{name}").alias(name) for name in values]
    if matched_ts:
        added.append(F.timestamp_micros(F.col("_hit.t")).alias(matched_ts))
    return out.select(*left_columns, *added)


def _value_type(right: DataFrame, values: list[str]) -> str:
    inner = ",".join(f"`{name}`:{right.schema[name].dataType.simpleString()}" for name in values)
    return f"struct<t:bigint,v:struct<{inner}>>"
