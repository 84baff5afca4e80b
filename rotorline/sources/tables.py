"""Relational sources: long measurements, packed days, sensor definitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rotorline.operators.quality import bucket_start

# --- Fixed values -----------------------------------------------------------
BUCKET_SECONDS = 300
DEFAULT_TIMESTEP = 60
# Sensor names start with this and the machine number.
SENSOR_PREFIX = "Main HTF Pump"
# ---------------------------------------------------------------------------


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str, low: str, high: str, parts: int,
              properties: dict[str, str] | None = None) -> DataFrame:
    """A partitioned read; filters and columns are pushed to the database by Spark."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=partition_column,
                                               lowerBound=low, upperBound=high, numPartitions=str(parts))
    return reader.options(**(properties or {})).load()


def pivot_measurements(long: DataFrame, sensors: dict[str, str], start: str | None = None, end: str | None = None,
                       keys: Sequence[str] = ("pump_id",), bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """(sensor, ts, value) to one row per bucket with the mean per sensor.

    ``sensors`` maps source name to column. The sensor set and the half-open time range reach the scan, and
    the conditional means combine map-side: one shuffle of one row per bucket and task.
    """
    rows = long.where(F.col("sensor").isin(*sensors))
    if start:
        rows = rows.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end:
        rows = rows.where(F.col("ts") < F.lit(end).cast("timestamp"))
    grouped = rows.groupBy(*keys, bucket_start("ts", bucket_seconds).alias("ts"))
    return grouped.agg(*[F.avg(F.when(F.col("sensor") == s, F.col("value"))).alias(c) for s, c in sensors.items()])


def running_only(long: DataFrame, speed_sensor: str, keys: Sequence[str] = ("pump_id",),
                 bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Measurements of buckets in which the speed sensor had any value above 0."""
    tagged = long.withColumn("bucket", bucket_start("ts", bucket_seconds))
    alive = tagged.where((F.col("sensor") == speed_sensor) & (F.col("value") > 0)).select(*keys, "bucket").distinct()
    return tagged.join(alive, [*keys, "bucket"], "left_semi")


def unpack_days(packed: DataFrame, keys: Sequence[str] = ("pump_id",), start: Column | None = None,
                end: Column | None = None, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """(date, timestep, value[]) to bucket means: element i lies at ``date + i*timestep``; empty buckets are
    dropped; the first row of a repeated (key, date) wins; the range is half open."""
    first = packed.groupBy(*keys, "date").agg(F.min(F.struct("arrival", "timestep", "value")).alias("_d"))
    cells = first.select(*keys, "date", F.col("_d.timestep").alias("timestep"), F.posexplode("_d.value").alias("i", "value"))
    at = F.timestamp_micros(F.unix_micros(F.col("date").cast("timestamp")) + F.col("i").cast("long") * F.col("timestep") * 1_000_000)
    rows = cells.withColumn("ts", at)
    if start is not None:
        rows = rows.where(F.col("ts") >= start)
    if end is not None:
        rows = rows.where(F.col("ts") < end)
    return rows.groupBy(*keys, bucket_start("ts", bucket_seconds).alias("ts")).agg(F.avg("value").alias("value")).where(
        F.col("value").isNotNull()
    )


def generic_name(name: Column, number: Column | str, prefix: str = SENSOR_PREFIX) -> Column:
    """Pump-specific sensor name to the generic one: the pump number inside it is dropped; others pass through."""
    number = F.lit(number) if isinstance(number, str) else number
    return F.regexp_replace(name, F.concat(F.lit(f"^({prefix}) "), number, F.lit(" ")), F.lit("$1 "))


def map_names(df: DataFrame, mapping: DataFrame, name: str = "sensor") -> DataFrame:
    """Lookup join: (name, generic); names without an entry stay."""
    out = df.join(mapping.withColumnRenamed("name", name), name, "left")
    return out.withColumn("generic", F.coalesce("generic", name))


def time_range(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def sensor_definitions(raw: DataFrame, excluded: DataFrame, prefix: str, order: str = "row_no") -> DataFrame:
    """Cleaned definitions: ids stripped and lowered, excluded ids left out, generic column by prefix strip,
    repeated columns of one equipment suffixed `` (2)``, `` (3)`` in source order, checks defaulting to false."""
    ident = F.lower(F.trim("sensor_id"))
    rows = raw.withColumn("sensor_id", ident).join(excluded.select(F.lower(F.trim("sensor_id")).alias("sensor_id")), "sensor_id", "left_anti")
    rows = rows.withColumn("column", F.regexp_replace(F.trim("name"), prefix, ""))
    nth = F.row_number().over(Window.partitionBy("equipment_id", "column").orderBy(order))
    rows = rows.withColumn("_nth", nth)
    suffix = F.when(F.col("_nth") > 1, F.concat(F.lit(" ("), F.col("_nth").cast("string"), F.lit(")"))).otherwise("")
    return rows.withColumns({
        "column": F.concat("column", suffix),
        "timestep": F.coalesce("timestep", F.lit(DEFAULT_TIMESTEP)),
        "check_constant": F.coalesce("check_constant", F.lit(False)),
        "check_falldown": F.coalesce("check_falldown", F.lit(False)),
    }).drop("_nth")


def override_definitions(local: DataFrame, table: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Non-null fields of a second table win."""
    other = table.select("sensor_id", *[F.col(c).alias(f"_o_{c}") for c in fields])
    out = local.join(other, "sensor_id", "left")
    return out.withColumns({c: F.coalesce(f"_o_{c}", c) for c in fields}).drop(*[f"_o_{c}" for c in fields])


def default_limits(sensors: DataFrame, catalogue: Sequence[dict]) -> DataFrame:
    """First catalogue key contained in the column name (any case) fills missing limits and false checks.

    The catalogue is a short ordered list, so it is a CASE expression, not a join.
    """
    lowered = F.lower("column")

    def pick(field: str) -> Column:
        expr = F.lit(None)
        for i, entry in enumerate(catalogue):
            value = F.lit(entry.get(field))
            test = F.contains(lowered, F.lit(entry["key"].lower()))
            expr = F.when(test, value) if i == 0 else expr.when(test, value)
        return expr

    return sensors.withColumns({
        "min_value": F.coalesce(F.col("min_value"), pick("min_value").cast("double")),
        "max_value": F.coalesce(F.col("max_value"), pick("max_value").cast("double")),
        "check_constant": F.when(F.col("check_constant"), True).otherwise(F.coalesce(pick("check_constant").cast("boolean"), F.lit(False))),
        "check_falldown": F.when(F.col("check_falldown"), True).otherwise(F.coalesce(pick("check_falldown").cast("boolean"), F.lit(False))),
    })


def canonical_order(columns: Sequence[str], sensors: Sequence[str], first: Sequence[str] = ("ts",)) -> list[str]:
    """value, value_quality pairs in sensor order; every other column appended."""
    wanted = list(first)
    for s in sensors:
        wanted += [c for c in (s, f"{s}_quality") if c in columns]
    return wanted + [c for c in columns if c not in wanted]


def missing_sensors(measured: DataFrame, configured: DataFrame) -> DataFrame:
    """Configured sensors without data, per pump and day on which the pump reported anything.

    ``configured``: (pump_id, sensor).
    """
    days = measured.select("pump_id", "date").distinct()
    found = measured.where(F.col("value").isNotNull()).select("pump_id", "date", "sensor").distinct()
    return days.join(configured, "pump_id").join(found, ["pump_id", "date", "sensor"], "left_anti")


def align_sensors(long: DataFrame, sensors: Sequence[str], keys: Sequence[str] = ("pump_id", "ts")) -> DataFrame:
    """Per-sensor series side by side by timestamp (outer alignment) as one aggregate."""
    return long.groupBy(*keys).agg(*[F.max(F.when(F.col("sensor") == s, F.col("value"))).alias(s) for s in sensors])
