"""Stream forms of the batch operators: resampling, deduplication, sessions, day roll-up."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rotorline.session import shared_folder

LATE = "10 minutes"


def scratch(spark: SparkSession) -> str:
    """A fresh folder below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4()}"


def read_table_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """One table file of a folder as a stream; the schema comes from the file, not from inference over data."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def run_available(stream: DataFrame, mode: str = "append", base: str | None = None) -> DataFrame:
    """Process what is there into Parquet and read it back; with the ``base`` of an earlier run, go on from where it stopped."""
    spark = stream.sparkSession
    base = base or scratch(spark)
    job = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    )
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def resample_stream(rows: DataFrame, rules: dict[str, Column], bucket: str = "5 minutes", late: str = LATE) -> DataFrame:
    """Tumbling buckets per pump; rows later than the watermark are dropped."""
    grouped = rows.withWatermark("ts", late).groupBy("pump_id", F.window("ts", bucket).alias("_w"))
    return grouped.agg(*[how.alias(name) for name, how in rules.items()]).select(
        "pump_id", F.col("_w.start").alias("ts"), *rules
    )


def distinct_stream(rows: DataFrame, keys: Sequence[str], late: str = LATE) -> DataFrame:
    """First arrival per key inside the watermark."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def operation_sessions(on_rows: DataFrame, gap: str, min_seconds: float = 0.0, late: str = LATE) -> DataFrame:
    """Gap-merged ON periods per pump, filtered by duration once closed."""
    grouped = on_rows.withWatermark("ts", late).groupBy("pump_id", F.session_window("ts", gap).alias("_s"))
    out = grouped.agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("n_rows"))
    seconds = (F.unix_micros("end") - F.unix_micros("start")) / 1e6
    return out.where(seconds >= min_seconds).select("pump_id", "start", "end", "n_rows")


def day_rollup(steps: DataFrame, late: str = LATE) -> DataFrame:
    """Day scores that feed the drift log."""
    grouped = steps.withWatermark("ts", late).groupBy("pump_id", F.window("ts", "1 day").alias("_w"))
    return grouped.agg(F.avg("l1").alias("l1_mean"), F.avg("l2").alias("l2_mean"), F.count(F.lit(1)).alias("n_steps")).select(
        "pump_id", F.col("_w.start").cast("date").alias("date"), "l1_mean", "l2_mean", "n_steps"
    )


def append_day_log(stream: DataFrame, path: str, checkpoint: str):
    """Append closed days to the log table."""
    return (
        stream.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
