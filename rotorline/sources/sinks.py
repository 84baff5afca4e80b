"""Sinks: partitioned readings, annotations, manifests, thresholds, reports, score caches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotorline.config import SEASON_MONTHS
from rotorline.functions.series import SEG
from rotorline.operators.annotation import ANNOTATION


def write_days(df: DataFrame, path: str, by: Sequence[str] = ("date",), fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Readings split by day, ordered by (date, pump, time) inside.

    The range partitioning ends on time, so a machine-day with a third of all rows is spread over files; the
    order makes file statistics select a machine. ``by=("pump_id", "date")`` gives one folder per machine-day,
    which suits small fleets only: a large one would need millions of folders.
    """
    order = [*SEG[::-1], "ts"]
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed.write.partitionBy(*by).mode(mode).format(fmt).save(path)


def annotation_table(annotations: DataFrame) -> DataFrame:
    """String form of the reasons and the fixed order (date, pump, start)."""
    text = annotations.withColumn("reasons", F.array_join("reasons", ";"))
    return text.select(*ANNOTATION).orderBy("date", "pump_id", "period_start")


def write_annotations(annotations: DataFrame, path: str) -> None:
    """CSV with header; an empty result still writes the header."""
    annotation_table(annotations).write.mode("overwrite").option("header", "true").csv(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.orderBy("date", "pump_id").write.mode("overwrite").option("header", "true").csv(path)


def publish_thresholds(level1: DataFrame, level2: DataFrame, path: str, version: str) -> list[str]:
    """Versioned Parquet of both levels; every season must be present in both, else nothing is written."""
    missing = set()
    for df in (level1, level2):
        present = {r[0] for r in df.select("scope_season").distinct().limit(len(SEASON_MONTHS) + 2).collect()}
        missing |= set(SEASON_MONTHS) - present
    if missing:
        raise ValueError(f"thresholds lack seasons: {sorted(missing)}")
    targets = []
    for name, df in (("level1", level1), ("level2", level2)):
        target = f"{path}/version={version}/{name}"
        df.write.mode("errorifexists").parquet(target)
        targets.append(target)
    return targets


def nested_report(days: DataFrame, windows: DataFrame | None = None, steps: DataFrame | None = None) -> DataFrame:
    """One JSON document per pump-day; window and step lists only when given."""
    out = days
    for name, detail in (("windows", windows), ("steps", steps)):
        if detail is not None:
            rest = [c for c in detail.columns if c not in SEG]
            grouped = detail.groupBy(*SEG).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(name))
            out = out.join(grouped, list(SEG), "left")
    body = F.struct(*[c for c in out.columns if c not in SEG])
    return out.select(*SEG, F.to_json(body).alias("report"))


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def prediction_rows(df: DataFrame, channels: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Long export: actual, predicted and error per key and channel."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("channel"), F.col(c).alias("actual"), F.col(f"pred_{c}").alias("predicted")) for c in channels
    ])
    return df.select(*keys, F.explode(cells).alias("_c")).select(*keys, "_c.*")


def prediction_errors(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per-channel MSE and the mean over channels (channel NULL)."""
    gap = F.col("actual") - F.col("predicted")
    per = rows.groupBy(*by, "channel").agg(F.avg(gap * gap).alias("mse"))
    mean = per.groupBy(*by).agg(F.avg("mse").alias("mse")).withColumn("channel", F.lit(None).cast("string"))
    return per.unionByName(mean)


def cached(spark: SparkSession, path: str, run_id: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """Scores stored under ``path/run=<id>`` are read back; otherwise computed and stored there first."""
    target = f"{path}/run={run_id}"
    try:
        return spark.read.parquet(target)
    except AnalysisException:
        compute().write.mode("errorifexists").parquet(target)
        return spark.read.parquet(target)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)
