"""Registered queries: what is written and read back, and the extension points."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotorline.config import ResampleRule
from rotorline.operators import calibration as K
from rotorline.operators import monitoring as M
from rotorline.operators import quality
from rotorline.operators.scoring import score_with
from rotorline.plans import catalog_evaluation as CE
from rotorline.plans import catalog_scoring as CS
from rotorline.plans import sql as S
from rotorline.plans import views as V
from rotorline.plans.registry import query, shape
from rotorline.session import materialize
from rotorline.sources import sinks
from rotorline.streaming.jobs import scratch

Spark = SparkSession


@query("src_13_split_days", S.with_(("readings",), f"SELECT {S.SEGS}, {S.i('n')}, {S.r('flow')} FROM (SELECT pump_id, date, count(*) AS n, sum(flow) AS flow FROM readings GROUP BY 1, 2)"))
def split_days(spark: Spark, sf: str) -> DataFrame:
    """Readings written by day, ordered by machine and time, and read back."""
    folder = f"{scratch(spark)}/days"
    r = V.readings(spark, sf)
    sinks.write_days(r, folder)
    back = spark.read.schema(r.schema).parquet(folder)
    return shape(back.groupBy("pump_id", "date").agg(F.count(F.lit(1)).alias("n"), F.sum("flow").alias("flow")))


@query("src_16_score_cache", S.with_(("res",), f"SELECT {S.i('pump_id')}, {S.i('2 * n', 'n')}, {S.r('2 * total', 'total')} FROM (SELECT pump_id, count(*) AS n, sum(res_flow) AS total FROM res GROUP BY 1)"))
def score_cache(spark: Spark, sf: str) -> DataFrame:
    """Scores computed and stored on the first call, read on the second."""
    folder = f"{scratch(spark)}/scores"

    def compute() -> DataFrame:
        return V.residual_rows(spark, sf).select("pump_id", "ts", "res_flow")

    first = sinks.cached(spark, folder, "run-1", compute)
    again = sinks.cached(spark, folder, "run-1", compute)
    both = first.unionByName(again)
    return shape(both.groupBy("pump_id").agg(F.count(F.lit(1)).alias("n"), F.sum("res_flow").alias("total")))


@query("snk_03_publish_thresholds", S.with_(("blocks4",), f"SELECT level, scope_season, {S.i('scope_pump')}, {S.r('warning')}, {S.r('alarm')} FROM blocks4, (SELECT unnest(['level1', 'level2']) AS level)"))
def publish_thresholds(spark: Spark, sf: str) -> DataFrame:
    """Versioned publication of both levels; every season must be there."""
    blocks = CS.l1_blocks(V.residual_rows(spark, sf), seasonal=True).select(*K.SCOPE, "warning", "alarm", "mean", "fallback")
    paths = sinks.publish_thresholds(blocks, blocks, f"{scratch(spark)}/thresholds", "v1")
    parts = [spark.read.parquet(p).withColumn("level", F.lit(p.rsplit("/", 1)[1])) for p in paths]
    return shape(parts[0].unionByName(parts[1]), ["level", "scope_season", "scope_pump", "warning", "alarm"])


@query("mon_07_recalibration_history", S.with_(("log",), f"""SELECT {S.SEGS}, reason, {S.i('is_last::INT', 'is_last')} FROM (SELECT pump_id, date, 'drift_alert' AS reason, date = max(date) OVER (PARTITION BY pump_id) AS is_last FROM log WHERE l1_mean > 4.5)"""))
def recalibration_history(spark: Spark, sf: str) -> DataFrame:
    """Two appends of recalibration records, read back with the newest one marked."""
    folder = f"{scratch(spark)}/history"
    due = materialize(CE.log(spark, sf).where(F.col("l1_mean") > 4.5).select(
        "pump_id", "date", F.lit("drift_alert").alias("reason"), F.lit(True).alias("applied")))
    early = F.dayofmonth("date") <= 15
    M.record_recalibration(due.where(early), folder)
    M.record_recalibration(due.where(~early), folder)
    return shape(M.recalibration_history(spark, folder), ["pump_id", "date", "reason", "is_last"])


@query("ext_02_plugin_scorer", S.with_(("readings",), f"SELECT {S.STEPS}, {S.r('(flow - 45.0::DOUBLE) * (flow - 45.0::DOUBLE)', 'score')} FROM readings WHERE flow IS NOT NULL"))
def plugin_scorer(spark: Spark, sf: str) -> DataFrame:
    """Any batch scorer in the model slot."""
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(score=(pdf["flow"] - 45.0) ** 2)[["pump_id", "date", "ts", "score"]]

    rows = V.readings(spark, sf).where("flow IS NOT NULL").select("pump_id", "date", "ts", "flow")
    return shape(score_with(rows, score, "pump_id int, date date, ts timestamp, score double"))


@query("ext_03_configured_resample", S.with_(("readings",), f"""SELECT {S.i('pump_id')}, {S.d()}, {S.t('b', 'ts')}, {S.rs(['speed', 'flow', 'outlet_pressure', 'motor_current'])} FROM (
  SELECT pump_id, date, time_bucket(INTERVAL 12 HOUR, ts) AS b, median(speed) AS speed, arg_max(flow, ts) FILTER (flow IS NOT NULL) AS flow, stddev_samp(outlet_pressure) AS outlet_pressure, sum(motor_current) AS motor_current
  FROM readings GROUP BY 1, 2, 3)"""))
def configured_resample(spark: Spark, sf: str) -> DataFrame:
    """Aggregations by name; unknown names are refused by the configuration."""
    rules = {"speed": "median", "flow": "last", "outlet_pressure": "std", "motor_current": "sum"}
    for name in rules.values():
        ResampleRule(12 * 3600, name)
    out = quality.resample(V.readings(spark, sf), rules, 12 * 3600, empty_buckets=False)
    return shape(out, ["pump_id", "date", "ts", *rules])
