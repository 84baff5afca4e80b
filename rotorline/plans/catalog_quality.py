"""Registered queries: quality, periods, baseline, detectors, annotation."""

from __future__ import annotations

import os
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rotorline.config import load_config
from rotorline.operators import annotation, detectors, monitoring, periods, quality
from rotorline.plans import sql as S
from rotorline.plans import views as V
from rotorline.plans.catalog_sources import annotations
from rotorline.plans.registry import query, shape
from rotorline.session import materialize
from rotorline.sources import sinks, tables

Spark = SparkSession
SENTINEL = replace(V.QUALITY, sentinel_value=0.0, sentinel_column_threshold=1)
QC = [f"{c}_quality" for c in S.CH]


@query("cln_01_first_per_timestamp", S.with_(("raw",), f"""SELECT {S.i('pump_id')}, {S.t()}, sensor, {S.r('value')} FROM (
  SELECT pump_id, date_trunc('minute', ts) AS ts, sensor, value, row_number() OVER (PARTITION BY pump_id, date_trunc('minute', ts) ORDER BY event_id) AS k FROM raw) WHERE k = 1"""))
def first_per_timestamp(spark: Spark, sf: str) -> DataFrame:
    rows = V.raw(spark, sf).withColumn("ts", F.date_trunc("minute", "ts"))
    return shape(quality.first_per_timestamp(rows, "event_id"), ["pump_id", "ts", "sensor", "value"])


@query("cln_02_gap_fill", S.with_(("filled_grid",), f"SELECT {S.STEPS}, {S.i('inserted')}, {S.r('speed')}, {S.r('flow')} FROM filled_grid"))
def gap_fill(spark: Spark, sf: str) -> DataFrame:
    return shape(quality.fill_gaps(V.sparse(spark, sf), V.STEP), ["pump_id", "date", "ts", "inserted", "speed", "flow"])


def labelled(spark: Spark, sf: str) -> DataFrame:
    return quality.label(V.sparse(spark, sf), V.QUALITY)


@query("cln_03_quality_codes", S.with_(("labelled",), f"SELECT {S.STEPS}, {S.i('inserted')}, {S.rs(S.CH)}, {S.ins(QC)} FROM labelled"))
def quality_codes(spark: Spark, sf: str) -> DataFrame:
    return shape(labelled(spark, sf), ["pump_id", "date", "ts", "inserted", *S.CH, *QC])


@query("cln_04_out_of_range", S.with_(("readings",), f"SELECT {S.i('pump_id')}, {S.i('n_bad')} FROM (SELECT pump_id, count(*) FILTER (flow < 0 OR flow > 120) AS n_bad FROM readings GROUP BY 1)"))
def out_of_range(spark: Spark, sf: str) -> DataFrame:
    bad = quality.out_of_range(F.col("flow"), V.QUALITY.sensors["flow"])
    return shape(V.readings(spark, sf).groupBy("pump_id").agg(F.count(F.when(bad, 1)).alias("n_bad")))


@query("cln_05_fall_down", S.with_(("readings",), f"""SELECT {S.STEPS}, {S.i('fall')} FROM (SELECT *, coalesce(count(flow) OVER x >= 2 AND stddev_samp(flow) OVER x / 120.0 > 0.15, false) AS fall
  FROM readings WINDOW x AS ({S.SEGW} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))"""))
def fall_down(spark: Spark, sf: str) -> DataFrame:
    from rotorline.functions.series import last_rows, ordered

    test = quality.fall_down(F.col("flow"), V.QUALITY.sensors["flow"], 0.15, last_rows(ordered(), 4), 2)
    return shape(V.readings(spark, sf).select("pump_id", "date", "ts", F.coalesce(test, F.lit(False)).alias("fall")))


@query("cln_06_frozen_runs", S.with_(("breaks",), f"""SELECT {S.STEPS}, {S.i('run_length')} FROM (
  SELECT *, count(*) FILTER (WHERE st_outlet_pressure) OVER (PARTITION BY pump_id, date, br_outlet_pressure) AS run_length FROM breaks) WHERE st_outlet_pressure"""))
def frozen_runs(spark: Spark, sf: str) -> DataFrame:
    from rotorline.functions.series import ordered, runs

    grid = quality.fill_gaps(V.sparse(spark, sf), V.STEP)
    still = F.abs(F.col("outlet_pressure") - F.lag("outlet_pressure").over(ordered())) < 8.0
    marked = runs(grid, {"still": still}).where("still")
    return shape(marked.select("pump_id", "date", "ts", F.col("still_len").alias("run_length")))


@query("cln_07_time_fall_down", S.with_(("breaks", ), f"SELECT {S.STEPS}, {S.ins(QC)} FROM (" + S.code_sql(
    f"{S.SEGW} RANGE BETWEEN INTERVAL 21599 SECOND PRECEDING AND CURRENT ROW") + ")"))
def time_fall_down(spark: Spark, sf: str) -> DataFrame:
    return shape(quality.label_by_time(V.sparse(spark, sf), V.QUALITY, 2 * V.STEP), ["pump_id", "date", "ts", *QC])


@query("cln_08_label_all", S.with_(("breaks",), f"SELECT {S.i('pump_id')}, {S.ins(QC)} FROM (SELECT pump_id, " + ", ".join(
    f"count(*) FILTER ({c} = 1) AS {c}" for c in QC) + " FROM (" + S.code_sql(f"{S.SEGW} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW", True) + ") GROUP BY 1)"))
def label_all(spark: Spark, sf: str) -> DataFrame:
    """Gap code on every sensor: the count of missing points per machine and sensor."""
    marked = quality.label(V.sparse(spark, sf), replace(V.QUALITY, missing_code="all"))
    return shape(marked.groupBy("pump_id").agg(*[F.count(F.when(F.col(c) == 1, 1)).alias(c) for c in QC]))


@query("cln_09_sentinel_rows", S.with_(("readings",), f"SELECT {S.i('pump_id')}, {S.i('n')} FROM (SELECT pump_id, count(*) FILTER ((" + " + ".join(
    f"coalesce((abs({c} - 0.0) <= 1e-8)::INT, 0)" for c in S.CH) + ") >= 1) AS n FROM readings GROUP BY 1)"))
def sentinel_rows(spark: Spark, sf: str) -> DataFrame:
    hit = quality.is_sentinel(V.readings(spark, sf), S.CH, 0.0, 1)
    return shape(V.readings(spark, sf).groupBy("pump_id").agg(F.count(F.when(hit, 1)).alias("n")))


@query("cln_10_clean", S.with_(("labelled",), f"SELECT {S.STEPS}, {S.rs(S.CH)} FROM (SELECT pump_id, date, ts, " + ", ".join(
    f"CASE WHEN sen OR {c}_quality IN (3, 4, 5) THEN NULL ELSE {c} END AS {c}" for c in S.CH) + " FROM (SELECT *, (" + " + ".join(
    f"coalesce((abs({c}) <= 1e-8)::INT, 0)" for c in S.CH) + ") >= 1 AS sen FROM labelled))"))
def clean(spark: Spark, sf: str) -> DataFrame:
    return shape(quality.clean(labelled(spark, sf), SENTINEL), ["pump_id", "date", "ts", *S.CH])


def _frozen_sql(empty_counts: bool) -> str:
    ch = ["speed", "outlet_pressure"]
    steps = ", ".join(f"abs({c} - last_value({c} IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS d_{c}" for c in ch)
    moving = " OR ".join(f"(count({c}) > 1 AND coalesce(max(d_{c}) >= 600, false))" for c in ch)
    checked = " OR ".join(f"count({c}) > 1" for c in ch)
    rule = f"NOT ({moving})" + ("" if empty_counts else f" AND ({checked})")
    return S.with_(("readings",), f"SELECT {S.SEGS}, {S.i('is_frozen')} FROM (SELECT pump_id, date, {rule} AS is_frozen FROM (SELECT *, {steps} FROM readings WINDOW w AS ({S.SEGW})) GROUP BY 1, 2)")


@query("cln_11_all_frozen", _frozen_sql(False))
def all_frozen(spark: Spark, sf: str) -> DataFrame:
    return shape(quality.all_frozen(V.readings(spark, sf), ["speed", "outlet_pressure"], 600.0))


@query("cln_12_all_frozen_or_empty", _frozen_sql(True))
def all_frozen_or_empty(spark: Spark, sf: str) -> DataFrame:
    return shape(quality.all_frozen(V.readings(spark, sf), ["speed", "outlet_pressure"], 600.0, empty_counts=True))


@query("cln_13_operational_filter", S.with_(("operated",), f"SELECT {S.STEPS}, {S.rs(S.CH)} FROM operated"))
def operational_filter(spark: Spark, sf: str) -> DataFrame:
    return shape(quality.run_steps(V.sparse(spark, sf), V.QUALITY, ("label", "clean", "filter")), ["pump_id", "date", "ts", *S.CH])


@query("cln_14_operational_runs", S.with_(("operated",), f"""SELECT {S.SEGS}, {S.i('run')}, {S.t('a', 'first_ts')}, {S.i('n')} FROM (
  SELECT pump_id, date, dense_rank() OVER (PARTITION BY pump_id, date ORDER BY br) AS run, a, n FROM (SELECT pump_id, date, br, min(ts) AS a, count(*) AS n FROM operated GROUP BY 1, 2, 3))"""))
def operational_runs(spark: Spark, sf: str) -> DataFrame:
    kept = quality.run_steps(V.sparse(spark, sf), V.QUALITY, ("label", "clean", "filter"))
    return shape(kept.groupBy("pump_id", "date", "run").agg(F.min("ts").alias("first_ts"), F.count(F.lit(1)).alias("n")))


S.cte("six", ("labelled",), "SELECT pump_id, date, time_bucket(INTERVAL 6 HOUR, ts) AS b, " + ", ".join(
    f"avg({c}) AS {c}, max({c}_quality) AS {c}_quality" for c in S.CH) + " FROM labelled GROUP BY 1, 2, 3")


@query("cln_15_resample", S.with_(("six",), f"SELECT {S.SEGS}, {S.t('g', 'ts')}, {S.rs(S.CH)}, {S.ins(QC)} FROM (SELECT s.pump_id, s.date, s.g, {', '.join('six.' + c for c in S.CH + QC)} FROM (" +
    "SELECT pump_id, date, unnest(generate_series(a, z, INTERVAL 6 HOUR)) AS g FROM (SELECT pump_id, date, min(b) AS a, max(b) AS z FROM six GROUP BY 1, 2)) s LEFT JOIN six ON six.pump_id = s.pump_id AND six.b = s.g)"))
def resample(spark: Spark, sf: str) -> DataFrame:
    df = labelled(spark, sf)
    return shape(quality.resample(df, quality.resample_rules(df, V.QUALITY), 2 * V.STEP), ["pump_id", "date", "ts", *S.CH, *QC])


S.cte("seg_stats", ("labelled", "operated", "sparse"), f"""SELECT l.pump_id, l.date, input_rows, inserted_rows, bad_cells,
  CASE WHEN frozen THEN 0 ELSE coalesce(n_out, 0) END AS output_rows, CASE WHEN frozen THEN 'all_frozen' WHEN coalesce(n_out, 0) = 0 THEN 'no_rows_after_steps' END AS skip_reason
  FROM (SELECT pump_id, date, count(*) FILTER (NOT inserted) AS input_rows, count(*) FILTER (inserted) AS inserted_rows, {' + '.join(f'count(*) FILTER ({c}_quality > 0)' for c in S.CH)} AS bad_cells FROM labelled GROUP BY 1, 2) l
  JOIN (SELECT pump_id, date, NOT ({' OR '.join(f'(count({c}) > 1 AND coalesce(max(d_{c}) >= 8.0, false))' for c in S.CH)}) AND ({' OR '.join(f'count({c}) > 1' for c in S.CH)}) AS frozen
    FROM (SELECT *, {', '.join(f'abs({c} - last_value({c} IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS d_{c}' for c in S.CH)} FROM sparse WINDOW w AS ({S.SEGW})) GROUP BY 1, 2) f USING (pump_id, date)
  LEFT JOIN (SELECT pump_id, date, datediff('hour', min(time_bucket(INTERVAL 6 HOUR, ts)), max(time_bucket(INTERVAL 6 HOUR, ts))) // 6 + 1 AS n_out FROM operated GROUP BY 1, 2) o USING (pump_id, date)""")


def _stats(spark: Spark, sf: str) -> DataFrame:
    return quality.segment_statistics(V.sparse(spark, sf), V.QUALITY)


@query("cln_16_step_chain", S.with_(("seg_stats",), f"SELECT {S.SEGS}, {S.ins(['input_rows', 'inserted_rows', 'bad_cells', 'output_rows'])}, skip_reason FROM seg_stats"))
def step_chain(spark: Spark, sf: str) -> DataFrame:
    return shape(_stats(spark, sf), ["pump_id", "date", "input_rows", "inserted_rows", "bad_cells", "output_rows", "skip_reason"])


S.cte("code_counts", ("labelled",), "SELECT sensor, code, count(*) AS n_cells FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS sensor, {c}_quality AS code FROM labelled" for c in S.CH) + ") GROUP BY 1, 2")


@query("cln_17_code_counts", S.with_(("code_counts",), f"SELECT sensor, {S.ins(['code', 'n_cells'])} FROM code_counts"))
def code_counts(spark: Spark, sf: str) -> DataFrame:
    return shape(quality.code_counts(labelled(spark, sf)), ["sensor", "code", "n_cells"])


@query("cln_18_resample_dense", S.with_(("seconds",), f"""SELECT {S.STEPS}, {S.i('n')} FROM (SELECT pump_id, date, CASE WHEN rows_ >= 3 AND med < 1300 THEN time_bucket(INTERVAL 1 HOUR, ts) ELSE ts END AS ts, count(*) AS n
  FROM seconds JOIN (SELECT pump_id, date, count(*) AS rows_, median(gap) AS med FROM (SELECT *, epoch(ts) - epoch(lag(ts) OVER ({S.SEGW})) AS gap FROM seconds) GROUP BY 1, 2) USING (pump_id, date) GROUP BY 1, 2, 3)"""))
def resample_dense(spark: Spark, sf: str) -> DataFrame:
    from rotorline.plans.catalog_sources import _seconds

    rows = _seconds(spark, sf).withColumn("n", F.lit(1))
    return shape(quality.resample_dense(rows, ["n"], 3600, 1300.0, how="count"), ["pump_id", "date", "ts", "n"])


@query("cln_19_stable_span", S.with_(("readings",), f"""SELECT {S.STEPS}, {S.r('speed')} FROM (SELECT *, count(*) FILTER (f) OVER p AS n, min(ts) FILTER (f) OVER p AS a, max(ts) FILTER (f) OVER p AS z
  FROM (SELECT *, coalesce(speed >= 0.5 * max(speed) OVER (PARTITION BY pump_id, date) AND max(speed) OVER (PARTITION BY pump_id, date) > 0, false) AS f FROM readings)
  WINDOW p AS (PARTITION BY pump_id, date)) WHERE n < 3 OR ts BETWEEN a AND z"""))
def stable_span(spark: Spark, sf: str) -> DataFrame:
    return shape(quality.stable_span(V.readings(spark, sf), share=0.5, min_rows=3), ["pump_id", "date", "ts", "speed"])


@query("joi_06_align_sensors", S.with_(("raw",), f"""SELECT {S.i('pump_id')}, {S.t()}, {S.r('click')}, {S.r('view')} FROM (
  SELECT pump_id, ts, max(a.value) AS click, max(b.value) AS view FROM (SELECT pump_id, date_trunc('minute', ts) AS ts, max(value) AS value FROM raw WHERE sensor = 'click' GROUP BY 1, 2) a
  FULL JOIN (SELECT pump_id, date_trunc('minute', ts) AS ts, max(value) AS value FROM raw WHERE sensor = 'view' GROUP BY 1, 2) b USING (pump_id, ts) GROUP BY 1, 2)"""))
def align_sensors(spark: Spark, sf: str) -> DataFrame:
    rows = V.raw(spark, sf).where(F.col("sensor").isin("click", "view")).withColumn("ts", F.date_trunc("minute", "ts"))
    return shape(tables.align_sensors(rows, ["click", "view"]), ["pump_id", "ts", "click", "view"])


# --- periods and baseline ----------------------------------------------------


def _periods(spark: Spark, sf: str) -> DataFrame:
    return periods.detect_periods(V.machine(spark, sf), V.SYSTEM)


@query("per_01_operation_periods", S.with_(("periods",), f"SELECT {S.SEGS}, {S.i('period_id')}, {S.t('s', 'start')}, {S.t('e', '\"end\"')}, {S.r('duration', 'duration_seconds')}, {S.i('n_rows')} FROM periods"))
def operation_periods(spark: Spark, sf: str) -> DataFrame:
    return shape(_periods(spark, sf), ["pump_id", "date", "period_id", "start", "end", "duration_seconds", "n_rows"])


@query("per_02_steady_rows", S.with_(("prow",), f"SELECT {S.STEPS}, {S.i('period_id')}, {S.r('speed')} FROM prow WHERE steady"))
def steady_rows(spark: Spark, sf: str) -> DataFrame:
    rows = periods.period_rows(V.machine(spark, sf), V.SYSTEM).where("steady")
    return shape(rows, ["pump_id", "date", "ts", "period_id", "speed"])


@query("per_03_robust_spread", S.with_(("readings",), f"""SELECT {S.i('pump_id')}, {S.r('median')}, {S.r('robust_std')} FROM (
  SELECT pump_id, max(m) AS median, greatest(1.4826 * median(abs(flow - m)), 0.5) AS robust_std FROM (SELECT pump_id, flow, median(flow) OVER (PARTITION BY pump_id) AS m FROM readings WHERE flow IS NOT NULL) GROUP BY 1)"""))
def robust_spread(spark: Spark, sf: str) -> DataFrame:
    return shape(periods.robust(V.readings(spark, sf).where("flow IS NOT NULL"), ["pump_id"], "flow", 0.5), ["pump_id", "median", "robust_std"])


@query("per_04_off_statistics", S.with_(("offs",), f"SELECT {S.SEGS}, {S.rs(['pressure_off', 'current_off'])} FROM offs"))
def off_statistics(spark: Spark, sf: str) -> DataFrame:
    return shape(periods.off_statistics(features(spark, sf)))


def features(spark: Spark, sf: str) -> DataFrame:
    return periods.period_features(V.machine(spark, sf), V.SYSTEM, V.EXTRA)


@query("per_05_off_variability", S.with_(("feat",), f"SELECT {S.SEGS}, {S.i('period_id')}, {S.i('n_off')}, {S.r('off_std')}, {S.r('ob_mean', 'off_before_mean')} FROM feat WHERE n_off >= 2"))
def off_variability(spark: Spark, sf: str) -> DataFrame:
    return shape(features(spark, sf).where("n_off >= 2"), ["pump_id", "date", "period_id", "n_off", "off_std", "off_before_mean"])


@query("per_06_steady_means", S.with_(("feat",), f"""SELECT {S.SEGS}, {S.i('period_id')}, {S.i('n_steady')}, {S.rs(['mean_speed', 'mean_motor_current', 'mean_outlet_pressure', 'mean_ratio'])},
  {S.r('CASE WHEN n_ob >= 2 THEN mean_outlet_pressure - ob_mean END', 'response')} FROM feat"""))
def steady_means(spark: Spark, sf: str) -> DataFrame:
    response = F.when(F.col("n_off_before") >= 2, F.col("mean_outlet_pressure") - F.col("off_before_mean"))
    return shape(features(spark, sf).withColumn("response", response),
                 ["pump_id", "date", "period_id", "n_steady", "mean_speed", "mean_motor_current", "mean_outlet_pressure", "mean_ratio", "response"])


def _key() -> Column:
    return F.when(F.col("name") == "", F.col("kind")).otherwise(F.concat_ws(":", "kind", "name"))


@query("per_07_channel_baseline", S.with_(("base",), f"SELECT {S.i('pump_id')}, k, {S.rs(['median', 'robust_std', 'q25', 'q95'])}, {S.i('n_obs')} FROM base"))
def channel_baseline(spark: Spark, sf: str) -> DataFrame:
    b = periods.compute_baseline(V.machine(spark, sf), V.SYSTEM, extra=V.EXTRA)
    return shape(b.withColumn("k", _key()), ["pump_id", "k", "median", "robust_std", "q25", "q95", "n_obs"])


def _without(block: str) -> str:
    """The baseline CTE chain over machine rows without the abnormal days."""
    text = S.with_(("base",), block)
    return text.replace("machine AS (\n  SELECT *,", "machine AS (\n  SELECT * FROM (SELECT *,", 1).replace(
        "FROM readings),\non_rows", "FROM readings) WHERE (day(date) + pump_id) % 3 <> 0),\non_rows", 1)


@query("per_08_baseline_without_abnormal", _without(f"SELECT {S.i('pump_id')}, k, {S.rs(['median', 'robust_std'])} FROM base"))
def baseline_without_abnormal(spark: Spark, sf: str) -> DataFrame:
    m = V.machine(spark, sf)
    bad = V.tagged(V.days(m, ())).where(F.col("label") == "abnormal")
    b = periods.refine_baseline(m, V.SYSTEM, bad, min_segments=1)
    return shape(b.withColumn("k", _key()), ["pump_id", "k", "median", "robust_std"])


# --- detectors ---------------------------------------------------------------


def _joined(spark: Spark, sf: str) -> DataFrame:
    f = materialize(features(spark, sf))
    return detectors.with_baseline(f, periods.baseline_wide(periods.baseline_long(f, V.SYSTEM)))


def _sd(key: str, floor: float = 1e-6) -> str:
    return f"greatest(coalesce(s_{S.bn(key)}, {floor}), {floor})"


def _listed(prefix: str, marks: list[str]) -> str:
    items = ", ".join(marks)
    return f"CASE WHEN len(list_filter([{items}], lambda x: x IS NOT NULL)) > 0 THEN '{prefix}' || array_to_string(list_filter([{items}], lambda x: x IS NOT NULL), ',') END"


_T = ["de_bearing_temp", "motor_current", *S.WIND]
_z = {c: f"CASE WHEN wcnt_{c} >= 2 THEN abs((wmean_{c} - m_mean_{c}) / {_sd('mean:' + c, 0.01)}) END" for c in S.WIND}
_OPD = f"""(cnt_outlet_pressure >= 2)"""
_SHIFT = f"""CASE WHEN coalesce(mean_speed > 100 AND m_speed > 100, false) THEN abs(mean_outlet_pressure / (mean_speed * mean_speed) - m_mean_outlet_pressure / (m_speed * m_speed)) > greatest({_sd('mean:outlet_pressure', 0.0)} / (m_speed * m_speed), 1e-9)
  ELSE abs(mean_outlet_pressure - m_mean_outlet_pressure) > greatest({_sd('mean:outlet_pressure', 0.0)}, 0.01) END"""
_VARY = f"""(coalesce(m_var_outlet_pressure > 0 AND (std_outlet_pressure > m_var_outlet_pressure + {_sd('var:outlet_pressure', 0.01)} OR std_outlet_pressure > 2.5 * m_var_outlet_pressure), false) OR std_outlet_pressure > 60.0)"""
_marks = f"[CASE WHEN {_SHIFT} THEN 'outlet_pressure:mean_shift' END, CASE WHEN {_VARY} THEN 'outlet_pressure:variability' END, CASE WHEN cnt_outlet_pressure >= 2 AND std_outlet_pressure < 2.0 THEN 'outlet_pressure:frozen' END]"

DETECTOR_SQL = {
    "speed_stability": f"CASE WHEN cnt_speed >= 2 AND std_speed > greatest({_sd('speed')}, 50.0) THEN 'speed_stability' END",
    "current_anomaly": f"CASE WHEN cnt_motor_current >= 2 AND (abs(mean_motor_current - m_current) > {_sd('current')} OR std_motor_current > {_sd('current')}) THEN 'current_anomaly' END",
    "current_speed_ratio": f"CASE WHEN cnt_ratio >= 2 AND abs(mean_ratio - m_ratio) > 3 * {_sd('ratio')} THEN 'current_speed_ratio' END",
    "pressure_on": f"CASE WHEN cnt_outlet_pressure >= 2 AND abs(mean_outlet_pressure - m_pressure_on) > {_sd('pressure_on')} THEN 'pressure_on' END",
    "pressure_off": f"""CASE WHEN n_ob >= 2 AND abs(ob_mean - m_pressure_off) > {_sd('pressure_off')} AND abs(ob_mean - m_pressure_off) > 10 AND (
      coalesce(n_off >= 2 AND off_std > greatest(m_pressure_off_var + {_sd('pressure_off_var')}, 3.0), false)
      OR coalesce(n_oa >= 2 AND oa_mean - ob_mean > 8.0 AND abs(oa_mean - m_pressure_off) <= 1.5 * {_sd('pressure_off')}, false)
      OR abs(ob_mean - m_pressure_off) > 2 * {_sd('pressure_off')}) THEN 'pressure_off' END""",
    "pressure_off_variability": f"CASE WHEN n_off >= 2 AND off_std > m_pressure_off_var + 3 * {_sd('pressure_off_var')} THEN 'pressure_off_variability' END",
    "pressure_off_extended": f"""CASE WHEN n_ox >= greatest(floor(3600 / interval_s), 2) AND n_oax >= 2 AND oax_mean IS NOT NULL AND abs(ox_mean - m_pressure_off) > 0.5 * {_sd('pressure_off')} AND abs(ox_mean - m_pressure_off) > 4.5 AND (
      (oax_mean - ox_mean > 3.5 AND abs(oax_mean - m_pressure_off) <= 2 * {_sd('pressure_off')}) OR abs(ox_mean - m_pressure_off) > 1.0 * {_sd('pressure_off')}) THEN 'pressure_off_extended' END""",
    "temperatures": _listed("temp_elevated:", [f"CASE WHEN mean_{c} > m_mean_{c} + {_sd('mean:' + c, 0.01)} THEN '{c}' END" for c in _T]),
    "vibration": _listed("vibration:", [m for c in ("de_vibration", "nde_vibration") for m in (
        f"CASE WHEN cnt_{c} >= 2 AND max_{c} > q_vib_max_{c} THEN '{c}_spike' END", f"CASE WHEN cnt_{c} >= 2 AND mean_{c} > m_vib_{c} + {_sd('vib:' + c, 0.005)} THEN '{c}_mean' END")]),
    "off_state_current": f"CASE WHEN n_off >= 2 AND abs(med_off_cur - m_current_off) > {_sd('current_off')} THEN 'off_state_current' END",
    "pressure_response": f"""CASE WHEN n_ob >= 2 AND m_response_slow IS NOT NULL AND (abs(mean_outlet_pressure - ob_mean - m_response_slow) > {_sd('response_slow', 0.5)}
      OR mean_outlet_pressure - ob_mean < -2 * {_sd('pressure_off', 0.5)}) THEN 'pressure_response' END""",
    "temp_absolute_limit": _listed("temp_absolute_limit:", ["CASE WHEN max_de_bearing_temp > 95 THEN 'de_bearing_temp' END", "CASE WHEN max_motor_u_winding_temp_1 > 220 THEN 'motor_u_winding_temp_1' END"]),
    "differential_pressure": "CASE WHEN cnt_head >= 2 AND s_mean_outlet_pressure IS NOT NULL AND std_head > greatest(s_mean_outlet_pressure, 0.5) THEN 'differential_pressure' END",
    "filter_condition": f"CASE WHEN cnt_filter_diff_pressure >= 2 AND mean_filter_diff_pressure > m_mean_filter_diff_pressure + {_sd('mean:filter_diff_pressure', 0.01)} THEN 'filter_condition' END",
    "flow_anomaly": f"CASE WHEN cnt_flow >= 2 AND cnt_fps >= 2 AND m_speed > 100 AND abs(mean_fps - m_mean_flow / m_speed) > greatest({_sd('mean:flow', 0.01)} / m_speed, 1e-6) THEN 'flow_anomaly:flow_speed_ratio' END",
    "frequency_anomaly": f"CASE WHEN cnt_frequency >= 2 AND (mean_frequency < 1.0 OR coalesce(abs(mean_frequency - m_mean_frequency) > {_sd('mean:frequency', 0.01)}, false)) THEN 'frequency_anomaly' END",
    "hydraulic_deficit": f"""CASE WHEN cnt_total_fw_flow >= 2 AND mean_total_fw_flow < m_mean_total_fw_flow - {_sd('mean:total_fw_flow', 0.001)} AND cnt_npsh_pressure >= 2 AND mean_npsh_pressure < m_pressure_on - {_sd('pressure_on', 0.001)}
      AND cnt_filter_diff_pressure >= 2 AND mean_filter_diff_pressure < m_mean_filter_diff_pressure - 1.5 * {_sd('mean:filter_diff_pressure', 0.001)} THEN 'hydraulic_deficit' END""",
    "outlet_pressure": f"CASE WHEN {_OPD} AND len(list_filter({_marks}, lambda x: x IS NOT NULL)) > 0 THEN array_to_string(list_filter({_marks}, lambda x: x IS NOT NULL), ';') END",
    "winding_temp_imbalance": f"""CASE WHEN {' + '.join(f'coalesce(({z} > 1.0)::INT, 0)' for z in _z.values())} BETWEEN 1 AND {' + '.join(f'(({z}) IS NOT NULL)::INT' for z in _z.values())} - 1 THEN
      'winding_temp_imbalance:' || array_to_string(list_filter([{', '.join(f"CASE WHEN {z} > 1.0 THEN 'u_{k + 1}' END" for k, z in enumerate(_z.values()))}], lambda x: x IS NOT NULL), ',') END""",
    "insufficient_data": "CASE WHEN n_steady < CASE WHEN interval_s >= 240 THEN 2 ELSE 10 END THEN 'insufficient_data' END",
}
# The winding names in reasons: 'motor_u_winding_temp_1' -> 'u_1'.
NUMBERS = [
    "speed_stability", "current_anomaly", "current_speed_ratio", "pressure_on", "pressure_off", "pressure_off_variability", "pressure_off_extended",
    "temperatures", "vibration", "off_state_current", "pressure_response", "temp_absolute_limit", "differential_pressure", "filter_condition",
    "flow_anomaly", "frequency_anomaly", "hydraulic_deficit", "outlet_pressure", "winding_temp_imbalance",
]


def _register(number: int, name: str) -> None:
    oracle = S.with_(("fb",), f"SELECT {S.SEGS}, {S.i('period_id')}, reason FROM (SELECT pump_id, date, period_id, {DETECTOR_SQL[name]} AS reason FROM fb)")

    @query(f"det_{number:02d}_{name}", oracle)
    def run(spark: Spark, sf: str) -> DataFrame:
        return shape(detectors.detect(_joined(spark, sf), V.SYSTEM, name))


for _n, _name in enumerate(NUMBERS, start=1):
    _register(_n, _name)


@query("det_21_insufficient_data", S.with_(("fb",), f"SELECT {S.SEGS}, {S.i('period_id')}, {DETECTOR_SQL['insufficient_data']} AS reason FROM fb"))
def insufficient_data(spark: Spark, sf: str) -> DataFrame:
    return shape(_joined(spark, sf).select("pump_id", "date", "period_id", detectors.insufficient_data().alias("reason")))


S.cte("judged", ("fb",), f"""SELECT *, bad AS abnormal FROM (SELECT *, len(all_) > 0 AND (list_contains(list_transform(all_, lambda x: regexp_extract(x, '^[^:;]*')), 'temp_absolute_limit')
  OR len(list_distinct(list_transform(all_, lambda x: regexp_extract(x, '^[^:;]*')))) >= 2) AS bad FROM (
  SELECT *, list_filter([{', '.join(DETECTOR_SQL[n] for n in ('insufficient_data', *V.SYSTEM.detectors))}], lambda x: x IS NOT NULL) AS all_ FROM fb))""")
S.cte("annotations", ("judged",), """SELECT date, pump_id, strftime(s, '%H:%M') AS period_start, strftime(e, '%H:%M') AS period_end, round(duration / 60.0, 1) AS duration_minutes,
  CASE WHEN bad THEN 'abnormal' ELSE 'normal' END AS classification, CASE WHEN bad THEN all_ ELSE CAST([] AS VARCHAR[]) END AS reasons FROM judged""")


@query("det_22_period_class", S.with_(("judged",), f"SELECT {S.SEGS}, {S.i('period_id')}, CASE WHEN bad THEN 'abnormal' ELSE 'normal' END AS classification, CASE WHEN bad THEN array_to_string(all_, ';') ELSE '' END AS reasons FROM judged"))
def period_class(spark: Spark, sf: str) -> DataFrame:
    judged = detectors.classify(_joined(spark, sf), V.SYSTEM).withColumn("reasons", F.array_join("reasons", ";"))
    return shape(judged, ["pump_id", "date", "period_id", "classification", "reasons"])


def _spread_alarm(f: detectors.Features, base: detectors.Baseline, cfg: object) -> Column:
    """A plug-in detector: bearing temperature spread above 20."""
    return F.when(f("std_de_bearing_temp") > 20.0, F.lit("bearing_spread"))


@query("det_23_plugin_detector", S.with_(("fb",), f"SELECT {S.SEGS}, {S.i('period_id')}, CASE WHEN std_de_bearing_temp > 20.0 THEN 'bearing_spread' END AS reason FROM fb"))
def plugin_detector(spark: Spark, sf: str) -> DataFrame:
    detectors.register_detector("bearing_spread", _spread_alarm)
    return shape(detectors.detect(_joined(spark, sf), V.SYSTEM, "bearing_spread"))


_ANN = f"{S.d()}, {S.i('pump_id')}, period_start, period_end, {S.r('duration_minutes')}, classification"


@query("det_24_annotation_run", S.with_(("annotations",), f"SELECT {_ANN} FROM annotations"))
def annotation_run(spark: Spark, sf: str) -> DataFrame:
    return shape(annotations(spark, sf), ["date", "pump_id", "period_start", "period_end", "duration_minutes", "classification"])


SYSTEM_FILE = os.path.join(os.path.dirname(__file__), "machine.yaml")


@query("ext_04_system_file", S.with_(("annotations",), f"SELECT {_ANN} FROM annotations"))
def annotation_by_file(spark: Spark, sf: str) -> DataFrame:
    """The annotation run with everything read from a system file."""
    system, _ = load_config(SYSTEM_FILE)
    found = annotation.annotate(V.machine(spark, sf), system, extra=V.EXTRA)
    return shape(found, ["date", "pump_id", "period_start", "period_end", "duration_minutes", "classification"])


@query("ext_04_quality_file", S.with_(("seg_stats",), f"SELECT {S.SEGS}, {S.ins(['input_rows', 'inserted_rows', 'bad_cells', 'output_rows'])}, skip_reason FROM seg_stats"))
def quality_by_file(spark: Spark, sf: str) -> DataFrame:
    """The step chain with the quality section of a system file."""
    _, rules = load_config(SYSTEM_FILE)
    stats = quality.segment_statistics(V.sparse(spark, sf), rules)
    return shape(stats, ["pump_id", "date", "input_rows", "inserted_rows", "bad_cells", "output_rows", "skip_reason"])


@query("snk_01_annotations", S.with_(("annotations",), f"SELECT {_ANN}, array_to_string(reasons, ';') AS reasons FROM annotations"))
def annotation_sink(spark: Spark, sf: str) -> DataFrame:
    return shape(sinks.annotation_table(annotations(spark, sf)))


@query("det_25_validation", S.with_(("annotations", "tagged"), f"""SELECT {S.d()}, {S.i('pump_id')}, expected, {S.i('coalesce(list_contains(c, expected), false)', 'correct')} FROM (
  SELECT DISTINCT date, pump_id, label AS expected FROM tagged) LEFT JOIN (SELECT date, pump_id, list(DISTINCT classification) AS c FROM annotations GROUP BY 1, 2) USING (date, pump_id)"""))
def validation(spark: Spark, sf: str) -> DataFrame:
    expected = V.days(V.tagged(V.readings(spark, sf))).withColumnRenamed("label", "expected")
    return shape(annotation.validate(annotations(spark, sf), expected), ["date", "pump_id", "expected", "correct"])


# Two annotation runs over orders: status of the first run, priority of the second.
@query("joi_02_changed_to_abnormal", f"""SELECT {S.i('pump_id')}, {S.i('n_changed')} FROM (SELECT o_custkey % 9 AS pump_id, count(*) AS n_changed FROM orders
  WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1)""")
def changed_to_abnormal(spark: Spark, sf: str) -> DataFrame:
    o = V.table(spark, sf, "orders").withColumn("pump_id", F.col("o_custkey") % 9)
    one = o.select("pump_id", "o_orderkey", F.when(F.col("o_orderstatus") == "O", "normal").otherwise("abnormal").alias("c"))
    two = o.select("pump_id", "o_orderkey", F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "abnormal").otherwise("normal").alias("c"))
    return shape(annotation.changed_to_abnormal(one, two, ["pump_id", "o_orderkey"], "c"))


_RX = "regexp_extract(trim(x), '^[^:]*')"
S.cte("manifest", ("annotations",), """SELECT *, CASE WHEN bad AND NOT (named > 0 AND other = 0) THEN 'test' WHEN NOT bad AND n_periods <= 3 AND min_duration >= 540 THEN 'train' END AS selection FROM (
  SELECT date, pump_id, count(*) AS n_periods, bool_or(classification = 'abnormal') AS bad, min(duration_minutes) AS min_duration, max(duration_minutes) AS max_duration,
    count(*) FILTER (classification = 'abnormal' AND len(reasons) > 0) AS named,
    count(*) FILTER (classification = 'abnormal' AND len(reasons) > 0 AND len(list_filter(string_split(array_to_string(reasons, ';'), ';'), lambda x: split_part(x, ':', 1) NOT IN ('insufficient_data', 'vibration', 'flow_anomaly'))) > 0) AS other
  FROM annotations GROUP BY 1, 2)""")


def manifest(spark: Spark, sf: str) -> DataFrame:
    return annotation.select_days(annotations(spark, sf), V.SYSTEM.selector)


@query("eva_24_day_selection", S.with_(("manifest",), f"SELECT {S.d()}, {S.i('pump_id')}, {S.i('n_periods')}, selection FROM manifest WHERE selection IS NOT NULL"))
def day_selection(spark: Spark, sf: str) -> DataFrame:
    return shape(manifest(spark, sf), ["date", "pump_id", "n_periods", "selection"])


@query("snk_02_manifest", S.with_(("manifest",), f"""SELECT {S.d()}, {S.i('pump_id')}, {S.r("CASE WHEN selection = 'train' THEN min_duration END", 'min_duration')},
  {S.r("CASE WHEN selection = 'train' THEN max_duration END", 'max_duration')}, selection FROM manifest WHERE selection IS NOT NULL"""))
def manifest_sink(spark: Spark, sf: str) -> DataFrame:
    return shape(manifest(spark, sf).orderBy("date", "pump_id"), ["date", "pump_id", "min_duration", "max_duration", "selection"])


@query("joi_07_selected_rows", S.with_(("manifest", "readings"), f"""SELECT part, {S.i('n')} FROM (SELECT 'train' AS part, count(*) AS n FROM readings SEMI JOIN (SELECT * FROM manifest WHERE selection = 'train') USING (date, pump_id)
  UNION ALL SELECT 'excluded', count(*) FROM (SELECT DISTINCT date, pump_id FROM readings) ANTI JOIN (SELECT * FROM manifest WHERE selection IS NOT NULL) USING (date, pump_id))"""))
def selected_rows(spark: Spark, sf: str) -> DataFrame:
    r, m = V.readings(spark, sf), manifest(spark, sf)
    kept = annotation.rows_of(r, m, "train").agg(F.lit("train").alias("part"), F.count(F.lit(1)).alias("n"))
    out = annotation.excluded_days(r, m).agg(F.lit("excluded").alias("part"), F.count(F.lit(1)).alias("n"))
    return shape(kept.unionByName(out))


@query("mon_11_quality_summary", S.with_(("seg_stats",), f"""SELECT {S.i('pump_id')}, {S.ins(['n_segments', 'n_written', 'input_rows', 'output_rows', 'skipped_frozen', 'skipped_empty'])} FROM (
  SELECT pump_id, count(*) AS n_segments, count(*) FILTER (output_rows > 0) AS n_written, sum(input_rows) AS input_rows, sum(output_rows) AS output_rows,
    count(*) FILTER (skip_reason = 'all_frozen') AS skipped_frozen, count(*) FILTER (skip_reason = 'no_rows_after_steps') AS skipped_empty FROM seg_stats GROUP BY GROUPING SETS ((pump_id), ()))"""))
def quality_summary(spark: Spark, sf: str) -> DataFrame:
    return shape(monitoring.quality_summary(_stats(spark, sf)), ["pump_id", "n_segments", "n_written", "input_rows", "output_rows", "skipped_frozen", "skipped_empty"])


@query("mon_11_code_summary", S.with_(("code_counts",), f"SELECT sensor, {S.ins(['code', 'n_cells'])} FROM (SELECT sensor, code, sum(n_cells) AS n_cells FROM code_counts WHERE code > 0 GROUP BY GROUPING SETS ((sensor, code), (sensor), (code), ()))"))
def code_summary(spark: Spark, sf: str) -> DataFrame:
    return shape(monitoring.code_summary(quality.code_counts(labelled(spark, sf))))


@query("mon_12_annotation_summary", S.with_(("annotations",), f"""SELECT {S.i('pump_id')}, {S.ins(['n_periods', 'n_abnormal'])}, {S.d('first_date', 'first_date')}, {S.d('last_date', 'last_date')} FROM (
  SELECT pump_id, count(*) AS n_periods, count(*) FILTER (classification = 'abnormal') AS n_abnormal, min(date) AS first_date, max(date) AS last_date FROM annotations GROUP BY GROUPING SETS ((pump_id), ()))"""))
def annotation_summary(spark: Spark, sf: str) -> DataFrame:
    return shape(annotation.summary(annotations(spark, sf)))


S.cte("reason_rows", ("annotations",), """SELECT * FROM (SELECT date, pump_id, period_start, period_end, trim(split_part(unnest(string_split(array_to_string(reasons, ';'), ';')), ':', 1)) AS reason
  FROM annotations WHERE classification = 'abnormal') WHERE reason <> ''""")


@query("mon_13_reason_frequency", S.with_(("reason_rows",), f"SELECT reason, {S.i('n')} FROM (SELECT reason, count(*) AS n FROM reason_rows GROUP BY 1)"))
def reason_frequency(spark: Spark, sf: str) -> DataFrame:
    return shape(annotation.reason_frequency(annotations(spark, sf)))


@query("mon_14_error_examples", S.with_(("reason_rows",), f"""SELECT reason, {S.i('pick')}, {S.d()}, {S.i('pump_id')}, period_start FROM (
  SELECT *, row_number() OVER (PARTITION BY reason ORDER BY a, b) AS pick FROM (
    SELECT *, CASE WHEN fst <= 3 AND idx = pump_first THEN 0 WHEN spread > 0 THEN 1 ELSE 2 END AS a, CASE WHEN fst <= 3 AND idx = pump_first THEN idx WHEN spread > 0 THEN spread ELSE idx END AS b FROM (
      SELECT *, dense_rank() OVER (PARTITION BY reason ORDER BY pump_first) AS fst,
        list_position(CASE WHEN n <= 3 THEN range(0, n) ELSE [CAST(round_even(0.0::DOUBLE * (n - 1) / 2, 0) AS BIGINT), CAST(round_even(1.0::DOUBLE * (n - 1) / 2, 0) AS BIGINT), n - 1] END, idx) AS spread FROM (
        SELECT *, min(idx) OVER (PARTITION BY reason, pump_id) AS pump_first FROM (
          SELECT *, row_number() OVER (PARTITION BY reason ORDER BY date, pump_id, period_start) - 1 AS idx, count(*) OVER (PARTITION BY reason) AS n
          FROM (SELECT DISTINCT * FROM reason_rows)))))) WHERE pick <= 3"""))
def error_examples(spark: Spark, sf: str) -> DataFrame:
    return shape(annotation.error_examples(annotations(spark, sf)), ["reason", "pick", "date", "pump_id", "period_start"])
