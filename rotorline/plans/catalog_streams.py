"""Registered queries: streaming jobs over the event table."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rotorline.functions.formulas import STATUS_MATRIX, season_of
from rotorline.operators import calibration as K
from rotorline.operators.features import norm_params
from rotorline.operators.quality import bucket_start
from rotorline.operators.scoring import SpeedLine
from rotorline.plans import catalog_scoring as CS
from rotorline.plans import sql as S
from rotorline.plans import views as V
from rotorline.plans.registry import query, shape
from rotorline.session import materialize
from rotorline.streaming import jobs
from rotorline.streaming.detector import STATE_STORE, control_rows, detect_stream, prepare, stored_state
from rotorline.streaming.step import StepConfig

Spark = SparkSession


def event_stream(spark: Spark, sf: str, batch: bool = False) -> DataFrame:
    e = V.table(spark, sf, "events") if batch else jobs.read_table_stream(spark, sf, "events.parquet")
    return e.select(
        (F.expr(f"user_id div {V.USERS_PER_PUMP}") + 1).cast("int").alias("pump_id"), "event_id",
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("sensor"), "value",
    )


# The watermark after everything has been read.
S.cte("wm", ("raw",), "SELECT max(ts) - INTERVAL 10 MINUTE AS wm FROM raw")


@query("str_09_stream_resample", S.with_(("raw", "wm"), f"""SELECT {S.i('pump_id')}, {S.t()}, {S.r('flow')}, {S.i('n')} FROM (SELECT pump_id, time_bucket(INTERVAL 1 HOUR, ts) AS ts, avg(value) FILTER (sensor = 'view') AS flow, count(*) AS n FROM raw GROUP BY 1, 2), wm
  WHERE ts + INTERVAL 1 HOUR <= wm"""))
def stream_resample(spark: Spark, sf: str) -> DataFrame:
    rules = {"flow": F.avg(F.when(F.col("sensor") == "view", F.col("value"))), "n": F.count(F.lit(1))}
    return shape(jobs.run_available(jobs.resample_stream(event_stream(spark, sf), rules, "1 hour")))


@query("str_10_stream_distinct", S.with_(("raw",), f"SELECT {S.i('pump_id')}, {S.d()}, {S.i('count(DISTINCT date_trunc(\'second\', ts))', 'n')} FROM raw GROUP BY pump_id, date"))
def stream_distinct(spark: Spark, sf: str) -> DataFrame:
    """One row per pump and second, whatever the batches: eight files in time order, one a trigger, every second row sent twice."""
    e = event_stream(spark, sf, batch=True).withColumn("ts", F.date_trunc("second", "ts"))
    twice = e.select("pump_id", "ts").union(e.where("event_id % 2 = 0").select("pump_id", "ts"))
    folder = f"{jobs.scratch(spark)}/events"
    twice.repartitionByRange(8, "ts").sortWithinPartitions("ts").write.parquet(folder)
    stream = spark.readStream.schema(twice.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    kept = jobs.run_available(jobs.distinct_stream(stream, ["pump_id", "ts"], "40 days"))
    return shape(kept.groupBy("pump_id", F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("n")))


@query("str_11_operation_sessions", S.with_(("raw", "wm"), f"""SELECT {S.i('pump_id')}, {S.t('a', 'start')}, {S.t('z', '"end"')}, {S.i('n_rows')} FROM (SELECT pump_id, s, min(ts) AS a, max(ts) AS z, count(*) AS n_rows FROM (
  SELECT *, sum(o) OVER (PARTITION BY pump_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY pump_id ORDER BY ts, event_id) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS o FROM raw WHERE sensor = 'click' AND value > 20))
  GROUP BY 1, 2), wm WHERE epoch(z) - epoch(a) >= 1800 AND z + INTERVAL 1 HOUR <= wm"""))
def operation_sessions(spark: Spark, sf: str) -> DataFrame:
    on = event_stream(spark, sf).where((F.col("sensor") == "click") & (F.col("value") > 20))
    return shape(jobs.run_available(jobs.operation_sessions(on, "1 hour", 1800.0)))


@query("str_12_day_rollup", S.with_(("raw", "wm"), f"""SELECT {S.i('pump_id')}, {S.d()}, {S.rs(['l1_mean', 'l2_mean'])}, {S.i('n_steps')} FROM (SELECT pump_id, date, avg(value) FILTER (sensor = 'view') AS l1_mean, avg(value) FILTER (sensor = 'signup') AS l2_mean, count(*) AS n_steps FROM raw GROUP BY 1, 2), wm
  WHERE date + INTERVAL 1 DAY <= wm"""))
def day_rollup(spark: Spark, sf: str) -> DataFrame:
    e = event_stream(spark, sf)
    steps = e.select("pump_id", "ts", F.when(F.col("sensor") == "view", F.col("value")).alias("l1"), F.when(F.col("sensor") == "signup", F.col("value")).alias("l2"))
    return shape(jobs.run_available(jobs.day_rollup(steps)))


def _model(spark: Spark, sf: str) -> tuple[DataFrame, SpeedLine, DataFrame, DataFrame, StepConfig]:
    """The readings, and everything the stream needs, learned in batch: lines, resolved thresholds, scaling."""
    r = V.grid(spark, sf)
    line = SpeedLine("speed", V.OUTPUTS).fit(r)
    res = V.residual_rows(spark, sf, r)
    seasons = F.explode(F.array(*[F.lit(s) for s in ("winter", "spring", "summer", "autumn")]))
    keys = r.select("pump_id").distinct().select("pump_id", seasons.alias("season"))
    level1 = K.resolve_blocks(keys, CS.l1_blocks(res, True), ["mean_vec", "cov_inv", "warning", "alarm", "mean"])
    th = CS.l2_thresholds(materialize(CS.l2_windows(spark, sf, r)))
    # The stream grades the smoothed error, so its thresholds are the window ones.
    named = th.select(
        F.lit(K.ALL_YEAR).alias("scope_season"), "scope_pump", F.lit(False).alias("fallback"),
        F.col("window_warning").alias("warning"), F.col("window_alarm").alias("alarm"), "mean")
    level2 = K.resolve_stream_blocks(keys, materialize(named), 2)
    p = {x["channel"]: x for x in norm_params(r.where(F.col("label") == "normal"), V.FILLED).collect()}
    mean = np.array([p[c]["mean"] for c in V.FILLED])
    std = np.array([p[c]["std"] or 1.0 for c in V.FILLED])
    return r.drop("label", "season"), line, materialize(level1), materialize(level2), StepConfig(V.HISTORY, mean, std, mean)


# --- the keyed detector --------------------------------------------------------
CONTROL_DAY = 16  # of January: every second pump is reset at its start
CONTROL_US = 1_705_363_200_000_000
SEASON_SHIFT = 45  # days; winter turns to spring in the middle of the month


def _fused_sql(one: str, two: str) -> str:
    return f"CASE WHEN {two} IS NULL THEN {one} " + " ".join(f"WHEN {one} = '{a}' AND {two} = '{b}' THEN '{c}'" for (a, b), c in STATUS_MATRIX.items()) + " END"


def _sequence_cte(name: str, season: str, reset: bool) -> None:
    """Twin of the detector: row-wise parts by windows, the sequential part by recursion over the rows of a pump.

    ``name``_seq has one row per reading in event order, restarted where the pump was reset.
    """
    epoch = f"CASE WHEN pump_id % 2 = 0 AND ts >= TIMESTAMP '2024-01-{CONTROL_DAY} 00:00:00' THEN 1 ELSE 0 END" if reset else "0"
    S.cte(f"{name}_rows", ("pred",), f"SELECT * EXCLUDE (season), {season} AS season, {epoch} AS seg FROM pred")
    S.cte(f"{name}_block", ("asked", "blocks4"), """
  SELECT * FROM (SELECT a.pump_id, a.season, b.* EXCLUDE (scope_season, scope_pump), row_number() OVER (PARTITION BY a.pump_id, a.season
      ORDER BY CASE WHEN b.scope_season = a.season THEN 0 ELSE 1 END, CASE WHEN b.scope_pump = a.pump_id THEN 0 ELSE 1 END) AS pick
    FROM asked a JOIN blocks4 b ON b.scope_season IN (a.season, 'all') AND b.scope_pump IN (a.pump_id, -1) AND NOT (b.scope_pump <> -1 AND b.fallback)) WHERE pick = 1""")
    ds = [f"coalesce({c} - pred_{c} - m_{c}, 0)" for c in S.OUT]
    diag = " + ".join(f"{x}*{x}/greatest(s_{c}*s_{c}, 1e-12)" for c, x in zip(S.OUT, ds))
    full = " + ".join(f"{'' if p == q else '2*'}{ds[n]}*i_{p}__{q}*{ds[m]}" for n, p in enumerate(S.OUT) for m, q in enumerate(S.OUT) if m >= n)
    valid = " OR ".join(f"({c} - pred_{c}) IS NOT NULL" for c in S.OUT)
    S.cte(f"{name}_one", (f"{name}_rows", f"{name}_block"), f"""
  SELECT pump_id, seg, date, ts, season, valid, CASE WHEN valid THEN dist ELSE 0 END AS l1_distance,
    CASE WHEN NOT valid THEN 'NORMAL' WHEN dist >= alarm THEN 'ALARM' WHEN dist >= warning THEN 'WARNING' ELSE 'NORMAL' END AS l1_status,
    CASE WHEN valid THEN {CS.health_sql('dist', 'mean', 'alarm')} ELSE 100 END AS l1_health, {', '.join(S.FIL)}
  FROM (SELECT x.*, ({valid}) AS valid, b.mean, b.warning, greatest(b.alarm, b.warning) AS alarm,
      sqrt(greatest(0.0, CASE WHEN diag THEN {diag} ELSE {full} END)) AS dist FROM {name}_rows x JOIN {name}_block b USING (pump_id, season))""")
    S.cte(f"{name}_fill", (f"{name}_one", "l2_means"), f"SELECT *, row_number() OVER w AS k, row_number() OVER (PARTITION BY pump_id, seg, date ORDER BY ts) AS rn, " + ", ".join(
        f"coalesce({c}, lag({c}) OVER w, a_{c}) AS now_{c}, coalesce({c}, lag({c}) OVER w, lead({c}) OVER w, a_{c}) AS old_{c}" for c in S.FIL)
        + f" FROM {name}_one, l2_means WINDOW w AS (PARTITION BY pump_id, seg ORDER BY ts)")
    edges = ((31, 9, -3, -5, 3), (9, 13, 12, 6, -5), (-3, 12, 17, 12, -3))
    scaled = [f"((({' + '.join(f'{w}.0::DOUBLE*' + (f'now_{c}' if n == 0 else f'lag(old_{c}, {n}) OVER w') for n, w in enumerate(ws))})/35.0::DOUBLE - a_{c}) / sd_{c})" for c in S.FIL for ws in edges]
    S.cte("st_spread", ("tagged",), "SELECT " + ", ".join(f"CASE WHEN coalesce(stddev_pop({c}), 0) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS sd_{c}" for c in S.FIL) + " FROM tagged WHERE label = 'normal'")
    S.cte(f"{name}_raw", (f"{name}_fill", "st_spread", "l2_thr"), f"""
  SELECT x.*, CASE WHEN rn >= 5 THEN (SELECT avg(v * v) FROM (SELECT unnest(zs) AS v)) END AS raw, t.mean AS l2_mean, t.window_warning AS l2_warning, greatest(t.window_alarm, t.window_warning) AS l2_alarm
  FROM (SELECT pump_id, seg, date, ts, season, valid, l1_distance, l1_status, l1_health, k, rn, [{', '.join(scaled)}] AS zs
    FROM {name}_fill, st_spread WINDOW w AS (PARTITION BY pump_id, seg ORDER BY ts)) x
  JOIN (SELECT p.pump_id, q.* FROM (SELECT DISTINCT pump_id FROM tagged) p JOIN l2_thr q
    ON q.scope_pump = CASE WHEN EXISTS (SELECT 1 FROM l2_thr o WHERE o.scope_pump = p.pump_id) THEN p.pump_id ELSE -1 END) t USING (pump_id)""")
    S.cte(f"{name}_seq", (f"{name}_raw",), f"""
  SELECT pump_id, seg, CAST(0 AS BIGINT) AS k, NULL::TIMESTAMP AS ts, NULL::DATE AS date, NULL::VARCHAR AS season, NULL::DOUBLE AS l1_distance, NULL::VARCHAR AS l1_status,
    NULL::DOUBLE AS l2_raw, NULL::DOUBLE AS ema, NULL::VARCHAR AS l2_status, NULL::VARCHAR AS status_raw, 0 AS run, NULL::VARCHAR AS status, NULL::DOUBLE AS health,
    false AS fired, NULL::TIMESTAMP AS last_alert, CAST(0 AS BIGINT) AS session, CAST(0 AS BIGINT) AS changes, NULL::BIGINT AS rn FROM {name}_raw WHERE k = 1
  UNION ALL
  SELECT pump_id, seg, k, ts, date, season, l1_distance, l1_status, raw, ema, coalesce(l2, 'BUFFERING'), fused, run, shown, health, fired,
    CASE WHEN run = 0 THEN NULL WHEN fired THEN ts ELSE before END, session + (shown IN ('WARNING', 'ALARM'))::INT, changes, rn
  FROM (SELECT *, shown = 'ALARM' AND (before IS NULL OR epoch(ts) - epoch(before) >= 3600) AS fired
    FROM (SELECT *, CASE WHEN fused NOT IN ('WARNING', 'ALARM') THEN 0 ELSE run0 + 1 END AS run,
        CASE WHEN fused IN ('WARNING', 'ALARM') AND run0 + 1 < 2 THEN 'NORMAL' ELSE fused END AS shown
      FROM (SELECT *, {_fused_sql('l1_status', 'l2')} AS fused,
          CASE WHEN l2h IS NULL THEN l1_health ELSE 0.6::DOUBLE * least(l1_health, l2h) + 0.4::DOUBLE * greatest(l1_health, l2h) END AS health
        FROM (SELECT *, CASE WHEN raw IS NULL THEN NULL WHEN ema >= l2_alarm THEN 'ALARM' WHEN ema >= l2_warning THEN 'WARNING' ELSE 'NORMAL' END AS l2,
            CASE WHEN raw IS NOT NULL THEN {CS.health_sql('ema', 'l2_mean', 'l2_alarm')} END AS l2h
          FROM (SELECT x.*, CASE WHEN x.raw IS NULL THEN s.ema WHEN s.ema IS NULL THEN x.l2_mean ELSE 0.3::DOUBLE * x.raw + 0.7::DOUBLE * s.ema END AS ema,
              s.run AS run0, s.last_alert AS before, s.session, s.changes + (s.season IS NOT NULL AND s.season <> x.season)::INT AS changes
            FROM {name}_seq s JOIN {name}_raw x ON x.pump_id = s.pump_id AND x.seg = s.seg AND x.k = s.k + 1)))))""")


_SHIFTED = S.SEASON.format("date + to_months(CAST((pump_id % 4) * 3 AS INTEGER))")
_sequence_cte("st", _SHIFTED, False)
_sequence_cte("sr", _SHIFTED, True)
_sequence_cte("sn", S.SEASON.format(f"date + {SEASON_SHIFT}"), False)

STEP = ["step", "l1_distance", "l1_status", "l2_raw", "l2_smoothed", "l2_status", "status_raw", "status", "health", "alert_fired", "session_alert_steps", "session_flagged"]
STEP_SQL = f"""{S.i('k - 1', 'step')}, {S.r('l1_distance')}, l1_status, {S.r('l2_raw')}, {S.r('CASE WHEN l2_raw IS NOT NULL THEN ema END', 'l2_smoothed')}, l2_status,
  status_raw, status, {S.r('health')}, {S.i('fired', 'alert_fired')}, {S.i('session', 'session_alert_steps')}, {S.i('session >= 3', 'session_flagged')}"""


def _shifted(ts: Column, pump: Column) -> Column:
    return V.shifted_season(ts.cast("date"), pump)


def _streamed(spark: Spark, sf: str, season: Callable[[Column, Column], Column] = _shifted, resets: bool = False, carry_state: bool = False) -> tuple[DataFrame, str]:
    """All readings through the detector: four time slices, stopped half-way and started again; what came out and the
    checkpoint. ``carry_state`` starts the second half as a new query from the state that the first one left."""
    spark.conf.set(*STATE_STORE)
    readings, line, level1, level2, cfg = _model(spark, sf)
    rows = readings.withColumns({"reset": F.lit(False), "heartbeat": F.lit(False)})
    pumps = rows.select("pump_id").distinct()
    first, last = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    base, cut, at = jobs.scratch(spark), [first + (last - first) * q // 4 for q in range(5)], CONTROL_US
    outputs, state = [], f"{base}/0"
    for half in (0, 1):
        folder = f"{base}/readings"
        for q in (2 * half, 2 * half + 1):
            end = cut[q + 1] if q < 3 else last + 1
            part = rows.where((F.unix_micros("ts") >= cut[q]) & (F.unix_micros("ts") < end))
            if resets and cut[q] <= at < end:
                part = part.unionByName(control_rows(rows, pumps.where("pump_id % 2 = 0"), F.timestamp_micros(F.lit(at)), True))
            if q == 3 or carry_state and q == 1:
                # A heartbeat beyond the last row lets the watermark pass every row.
                part = part.unionByName(control_rows(rows, pumps.limit(1), F.timestamp_micros(F.lit((last if q == 3 else cut[2]) + 3_600_000_000)), False))
            part.coalesce(1).write.mode("append").parquet(folder if not carry_state else f"{folder}-{half}")
        source = folder if not carry_state else f"{folder}-{half}"
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
        ready = prepare(stream, line.transform, level1, level2, V.OUTPUTS, season(F.col("ts"), F.col("pump_id")))
        initial = materialize(stored_state(spark, f"{state}/state")) if carry_state and half else None
        state = f"{base}/{half}" if carry_state else f"{base}/0"
        outputs.append(jobs.run_available(detect_stream(ready, cfg, V.FILLED, initial=initial), base=state))
    out = outputs[1] if not carry_state else outputs[0].unionByName(outputs[1])
    return out, f"{state}/state"


@query("str_01_detector_stream", S.with_(("st_seq",), f"SELECT {S.i('pump_id')}, {S.t()}, {STEP_SQL} FROM st_seq WHERE k > 0", recursive=True))
def detector_stream(spark: Spark, sf: str) -> DataFrame:
    """Every reading's result, in four batches with a restart between."""
    return shape(_streamed(spark, sf)[0], ["pump_id", "ts", *STEP])


@query("str_02_stored_state", S.with_(("st_seq",), f"""SELECT {S.i('pump_id')}, {S.i('k', 'total')}, {S.t('ts', 'last_ts')}, {S.i('rn', 'day_rows')}, {S.r('ema')}, {S.i('run')},
  {S.t('last_alert', 'last_alert')}, {S.i('session')}, season, {S.i('changes', 'season_changes')} FROM (SELECT *, row_number() OVER (PARTITION BY pump_id ORDER BY k DESC) AS back FROM st_seq WHERE k > 0) WHERE back = 1""", recursive=True))
def stored_states(spark: Spark, sf: str) -> DataFrame:
    """What the state store holds after the second half was run by another query that started from the first one's state."""
    held = stored_state(spark, _streamed(spark, sf, carry_state=True)[1])
    held = held.withColumns({"last_ts": F.timestamp_micros("last_us"), "last_alert": F.timestamp_micros("last_alert_us")})
    return shape(held, ["pump_id", "total", "last_ts", "day_rows", "ema", "run", "last_alert", "session", "season", "season_changes"])


@query("str_03_level1_rows", S.with_(("st_seq",), f"SELECT {S.i('pump_id')}, {S.d()}, {S.i('count(*)', 'n')}, {S.r('avg(l1_distance)', 'l1_mean')}, {S.i('sum((l1_distance = 0)::INT)', 'n_neutral')}, {S.i('sum((l1_status <> \'NORMAL\')::INT)', 'n_alert')} FROM st_seq WHERE k > 0 GROUP BY pump_id, date", recursive=True))
def level1_rows(spark: Spark, sf: str) -> DataFrame:
    """Level 1 of the stream by day: missing channels count at the mean residual, rows without any are neutral."""
    out = _streamed(spark, sf)[0].groupBy("pump_id", F.to_date("ts").alias("date"))
    alert = F.sum(F.when(F.col("l1_status") != "NORMAL", 1).otherwise(0)).alias("n_alert")
    return shape(out.agg(F.count("*").alias("n"), F.avg("l1_distance").alias("l1_mean"), F.sum((F.col("l1_distance") == 0).cast("int")).alias("n_neutral"), alert))


@query("str_04_level2_days", S.with_(("st_seq",), f"SELECT {S.i('pump_id')}, {S.d()}, {S.i('count(l2_raw)', 'n_windows')}, {S.r('avg(l2_raw)', 'raw')}, {S.r('max_by(ema, k) FILTER (l2_raw IS NOT NULL)', 'smoothed')} FROM st_seq WHERE k > 0 GROUP BY pump_id, date", recursive=True))
def level2_days(spark: Spark, sf: str) -> DataFrame:
    """Level 2 of the stream by day: windows scored, their mean error and the smoothed error at the day's end."""
    out = _streamed(spark, sf)[0].groupBy("pump_id", F.to_date("ts").alias("date"))
    return shape(out.agg(F.count("l2_raw").alias("n_windows"), F.avg("l2_raw").alias("raw"), F.max_by("l2_smoothed", F.when(F.col("l2_smoothed").isNotNull(), F.col("step"))).alias("smoothed")))


@query("str_05_warm_up", S.with_(("sr_seq",), f"""SELECT {S.i('pump_id')}, {S.d()}, {S.i('sum((l2_status = \'BUFFERING\')::INT)', 'n_buffering')}, {S.i('sum((l2_status = \'BUFFERING\' AND status_raw = l1_status)::INT)', 'n_level1_alone')},
  {S.t('min(ts) FILTER (l2_raw IS NOT NULL)', 'first_window')} FROM sr_seq WHERE k > 0 GROUP BY pump_id, date""", recursive=True))
def warm_up(spark: Spark, sf: str) -> DataFrame:
    """Rows on which level 2 buffers: at the start of every day and after a reset; then level 1 decides alone."""
    out = _streamed(spark, sf, resets=True)[0].groupBy("pump_id", F.to_date("ts").alias("date"))
    buffering = F.col("l2_status") == "BUFFERING"
    return shape(out.agg(
        F.sum(buffering.cast("int")).alias("n_buffering"), F.sum((buffering & (F.col("status_raw") == F.col("l1_status"))).cast("int")).alias("n_level1_alone"),
        F.min(F.when(~buffering, F.col("ts"))).alias("first_window")))


@query("str_06_alarms_online", S.with_(("st_seq",), f"""SELECT {S.i('pump_id')}, {S.d()}, {S.i('sum((status_raw <> \'NORMAL\')::INT)', 'n_raw')}, {S.i('sum((status <> \'NORMAL\')::INT)', 'n_shown')},
  {S.i('sum((status <> status_raw)::INT)', 'n_filtered')}, {S.i('sum(fired::INT)', 'n_fired')}, {S.i('max(session)', 'session')} FROM st_seq WHERE k > 0 GROUP BY pump_id, date""", recursive=True))
def alarms_online(spark: Spark, sf: str) -> DataFrame:
    """Spike filter, rate limit and session counter of the stream, by day."""
    out = _streamed(spark, sf)[0].groupBy("pump_id", F.to_date("ts").alias("date"))
    number = lambda test, name: F.sum(test.cast("int")).alias(name)
    return shape(out.agg(
        number(F.col("status_raw") != "NORMAL", "n_raw"), number(F.col("status") != "NORMAL", "n_shown"), number(F.col("status") != F.col("status_raw"), "n_filtered"),
        number(F.col("alert_fired"), "n_fired"), F.max("session_alert_steps").alias("session")))


@query("str_07_season_change", S.with_(("sn_seq",), f"""SELECT {S.i('pump_id')}, season, {S.i('count(*)', 'n')}, {S.t('min(ts)', 'since')}, {S.i('max(changes)', 'season_changes')}, {S.r('avg(l1_distance)', 'l1_mean')},
  {S.i('sum((l1_status = \'WARNING\')::INT)', 'n_warning')}, {S.i('sum((l1_status = \'ALARM\')::INT)', 'n_alarm')} FROM sn_seq WHERE k > 0 GROUP BY pump_id, season""", recursive=True))
def season_change(spark: Spark, sf: str) -> DataFrame:
    """Seasons by event time: the thresholds of every pump change with the row's season, the state counts the changes."""
    out, checkpoint = _streamed(spark, sf, lambda ts, pump: season_of(F.date_add(ts.cast("date"), SEASON_SHIFT)))
    by = out.groupBy("pump_id", "season").agg(
        F.count("*").alias("n"), F.min("ts").alias("since"), F.avg("l1_distance").alias("l1_mean"),
        *[F.sum((F.col("l1_status") == s).cast("int")).alias(f"n_{s.lower()}") for s in ("WARNING", "ALARM")])
    last = stored_state(spark, checkpoint).select("pump_id", F.col("season").alias("season"), "season_changes")
    both = by.join(last, ["pump_id", "season"], "left").withColumn("season_changes", F.coalesce("season_changes", F.lit(0)))
    return shape(both, ["pump_id", "season", "n", "since", "season_changes", "l1_mean", "n_warning", "n_alarm"])


@query("str_08_reset", S.with_(("sr_seq",), f"""SELECT {S.i('pump_id')}, {S.i('k', 'total')}, {S.i('seg', 'resets')}, {S.r('ema')}, {S.i('run')}, {S.i('session')} FROM (
  SELECT *, row_number() OVER (PARTITION BY pump_id ORDER BY seg DESC, k DESC) AS back FROM sr_seq WHERE k > 0) WHERE back = 1""", recursive=True))
def reset(spark: Spark, sf: str) -> DataFrame:
    """Every second pump is reset by control rows in the stream; the state store is read back after a restart."""
    held = stored_state(spark, _streamed(spark, sf, resets=True)[1])
    return shape(held, ["pump_id", "total", "resets", "ema", "run", "session"])
