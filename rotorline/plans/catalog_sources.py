"""Registered queries: sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotorline.config import SystemConfig
from rotorline.operators import annotation, monitoring, quality
from rotorline.plans import sql as S
from rotorline.plans import views as V
from rotorline.plans.registry import query, shape
from rotorline.session import materialize, shared_folder
from rotorline.sources import files, sinks, tables

Spark = SparkSession

# A file listing: one name per order, with unknown pumps, impossible dates and foreign files among them.
_NAMES_SQL = """SELECT '/plant/' || (o_custkey % 7) || '/' || CASE WHEN o_orderkey % 11 = 0 THEN 'note_' ELSE 'pump_' END || (o_orderkey % 6)
  || '_2024-' || lpad(CAST(o_orderkey % 14 AS VARCHAR), 2, '0') || '-' || lpad(CAST(o_custkey % 33 AS VARCHAR), 2, '0') || '.csv' AS path FROM orders"""
_FOUND_SQL = f"""SELECT try_cast(regexp_extract(n, '^pump_(\\d+)_(\\d{{4}}-\\d{{2}}-\\d{{2}}).*\\.csv$', 2) AS DATE) AS date,
  try_cast(regexp_extract(n, '^pump_(\\d+)_(\\d{{4}}-\\d{{2}}-\\d{{2}}).*\\.csv$', 1) AS INTEGER) AS pump_id, path
  FROM (SELECT path, regexp_extract(path, '[^/]*$') AS n FROM ({_NAMES_SQL}))"""
_FILES = SystemConfig(pump_ids=(1, 2, 3, 4, 9))


def _names(spark: Spark, sf: str) -> DataFrame:
    o = V.table(spark, sf, "orders")
    kind = F.when(F.col("o_orderkey") % 11 == 0, "note_").otherwise("pump_")
    return o.select(F.concat(
        F.lit("/plant/"), (F.col("o_custkey") % 7).cast("string"), F.lit("/"), kind, (F.col("o_orderkey") % 6).cast("string"),
        F.lit("_2024-"), F.lpad((F.col("o_orderkey") % 14).cast("string"), 2, "0"), F.lit("-"),
        F.lpad((F.col("o_custkey") % 33).cast("string"), 2, "0"), F.lit(".csv"),
    ).alias("path"))


@query("src_01_discover_files", f"SELECT {S.d()}, {S.i('pump_id')}, path FROM ({_FOUND_SQL}) WHERE date IS NOT NULL AND pump_id IN (1, 2, 3, 4, 9)")
def discover_files(spark: Spark, sf: str) -> DataFrame:
    return shape(files.discover(_names(spark, sf), _FILES))


@query("src_18_discovery_summary", f"""WITH f AS (SELECT * FROM ({_FOUND_SQL}) WHERE date IS NOT NULL AND pump_id IN (1, 2, 3, 4, 9)),
  p AS (SELECT unnest([1, 2, 3, 4, 9]) AS pump_id)
  SELECT {S.i('pump_id')}, {S.i('n_files')}, {S.d('first_date', 'first_date')}, {S.d('last_date', 'last_date')} FROM (
    SELECT p.pump_id, count(f.path) AS n_files, min(date) AS first_date, max(date) AS last_date FROM p LEFT JOIN f USING (pump_id) GROUP BY 1
    UNION ALL SELECT NULL, count(*), min(date), max(date) FROM f)""")
def discovery_summary(spark: Spark, sf: str) -> DataFrame:
    return shape(files.discovery_summary(files.discover(_names(spark, sf), _FILES), _FILES), ["pump_id", "n_files", "first_date", "last_date"])


@query("src_02_load_by_position", f"""SELECT {S.t()}, {S.r('ambient_temp')}, {S.r('speed')}, {S.r('extra_a')}, {S.r('extra_b')} FROM (
  SELECT try_cast(CASE WHEN event_id % 13 = 0 THEN 'broken' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP) AS ts,
    try_cast(CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS ambient_temp, CAST(value AS DOUBLE) AS speed,
    CAST(user_id AS DOUBLE) AS extra_a, CAST(NULL AS DOUBLE) AS extra_b FROM events) WHERE ts IS NOT NULL""")
def load_by_position(spark: Spark, sf: str) -> DataFrame:
    """Text columns in file order, one excluded position, one supplementary column present, one absent."""
    e = V.raw(spark, sf)
    text = e.select(
        F.when(F.col("event_id") % 13 == 0, "broken").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("Time"),
        F.col("sensor").alias("Unit"),
        F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("Ambient"),
        F.col("value").cast("string").alias("Speed rpm"),
        F.col("user_id").cast("string").alias("extra_a"),
    )
    cfg = SystemConfig(excluded_source_columns=(1,), clean_names=("timestamp", "ambient_temp", "speed"), supplementary_columns={"extra_a": "extra_a", "none": "extra_b"})
    return shape(files.by_position(text, cfg))


# Four shapes of file by machine: complete; with further columns; without the excluded column; with a column missing.
_CSV = SystemConfig(
    pump_ids=tuple(range(1, 5)), file_pattern=r"pump_id=(\d+)/date=(\d{4}-\d{2}-\d{2})/[^/]*\.csv$", excluded_source_columns=(1,), expected_source_count=4,
    clean_names=("timestamp", "ambient_temp", "speed"), supplementary_columns={"User": "user", "Nowhere": "nothing"})


def _csv_days(spark: Spark, sf: str) -> str:
    """The events as CSV files in folders by machine and day; every machine's files have their own header."""
    e = V.raw(spark, sf)
    text = e.select(
        ((F.col("pump_id") - 1) % 5 + 1).alias("pump_id"), "date",
        F.when(F.col("event_id") % 13 == 0, "broken").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("Time"),
        F.col("sensor").alias("Unit"), F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("Ambient"),
        F.col("value").alias("Speed rpm"), F.lit("a, b").alias("Note"), F.col("user_id").alias("User"))
    shapes = (["Time", "Unit", "Ambient", "User"], ["Time", "Unit", "Ambient", "Speed rpm", "Note", "User"], ["Time", "Ambient", "Speed rpm"], ["Time", "Ambient"], ["Time", "Unit", "Ambient", "User"])
    folder = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4()}"
    for k, names in enumerate(shapes):
        own = text.where(F.col("pump_id") == k + 1).select("pump_id", "date", *names)
        own.repartition("date").write.mode("append").partitionBy("pump_id", "date").option("header", "true").csv(folder)
    return folder


S.cte("csv_rows", ("raw",), """SELECT (pump_id - 1) % 5 + 1 AS pump_id, date, event_id, user_id, try_cast(CASE WHEN event_id % 13 = 0 THEN 'broken' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP) AS ts,
  try_cast(CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS ambient_temp, CAST(value AS DOUBLE) AS value FROM raw""")


@query("src_02_csv_files", S.with_(("csv_rows",), f"""SELECT {S.SEGS}, {S.t()}, {S.r('ambient_temp')}, {S.r("CASE WHEN pump_id = 1 THEN user_id ELSE value END", 'speed')}, {S.r("CASE WHEN pump_id < 3 THEN user_id END", 'user')},
  {S.r('CAST(NULL AS DOUBLE)', 'nothing')} FROM csv_rows WHERE pump_id < 4 AND ts IS NOT NULL"""))
def csv_files(spark: Spark, sf: str) -> DataFrame:
    """Real files, each read by its own header; pump 4's have too few columns, pump 5 is not configured."""
    return shape(files.load_days(spark, _csv_days(spark, sf), _CSV), ["pump_id", "date", "ts", "ambient_temp", "speed", "user", "nothing"])


@query("src_02_file_report", S.with_(("csv_rows",), f"""SELECT {S.SEGS}, {S.i('CASE pump_id WHEN 1 THEN 4 WHEN 2 THEN 6 WHEN 3 THEN 3 ELSE 2 END', 'n_columns')}, {S.i('count(*)', 'n_rows')},
  CASE WHEN pump_id = 4 THEN 'unexpected column count 2' END AS problem FROM csv_rows WHERE pump_id < 5 GROUP BY pump_id, date"""))
def csv_report(spark: Spark, sf: str) -> DataFrame:
    """What the loader says about every file that it finds."""
    told = files.file_report(spark, _csv_days(spark, sf), _CSV)
    found = files.discover(told.select("path"), _CSV)
    return shape(told.join(found, "path"), ["pump_id", "date", "n_columns", "n_rows", "problem"])


# Raw measurement times of a machine-day, truncated to whole seconds: at most 86 400 per segment.
S.cte("seconds", ("raw",), "SELECT DISTINCT pump_id, date, date_trunc('second', ts) AS ts FROM raw")


def _seconds(spark: Spark, sf: str) -> DataFrame:
    return V.raw(spark, sf).select("pump_id", "date", F.date_trunc("second", "ts").alias("ts")).distinct()


@query("src_03_sampling_interval", S.with_(("seconds",), f"""SELECT {S.SEGS}, {S.r('interval_s')} FROM (
  SELECT pump_id, date, CASE WHEN median(gap) > 0 THEN median(gap) ELSE 5.0 END AS interval_s
  FROM (SELECT pump_id, date, epoch(ts) - epoch(lag(ts) OVER ({S.SEGW})) AS gap FROM seconds) GROUP BY 1, 2)"""))
def sampling_interval(spark: Spark, sf: str) -> DataFrame:
    return shape(quality.median_gap(_seconds(spark, sf)))


@query("src_04_modal_timestep", S.with_(("readings",), f"""SELECT {S.SEGS}, {S.i('timestep_s')} FROM (
  SELECT pump_id, date, coalesce(greatest(max(gap) FILTER (k = 1 AND n > 0), 1), 60) AS timestep_s FROM (
    SELECT *, row_number() OVER (PARTITION BY pump_id, date ORDER BY n DESC, gap) AS k FROM (
      SELECT pump_id, date, gap, count(gap) AS n FROM (SELECT pump_id, date, CAST(floor(epoch(ts) - epoch(lag(ts) OVER ({S.SEGW}))) AS BIGINT) AS gap
        FROM readings WHERE de_bearing_temp IS NOT NULL AND flow IS NOT NULL) GROUP BY 1, 2, 3)) GROUP BY 1, 2)"""))
def modal_timestep(spark: Spark, sf: str) -> DataFrame:
    return shape(quality.modal_gap(V.readings(spark, sf).where("de_bearing_temp IS NOT NULL AND flow IS NOT NULL")))


@query("src_05_pivot_measurements", S.with_(("raw",), f"""SELECT {S.i('pump_id')}, {S.t()}, {S.r('speed')}, {S.r('flow')}, {S.r('motor_current')} FROM (
  SELECT pump_id, time_bucket(INTERVAL 5 MINUTE, ts) AS ts, avg(CASE WHEN sensor = 'click' THEN value END) AS speed,
    avg(CASE WHEN sensor = 'view' THEN value END) AS flow, avg(CASE WHEN sensor = 'error' THEN value END) AS motor_current
  FROM raw WHERE sensor IN ('click', 'view', 'error') AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-28' GROUP BY 1, 2)"""))
def pivot_measurements(spark: Spark, sf: str) -> DataFrame:
    names = {"click": "speed", "view": "flow", "error": "motor_current"}
    return shape(tables.pivot_measurements(V.raw(spark, sf), names, "2024-01-03", "2024-01-28"))


@query("src_06_running_filter", S.with_(("raw",), f"""SELECT {S.i('pump_id')}, sensor, {S.i('n')}, {S.r('total')} FROM (
  SELECT pump_id, sensor, count(*) AS n, sum(value) AS total FROM raw r WHERE EXISTS (SELECT 1 FROM raw q WHERE q.pump_id = r.pump_id
    AND q.sensor = 'click' AND q.value > 0 AND time_bucket(INTERVAL 5 MINUTE, q.ts) = time_bucket(INTERVAL 5 MINUTE, r.ts)) GROUP BY 1, 2)"""))
def running_filter(spark: Spark, sf: str) -> DataFrame:
    kept = tables.running_only(V.raw(spark, sf), "click")
    return shape(kept.groupBy("pump_id", "sensor").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")))


# Packed days: the values of a sensor bucketed to ten minutes, NULL where nothing arrived.
S.cte("packed", ("raw",), """SELECT pump_id, sensor, date, 600 AS timestep, [m[k] FOR k IN range(0, 144)] AS value FROM (
  SELECT pump_id, sensor, date, map_from_entries(list((slot, v))) AS m FROM (SELECT pump_id, sensor, date, CAST(hour(ts) * 6 + minute(ts) // 10 AS BIGINT) AS slot, avg(value) AS v
  FROM raw GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)""")


def _packed(spark: Spark, sf: str) -> DataFrame:
    rows = V.raw(spark, sf)
    slot = F.hour("ts") * 6 + F.floor(F.minute("ts") / 10)
    cells = rows.groupBy("pump_id", "sensor", "date", slot.cast("int").alias("slot")).agg(F.avg("value").alias("v"))
    day = cells.groupBy("pump_id", "sensor", "date").agg(F.map_from_entries(F.collect_list(F.struct("slot", "v"))).alias("m"))
    value = F.transform(F.sequence(F.lit(0), F.lit(143)), lambda k: F.try_element_at("m", k))
    one = day.select("pump_id", "sensor", "date", F.lit(1).alias("arrival"), F.lit(600).alias("timestep"), value.alias("value"))
    # A second, later copy of every day: the first must win.
    again = one.withColumns({"arrival": F.lit(2), "value": F.transform("value", lambda v: v + 1000.0)})
    return one.unionByName(again)


@query("src_07_packed_days", S.with_(("packed",), f"""SELECT {S.i('pump_id')}, sensor, {S.t()}, {S.r('value')} FROM (
  SELECT pump_id, sensor, time_bucket(INTERVAL 1 HOUR, CAST(date AS TIMESTAMP) + to_seconds(i * timestep)) AS ts, avg(v) AS value
  FROM (SELECT pump_id, sensor, date, timestep, unnest(value) AS v, unnest(range(0, 144)) AS i FROM packed)
  WHERE CAST(date AS TIMESTAMP) + to_seconds(i * timestep) < TIMESTAMP '2024-02-01' GROUP BY 1, 2, 3) WHERE value IS NOT NULL"""))
def packed_days(spark: Spark, sf: str) -> DataFrame:
    """Every sensor of every machine; the range ends after the table's last day."""
    end = F.lit("2024-02-01").cast("timestamp")
    return shape(tables.unpack_days(_packed(spark, sf), ["pump_id", "sensor"], end=end, bucket_seconds=3600))


_SENSOR_SQL = "SELECT 'Main HTF Pump ' || (p_partkey % 4) || ' ' || p_type AS name, CAST(p_partkey % 3 AS VARCHAR) AS number, p_size FROM part"


@query("src_08_generic_names", f"""SELECT generic, {S.i('n')} FROM (SELECT
  regexp_replace(name, '^(Main HTF Pump) ' || number || ' ', '\\1 ') AS generic, count(*) AS n FROM ({_SENSOR_SQL}) GROUP BY 1)""")
def generic_names(spark: Spark, sf: str) -> DataFrame:
    p = V.table(spark, sf, "part")
    named = p.select(
        F.concat(F.lit("Main HTF Pump "), (F.col("p_partkey") % 4).cast("string"), F.lit(" "), F.col("p_type")).alias("name"),
        (F.col("p_partkey") % 3).cast("string").alias("number"),
    )
    out = named.select(tables.generic_name(F.col("name"), F.col("number")).alias("generic"))
    return shape(out.groupBy("generic").agg(F.count(F.lit(1)).alias("n")))


@query("src_09_time_range", f"SELECT {S.t('min(ts)', 'first_ts')}, {S.t('max(ts)', 'last_ts')} FROM events")
def time_range(spark: Spark, sf: str) -> DataFrame:
    return shape(tables.time_range(V.raw(spark, sf)))


S.cte("defs_raw", (), """SELECT p_partkey AS row_no, ' ' || upper(p_name) || ' ' AS sensor_id, '1/' || p_type AS name, CAST(p_partkey % 5 AS INTEGER) AS equipment_id,
  CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size * 10 END AS timestep, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_retailprice / 10 END AS min_value,
  CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_retailprice END AS max_value, CASE WHEN p_size % 2 = 0 THEN NULL ELSE p_size % 7 = 1 END AS check_constant FROM part""")
S.cte("defs", ("defs_raw",), """SELECT row_no, lower(trim(sensor_id)) AS sensor_id, equipment_id,
  c || CASE WHEN k > 1 THEN ' (' || k || ')' ELSE '' END AS "column", coalesce(timestep, 60) AS timestep, min_value, max_value, coalesce(check_constant, false) AS check_constant
  FROM (SELECT *, row_number() OVER (PARTITION BY equipment_id, c ORDER BY row_no) AS k FROM (
    SELECT *, regexp_replace(trim(name), '^\\d+/', '') AS c FROM defs_raw WHERE lower(trim(sensor_id)) NOT IN (SELECT lower(trim(p_name)) FROM part WHERE p_size = 50)))""")


def _definitions(spark: Spark, sf: str) -> DataFrame:
    p = V.table(spark, sf, "part")
    size = F.col("p_size")
    raw = p.select(
        F.col("p_partkey").alias("row_no"), F.concat(F.lit(" "), F.upper("p_name"), F.lit(" ")).alias("sensor_id"),
        F.concat(F.lit("1/"), F.col("p_type")).alias("name"), (F.col("p_partkey") % 5).cast("int").alias("equipment_id"),
        F.when(size % 4 != 0, size * 10).alias("timestep"), F.when(size % 3 != 0, F.col("p_retailprice") / 10).alias("min_value"),
        F.when(size % 5 != 0, F.col("p_retailprice")).alias("max_value"), F.when(size % 2 != 0, size % 7 == 1).alias("check_constant"),
        F.lit(None).cast("boolean").alias("check_falldown"),
    )
    excluded = p.where(size == 50).select(F.col("p_name").alias("sensor_id"))
    return tables.sensor_definitions(raw, excluded, r"^\d+/")


@query("src_10_sensor_definitions", S.with_(("defs",), f"""SELECT {S.i('row_no')}, sensor_id, {S.i('equipment_id')}, "column", {S.i('timestep')},
  {S.r('min_value')}, {S.r('max_value')}, {S.i('check_constant')} FROM defs"""))
def sensor_definitions(spark: Spark, sf: str) -> DataFrame:
    cols = ["row_no", "sensor_id", "equipment_id", "column", "timestep", "min_value", "max_value", "check_constant"]
    return shape(_definitions(spark, sf), cols)


def _overrides(spark: Spark, sf: str) -> DataFrame:
    li = V.table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.min("l_quantity").alias("lo"), F.max("l_extendedprice").alias("hi"))
    p = V.table(spark, sf, "part").join(li, F.col("l_partkey") == F.col("p_partkey"))
    return p.groupBy(F.lower(F.trim("p_name")).alias("sensor_id")).agg(
        F.min(F.when(F.col("lo") < 3, F.col("lo"))).alias("min_value"), F.max(F.when(F.col("hi") > 40000, F.col("hi"))).alias("max_value"))


@query("src_11_definition_override", S.with_(("defs",), f"""SELECT {S.i('row_no')}, {S.r('coalesce(o.lo, min_value)', 'min_value')}, {S.r('coalesce(o.hi, max_value)', 'max_value')}
  FROM defs LEFT JOIN (SELECT lower(trim(p_name)) AS sensor_id, min(CASE WHEN lo < 3 THEN lo END) AS lo, max(CASE WHEN hi > 40000 THEN hi END) AS hi FROM part JOIN (
    SELECT l_partkey, min(l_quantity) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1) ON l_partkey = p_partkey GROUP BY 1) o USING (sensor_id)"""))
def definition_override(spark: Spark, sf: str) -> DataFrame:
    out = tables.override_definitions(_definitions(spark, sf), _overrides(spark, sf), ["min_value", "max_value"])
    return shape(out, ["row_no", "min_value", "max_value"])


# Catalogue of default limits: the first key found in the column name decides.
_CATALOGUE = [
    {"key": "BRUSHED", "min_value": 0, "max_value": 500, "check_constant": True},
    {"key": "steel", "min_value": -5, "check_constant": False},
    {"key": "anodized", "max_value": 90},
]


@query("src_12_default_limits", S.with_(("defs",), f"""SELECT {S.i('row_no')},
  {S.r("coalesce(min_value, CASE WHEN contains(lower(\"column\"), 'brushed') THEN 0 WHEN contains(lower(\"column\"), 'steel') THEN -5 END)", 'min_value')},
  {S.r("coalesce(max_value, CASE WHEN contains(lower(\"column\"), 'brushed') THEN 500 WHEN contains(lower(\"column\"), 'steel') THEN NULL WHEN contains(lower(\"column\"), 'anodized') THEN 90 END)", 'max_value')},
  {S.i("check_constant OR contains(lower(\"column\"), 'brushed')", 'check_constant')} FROM defs"""))
def default_limits(spark: Spark, sf: str) -> DataFrame:
    return shape(tables.default_limits(_definitions(spark, sf), _CATALOGUE), ["row_no", "min_value", "max_value", "check_constant"])


@query("src_14_canonical_order", S.with_(("labelled",), "SELECT " + ", ".join(
    [S.t(), *[x for c in ("outlet_pressure", "speed") for x in (S.r(c), S.i(f"{c}_quality"))], S.i("pump_id"), S.d(), S.i("inserted"),
     S.r("flow"), S.r("motor_current"), S.r("de_bearing_temp"), *[S.i(f"{c}_quality") for c in ("flow", "motor_current", "de_bearing_temp")]]) + " FROM labelled"))
def canonical_order(spark: Spark, sf: str) -> DataFrame:
    df = quality.label(V.sparse(spark, sf), V.QUALITY)
    return shape(df, tables.canonical_order(df.columns, ["outlet_pressure", "speed"]))


@query("src_15_union_tagged", S.with_(("readings",), f"""SELECT dataset, {S.i('n')}, {S.r('flow')}, {S.r('motor_current')} FROM (
  SELECT 'train' AS dataset, count(*) AS n, sum(flow) AS flow, CAST(NULL AS DOUBLE) AS motor_current FROM readings WHERE day(date) <= 20
  UNION ALL SELECT 'test', count(*), sum(flow), sum(motor_current) FROM readings WHERE day(date) > 20)"""))
def union_tagged(spark: Spark, sf: str) -> DataFrame:
    r = V.readings(spark, sf)
    parts = {"train": r.where(F.dayofmonth("date") <= 20).drop("motor_current"), "test": r.where(F.dayofmonth("date") > 20)}
    both = files.union_tagged(parts)
    return shape(both.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.sum("flow").alias("flow"), F.sum("motor_current").alias("motor_current")))


@query("src_17_missing_sensors", S.with_(("raw",), f"""SELECT {S.SEGS}, sensor FROM (SELECT DISTINCT pump_id, date FROM raw),
  (SELECT unnest(['click', 'view', 'purchase', 'error', 'signup', 'absent']) AS sensor) c
  WHERE (pump_id, date, sensor) NOT IN (SELECT pump_id, date, sensor FROM raw WHERE value > 60)"""))
def missing_sensors(spark: Spark, sf: str) -> DataFrame:
    r = V.raw(spark, sf)
    names = F.explode(F.array(*[F.lit(s) for s in ("click", "view", "purchase", "error", "signup", "absent")]))
    configured = r.select("pump_id").distinct().select("pump_id", names.alias("sensor"))
    reported = r.withColumn("value", F.when(F.col("value") > 60, F.col("value")))
    return shape(tables.missing_sensors(reported, configured))


@query("src_19_strict_load", f"SELECT {S.i('event_id')}, {S.t()} FROM events")
def strict_load(spark: Spark, sf: str) -> DataFrame:
    e = V.raw(spark, sf)
    text = e.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"))
    return shape(files.strict(text), ["event_id", "ts"])


@query("src_20_schema_contract", S.with_(("readings",), f"SELECT {S.i('pump_id')}, {S.i('n')} FROM (SELECT pump_id, count(*) AS n FROM readings GROUP BY 1)"))
def schema_contract(spark: Spark, sf: str) -> DataFrame:
    r = V.readings(spark, sf).withColumn("pump_id", F.col("pump_id").cast("string"))
    return shape(files.require(r, ["speed"], V.OUTPUTS).groupBy("pump_id").agg(F.count(F.lit(1)).alias("n")))


@query("snk_04_nested_report", S.with_(("l1_days",), f"SELECT {S.SEGS}, status, {S.i('n_steps')} FROM l1_days"))
def nested_report(spark: Spark, sf: str) -> DataFrame:
    """Build the JSON report with step detail and read the day fields and the step count back out of it."""
    from rotorline.operators.scoring import level1_days
    from rotorline.plans.catalog_scoring import l1_steps

    scored = materialize(l1_steps(spark, sf).select("pump_id", "date", "ts", "distance", "status", "warning", "alarm"))
    days = level1_days(scored).select("pump_id", "date", "status", "n_steps")
    report = sinks.nested_report(days, steps=scored.drop("warning", "alarm"))
    body = F.from_json("report", "status string, n_steps long, steps array<struct<status:string>>")
    return shape(report.withColumn("b", body).select("pump_id", "date", "b.status", F.size("b.steps").alias("n_steps")))


@query("snk_05_prediction_errors", S.with_(("pred",), "SELECT channel, " + S.r("mse") + " FROM (WITH p AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS channel, avg(({c} - pred_{c}) * ({c} - pred_{c})) AS mse FROM pred" for c in S.OUT) + ") SELECT * FROM p UNION ALL SELECT NULL, avg(mse) FROM p)"))
def prediction_errors(spark: Spark, sf: str) -> DataFrame:
    rows = sinks.prediction_rows(V.predicted(spark, sf), V.OUTPUTS, ["pump_id", "ts"])
    return shape(sinks.prediction_errors(rows), ["channel", "mse"])


def annotations(spark: Spark, sf: str) -> DataFrame:
    return annotation.annotate(V.machine(spark, sf), V.SYSTEM, extra=V.EXTRA)


def day_log(spark: Spark, sf: str) -> DataFrame:
    from rotorline.plans.catalog_scoring import l1_days, l2_days

    g = V.grid(spark, sf)
    first = materialize(l1_days(spark, sf, g))
    return monitoring.day_log(first, l2_days(spark, sf, g), first)
