"""Files, contracts, sinks and configuration."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from rotorline import config as cfgmod
from rotorline.config import ConfigError, QualityConfig, ResampleRule, SensorRule, SystemConfig
from rotorline.operators import detectors
from rotorline.sources import files, sinks, tables
from tests.helpers import at, segment

YAML = """
system_name: plant
data_root: ../data
output_dir: out
file_pattern: "^pump_(\\\\d+)_(\\\\d{4}-\\\\d{2}-\\\\d{2})\\\\.csv$"
date_format: "%Y-%m-%d"
pump_ids: [1, 2]
columns:
  expected_source_count: 4
  exclude_indices: [1]
  clean_names: [timestamp, speed, motor_current]
  timestamp_col: timestamp
  supplementary_columns: {"Filter dP": filter_diff_pressure}
  speed_col: speed
  current_col: motor_current
  pressure_col: outlet_pressure
  temp_cols: [de_bearing_temp]
  prox_cols: [de_vibration]
thresholds: {anomaly_sigma: 2.5, absolute_temp_limits: {de_bearing_temp: 95}}
detectors: [speed_stability, temperatures]
data_selector: {max_periods_per_day: 4}
quality:
  timestep_seconds: 300
  speed_on_threshold: 450
  min_consecutive_operational: 3
  frozen_tolerance: 1.0e-6
  frozen_period_seconds: 3600
  variability_threshold: 0.15
  rolling_window_samples: 6
  rolling_min_periods: 3
  output_dir: out
  dashboard_output: out
  sensors:
    speed: {min_value: 0, max_value: 2400, check_constant: true, check_falldown: true}
  cleaning: {codes_to_nan: [3, 5], drop_quality_columns: false}
  resample: {target_interval: "5min", value_agg: mean, quality_agg: max}
examples:
  normal: [{date: "2025-06-26", pump: 1}]
"""


def test_yaml(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text(YAML)
    system, quality = cfgmod.load_config(str(path))
    assert system.thresholds.anomaly_sigma == 2.5 and system.columns.temps == ("de_bearing_temp",)
    assert system.selector.max_periods_per_day == 4 and system.examples == {"normal": (("2025-06-26", 1),)}
    assert quality.resample.target_seconds == 300 and quality.codes_to_null == (3, 5) and not quality.drop_quality_columns
    assert system.columns.pressure == system.columns.pressure_off == "outlet_pressure"
    assert system.supplementary_columns == {"Filter dP": "filter_diff_pressure"} and system.source_count == 4
    assert system.data_root == str(tmp_path.parent / "data") and system.spark_date_format == "yyyy-MM-dd"
    # What the file does not say is not what the dataclass alone would say.
    th = system.thresholds
    assert (th.min_period_duration, th.speed_on_threshold, th.gap_merge_threshold, th.frozen_sensor_min_samples) == (600.0, 100.0, 30.0, 10)
    assert (th.pressure_off_absolute_threshold, th.pressure_off_rebound_threshold) == (5.0, 4.0) and system.selector.min_normal_duration_minutes == 120.0
    assert quality.speed_on_threshold == 450.0


@pytest.mark.parametrize("line,message", [
    ("pump_ids: [1, 2]", "pump_ids"), ("  timestamp_col: timestamp", "timestamp_col"), ("  prox_cols: [de_vibration]", "prox_cols"),
    ("  min_consecutive_operational: 3", "min_consecutive_operational"), ("  speed_col: speed", "speed_col")])
def test_missing_keys_are_named(tmp_path, line, message):
    path = tmp_path / "c.yaml"
    assert YAML.count(line) == 1
    path.write_text(YAML.replace(line, ""))
    with pytest.raises(ConfigError, match=message):
        cfgmod.load_config(str(path))


@pytest.mark.parametrize("old,new,message", [
    ("speed_col: speed", "speed_col: rpm", "rpm"), ("speed: {min_value: 0,", "flow: {min_value: 0,", "flow"), ("speed: {min_value: 0,", "speed: {", "min_value"),
    ("anomaly_sigma: 2.5", "anomaly_sigma: much", "thresholds"), ("pump: 1}", "machine: 1}", "examples"), ('"^pump_', '"^pump_[', "regular"),
    ("detectors: [speed_stability, temperatures]", "detectors: all", "list")])
def test_wrong_values_are_refused(tmp_path, old, new, message):
    path = tmp_path / "c.yaml"
    path.write_text(YAML.replace(old, new))
    with pytest.raises(ConfigError, match=message):
        cfgmod.load_config(str(path))


def test_defaults_of_the_file(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text(YAML.replace("codes_to_nan: [3, 5], ", "").replace('  resample: {target_interval: "5min", value_agg: mean, quality_agg: max}\n', "").replace("  pressure_col: outlet_pressure\n", ""))
    system, quality = cfgmod.load_config(str(path))
    assert quality.codes_to_null == () and quality.resample is None and system.columns.pressure is None and system.columns.pressure_off is None
    path.write_text(YAML[:YAML.index("quality:")])
    assert cfgmod.load_config(str(path))[1] is None
    path.write_text("")
    with pytest.raises(ConfigError, match="system_name"):
        cfgmod.load_config(str(path))


def test_the_views_system_file_says_what_the_views_say():
    from rotorline.plans import views
    from rotorline.plans.catalog_quality import SYSTEM_FILE

    system, quality = cfgmod.load_config(SYSTEM_FILE)
    assert (system.columns, system.thresholds, system.detectors, system.selector) == (views.SYSTEM.columns, views.SYSTEM.thresholds, views.SYSTEM.detectors, views.SYSTEM.selector)
    assert quality == views.QUALITY


def test_config_validation():
    with pytest.raises(ConfigError):
        ResampleRule(300, "exec")
    with pytest.raises(ConfigError):
        QualityConfig(sensors={})
    with pytest.raises(ConfigError):
        SystemConfig(file_pattern="nothing")
    with pytest.raises(ConfigError):
        QualityConfig(sensors={"x": SensorRule()}, missing_code="none")


CFG = SystemConfig(pump_ids=(1, 2), excluded_source_columns=(1,), clean_names=("timestamp", "speed", "motor_current"), supplementary_columns={"extra": "extra", "none": "absent"})


def test_load_days(spark, tmp_path):
    root = tmp_path / "data" / "deep"
    root.mkdir(parents=True)
    head = "Time,pump_id,Speed,Amps,extra\n"
    (root / "pump_1_2024-01-02.csv").write_text(head + "2024-01-02 00:00:00,1,900,10,5\nbroken,1,900,10,5\n2024-01-02 00:05:00,1,NaN,x,\n")
    (root / "pump_2_2024-02-31.csv").write_text(head + "2024-01-02 00:00:00,2,900,10,5\n")
    (root / "pump_7_2024-01-02.csv").write_text(head + "2024-01-02 00:00:00,7,900,10,5\n")
    (root / "notes.csv").write_text("a\n1\n")
    found = files.discover(files.list_files(spark, str(tmp_path / "data")), CFG).collect()
    assert [(str(r["date"]), r["pump_id"]) for r in found] == [("2024-01-02", 1)]
    rows = files.load_days(spark, str(tmp_path / "data"), CFG).orderBy("ts").collect()
    assert [(r["speed"], r["motor_current"], r["extra"], r["absent"]) for r in rows] == [(900.0, 10.0, 5.0, None), (None, None, None, None)]
    assert all(r["pump_id"] == 1 and "pump_1" in r["path"] for r in rows)


def test_every_file_has_its_own_header(spark, tmp_path):
    """Widths, order of further columns, quotes, line ends, marks at the start; what is left out is reported."""
    root = tmp_path / "data"
    root.mkdir()
    files_ = {
        "pump_1_2024-01-01.csv": 'Time,pump_id,Speed,Amps,extra\n2024-01-01 00:00:00,1,900,10,5\n\n2024-01-01 00:05:00,1\n',
        "pump_1_2024-01-02.csv": 'Time,pump_id,Speed,Amps,other,extra\r\n"2024-01-02 00:00:00",1,901,"11","a, b",6\r\n',
        "pump_1_2024-01-03.csv": "\ufeffZeit,Drehzahl,Strom\n2024-01-03 00:00:00,902,12\n",
        "pump_2_2024-01-01.csv": "Time,Speed\n2024-01-01 00:00:00,903\n",
        "pump_2_2024-01-02.csv": "Time,pump_id,Speed,Amps\n",
        "pump_2_2024-01-03.csv": "Time,pump_id,Speed,Amps\n2024-01-01 00:00:00,2,903,1,2,3\n",
        "pump_2_2024-01-04.csv": "",
        "pump_3_2024-01-01.csv": "Time,pump_id,Speed,Amps\n2024-01-01 00:00:00,3,903,1\n",
    }
    for name, text in files_.items():
        (root / name).write_bytes(text.encode())
    rows = files.load_days(spark, str(root), CFG).orderBy("ts").collect()
    assert [(str(r["date"]), r["ts"].minute, r["speed"], r["motor_current"], r["extra"], r["absent"]) for r in rows] == [
        ("2024-01-01", 0, 900.0, 10.0, 5.0, None), ("2024-01-01", 5, None, None, None, None), ("2024-01-02", 0, 901.0, 11.0, 6.0, None), ("2024-01-03", 0, 902.0, 12.0, None, None)]
    told = {r["path"].rsplit("/", 1)[1]: (r["n_columns"], r["n_rows"], r["problem"]) for r in files.file_report(spark, str(root), CFG).collect()}
    assert told == {
        "pump_1_2024-01-01.csv": (5, 2, None), "pump_1_2024-01-02.csv": (6, 1, None), "pump_1_2024-01-03.csv": (3, 1, None),
        "pump_2_2024-01-01.csv": (2, 1, "unexpected column count 2"), "pump_2_2024-01-02.csv": (4, 0, "empty"), "pump_2_2024-01-03.csv": (4, 1, "unreadable")}  # a file of no bytes has no row


def test_strict_and_contract(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00", "1"), ("nonsense", "1")], "timestamp string, pump_id string")
    with pytest.raises(Exception, match="invalid timestamp"):
        files.strict(df).collect()
    with pytest.raises(files.SchemaError, match="time"):
        files.strict(df, "time").collect()
    good = df.limit(1).withColumn("ts", F.col("timestamp").cast("timestamp"))
    assert files.require(good, [], []).schema["pump_id"].dataType.simpleString() == "int"
    with pytest.raises(files.SchemaError, match="speed"):
        files.require(good, ["speed"], [])
    with pytest.raises(Exception, match="not an integer"):
        files.require(good.withColumn("pump_id", F.lit("1.5")), [], []).collect()


def test_day_sink_and_cache(spark, tmp_path):
    df = segment(spark, [1.0, 2.0]).unionByName(segment(spark, [3.0], pump=2))
    sinks.write_days(df, str(tmp_path / "days"), by=("pump_id", "date"))
    assert (tmp_path / "days" / "pump_id=1" / "date=2024-01-02").exists()
    assert spark.read.parquet(str(tmp_path / "days")).count() == 3
    sinks.write_days(df, str(tmp_path / "by_date"))
    assert (tmp_path / "by_date" / "date=2024-01-02").exists() and spark.read.parquet(str(tmp_path / "by_date")).count() == 3
    calls = []
    build = lambda: calls.append(1) or df
    first = sinks.cached(spark, str(tmp_path / "c"), "r1", build).count()
    assert (first, sinks.cached(spark, str(tmp_path / "c"), "r1", build).count(), len(calls)) == (3, 3, 1)
    sinks.append_log(df, str(tmp_path / "log"))
    sinks.append_log(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 6


def test_thresholds_need_every_season(spark, tmp_path):
    def th(*seasons):
        return spark.createDataFrame([(s, 1.0) for s in seasons], "scope_season string, warning double")

    full = th("winter", "spring", "summer", "autumn", "all")
    with pytest.raises(ValueError, match="summer"):
        sinks.publish_thresholds(full, th("winter", "spring", "autumn"), str(tmp_path), "v1")
    assert not list(tmp_path.iterdir())
    assert [spark.read.parquet(p).count() for p in sinks.publish_thresholds(full, full, str(tmp_path), "v1")] == [5, 5]


def test_empty_annotations_write_a_header(spark, tmp_path):
    schema = "date date, pump_id int, period_start string, period_end string, duration_minutes double, classification string, reasons array<string>"
    sinks.write_annotations(spark.createDataFrame([], schema), str(tmp_path / "a"))
    text = "".join(p.read_text() for p in (tmp_path / "a").glob("*.csv"))
    assert text.startswith("date,pump_id,period_start")


def test_report_detail_is_optional(spark):
    days = spark.createDataFrame([(1, at(0).date(), "ALARM")], "pump_id int, date date, status string")
    steps = spark.createDataFrame([(1, at(0).date(), at(60), 2.0), (1, at(0).date(), at(0), 1.0)], "pump_id int, date date, ts timestamp, distance double")
    plain = json.loads(sinks.nested_report(days).first()["report"])
    full = json.loads(sinks.nested_report(days, steps=steps).first()["report"])
    assert plain == {"status": "ALARM"} and [s["distance"] for s in full["steps"]] == [1.0, 2.0]


def test_canonical_order():
    assert tables.canonical_order(["b_quality", "z", "ts", "a", "b", "a_quality"], ["a", "b"]) == ["ts", "a", "a_quality", "b", "b_quality", "z"]


def test_detector_registry():
    with pytest.warns(RuntimeWarning, match="built in"):
        detectors.register_detector("vibration", lambda f, b, c: None)
    with pytest.warns(RuntimeWarning, match="not found"):
        found = detectors.resolve(["vibration", "nothing", "flow_anomaly"])
    assert list(found) == ["vibration", "flow_anomaly"] and found["vibration"] is detectors.vibration
    with pytest.raises(TypeError):
        detectors.register_detector(3, None)
