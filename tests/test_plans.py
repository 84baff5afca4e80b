"""Plan shapes that must hold by construction."""

from __future__ import annotations

import io
import re
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from rotorline.operators import detectors, fusion, periods, quality
from rotorline.plans import views as V
from rotorline.sources.tables import pivot_measurements

SF = "/root/testdata/sf0.001"


def plan(df, mode="simple") -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def exchanges(text: str) -> list[str]:
    return re.findall(r"Exchange hashpartitioning\(([^)]*)", text)


def test_quality_chain_has_one_segment_exchange(spark):
    """Bucket means need one exchange; label, clean and filter add a single one on the segment."""
    df = quality.run_steps(V.sparse(spark, SF), V.QUALITY, ("label", "clean", "filter"))
    text = plan(df)
    by = exchanges(text)
    assert len(by) == 2, by
    assert sum("date" in e for e in by) == 1
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" not in text


def test_period_features_scan_once(spark):
    df = periods.period_features(V.machine(spark, SF), V.SYSTEM, V.EXTRA)
    text = plan(df)
    assert text.count("FileScan") == 1 and "Join" not in text and len(exchanges(text)) == 2


@pytest.mark.parametrize("build", ["detectors", "align", "rate"])
def test_no_nested_loops(spark, build):
    m = V.machine(spark, SF)
    f = periods.period_features(m, V.SYSTEM, V.EXTRA)
    if build == "detectors":
        df = detectors.classify(detectors.with_baseline(f, periods.baseline_wide(periods.baseline_long(f, V.SYSTEM))), V.SYSTEM)
    else:
        steps = m.select("pump_id", "date", "ts", F.col("flow").alias("distance"), F.when(F.col("flow") > 40, "ALARM").otherwise("NORMAL").alias("status"))
        df = fusion.align_windows(steps, steps, 600.0) if build == "align" else fusion.rate_limit(fusion.spike_filter(steps))
    text = plan(df)
    assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_filters_and_columns_reach_the_scan(spark):
    e = spark.read.parquet(f"{SF}/events.parquet").select(
        (F.col("user_id") % 4).alias("pump_id"), F.col("event_type").alias("sensor"), F.col("ts").cast("timestamp").alias("ts"), "value")
    text = plan(pivot_measurements(e, {"click": "speed", "view": "flow"}))
    assert re.search(r"PushedFilters: \[[^\]]*In\(event_type", text)
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "props" not in schema and "event_id" not in schema


def test_registered_queries_have_oracles():
    from __spark_entry__ import oracle_sql, queries

    names, oracles = set(queries()), set(oracle_sql())
    assert oracles <= names and len(names) > 150 and len(names - oracles) < 25


def test_catalog_imports_without_a_session():
    """The driver asks for the queries before it starts Spark."""
    import subprocess
    import sys

    code = "import __spark_entry__ as e; print(len(e.queries()) > 150)"
    root = __file__.rsplit("/tests/", 1)[0]
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip().endswith("True"), out.stderr[-500:]


@pytest.mark.parametrize("name", ["eda_01_density_histogram", "eva_18_policy_metrics", "joi_08_threshold_chain", "joi_09_stream_thresholds"])
def test_one_row_sides_are_scalars(spark, name):
    from rotorline.plans.catalog import QUERIES

    plan = QUERIES[name].build(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
