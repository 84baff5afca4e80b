"""Published expectations on small frames."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from rotorline.config import QualityConfig, SensorRule, SystemConfig, Thresholds
from rotorline.functions import formulas as X
from rotorline.operators import calibration as K
from rotorline.operators import features as FE
from rotorline.operators import fusion as U
from rotorline.operators import monitoring as M
from rotorline.operators import periods as P
from rotorline.operators import quality as Q
from rotorline.operators import scoring as C
from tests.helpers import at, ordered, segment

N, W, A = "NORMAL", "WARNING", "ALARM"


def alarm_rows(spark, statuses, times=None):
    times = times or [60 * i for i in range(len(statuses))]
    rows = [(1, at(0).date(), at(t), s) for s, t in zip(statuses, times)]
    return spark.createDataFrame(rows, "pump_id int, date date, ts timestamp, status string")


@pytest.mark.parametrize("statuses, n, shown", [
    ([W], 2, [N]), ([A], 2, [N]), ([W, W], 2, [N, W]), ([A, A], 2, [N, A]), ([W, N, W], 2, [N, N, N]),
    ([A], 1, [A]), ([A, A, A], 2, [N, A, A]),
])
def test_spike_filter(spark, statuses, n, shown):
    out = U.spike_filter(alarm_rows(spark, statuses), n=n)
    assert [r[0] for r in ordered(out, "filtered_status")] == shown


@pytest.mark.parametrize("statuses, times, fired", [
    ([A], [0], [1]), ([A, A], [0, 10], [1, 0]), ([A, A], [0, 3600], [1, 1]), ([W], [0], [0]), ([A, N, A], [0, 10, 20], [1, 0, 1]),
])
def test_rate_limit(spark, statuses, times, fired):
    out = U.rate_limit(U.spike_filter(alarm_rows(spark, statuses, times), n=1), 3600, n=1)
    assert [r[0] for r in ordered(out, "alert_fired")] == fired


def test_session_and_day_flags(spark):
    steps = U.spike_filter(alarm_rows(spark, [W, W, W, W, N]), n=2)
    assert [r[0] for r in ordered(U.session_counter(steps), "session_flagged")] == [0, 0, 0, 1, 1]
    assert U.day_flags(steps).first()["flagged"] == 1


@pytest.mark.parametrize("r, s, p, m, low, high", [
    (0.0, 1.0, 2.33, 0.0, 90, 100), (2.33, 1.0, 2.33, 0.0, 40, 60), (4.66, 1.0, 2.33, 0.0, 0, 10),
    (1.4, 3.15, 8.93, 1.4, 90, 100), (4.8, 3.15, 8.93, 0.61, 70, 100), (100.0, 1.0, 2.33, 0.0, 0, 1), (0.5, 0.0, 0.0, 0.0, 0, 100),
])
def test_channel_health(spark, r, s, p, m, low, high):
    df = spark.range(1).select(X.channel_health(*[F.lit(v) for v in (r, s, p, m)]).alias("h"))
    h = df.first()["h"]
    assert low <= h <= high and np.isfinite(h)


def test_channel_health_days(spark):
    rows = [(1, at(0).date(), at(60 * i), "c", h, z) for i, (h, z) in enumerate(((80.0, 0.5), (30.0, 2.0), (60.0, 1.0)))]
    df = spark.createDataFrame(rows, "pump_id int, date date, ts timestamp, channel string, health double, z double")
    d = C.channel_health_days(df).first()
    assert round(d["mean_health"], 2) == 56.67 and d["min_health"] == 30 and round(d["mean_z"], 4) == 1.1667
    assert d["max_z"] == 2 and d["n_low"] == 1


@pytest.mark.parametrize("scores, alpha, expected", [
    (range(1, 20), 0.05, 19), (range(1, 101), 0.05, 96), (range(1, 1001), 0.05, 951), ([5], 0.05, 5), ([3.14] * 50, 0.05, 3.14),
    (range(1, 101), 0.10, 91),
])
def test_conformal_quantile(spark, scores, alpha, expected):
    df = spark.createDataFrame([("g", float(s)) for s in scores], "k string, s double")
    assert K.conformal_quantile(df, ["k"], "s", alpha).first()["conformal"] == pytest.approx(expected)


def test_conformal_coverage(spark):
    got = spark.range(1).select(K.conformal_coverage(F.lit(100), 0.05).alias("c")).first()["c"]
    assert got == pytest.approx(96 / 101)


def test_conformal_exceedance(spark):
    """Fresh scores exceed the conformal threshold at about the nominal rate."""
    rng = np.random.default_rng(7)
    trials = 2000
    rows = [(t, float(v)) for t in range(trials) for v in rng.normal(size=60)]
    df = spark.createDataFrame(rows, "t int, s double")
    q = {r["t"]: r["conformal"] for r in K.conformal_quantile(df, ["t"], "s", 0.05).collect()}
    fresh = rng.normal(size=trials)
    assert 0.02 <= np.mean([fresh[t] > q[t] for t in range(trials)]) <= 0.07


def test_status_matrix_and_missing_level(spark):
    pairs = [(a, b) for a in (N, W, A) for b in (N, W, A, None)]
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("f", X.fuse(F.col("a"), F.col("b")))
    for r in df.collect():
        expected = r["a"] if r["b"] is None else max((r["a"], r["b"]), key=(N, W, A).index)
        assert r["f"] == expected


def test_status_order_is_checked(spark):
    df = spark.range(1).select(X.status_of(F.lit(1.0), F.lit(2.0), F.lit(1.0)).alias("s"))
    with pytest.raises(Exception, match="alarm threshold"):
        df.collect()


def test_severity_and_health(spark):
    df = spark.range(1).select(
        X.severity(F.lit(5.0), F.lit(2.0)).alias("a"), X.severity(F.lit(1.0), F.lit(0.0)).alias("b"),
        X.combined_severity(F.lit(0.5), F.lit(1.0)).alias("c"), X.combined_severity(F.lit(0.5), F.lit(None).cast("double")).alias("d"),
        X.health(F.lit(1.0), F.lit(2.0), F.lit(1.5)).alias("e"), X.combined_health(F.lit(80.0), F.lit(20.0)).alias("f"),
        X.health(F.lit(3.0), F.lit(2.0), F.lit(4.0)).alias("g"),
    ).first()
    assert (df["a"], df["b"], df["c"], df["d"], df["e"], df["f"], df["g"]) == (2.0, 0.0, 1.15, 0.5, 100.0, 44.0, 50.0)


def test_season_map(spark):
    df = spark.sql("SELECT explode(sequence(1, 12)) AS m").select(X.season_of(F.make_date(F.lit(2024), "m", F.lit(5))).alias("s"), "m")
    got = {r["m"]: r["s"] for r in df.collect()}
    assert got == {12: "winter", 1: "winter", 2: "winter", 3: "spring", 4: "spring", 5: "spring", 6: "summer", 7: "summer",
                   8: "summer", 9: "autumn", 10: "autumn", 11: "autumn"}


def _cfg(**kw):
    return QualityConfig(sensors={"x": SensorRule(0, 100, True, False)}, **kw)


def test_frozen_run(spark):
    """Thirteen equal values: twelve differences are zero, so the first row is not flagged."""
    out = Q.label(segment(spark, [7.0] * 13), _cfg())
    assert [r[0] for r in ordered(out, "x_quality")] == [0] + [5] * 12
    broken = Q.label(segment(spark, [7.0] * 6 + [None] + [7.0] * 6), _cfg())
    assert [r[0] for r in ordered(broken, "x_quality")] == [0] * 6 + [2] + [0] * 6


def test_gap_codes_first_and_all(spark):
    df = segment(spark, [1.0, 2.0], times=[0, 900]).withColumn("y", F.col("x"))
    cfg = QualityConfig(sensors={"x": SensorRule(), "y": SensorRule()})
    assert ordered(Q.label(df, cfg), "x_quality", "y_quality") == [(0, 0), (1, 2), (1, 2), (0, 0)]
    both = Q.label(df, replace(cfg, missing_code="all"))
    assert ordered(both, "x_quality", "y_quality") == [(0, 0), (1, 1), (1, 1), (0, 0)]


def test_off_grid_rows_stay(spark):
    out = Q.fill_gaps(segment(spark, [1.0, 2.0, 3.0], times=[0, 400, 900]), 300)
    assert ordered(out, "x", "inserted") == [(1.0, False), (None, True), (2.0, False), (None, True), (3.0, False)]


def test_all_null_column_stops_early(spark):
    out = Q.label(segment(spark, [None, None, None]), _cfg())
    assert [r[0] for r in ordered(out, "x_quality")] == [2, 2, 2]


def test_sentinel_rules(spark):
    df = spark.createDataFrame([(246.0, 246.0, 1.0), (246.0, 2.0, 3.0), (246.001, 246.0, 1.0)], "a double, b double, c double")
    hits = [r[0] for r in df.select(Q.is_sentinel(df, ["a", "b", "c"], 246.0, 2)).collect()]
    assert hits == [True, False, True]
    assert [r[0] for r in df.select(Q.is_sentinel(df, ["a", "b", "c"], 246.0, 4)).collect()] == [False] * 3
    assert [r[0] for r in df.select(Q.is_sentinel(df, ["a", "b", "c"], 246.0, 0)).collect()] == [True] * 3


def _period_cfg(**kw):
    base = dict(speed_on_threshold=500.0, gap_merge_threshold=600.0, min_period_duration=0.0, ramp_exclude_seconds=300.0)
    return SystemConfig(thresholds=Thresholds(**{**base, **kw}))


@pytest.mark.parametrize("extra, n", [(600, 1), (601, 2)])
def test_gap_merge(spark, extra, n):
    """Runs of 60 s data separated by one interval plus 600 s merge, 601 s do not."""
    first = [i * 60 for i in range(10)]
    second = [first[-1] + 60 + extra + i * 60 for i in range(10)]
    stop = [first[-1] + 60]
    df = segment(spark, [900.0] * 10 + [0.0] + [900.0] * 10, times=first + stop + second, column="speed")
    out = P.detect_periods(df, _period_cfg()).collect()
    # The stopped row counts when it lies inside a merged gap.
    assert len(out) == n and sum(r["n_rows"] for r in out) == (21 if n == 1 else 20)


def test_steady_middle_half(spark):
    """A short period falls back to the middle half of its rows."""
    df = segment(spark, [900.0] * 8, step=60, column="speed").withColumn("motor_current", F.lit(1.0)).withColumn("outlet_pressure", F.lit(1.0))
    rows = P.period_rows(df, _period_cfg())
    assert [r[0] for r in ordered(rows, "steady")] == [False, False, True, True, True, True, False, False]


def test_rolling_drift_rules(spark):
    rows = [(1, f"2024-01-{d:02d}", 2.0, 1.0, "", "NORMAL") for d in range(1, 16)]
    log = spark.createDataFrame(rows, "pump_id int, date string, l1_mean double, l2_mean double, season string, day_status string")
    log = log.withColumn("date", F.to_date("date"))
    training = spark.createDataFrame([("l1_mahalanobis", 1.6), ("l2_smoothed_mse", 0.0)], "metric string, training_mean double")
    got = {r["metric"]: (r["level"], r["drift"]) for r in M.drift(log, training).collect()}
    assert got["l1_mahalanobis"][0] == "WARNING" and got["l2_smoothed_mse"] == ("CRITICAL", float("inf"))
    assert M.drift(log.limit(14), training).count() == 0


def test_smoothing_is_per_day(spark):
    rng = np.random.default_rng(1)
    rows = []
    for d, level in ((0, 10.0), (1, 20.0)):
        for i in range(20):
            t = at(86400 * d + 600 * i)
            rows.append((1, t.date(), t, float(level + rng.normal(0, 0.3))))
    short = at(86400 * 2)
    rows += [(1, short.date(), at(86400 * 2 + 600 * i), 5.0) for i in range(3)]
    df = spark.createDataFrame(rows, "pump_id int, date date, ts timestamp, x double")
    per_day = FE.smooth(df, ["x"])
    assert per_day.count() == 40
    whole = FE.smooth(df.where("x > 6"), ["x"], keys=("pump_id",))
    joined = per_day.alias("a").join(whole.alias("b"), ["pump_id", "ts"]).select(F.max(F.abs(F.col("a.x") - F.col("b.x"))).alias("m"))
    assert joined.first()["m"] > 0.01


def test_threshold_chain(spark):
    rows = [("winter", 1, 1.0, False), ("winter", 2, 2.0, True), ("winter", -1, 3.0, False), ("all", 1, 4.0, False), ("all", 2, 5.0, True), ("all", -1, 6.0, False)]
    blocks = spark.createDataFrame(rows, "scope_season string, scope_pump int, warning double, fallback boolean")
    keys = spark.createDataFrame([(1, "winter"), (2, "winter"), (1, "summer"), (2, "summer"), (9, "summer")], "pump_id int, season string")
    got = {(r["pump_id"], r["season"]): r["warning"] for r in K.resolve_blocks(keys, blocks, ["warning"]).collect()}
    assert got == {(1, "winter"): 1.0, (2, "winter"): 3.0, (1, "summer"): 4.0, (2, "summer"): 6.0, (9, "summer"): 6.0}


def test_weak_pump_falls_back_and_merge_keeps_other_fields(spark):
    rng = np.random.default_rng(3)
    rows = [(1, float(a), float(b)) for a, b in rng.normal(size=(60, 2))] + [(2, float(a), float(b)) for a, b in rng.normal(size=(10, 2))]
    res = spark.createDataFrame(rows, "pump_id int, res_a double, res_b double")
    blocks = K.calibrate(res, ["a", "b"])
    got = {r["scope_pump"]: r for r in blocks.collect()}
    assert not got[1]["fallback"] and got[2]["fallback"] and got[2]["warning"] == got[-1]["warning"]
    assert got[1]["cov_inv"]["a"]["b"] == 0.0 and got[-1]["cov_inv"]["a"]["b"] != 0.0
    d = res.withColumns({"distance": F.abs("res_a"), "season": F.lit("winter")})
    merged = K.merge_conformal(blocks, K.conformal_blocks(d).where("scope_pump = 1"))
    assert {r["scope_pump"]: r["conformal_quantile"] is not None for r in merged.collect()} == {1: True, 2: False, -1: False}
    assert set(blocks.columns) < set(merged.columns)


def test_zero_range_normalises_to_zero(spark):
    df = segment(spark, [4.0, 4.0, 4.0])
    out = FE.normalize(df, FE.norm_params(df, ["x"]), ["x"], "min-max")
    assert [r[0] for r in ordered(out, "x")] == [0.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        FE.normalize(df, FE.norm_params(df, ["x"]), ["x"], "log")
    with pytest.raises(ValueError):
        FE.normalize(df, FE.norm_params(df, ["x"]), ["y"])


def test_recalibration_reason(spark):
    df = spark.sql("SELECT date'2024-04-10' d").select(
        M.recalibration_reason(F.col("d"), F.lit("2024-01-01").cast("date"), F.lit(0), F.lit(False)).alias("a"),
        M.recalibration_reason(F.col("d"), F.lit("2024-03-01").cast("date"), F.lit(0), F.lit(False)).alias("b"),
        M.recalibration_reason(F.col("d"), F.lit("2024-03-01").cast("date"), F.lit(2), F.lit(False)).alias("c"),
        M.recalibration_reason(F.col("d"), F.lit("2024-03-01").cast("date"), F.lit(2), F.lit(True)).alias("e"),
    ).first()
    assert tuple(df) == ("quarterly", "none", "drift_alert", "post_maintenance")
