"""Operators against short brute-force computations on seeded random data."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from rotorline.config import Columns, SystemConfig, Thresholds
from rotorline.functions.asof import asof_join
from rotorline.functions.ordered import auc_of, best_f1, exact_quantiles, roc_table, running_totals, youden
from rotorline.functions.series import ema, runs
from rotorline.operators import calibration
from rotorline.operators import evaluation as E
from rotorline.operators import features as FE
from rotorline.operators import outliers as O
from tests.helpers import at, ordered, segment


@pytest.mark.parametrize("seed", range(3))
def test_runs(spark, seed):
    flags = np.random.default_rng(seed).random(60) < 0.6
    df = segment(spark, flags.astype(float))
    got = ordered(runs(df, {"on": F.col("x") == 1}), "on", "on_pos", "on_len")
    expected, start = [], 0
    for i, f in enumerate(flags):
        if not f:
            expected.append((False, None, None))
            continue
        start = i if i == 0 or not flags[i - 1] else start
        end = next((j for j in range(i, len(flags)) if not flags[j]), len(flags))
        expected.append((True, i - start + 1, end - start))
    assert got == expected


def fold(x, alpha=0.3, first=None):
    out = []
    for v in x:
        out.append((v if first is None else first) if not out else alpha * v + (1 - alpha) * out[-1])
    return out


@pytest.mark.parametrize("block", [4, 7, 256])
def test_ema_blocks(spark, block):
    x = np.random.default_rng(5).random(50)
    got = [r[0] for r in ordered(ema(segment(spark, x), "x", "e", block_rows=block), "e")]
    assert np.allclose(got, fold(x), rtol=1e-12)
    seeded = [r[0] for r in ordered(ema(segment(spark, x), "x", "e", block_rows=block, seed=F.lit(9.0)), "e")]
    assert np.allclose(seeded, fold(x, first=9.0), rtol=1e-12)


@pytest.mark.parametrize("alpha", [0.95, 0.999, 1.0])
def test_ema_fast_decay(spark, alpha):
    x = np.random.default_rng(7).random(400)
    got = [r[0] for r in ordered(ema(segment(spark, x), "x", "e", alpha=alpha, seed=F.lit(9.0)), "e")]
    assert np.allclose(got, fold(x, alpha, first=9.0), rtol=1e-10)


@pytest.mark.parametrize("alpha", [0.3, 0.001])
def test_ema_of_a_million_rows_of_one_pump(spark, alpha):
    n = 1_000_000
    rows = spark.range(n).select(
        F.lit(1).alias("pump_id"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 7).alias("ts"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 100.0).alias("x"))
    rows = rows.withColumn("date", F.to_date("ts"))
    frame = ema(rows, "x", "e", ["pump_id"], alpha=alpha, long_series=True)
    assert "collect_list" not in frame._jdf.queryExecution().toString()
    got = frame.where("unix_seconds(ts) % 999 = 0").select(((F.unix_seconds("ts") - 1_704_067_200) / 7).cast("long").alias("i"), "e").collect()
    x = [r.x for r in rows.orderBy("ts").select("x").collect()]
    state, want = x[0], {}
    for i, v in enumerate(x):
        state = v if i == 0 else alpha * v + (1 - alpha) * state
        want[i] = state
    assert len(got) > 900 and all(r.e == pytest.approx(want[r.i], rel=1e-9) for r in got)


def test_ema_long_series(spark):
    """A whole pump chained over days; longer than the closed form could reach."""
    rng = np.random.default_rng(6)
    rows, x = [], rng.random(3000)
    for i, v in enumerate(x):
        t = at(900 * i)
        rows.append((1, t.date(), t, float(v)))
    df = spark.createDataFrame(rows, "pump_id int, date date, ts timestamp, x double")
    got = [r[0] for r in ordered(ema(df, "x", "e", ["pump_id"], long_series=True, block_rows=40), "e")]
    assert np.allclose(got, fold(x), rtol=1e-10)


def hot_frame(spark, n=4000, seed=2):
    """A third of the rows on one key and one value."""
    rng = np.random.default_rng(seed)
    keys = np.where(rng.random(n) < 0.4, 0, rng.integers(0, 5, n))
    vals = np.where(rng.random(n) < 0.33, 1.5, np.round(rng.normal(size=n), 3))
    rows = [(int(k), float(v), bool(b)) for k, v, b in zip(keys, vals, rng.random(n) < 0.3)]
    return spark.createDataFrame(rows, "k int, v double, bad boolean"), rows


@pytest.mark.parametrize("narrow", [False, True])
def test_quantiles_and_running_totals(spark, narrow):
    df, rows = hot_frame(spark)
    if narrow:  # one key with all values close together, the others far away
        rows = [(k, v / 1e6 if k == 0 else v, b) for k, v, b in rows]
        df = spark.createDataFrame(rows, "k int, v double, bad boolean")
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", {"a": 0.01, "b": 0.5, "c": 0.987}).collect()}
    for k in got:
        v = [r[1] for r in rows if r[0] == k]
        assert np.allclose([got[k]["a"], got[k]["b"], got[k]["c"]], np.quantile(v, [0.01, 0.5, 0.987]))
    totals = running_totals(df, ["k"], "v", {"n": F.lit(1)}).collect()
    for r in totals[:200]:
        assert r["cum_n"] == sum(1 for x in rows if x[0] == r["k"] and x[1] <= r["v"])


def test_auc_youden_f1_with_ties(spark):
    df, rows = hot_frame(spark, 600)
    table = roc_table(df, ["k"], "v", F.col("bad"))
    auc = {r["k"]: r["auc_roc"] for r in auc_of(table, ["k"]).collect()}
    j = {r["k"]: r for r in youden(table, ["k"]).collect()}
    f1 = {r["k"]: r for r in best_f1(table, ["k"]).collect()}
    for k in auc:
        p = np.array([r[1] for r in rows if r[0] == k and r[2]])
        n = np.array([r[1] for r in rows if r[0] == k and not r[2]])
        wins = (p[:, None] > n[None, :]).sum() + 0.5 * (p[:, None] == n[None, :]).sum()
        assert auc[k] == pytest.approx(wins / (len(p) * len(n)))
        scores = sorted(set(p) | set(n), reverse=True)
        gain = [round((p >= s).mean() - (n >= s).mean(), 12) for s in scores]
        assert j[k]["threshold"] == scores[int(np.argmax(gain))]
        best = [round(2 * (p >= s).sum() / ((p >= s).sum() + (n >= s).sum() + len(p)), 12) for s in scores[::-1]]
        assert f1[k]["threshold"] == scores[::-1][int(np.argmax(best))]


@pytest.mark.parametrize("direction", ["nearest", "backward"])
@pytest.mark.parametrize("slot", [None, 100.0])
def test_asof(spark, direction, slot):
    rng = np.random.default_rng(11)
    lt, rt = sorted(rng.integers(0, 5000, 120).tolist()), sorted(set(rng.integers(0, 5000, 60).tolist()))
    tol = 45
    left = spark.createDataFrame([(1, at(t), i) for i, t in enumerate(lt)], "k int, ts timestamp, i int")
    right = spark.createDataFrame([(1, at(t), float(t)) for t in rt], "k int, ts timestamp, v double")
    got = {r["i"]: r["v"] for r in asof_join(left, right, ["k"], ["v"], tol, direction=direction, slot_seconds=slot).collect()}
    for i, t in enumerate(lt):
        near = [r for r in rt if (r <= t or direction == "nearest") and abs(r - t) <= tol]
        expected = min(near, key=lambda r: (abs(r - t), r)) if near else None
        assert got[i] == (None if expected is None else float(expected))
    assert len(got) == len(lt)


def test_smoothing_weights(spark):
    x = np.random.default_rng(8).normal(size=12)
    expected = np.empty(12)
    for i in range(12):
        lo = min(max(i - 2, 0), 7)
        fit = np.polyfit(np.arange(lo, lo + 5), x[lo:lo + 5], 2)
        expected[i] = np.polyval(fit, i)
    got = [r[0] for r in ordered(FE.smooth(segment(spark, x), ["x"]), "x")]
    assert np.allclose(got, expected)


def test_histories(spark):
    x = np.arange(6.0)
    padded = [r[0] for r in ordered(FE.padded_history(segment(spark, x), ["x"], 3), "window")]
    assert padded[0] == [0, 0, 0] and padded[1] == [0, 0, 1] and padded[5] == [3, 4, 5]
    skipped = [r[0] for r in ordered(FE.full_history(segment(spark, x), ["x"], 3), "window")]
    every = [r[0] for r in ordered(FE.full_history(segment(spark, x), ["x"], 3, skip_first=False), "window")]
    assert skipped == [[1, 2, 3], [2, 3, 4], [3, 4, 5]] and every == [[0, 1, 2], *skipped]


def test_split_properties(spark):
    rows = [(p, at(86400 * d).date(), "abnormal" if d % 3 == 0 else "normal") for p in (1, 2, 3) for d in range(60)]
    days = spark.createDataFrame(rows, "pump_id int, date date, label string")
    parts = FE.split_days(days, {"a": 0.7, "b": 0.3}, ["pump_id", "label"])
    once, again = parts.collect(), FE.split_days(days.repartition(3), {"a": 0.7, "b": 0.3}, ["pump_id", "label"]).collect()
    assert sorted(once) == sorted(again) and len(once) == 180
    for p in (1, 2, 3):
        for label, n in (("normal", 40), ("abnormal", 20)):
            assert sum(r["part"] == "a" for r in once if (r["pump_id"], r["label"]) == (p, label)) == round(0.7 * n)
    other = FE.split_days(days, {"a": 0.7, "b": 0.3}, ["pump_id", "label"], seed=1).collect()
    assert sorted(other) != sorted(once)


def test_multiplier_search_matches_exhaustive(spark):
    """T17: n^2 evaluations give what all n^4 combinations give."""
    rng = np.random.default_rng(4)
    rows = [(p, at(86400 * d).date(), "abnormal" if d % 2 else "normal", float(rng.gamma(2, 1 + d % 2)), None if rng.random() < 0.2 else float(rng.gamma(2, 1)))
            for p in (1, 2) for d in range(8) for _ in range(12)]
    steps = spark.createDataFrame(rows, "pump_id int, date date, label string, l1 double, l2 double")
    th = {1: (3.0, 3.5, 3.2, 3.4), 2: (4.0, 5.0, 2.8, 3.6)}
    limits = spark.createDataFrame([(p, *v) for p, v in th.items()], "pump_id int, l1_warning double, l1_alarm double, l2_warning double, l2_alarm double")
    grid, k = E.multiplier_grid(3), 3

    def flags(m):
        out = {}
        for p, d, label, a, b in rows:
            w1, a1, w2, a2 = (t * x for t, x in zip(th[p], m))
            s1 = 2 if a >= a1 else int(a >= w1)
            s2 = 0 if b is None else 2 if b >= a2 else int(b >= w2)
            key = (p, d, label)
            out[key] = out.get(key, 0) + int(max(s1, s2) >= 1)
        return {key: n >= k for key, n in out.items()}

    def det(f, p):
        hits = [v for (q, _, label), v in f.items() if q == p and label == "abnormal"]
        return sum(hits) / len(hits)

    base = flags((1, 1, 1, 1))
    expected = set()
    for m in np.array(np.meshgrid(grid, grid, grid, grid)).T.reshape(-1, 4):
        w1, a1, w2, a2 = m
        if any(t[0] * w1 >= t[1] * a1 or t[2] * w2 >= t[3] * a2 for t in th.values()):
            continue
        f = flags((w1, a1, w2, a2))
        if all(det(f, p) >= det(base, p) for p in th):
            fa = [v for (_, _, label), v in f.items() if label == "normal"]
            expected.add((*np.round(m, 6), round(sum(fa) / len(fa), 6)))
    got = {tuple(round(r[c], 6) for c in ("l1_mult", "l1_alarm_mult", "l2_mult", "l2_alarm_mult", "fa_rate"))
           for r in E.multiplier_search(steps, limits, 3, k).collect()}
    assert got == expected and got


def test_isolation_forest_ranks_outliers_first(spark):
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(size=(300, 3)), rng.normal(8, 0.5, size=(5, 3))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, v array<double>")
    out = O.isolation_forest(df, df, "v", ["id"], n_trees=50)
    top = {r["id"] for r in out.orderBy(F.desc("forest_score")).limit(5).collect()}
    assert top == set(range(300, 305))
    again = {r["id"]: r["forest_score"] for r in O.isolation_forest(df.repartition(3), df, "v", ["id"], n_trees=50).collect()}
    assert again == {r["id"]: r["forest_score"] for r in out.collect()}


def test_lof_brute_force(spark):
    rng = np.random.default_rng(10)
    x = np.vstack([rng.normal(size=(80, 2)), [[9.0, 9.0]]])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, v array<double>")
    got = {r["id"]: r["lof"] for r in O.local_outlier_factor(df, df, "v", ["id"], k=5).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    own = d + np.diag([np.inf] * len(x))
    nb = np.argsort(own, axis=1)[:, :5]
    kd = np.take_along_axis(own, nb, 1)[:, -1]
    lrd = 1 / (np.maximum(np.take_along_axis(own, nb, 1), kd[nb]).mean(1) + 1e-10)
    nn = np.argsort(d, axis=1, kind="stable")[:, :5]
    new = 1 / (np.maximum(np.take_along_axis(d, nn, 1), kd[nn]).mean(1) + 1e-10)
    assert np.allclose([got[i] for i in range(len(x))], lrd[nn].mean(1) / new - 1.5)
    assert max(got, key=got.get) == 80


def test_pca_reconstruction(spark):
    rng = np.random.default_rng(12)
    base = rng.normal(size=(200, 1)) @ np.array([[1.0, 2.0, -1.0]])
    x = np.vstack([base + rng.normal(0, 0.01, base.shape), [[5.0, -5.0, 5.0]]])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, v array<double>")
    out = O.pca_reconstruction(df.where("id < 200"), df, "v").orderBy(F.desc("pca_error")).first()
    assert out["id"] == 200


def test_outlier_vote_is_unanimous(spark):
    """A far period collects three votes, the crowd does not."""
    from rotorline.config import Columns, SystemConfig

    cfg = SystemConfig(columns=Columns(speed="s", current="c", pressure="p", temps=("t1", "t2"), vibrations=("v",)))
    names = O.vote_columns(cfg)
    assert names == ["mean_s", "mean_c", "mean_ratio", "mean_p", "mean_t1", "mean_t2", "mean_v", "max_v"]
    rng = np.random.default_rng(13)
    x = np.vstack([rng.normal(size=(200, 8)), np.full((1, 8), 9.0)])
    rows = [(i, *[float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{n} double" for n in names))
    votes = {r["id"]: r["vote_lof"] + r["vote_forest"] + r["vote_mahalanobis"] for r in O.period_votes(df, names, ["id"], F.col("id") < 200, 30.0, 0.6).collect()}
    assert votes[200] == 3 and sum(v == 3 for v in votes.values()) <= 3


def test_gaps_longer_than_a_day_of_seconds(spark):
    from rotorline.operators.quality import fill_gaps

    df = spark.createDataFrame([(1, at(0).date(), at(t), 1.0) for t in (0, 46_800)], "pump_id int, date date, ts timestamp, x double")
    out = fill_gaps(df, 0.5)
    assert out.count() == 93_601 and out.where("not inserted").count() == 2
    assert out.select("ts").distinct().count() == 93_601


@pytest.mark.parametrize("seed", range(3))
def test_rows_of_periods_by_the_rule(spark, seed):
    """Which rows belong to which period, near-period rows included, against every pair of row and period."""
    from rotorline.operators import periods

    rng = np.random.default_rng(seed)
    rows = []
    for pump in (1, 2, 3):
        t, on = 0, False
        for _ in range(160):
            t += int(rng.choice([60, 60, 60, 120, 900]))
            on = on != (rng.random() < 0.15)
            rows.append((pump, t, float(rng.choice([900.0, 1000.0])) if on else float(rng.choice([0.0, 0.0, 100.0])), float(rng.normal(5, 1))))
    th = Thresholds(min_period_duration=240.0, gap_merge_threshold=150.0, off_window_seconds=1500.0, near_period_seconds=180.0)
    cfg = SystemConfig(columns=Columns(pressure_off="outlet_pressure"), thresholds=th)
    df = spark.createDataFrame([(p, at(t), v, v / 10, x) for p, t, v, x in rows], "pump_id int, ts timestamp, speed double, motor_current double, outlet_pressure double").withColumn("date", F.lit(date(2024, 1, 2)))
    found = {}
    for r in periods.detect_periods(df, cfg).collect():
        found.setdefault(r["pump_id"], []).append((r["period_id"], r["start"], r["end"]))
    assert sum(map(len, found.values())) > 5
    want, off = set(), {}
    for pump, own in found.items():
        mine = [(at(t), v, x) for p, t, v, x in rows if p == pump]
        for pid, start, end in own:
            earlier = [t for t, v, _ in mine if v > 500 and t < start]
            for t, _, _ in mine:
                after_on = not earlier or t >= earlier[-1] + timedelta(seconds=180)
                if t <= end + timedelta(seconds=1500) and (t >= start - timedelta(seconds=1500) or after_on):
                    want.add((pump, t, pid))
        near = timedelta(seconds=180)
        off[pump] = [x for t, v, x in mine if v == 0 and not any(a - near <= t <= b + near for _, a, b in own)]
    joined = periods.period_rows(df, cfg).collect()
    assert {(r["pump_id"], r["ts"], r["period_id"]) for r in joined} == want and len(joined) == len(want)
    for r in joined:
        assert r["segment_off_rows"] == len(off[r["pump_id"]])
        assert r["segment_pressure_off"] == (pytest.approx(np.mean(off[r["pump_id"]])) if off[r["pump_id"]] else None)


def test_scope_moments_equal_those_of_copied_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(int(p), str(s), float(x), float(x * 0.5 + y + 1000)) for p, s, x, y in zip(rng.integers(1, 4, 300), rng.choice(["winter", "summer"], 300), rng.normal(50, 3, 300), rng.normal(size=300), strict=True)]
    rows.append((9, "spring", 1.0, 2.0))
    df = spark.createDataFrame(rows, "pump_id int, season string, res_a double, res_b double")
    for seasonal in (False, True):
        plain = {r[:2]: r for r in calibration.covariance(calibration.with_scopes(df, seasonal), ["a", "b"]).collect()}
        pooled = {r[:2]: r for r in calibration.scope_moments(df, ["a", "b"], seasonal).collect()}
        assert plain.keys() == pooled.keys() and len(plain) == (15 if seasonal else 5)
        for k, p in plain.items():
            for name in p.asDict():
                assert pooled[k][name] == (pytest.approx(p[name], rel=1e-9, abs=1e-9) if isinstance(p[name], float) else p[name]), (k, name)


def test_multiplier_grid_equals_counting(spark):
    rng = np.random.default_rng(4)
    rows = [(1 + i % 2, date(2024, 1, 1 + i % 5), "normal" if i % 5 else "abnormal", float(rng.uniform(0, 3)), None if i % 17 == 0 else float(rng.uniform(0, 3))) for i in range(200)]
    steps = spark.createDataFrame(rows, "pump_id int, date date, label string, l1 double, l2 double")
    th = spark.createDataFrame([(1, 1.0, 1.5), (2, 1.2, 1.1)], "pump_id int, l1_warning double, l2_warning double")
    ms, base = [0.5, 1.0, 2.0], {1: (1.0, 1.5), 2: (1.2, 1.1)}
    got = {(r["pump_id"], r["date"], r["l1_mult"], r["l2_mult"]): r["flagged"] for r in E.day_alerts(E.step_histogram(steps, th, ms), ms, 6).collect()}
    want = {}
    for a in ms:
        for b in ms:
            for p, d, _, x, y in rows:
                hit = x >= base[p][0] * a or y is not None and y >= base[p][1] * b
                want[p, d, a, b] = want.get((p, d, a, b), 0) + hit
    assert got == {k: int(n >= 6) for k, n in want.items()}


def test_pca_error_equals_numpy(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 6)) @ np.diag([5, 4, 1, 0.3, 0.2, 0.1]) @ rng.normal(size=(6, 6)) + 7
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    train = x[:200]
    mean, std = train.mean(0), train.std(0, ddof=1)
    z = (train - mean) / std
    value, vector = np.linalg.eigh(np.cov(z.T))
    value, vector = value[::-1], vector[:, ::-1]
    basis = vector[:, :int(np.searchsorted(np.cumsum(value) / value.sum(), 0.95)) + 1]
    every = (x - mean) / std
    want = np.abs(every - every @ basis @ basis.T).mean(1)
    got = {r["id"]: r["pca_error"] for r in O.pca_reconstruction(df.where("id < 200"), df, "v").collect()}
    assert all(got[i] == pytest.approx(w, abs=1e-8) for i, w in enumerate(want))


def test_linear_conditions_equal_least_squares(spark):
    from rotorline.operators.scoring import LinearConditions

    rng = np.random.default_rng(9)
    rows = [(p, date(2024, 1, 2), at(300 * i), float(a), float(b)) for p in (1, 2) for i, (a, b) in enumerate(rng.normal(50, 9, (60, 2)))]
    df = spark.createDataFrame(rows, "pump_id int, date date, ts timestamp, speed double, current double").withColumn("flow", F.col("speed") * 0.3 - F.col("current") * 0.1 + F.sin(F.col("speed")))
    hist = FE.padded_history(df, ["speed", "current"], 3, out="_h").select("pump_id", "ts", "_h", "flow").collect()
    x = np.array([[1.0, *r["_h"]] for r in hist])
    want = dict(zip([(r["pump_id"], r["ts"]) for r in hist], x @ np.linalg.lstsq(x, np.array([r["flow"] for r in hist]), rcond=None)[0], strict=True))
    got = LinearConditions(["speed", "current"], ["flow"]).fit(df).transform(df).collect()
    assert len(got) == 120 and all(r["pred_flow"] == pytest.approx(want[r["pump_id"], r["ts"]], rel=1e-4) for r in got)
