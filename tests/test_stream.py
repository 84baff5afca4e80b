"""The streaming detector: bounded = unbounded buffer, any batches = sequential steps, late rows, restart, reset, hand-over."""

from __future__ import annotations


import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rotorline.streaming import jobs
from rotorline.streaming.detector import Detector, detect_stream, stored_state
from rotorline.streaming.step import DAY_US, NEAR_US, PumpState, StepConfig, smooth_day, step, steps

US0 = 1_704_153_600_000_000  # 2024-01-02 UTC


def unbounded(rows, cfg):
    """Replay the whole buffer at every step, as the rules are written."""
    out, ema = [], None
    for k in range(1, len(rows) + 1):
        buffer = rows[:k]
        raw = None
        if k >= cfg.history:
            x = np.array([v for _, v in buffer], dtype=float)
            ahead = x.copy()
            ahead[1:] = np.where(np.isnan(x[1:]), x[:-1], x[1:])
            back = ahead.copy()
            back[:-1] = np.where(np.isnan(ahead[:-1]), ahead[1:], ahead[:-1])
            full = np.where(np.isnan(back), cfg.means, back)
            us = np.array([t for t, _ in buffer])
            frames, times = [], []
            for day in dict.fromkeys((us // DAY_US).tolist()):
                pick = us // DAY_US == day
                if pick.sum() >= 5:
                    frames.append(smooth_day(full[pick]))
                    times.append(us[pick])
            if frames:
                at, frame = np.concatenate(times), np.vstack(frames)
                near = int(np.argmin(np.abs(at - us[-1])))
                if abs(at[near] - us[-1]) <= NEAR_US and near >= cfg.history - 1:
                    w = (frame[near - cfg.history + 1:near + 1] - cfg.base) / cfg.span
                    raw = float((w**2).mean())
                    ema = 0.5 if ema is None else 0.3 * raw + 0.7 * ema
        out.append((raw, ema if raw is not None else None))
    return out


def make_rows(seed, n=120, channels=2):
    rng = np.random.default_rng(seed)
    rows, us = [], US0
    for _ in range(n):
        us += 300_000_000 if rng.random() < 0.93 else int(rng.integers(1, 90)) * 900_000_000
        v = rng.normal(size=channels)
        v[rng.random(channels) < 0.15] = np.nan
        rows.append((us, v))
    return rows


def config(history):
    return StepConfig(history, np.array([0.1, -0.1]), np.array([1.2, 0.8]), np.array([0.05, 0.02]))


BASE = {"l1_valid": True, "l1_status": "NORMAL", "l1_health": 90.0, "l2_warning": 1.0, "l2_alarm": 1.5, "l2_mean": 0.5}


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("history", [3, 6, 13])
def test_bounded_buffer_equals_unbounded(seed, history):
    rows, cfg = make_rows(seed), config(history)
    state, got = PumpState(), []
    for us, v in rows:
        r = step(state, cfg, {**BASE, "us": us, "values": v})
        got.append((r["l2_raw"], r["l2_smoothed"]))
        assert len(state.rows) <= 2 * (history + 8)
    for (a, b), (c, d) in zip(got, unbounded(rows, cfg)):
        assert (a is None) == (c is None)
        if a is not None:
            assert a == pytest.approx(c, rel=1e-9) and b == pytest.approx(d, rel=1e-9)


@pytest.mark.parametrize("history", [1, 3, 13])
def test_steps_together_equal_steps_one_by_one(history):
    cfg, rng = config(history), np.random.default_rng(history)
    for seed in range(8):
        rows = [{**BASE, "us": us, "values": v} for us, v in make_rows(seed, 200)]
        if seed % 2:
            rows[90]["us"] -= 2 * DAY_US  # behind the state, as a hand-over may bring it
        one, many, got = PumpState(), PumpState(), []
        want = [step(one, cfg, r) for r in rows]
        while len(got) < len(rows):
            got += steps(many, cfg, rows[len(got):len(got) + int(rng.integers(1, 50))])
        for a, b in zip(got, want):
            assert a == {k: pytest.approx(v, rel=1e-12) if isinstance(v, float) else v for k, v in b.items()}
        assert [r[:2] for r in many.rows] == [r[:2] for r in one.rows]
        assert all(np.array_equal(a[2], b[2], equal_nan=True) for a, b in zip(many.rows, one.rows))


def test_warm_up_and_missing_level_one():
    cfg, state = config(3), PumpState()
    seen = [step(state, cfg, {**BASE, "us": US0 + i * 300_000_000, "values": np.zeros(2), "l1_status": "WARNING"}) for i in range(8)]
    # Level 2 buffers for the first four rows of the day; the first scored window takes the training mean.
    assert [r["l2_status"] for r in seen[:5]] == ["BUFFERING"] * 4 + ["NORMAL"]
    assert seen[4]["l2_smoothed"] == 0.5 and seen[0]["status_raw"] == "WARNING" and seen[0]["status"] == "NORMAL"
    assert seen[1]["status"] == "WARNING" and seen[3]["session_flagged"] and seen[0]["health"] == 90.0
    alone = step(state, cfg, {**BASE, "us": US0 + 8 * 300_000_000, "values": np.zeros(2), "l1_valid": False, "l1_status": None, "l1_health": None})
    assert alone["status_raw"] == alone["l2_status"]


def frame(spark, rows, pump=1, **extra):
    data = [(pump, us, *[None if np.isnan(x) else float(x) for x in v]) for us, v in rows]
    df = spark.createDataFrame(data, "pump_id int, us long, a double, b double")
    df = df.withColumn("ts", F.timestamp_micros("us"))
    fixed = {
        "reset": False, "heartbeat": False, "season": "winter", "l1_valid": True, "l1_distance": 1.0, "l1_status": "NORMAL", "l1_health": 90.0,
        "l2_warning": 1.0, "l2_alarm": 1.5, "l2_mean": 0.5,
    }
    return df.withColumns({k: F.lit(v) for k, v in {**fixed, **extra}.items()})


def heartbeat(spark, us):
    return frame(spark, [(us, np.zeros(2))], heartbeat=True)


def streamed(spark, parts, cfg, folder, watermark="10 minutes", base=None, initial=None):
    """Each part is one file and one micro-batch."""
    for df in parts:
        df.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return jobs.run_available(detect_stream(stream, cfg, ["a", "b"], watermark, initial), base=base)


def sequential(pumps, cfg):
    out = {}
    for pump, rows in pumps.items():
        state = PumpState()
        for us, v in rows:
            out[pump, us] = step(state, cfg, {**BASE, "us": us, "values": v})
    return out


def same(rows, want):
    got = {(r["pump_id"], int(r["us"])): r for r in rows.withColumn("us", F.unix_micros("ts")).collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        for name, value in w.items():
            assert got[k][name] == (pytest.approx(value, rel=1e-12) if isinstance(value, float) else value), (k, name)


@pytest.mark.parametrize("deal", ["one", "four", "shuffled"])
def test_batches_do_not_matter(spark, tmp_path, deal):
    """The same rows in one batch, in four by time, and in four at random with rows up to days late, doubled and disagreeing."""
    cfg = config(6)
    pumps = {1: make_rows(1, 90), 2: make_rows(2, 90)}
    end = max(rows[-1][0] for rows in pumps.values())
    every = frame(spark, pumps[1], 1).unionByName(frame(spark, pumps[2], 2))
    larger = every.where("us % 7 = 0 and a is not null").withColumn("a", F.col("a") + 1)  # a second version of some rows, never the smallest
    every = every.unionByName(larger).withColumn("part", {
        "one": F.lit(0), "four": F.floor((F.col("us") - US0) * 4 / (end - US0 + 1)), "shuffled": F.pmod(F.hash("us", "pump_id", "a"), F.lit(4))}[deal])
    parts = [every.where(F.col("part") == q).drop("part") for q in range(1 if deal == "one" else 4)]
    late = "40 days" if deal == "shuffled" else "10 minutes"
    same(streamed(spark, [*parts, heartbeat(spark, end + 50 * DAY_US)], cfg, str(tmp_path / "in"), late), sequential(pumps, cfg))


def test_rows_wait_for_the_watermark_and_late_ones_are_dropped(spark, tmp_path):
    cfg = config(3)
    rows = [(US0 + i * 300_000_000, np.zeros(2)) for i in range(8)]
    # Rows up to minute 25 step in the second batch. Minute 32 still comes in order there, minute 3 is too late in the third.
    second = [(US0 + 32 * 60_000_000, np.ones(2))]
    third = [(US0 + 40 * 60_000_000, np.zeros(2)), (US0 + 3 * 60_000_000, np.ones(2))]
    out = streamed(spark, [frame(spark, rows), frame(spark, second), frame(spark, third)], cfg, str(tmp_path / "in"))
    got = [(r["step"], (r["us"] - US0) // 60_000_000) for r in out.withColumn("us", F.unix_micros("ts")).orderBy("ts").collect()]
    # The watermark ends at minute 30: what is later keeps waiting in the state.
    assert got == [(i, 5 * i) for i in range(6)]
    rest = streamed(spark, [heartbeat(spark, US0 + DAY_US)], cfg, str(tmp_path / "in"), base=str(tmp_path / "again"))
    assert [(r["us"] - US0) // 60_000_000 for r in rest.withColumn("us", F.unix_micros("ts")).orderBy("ts").collect()] == [0, 5, 10, 15, 20, 25, 30, 32, 35, 40]


def test_restart_reset_and_stored_state(spark, tmp_path):
    cfg, base, folder = config(3), str(tmp_path / "run"), str(tmp_path / "in")
    pumps = {p: [(US0 + i * 300_000_000, np.full(2, float(i))) for i in range(10)] for p in (1, 2)}
    at = pumps[1][6][0]
    control = frame(spark, [(at, np.zeros(2))], 1, reset=True)
    first = frame(spark, pumps[1][:5], 1).unionByName(frame(spark, pumps[2][:5], 2))
    second = frame(spark, pumps[1][5:], 1).unionByName(frame(spark, pumps[2][5:], 2, season="spring")).unionByName(control)
    streamed(spark, [first], cfg, folder, base=base)
    middle = {r["pump_id"]: r for r in stored_state(spark, f"{base}/state").collect()}
    assert {p: (r["total"], r["resets"]) for p, r in middle.items()} == {1: (2, 0), 2: (2, 0)}  # three rows wait
    out = streamed(spark, [second, heartbeat(spark, US0 + DAY_US)], cfg, folder, base=base)
    # The reset comes before the row of the same time.
    want = sequential({1: pumps[1][:6], 2: pumps[2]}, cfg) | sequential({1: pumps[1][6:]}, cfg)
    same(out, want)
    held = {r["pump_id"]: r for r in stored_state(spark, f"{base}/state").collect()}
    assert (held[1]["total"], held[1]["resets"], held[2]["total"], held[2]["resets"]) == (4, 1, 10, 0)
    assert (held[1]["season_changes"], held[2]["season_changes"], held[2]["season"]) == (0, 1, "spring")
    assert out.where("season_changed").count() == 1
    assert held[2]["ema"] == pytest.approx(want[2, pumps[2][-1][0]]["l2_smoothed"]) and held[2]["row_us"] == [us for us, _ in pumps[2]]


def test_a_new_query_takes_over_stored_state(spark, tmp_path):
    cfg = config(3)
    rows = {1: make_rows(4, 60), 2: make_rows(5, 60)}
    cut = rows[1][30][0]
    halves = [[frame(spark, [r for r in rs if (r[0] < cut) == early], p) for p, rs in rows.items()] for early in (True, False)]
    base = str(tmp_path / "first")
    one = streamed(spark, [halves[0][0].unionByName(halves[0][1]), heartbeat(spark, cut + 600_000_000)], cfg, str(tmp_path / "a"), base=base)
    held = stored_state(spark, f"{base}/state")
    two = streamed(spark, [halves[1][0].unionByName(halves[1][1]), heartbeat(spark, cut + 90 * DAY_US)], cfg, str(tmp_path / "b"), initial=held)
    same(one.unionByName(two), sequential(rows, cfg))


def test_training_mean_is_required(spark):
    with pytest.raises(ValueError):
        detect_stream(frame(spark, make_rows(1, 5)), StepConfig(3, np.zeros(2), np.ones(2), np.array([np.nan, 0.0])), ["a", "b"])


class Store:
    """The state of one pump in memory, which counts the calls to it."""

    def __init__(self):
        self.calls, self.held, self.timers = 0, {}, set()

    def __call__(self, name, *schemas):
        return Variable(self, name)

    getValueState = getListState = getMapState = __call__

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


class Variable:
    def __init__(self, store, name):
        self.store, self.name = store, name

    def exists(self):
        self.store.calls += 1
        return self.name in self.store.held

    def get(self):
        self.store.calls += 1
        return self.store.held.get(self.name, ())

    def update(self, value):
        self.store.calls += 1
        self.store.held[self.name] = value

    put = update

    def appendValue(self, value):
        self.update([*self.store.held.get(self.name, ()), value])

    def clear(self):
        self.store.calls += 1
        self.store.held.pop(self.name, None)


class Now:
    def __init__(self, us):
        self.getCurrentWatermarkInMs = lambda: us // 1000


@pytest.mark.parametrize("n", [10, 100, 3000])
def test_calls_to_the_state_do_not_grow_with_rows(n):
    rows, cfg, store = make_rows(3, n), config(3), Store()
    detector = Detector(cfg, ["a", "b"])
    detector.init(store)
    given = {"reset": False, "season": "winter", "l1_distance": 1.0, **BASE}
    frame = pd.DataFrame([{"us": us, **given, "a": v[0], "b": v[1]} for us, v in rows])
    # Shuffled, a third of the rows twice in one batch, and all rows up to the middle again with a larger value.
    again = frame[: n // 2].assign(a=frame.a[: n // 2] + 1).dropna(subset=["a"])
    for part in (pd.concat([frame, frame[::3]]).sample(frac=1, random_state=1), again):
        list(detector.handleInputRows((1,), iter([part]), None))
    assert store.calls <= 8
    middle = rows[n // 2][0] // 1000 * 1000
    got = [r for us in (middle, rows[-1][0] + 1_000_000) for out in detector.handleExpiredTimer((1,), Now(us), None) for r in out.itertuples()]
    assert store.calls <= 20 + 2 * (n // 1024) and "waiting" not in store.held
    want = sequential({1: rows}, cfg)
    assert [r.ts.value // 1000 for r in got] == [us for us, _ in rows]
    for r, w in zip(got, want.values()):
        assert (r.step, r.status, r.alert_fired) == (w["step"], w["status"], w["alert_fired"])
        assert np.isnan(r.l2_raw) if w["l2_raw"] is None else r.l2_raw == pytest.approx(w["l2_raw"], rel=1e-12)
