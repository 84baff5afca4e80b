"""The keyed streaming detector."""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from rotorline.functions.formulas import health, mahalanobis, season_of, status_of
from rotorline.streaming.step import PumpState, StepConfig, steps

STATE_STORE = (
    "spark.sql.streaming.stateStore.providerClass",
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
)
OUTPUT = (
    "pump_id int, ts timestamp, season string, season_changed boolean, step long, l1_distance double, l1_status string, "
    "l1_health double, l2_raw double, l2_smoothed double, l2_status string, l2_health double, status_raw string, status string, "
    "health double, alert_fired boolean, session_alert_steps long, session_flagged boolean"
)
TYPES = dict(part.strip().split(" ") for part in OUTPUT.split(","))
FIELDS = list(TYPES)
#: What a row brings to its step besides its channels.
CARRIED = {
    "season": "string", "l1_valid": "boolean", "l1_distance": "double", "l1_status": "string", "l1_health": "double",
    "l2_warning": "double", "l2_alarm": "double", "l2_mean": "double",
}
#: State of one pump; the buffered rows lie one after another in ``row_values``.
STATE = {
    "total": "long", "last_us": "long", "day": "long", "day_rows": "long", "ema": "double", "run": "long", "last_alert_us": "long",
    "session": "long", "season": "string", "season_changes": "long", "resets": "long", "next_ms": "long", "previous": "array<double>",
    "row_us": "array<long>", "row_days": "array<long>", "row_values": "array<double>",
}
COUNTERS = ("total", "last_us", "day", "day_rows", "ema", "run", "last_alert_us", "session")
PIECE_ROWS = 1024  # of waiting rows in one element of the list


def level1_columns(channels: Sequence[str]) -> dict[str, Column]:
    """Level 1 of a streamed row: missing channels count at the mean residual; without any channel neutral."""
    valid = [F.col(c).isNotNull() & F.col(f"pred_{c}").isNotNull() for c in channels]
    any_valid = valid[0]
    for v in valid[1:]:
        any_valid = any_valid | v
    delta = {c: F.coalesce(F.col(c) - F.col(f"pred_{c}") - F.col("mean_vec")[c], F.lit(0.0)) for c in channels}
    d = mahalanobis(delta, F.col("cov_inv"))
    alarm = F.greatest(F.col("alarm"), F.col("warning"))
    return {
        "l1_valid": any_valid,
        "l1_distance": F.when(any_valid, d).otherwise(0.0),
        "l1_status": F.when(any_valid, status_of(d, F.col("warning"), alarm, strict=False)).otherwise("NORMAL"),
        "l1_health": F.when(any_valid, health(d, F.col("mean"), alarm)).otherwise(100.0),
    }


def prepare(rows: DataFrame, predictions, level1: DataFrame, level2: DataFrame, channels: Sequence[str],
            season: Column | None = None) -> DataFrame:
    """Join predictions and thresholds to a (streaming) frame.

    ``predictions`` maps a frame to one with ``pred_<channel>``; ``level1``/``level2`` hold the resolved blocks
    per (pump_id, season). The season is a column of each row, so a season change switches the thresholds of
    every pump without shared state.
    """
    out = predictions(rows.withColumn("season", season if season is not None else season_of(F.col("ts"))))
    one = level1.select("pump_id", "season", "mean_vec", "cov_inv", "warning", "alarm", "mean")
    two = level2.select(
        "pump_id", "season", F.col("warning").alias("l2_warning"), F.col("alarm").alias("l2_alarm"), F.col("mean").alias("l2_mean")
    )
    out = out.join(one, ["pump_id", "season"], "left").join(two, ["pump_id", "season"], "left")
    return out.withColumns(level1_columns(channels)).withColumn("us", F.unix_micros("ts"))


class Detector(StatefulProcessor):
    """Rows wait until the watermark has passed them and then step in order of event time.

    So what comes out depends on the rows alone, not on how they were dealt into batches. Of several rows of one pump
    and time the smallest counts, whichever came first. Rows that Spark drops as late are the only ones that do not step.
    A row with ``reset`` forgets the pump's state; a row with ``heartbeat`` moves nothing but the watermark.

    What a pump brings in one batch waits as one element of a list, a column of values per field, so the calls to the state
    store grow with pumps and batches, not with rows. When a timer fires, what still waits is written anew without doubles.
    """

    def __init__(self, cfg: StepConfig, channels: Sequence[str]):
        self.cfg, self.channels = cfg, list(channels)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pump = handle.getValueState("pump", ", ".join(f"{n} {t}" for n, t in STATE.items()))
        columns = {"us": "long", "reset": "boolean", **CARRIED, "channels": "double"}
        self.waiting = handle.getListState("waiting", ", ".join(f"{n} array<{t}>" for n, t in columns.items()))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Take over what ``stored_state`` read from another run."""
        for r in initialState.itertuples(index=False):
            self.pump.update(tuple(None if n == "next_ms" else _plain(getattr(r, n)) for n in STATE))

    def _load(self) -> dict:
        if self.pump.exists():
            return dict(zip(STATE, self.pump.get(), strict=True))
        return _pack(PumpState(), {"season": None, "season_changes": 0, "resets": 0, "next_ms": None})

    def _unpack(self, v: dict) -> tuple[PumpState, dict]:
        values = _numbers(v["row_values"]).reshape(len(v["row_us"]), len(self.channels))
        rows = list(zip(v["row_us"], v["row_days"], values, strict=True))
        state = PumpState(*[v[n] for n in COUNTERS], None if v["previous"] is None else _numbers(v["previous"]), rows)
        return state, {n: v[n] for n in ("season", "season_changes", "resets", "next_ms")}

    def _wake(self, held: dict, us: int | None) -> None:
        """One timer a pump: just after the earliest row that waits."""
        at = None if us is None else us // 1000 + 1
        if at is not None and (held["next_ms"] is None or at < held["next_ms"]):
            if held["next_ms"] is not None:
                self.handle.deleteTimer(held["next_ms"])
            self.handle.registerTimer(at)
            held["next_ms"] = at

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._load()
        earliest = None
        for frame in rows:
            us = [int(x) for x in frame["us"].tolist()]
            columns = [_stored(t, frame[n].tolist()) for n, t in CARRIED.items()]
            values = _stored("double", frame[self.channels].to_numpy(dtype=float).ravel())
            self.waiting.appendValue((us, [bool(x) for x in frame["reset"].tolist()], *columns, values))
            earliest = min(us) if earliest is None else min(earliest, *us)
        self._wake(held, earliest)
        self.pump.update(tuple(held[n] for n in STATE))
        return iter(())

    def _waiting(self) -> dict[tuple[int, bool], tuple]:
        """What waits by (time, not a reset): the carried fields and the channels. Of doubles the smallest."""
        found: dict[tuple[int, bool], tuple] = {}
        width = len(self.channels)
        for us, reset, *carried, values in self.waiting.get():
            carried = [[None if v is None or v != v else v for v in c] for c in carried]
            for i, row in enumerate(zip(us, reset, *carried, strict=True)):
                at, brought = (row[0], not row[1]), (*row[2:], values[i * width:(i + 1) * width])
                if at not in found or _order(tuple(_plain(brought))) < _order(tuple(_plain(found[at]))):
                    found[at] = brought
        return found

    def _keep(self, rows: list[tuple[tuple[int, bool], tuple]]) -> None:
        """Write what goes on waiting, in pieces of a bounded number of rows."""
        if not rows:
            self.waiting.clear()
            return
        pieces = []
        for start in range(0, len(rows), PIECE_ROWS):
            part = rows[start:start + PIECE_ROWS]
            *columns, values = zip(*[b for _, b in part], strict=True)
            columns = [_stored(t, c) for t, c in zip(CARRIED.values(), columns, strict=True)]
            flat = _stored("double", [x for v in values for x in v])
            pieces.append(([at[0] for at, _ in part], [not at[1] for at, _ in part], *columns, flat))
        self.waiting.put(pieces)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, extra = self._unpack(self._load())
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        extra["next_ms"] = None
        waiting = sorted(self._waiting().items(), key=lambda row: row[0])
        due = bisect_left(waiting, passed, key=lambda row: row[0][0])
        given, results, together = [], [], []
        for (us, is_row), (*fields, values) in waiting[:due]:
            if not is_row:
                results += steps(state, self.cfg, together) if together else []
                state, extra, together = PumpState(), {**extra, "season": None, "resets": extra["resets"] + 1}, []
                continue
            brought = dict(zip(CARRIED, fields, strict=True))
            changed = extra["season"] is not None and brought["season"] != extra["season"]
            extra["season"], extra["season_changes"] = brought["season"], extra["season_changes"] + changed
            together.append({**brought, "us": us, "values": _numbers(values)})
            given.append({**brought, "pump_id": key[0], "ts": us, "season_changed": bool(changed)})
        results += steps(state, self.cfg, together) if together else []
        if due:
            self._keep(waiting[due:])
        held = _pack(state, extra)
        self._wake(held, waiting[due][0][0] if due < len(waiting) else None)
        self.pump.update(tuple(held[n] for n in STATE))
        if given:
            yield pd.DataFrame({n: _column(n, [(g if n in g else r)[n] for g, r in zip(given, results, strict=True)]) for n in FIELDS})

    def close(self) -> None:
        pass


def _pack(s: PumpState, extra: dict) -> dict:
    """What the state store holds of a pump."""
    return {
        **{n: getattr(s, n) for n in COUNTERS}, **extra, "previous": None if s.previous is None else _plain(s.previous),
        "row_us": [int(r[0]) for r in s.rows], "row_days": [int(r[1]) for r in s.rows], "row_values": [x for r in s.rows for x in _plain(r[2].tolist())],
    }


def _column(name: str, values: list) -> np.ndarray | list:
    if name == "ts":
        return np.array(values, dtype="datetime64[us]")
    return np.array(values, dtype=float) if TYPES[name] == "double" else values


def _stored(kind: str, values) -> array | list:
    """A column for the state store: doubles packed, missing ones as NaN."""
    return array("d", np.asarray(values, dtype=float).tobytes()) if kind == "double" else _plain(list(values))


def _plain(value):
    """Python values without NaN, as the state store takes them."""
    if isinstance(value, float):
        return None if value != value else value
    if isinstance(value, list | tuple | np.ndarray | array):
        return [_plain(x) for x in value]
    value = value.item() if isinstance(value, np.generic) else value
    return None if value is None or value is pd.NA or isinstance(value, float) and np.isnan(value) else value


def _numbers(values) -> np.ndarray:
    return np.array([np.nan if v is None else v for v in values], dtype=float)


def _order(brought: tuple) -> tuple:
    """A total order of what rows bring, missing values first."""
    return tuple((x is not None, _order(tuple(x)) if isinstance(x, list) else 0 if x is None else x) for x in brought)


def detect_stream(
    prepared: DataFrame, cfg: StepConfig, channels: Sequence[str], watermark: str = "10 minutes", initial: DataFrame | None = None
) -> DataFrame:
    """Full result per row, once the watermark has passed it. ``initial``: a table of ``stored_state`` to start from."""
    for flag in ("reset", "heartbeat"):
        if flag not in prepared.columns:
            prepared = prepared.withColumn(flag, F.lit(False))
    if not np.isfinite(cfg.means).all():
        raise ValueError("every channel needs a training mean: the bounded buffer relies on it")
    # The test names the time so that it stays above the watermark, which heartbeats are to move.
    timed = prepared.withWatermark("ts", watermark).where(~F.coalesce("heartbeat", F.lit(False)) | F.col("ts").isNull())
    carried = [F.col(n).cast(t).alias(n) for n, t in CARRIED.items()]
    picked = timed.select("pump_id", "us", "ts", F.coalesce("reset", F.lit(False)).alias("reset"), *carried, *[F.col(c).cast("double").alias(c) for c in channels])
    return picked.groupBy("pump_id").transformWithStateInPandas(
        statefulProcessor=Detector(cfg, channels), outputStructType=OUTPUT, outputMode="append", timeMode="EventTime",
        initialState=None if initial is None else initial.select("pump_id", *STATE).groupBy("pump_id"),
    )


def stored_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """pump_id and the state that a stopped or running detector last committed, read by Spark's state data source."""
    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "pump").load()
    return held.select(F.col("key.pump_id").alias("pump_id"), "value.*")


def control_rows(like: DataFrame, pumps: DataFrame, at: Column, reset: bool) -> DataFrame:
    """Rows that steer the detector, with the columns of ``like``: resets of the pumps listed, or heartbeats."""
    rows = pumps.select("pump_id", at.alias("ts")).withColumns({"reset": F.lit(reset), "heartbeat": F.lit(not reset)})
    return rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema])
