from __future__ import annotations

from datetime import date, datetime, timedelta

T0 = datetime(2024, 1, 2)


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


def segment(spark, values, step=300, pump=1, column="x", times=None, day=date(2024, 1, 2)):
    """One pump-day of a single channel."""
    times = times if times is not None else [i * step for i in range(len(values))]
    rows = [(pump, day, at(t), None if v is None else float(v)) for t, v in zip(times, values)]
    return spark.createDataFrame(rows, f"pump_id int, date date, ts timestamp, {column} double")


def ordered(df, *columns):
    return [tuple(r) for r in df.orderBy("pump_id", "ts").select(*columns).collect()]
