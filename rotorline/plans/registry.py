"""Registry of runnable queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    oracle: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Build], Build]:
    def add(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"query '{name}' registered twice")
        QUERIES[name] = Query(name, build, oracle)
        return build

    return add


def shape(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 6) -> DataFrame:
    """Plain comparable types: whole numbers as bigint, fractions rounded, dates and times as text."""
    picked = []
    for name in columns or df.columns:
        kind, c = df.schema[name].dataType, F.col(f"`{name}`")
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
            c = c.cast("bigint")
        elif isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
            # A hair above one: exact halves round the same way in every engine.
            c = F.round(c.cast("double") * (1.0 + 1e-13), digits)
        elif isinstance(kind, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        picked.append(c.alias(name))
    return df.select(*picked)
