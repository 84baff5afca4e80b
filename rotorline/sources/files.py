"""Per-day files: discovery, CSV loading, training directories."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rotorline.config import SystemConfig
from rotorline.operators.quality import nan_to_null


ROWS_AT_ONCE = 10_000


class SchemaError(ValueError):
    """The input does not have the columns an operator needs."""


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Paths below ``root``; only the listing is read, never the content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(root)
    return files.select("path")


def discover(paths: DataFrame, cfg: SystemConfig) -> DataFrame:
    """(date, pump_id, path) of files whose name fits the pattern, belongs to a configured pump and has a real date.

    A pattern with a slash is held against the whole path, so that folders may carry the pump and the date.
    """
    pump, day = _named(F.col("path"), cfg)
    out = paths.select(_date_of(day, cfg).alias("date"), pump.try_cast("int").alias("pump_id"), "path")
    return out.where(F.col("date").isNotNull() & F.col("pump_id").isin(*cfg.pump_ids)).orderBy("date", "pump_id", "path")


def _named(path: Column, cfg: SystemConfig) -> tuple[Column, Column]:
    """Pump and date as a path has them, empty where the pattern does not fit."""
    where = path if "/" in cfg.file_pattern else F.substring_index(path, "/", -1)
    return F.regexp_extract(where, cfg.file_pattern, 1), F.regexp_extract(where, cfg.file_pattern, 2)


def _date_of(day: Column, cfg: SystemConfig) -> Column:
    return F.try_to_timestamp(day, F.lit(cfg.spark_date_format)).cast("date")


def discovery_summary(found: DataFrame, cfg: SystemConfig) -> DataFrame:
    """Files, first and last date per configured pump, pumps without files included; one total row (NULL pump)."""
    pumps = found.sparkSession.createDataFrame([(p,) for p in cfg.pump_ids], "pump_id int")
    per_pump = found.groupBy("pump_id").agg(
        F.count(F.lit(1)).alias("n_files"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )
    filled = pumps.join(per_pump, "pump_id", "left").fillna(0, ["n_files"])
    total = filled.agg(F.sum("n_files").alias("n_files"), F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"))
    return filled.unionByName(total.withColumn("pump_id", F.lit(None).cast("int")))


def by_position(raw: DataFrame, cfg: SystemConfig, ts: str = "timestamp") -> DataFrame:
    """Positional core columns renamed, supplementary ones by header (NULL when absent), types coerced, bad times dropped."""
    names = [c for i, c in enumerate(raw.columns) if i not in cfg.excluded_source_columns and not c.startswith("_")]
    if len(names) < len(cfg.clean_names):
        raise SchemaError(f"expected {len(cfg.clean_names)} core columns, found {len(names)}")
    core = dict(zip(cfg.clean_names, names))
    more = {own: source for source, own in cfg.supplementary_columns.items()}
    picked = {c: F.col(f"`{core[c]}`") for c in cfg.clean_names}
    picked |= {own: F.col(f"`{source}`") if source in raw.columns else F.lit(None) for own, source in more.items()}
    return _coerced(raw, picked, [c for c in raw.columns if c.startswith("_")], ts)


def _coerced(raw: DataFrame, columns: dict[str, Column], keep: Sequence[str], ts: str) -> DataFrame:
    """Times parsed (rows without one dropped), everything else a number or NULL."""
    values = [c for c in columns if c != ts]
    picked = [F.try_to_timestamp(columns[ts].cast("string")).alias("ts"), *[columns[c].cast("string").try_cast("double").alias(c) for c in values]]
    return nan_to_null(raw.select(*keep, *picked).where(F.col("ts").isNotNull()), values)


def _parsed(cfg: SystemConfig, rows_wanted: bool):
    """Files (path, content) into rows of text by their own headers, or into one row each that says what is wrong."""
    own = [*cfg.clean_names, *dict.fromkeys(cfg.supplementary_columns.values())]

    def cells(header: list[str], problem: str) -> list[int | None]:
        if problem:
            return []
        left_out = cfg.excluded_source_columns if len(header) >= cfg.source_count else ()
        core = [i for i in range(min(len(header), cfg.source_count)) if i not in left_out]
        at = {c: header.index(source) for source, c in cfg.supplementary_columns.items() if source in header}
        return [*core, *[at.get(c) for c in own[len(cfg.clean_names):]]]

    def problem_of(header: list[str], rows: list[list[str]]) -> str:
        after = cfg.source_count - len(cfg.excluded_source_columns)
        if not rows:
            return "empty"
        if len(header) < cfg.source_count and len(header) != after:
            return f"unexpected column count {len(header)}"
        if after != len(cfg.clean_names):
            return f"unexpected column count after leaving columns out {after}"
        return "unreadable" if any(len(r) > len(header) for r in rows) else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                lines = [r for r in csv.reader(io.StringIO((content or "").removeprefix("\ufeff"))) if r]
                header, rows = (lines[0], lines[1:]) if lines else ([], [])
                problem = problem_of(header, rows)
                if not rows_wanted:
                    data = {"path": [path], "n_columns": [len(header)], "n_rows": [len(rows)], "problem": [problem or None]}
                    yield pa.RecordBatch.from_pydict(data, pa.schema([("path", pa.string()), ("n_columns", pa.int32()), ("n_rows", pa.int64()), ("problem", pa.string())]))
                    continue
                places = cells(header, problem)
                for begin in range(0, len(rows) if places else 0, ROWS_AT_ONCE):
                    part = rows[begin:begin + ROWS_AT_ONCE]
                    columns = [[(r[i] or None) if i is not None and i < len(r) else None for r in part] for i in places]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part), pa.string()), *[pa.array(c, pa.string()) for c in columns]], names=["path", *own])

    return run


def _contents(spark: SparkSession, root: str, cfg: SystemConfig) -> DataFrame:
    """path, content of the pump-day files below ``root``; other files are not read."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.csv")
    pump, day = _named(F.col("_metadata.file_path"), cfg)
    wanted = pump.try_cast("int").isin(*cfg.pump_ids) & _date_of(day, cfg).isNotNull()
    return files.where(wanted).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def load_days(spark: SparkSession, root: str, cfg: SystemConfig) -> DataFrame:
    """All pump-day files below ``root`` as one frame with pump_id, date and path.

    Every file is read by its own header: with all source columns (or more) the core ones are taken by position and the
    excluded ones left out; a file already without these is taken as it is; other widths, empty files and files with
    rows longer than their header are left out, see ``file_report``. Supplementary columns are found by header and NULL
    where a file does not have them. Cells that are no numbers become NULL, rows without a valid time are dropped.

    A file is one unit of work and is held in memory by its task: the readings of a pump and day.
    """
    own = [*cfg.clean_names, *dict.fromkeys(cfg.supplementary_columns.values())]
    text = _contents(spark, root, cfg).mapInArrow(_parsed(cfg, True), ", ".join(f"`{c}` string" for c in ["path", *own]))
    pump, day = _named(F.col("path"), cfg)
    out = _coerced(text, {c: F.col(f"`{c}`") for c in own}, ["path"], cfg.timestamp_col)
    return out.withColumns({"pump_id": pump.cast("int"), "date": _date_of(day, cfg)})


def file_report(spark: SparkSession, root: str, cfg: SystemConfig) -> DataFrame:
    """path, n_columns, n_rows, problem: what ``load_days`` leaves out and why (NULL: nothing). Files of no bytes are not listed."""
    return _contents(spark, root, cfg).mapInArrow(_parsed(cfg, False), "path string, n_columns int, n_rows long, problem string")


def union_tagged(parts: dict[str, DataFrame]) -> DataFrame:
    """Union by name with a ``dataset`` tag; columns missing in a part are NULL."""
    tagged = [df.withColumn("dataset", F.lit(tag)) for tag, df in parts.items()]
    out = tagged[0]
    for more in tagged[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def strict(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Any invalid timestamp fails the query; a missing column fails at once."""
    if ts not in df.columns:
        raise SchemaError(f"missing column '{ts}'")
    parsed = F.try_to_timestamp(F.col(ts).cast("string"))
    bad = F.raise_error(F.concat(F.lit("invalid timestamp: "), F.coalesce(F.col(ts).cast("string"), F.lit("NULL"))))
    return df.withColumn("ts", F.coalesce(parsed, bad.cast("timestamp")))


def require(df: DataFrame, inputs: Sequence[str], outputs: Sequence[str], pump: str = "pump_id") -> DataFrame:
    """Schema contract: timestamp, integer pump id and all named columns, else an error naming them.

    Value errors (a pump id that is not a whole number) fail when the rows are read.
    """
    needed = ["ts", pump, *inputs, *outputs]
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise SchemaError(f"missing columns: {missing}")
    if not isinstance(df.schema["ts"].dataType, (T.TimestampType, T.TimestampNTZType)):
        raise SchemaError("column 'ts' must be a timestamp")
    raw = F.col(pump).try_cast("double")
    whole = raw.isNotNull() & (raw == F.floor(raw))
    bad = F.raise_error(F.concat(F.lit("pump id is not an integer: "), F.coalesce(F.col(pump).cast("string"), F.lit("NULL"))))
    return df.withColumn(pump, F.when(whole, raw.cast("int")).otherwise(bad.cast("int")))
