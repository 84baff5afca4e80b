"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where none is named and the session is a local one."""
    context = spark.sparkContext
    named = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage: the rows live in the shared folder, not on an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def released(df: DataFrame) -> DataFrame:
    """``cut``, and then a collection on the driver, upon which Spark's cleaner removes the shuffle files and checkpoints
    of steps that nothing refers to any more. For long chains of steps, whose files would otherwise stay to the end."""
    out = cut(df)
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def md5_number(text: Column) -> Column:
    """The first 32 bits of the MD5 sum: a hash that SQL engines agree on."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def id_text(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def row_key() -> Column:
    """One number for a document's id, text and source; rows alike in all three are the same document."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("")) for c in ("doc_id", "text", "source")]
    return F.xxhash64(*parts)


def fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(id_text(column).cast("binary")) % parts


def duck_md5_number(expr: str) -> str:
    return f"('0x' || substr(md5({expr}), 1, 8))::BIGINT"
