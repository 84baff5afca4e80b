"""Sharding by fixed virtual slots.

A record hashes into one of ``SLOTS`` virtual slots and never changes it. A versioned map says which shard holds
which slot; only the map is edited when shards are added or loads are evened, so records move in whole slots.

The map for n shards follows from the map for n-1: slot v goes to the new shard when its hash for that step is
divisible by n. Record id and shard count alone decide, and one more shard takes rows only into itself.

Edge cases: a null id hashes as empty text, a null text has one byte (the record end) and checksum 0, repeated rows
get places of their own, an empty table gives no rows. Columns other than ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rotorline.llm.base import cut, duck_md5_number, id_text, md5_number, table

SLOTS = 16384
SHARDS = 8


def shard_of(slot: Column, shards: int) -> Column:
    """Apply the edits for 2, 3, ... shards in order; the last that hits holds the slot."""
    held = F.lit(0)
    for k in range(1, shards):
        held = F.when(md5_number(F.concat_ws(":", slot.cast("string"), F.lit(k))) % (k + 1) == 0, k).otherwise(held)
    return held.cast("int")


def slot_map(spark: SparkSession, shards: int, slots: int = SLOTS, version: int = 1) -> DataFrame:
    """version, vslot, shard: one row per virtual slot."""
    slot = F.col("id")
    return spark.range(slots).select(F.lit(version).alias("version"), slot.alias("vslot"), shard_of(slot, shards).alias("shard"))


def save_map(slots: DataFrame, path: str) -> None:
    """Add a version to the stored map; earlier versions stay readable."""
    slots.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version, the newest by default."""
    stored = spark.read.parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == version).select("version", "vslot", "shard")


def slot_bytes(records: DataFrame) -> DataFrame:
    """vslot, rows, bytes: what each virtual slot holds."""
    return records.groupBy("vslot").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))


def rebalance(slots: DataFrame, loads: DataFrame) -> DataFrame:
    """The next version of the map, with bytes evened.

    Each shard keeps slots, in slot order, up to the mean load. The excess slots are laid end to end, and so is the
    room of the shards below the mean; a slot goes where its middle falls. Tables here have one row per slot.
    """
    held = slots.join(loads, "vslot", "left").select("version", "vslot", "shard", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    mean = held.agg(F.sum("bytes") / F.countDistinct("shard")).scalar()
    run = F.sum("bytes").over(Window.partitionBy("shard").orderBy("vslot"))
    marked = held.withColumn("over", (run > mean) & (F.col("bytes") > 0))
    line = Window.orderBy("shard", "vslot")
    moving = marked.where("over").select("vslot", (F.sum("bytes").over(line) - F.col("bytes") / 2).alias("middle"))
    kept = marked.groupBy("shard").agg(F.sum(F.when(~F.col("over"), F.col("bytes")).otherwise(0)).alias("bytes"))
    ends = kept.select("shard", (mean - F.col("bytes")).alias("room"), F.sum(mean - F.col("bytes")).over(Window.orderBy("shard")).alias("until"))
    room = ends.select(F.col("shard").alias("to"), (F.col("until") - F.col("room")).alias("since"), "until")
    placed = moving.join(F.broadcast(room), (F.col("middle") > F.col("since")) & (F.col("middle") <= F.col("until")))
    return held.join(placed.select("vslot", "to"), "vslot", "left").select(
        (F.col("version") + 1).alias("version"), "vslot", F.coalesce("to", "shard").alias("shard"))


def records_of(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot: the light rows that all further steps work on."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                       (md5_number(id_text()) % slots).alias("vslot"))


def assign(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Every record with its shard, its place in the shard (from 0, no gaps) and its shard were there one more.

    Places follow the virtual slot, then id, checksum and size. A slot's start in its shard is a running sum over
    the slot table, which has ``slots`` rows at most; records are only ordered within their slot.
    """
    records = cut(records_of(docs, slots))
    spark = docs.sparkSession
    held = slot_map(spark, shards, slots).select("vslot", "shard")
    grown = slot_map(spark, shards + 1, slots, 2).select("vslot", F.col("shard").alias("grown_shard"))
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_bytes(records).join(held, "vslot").withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0))).join(grown, "vslot")
    place = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")) - 1
    return records.withColumn("place", place).join(
        F.broadcast(starts.select("vslot", "shard", "start", "grown_shard")), "vslot",
    ).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("place")).alias("slot"),
             "grown_shard", F.col("vslot").alias("virtual_slot"))


def placed(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """The documents with all their columns, and virtual_slot and shard (which replace columns of these names)."""
    slot = md5_number(id_text()) % slots
    held = slot_map(docs.sparkSession, shards, slots).select(F.col("vslot").alias("_slot"), F.col("shard").alias("_shard"))
    found = docs.withColumn("_vslot", slot).join(F.broadcast(held), F.col("_vslot") == F.col("_slot"))
    kept = [f"`{c}`" for c in docs.columns if c not in ("virtual_slot", "shard")]
    return found.select(*kept, F.col("_vslot").alias("virtual_slot"), F.col("_shard").alias("shard"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))


def _duck_shard(shards: int) -> str:
    """The edits as one CASE, last edit first."""
    arms = "".join(f" WHEN {duck_md5_number(f'vslot::VARCHAR || {chr(39)}:{k}{chr(39)}')} % {k + 1} = 0 THEN {k}" for k in range(shards - 1, 0, -1))
    return f"(CASE{arms} ELSE 0 END)::INTEGER"


# CRC-32 by bytes over a table that the first lines derive.
ORACLE = f"""
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i] || range(8), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))
), rec AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, hex(encode(coalesce(text, ''))) AS h,
         {duck_md5_number("coalesce(doc_id::VARCHAR, '')")} % {SLOTS} AS vslot
  FROM documents
), sums AS (
  SELECT doc_id, size, vslot,
    xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(h), 2), lambda p: ('0x' || substr(h, p, 2))::BIGINT),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM rec, crc_table
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY vslot, doc_id, text_crc32, size) - 1 AS slot,
       {_duck_shard(SHARDS + 1)} AS grown_shard, vslot AS virtual_slot
FROM (SELECT *, {_duck_shard(SHARDS)} AS shard FROM sums)
"""
