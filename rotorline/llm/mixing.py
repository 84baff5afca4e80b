"""Mixing sources to target weights by systematic sampling.

Targets: the sources, by code point and null last, weigh 5, 2, 1 in turn and share ``total`` times all words. A
target stops at ``most`` times what its source has; the excess is shared again by weight until none is above. That is
the level at which ``min(most * words, level * weight)`` adds up to the whole.

Sample: every document of a source expects ``target / words`` copies. Documents are laid in an order, their expected
copies are summed up, one offset per source is added, and a document is taken once for every whole number its stretch
crosses. The order goes by size class (eighths of an octave), then by the MD5 sum of the id: neighbours are alike in
size, so the words taken stay within about one document of the target. The offset comes from the seed and the name of
the source, so that reruns agree.

The running sum has three levels, none of which holds a whole source: places within a bucket of about ``BUCKET`` rows,
bucket counts within a size class, class counts within a source. A bucket is a stretch of MD5 values; their number
follows the row count and does not change the result.

Edge cases: a null text has no words, a null source is a source of its own, a source without words has target 0,
repeated rows are sampled each for itself, an empty table gives no rows. Columns other than ``doc_id``, ``text`` and
``source`` are not looked at by ``plan``; ``emit`` returns all columns of its input, and only those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rotorline.llm.base import WORD, cut, duck_md5_number, id_text, md5_number, row_key, table

WEIGHTS = (5, 2, 1)
TOTAL, MOST = 1.5, 2.0
SEED = 42
BUCKET = 4000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """source, source_size, target. One row per source goes through the windows."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (turn % len(WEIGHTS) + 1).cast("int"))
    weighed = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    # From the source that reaches its cap first: what the capped ones before it take, and the weight from it on.
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, on = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    level = (total * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(on)
    leveled = weighed.withColumn("level", level)
    first = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(whole)["level"]
    return leveled.select("source", "source_size", F.least("cap", F.coalesce(first * F.col("weight"), F.col("cap"))).alias("target"))


def offset(source: Column, seed: int) -> Column:
    return md5_number(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.concat(F.lit("s"), source), F.lit("")))) / F.lit(2.0**32)


def plan(docs: DataFrame, total: float = TOTAL, most: float = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, row_key, size, source_size, target, taken, copies: how often each document enters the mix."""
    order = md5_number(F.concat_ws("|", F.lit(str(seed)), id_text()))
    light = cut(docs.select("doc_id", row_key().alias("row_key"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), order.alias("hash"))
                .withColumn("class", F.floor(F.log2(F.col("size") + 1.0) * 8).cast("int")))
    buckets = light.agg(F.ceil(F.count("*") / BUCKET)).scalar()
    light = light.withColumn("bucket", F.floor(F.col("hash") * buckets / F.lit(2.0**32)))
    slot = ["class", "bucket"]
    row = Window.partitionBy("source", *slot).orderBy("hash", "doc_id", "size", "row_key")
    counts = light.groupBy("source", *slot).agg(F.count("*").alias("n"))
    in_class = counts.withColumn("bucket_start", F.coalesce(F.sum("n").over(Window.partitionBy("source", "class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    classes = counts.groupBy("source", "class").agg(F.sum("n").alias("n"))
    in_source = classes.select("source", "class", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("class_start"))
    wanted = targets(light, total, most)
    starts = (
        in_class.alias("b").join(in_source.alias("c"), F.col("b.source").eqNullSafe(F.col("c.source")) & (F.col("b.class") == F.col("c.class")))
        .join(wanted.alias("w"), F.col("b.source").eqNullSafe(F.col("w.source")))
        .select(F.col("b.source").alias("source"), "b.class", "b.bucket", (F.col("class_start") + F.col("bucket_start")).alias("start"), "source_size", "target")
    )
    placed = light.withColumn("place", F.row_number().over(row))
    laid = placed.alias("p").join(
        starts.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source")) & (F.col("p.class") == F.col("s.class")) & (F.col("p.bucket") == F.col("s.bucket")),
    ).select("p.doc_id", "p.row_key", "p.source", "p.size", "source_size", "target", (F.col("start") + F.col("place")).cast("double").alias("rank"))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(F.lit(0.0))
    u = offset(F.col("source"), seed)
    copies = (F.floor(rate * F.col("rank") + u) - F.floor(rate * (F.col("rank") - 1) + u)).cast("long")
    return laid.withColumn("copies", copies).select(
        "doc_id", "row_key", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def emit(docs: DataFrame, mix: DataFrame) -> DataFrame:
    """The mix itself: each document as often as planned, with the columns of ``docs``.

    Rows meet their plan by id, text and source. Rows alike in all three are one document whose copies add up.
    """
    chosen = mix.groupBy(F.col("row_key").alias("_planned")).agg(F.sum("copies").alias("_copies")).where("_copies > 0")
    keyed = docs.withColumn("_row_key", row_key())
    one = keyed.join(chosen, F.col("_row_key") == F.col("_planned")).dropDuplicates(["_row_key"])
    return one.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*[f"`{c}`" for c in docs.columns])


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(table(spark, sf_dir, "documents")).drop("row_key")


_SEEDED = duck_md5_number(f"'{SEED}|' || coalesce(doc_id::VARCHAR, '')")
_OFFSET = duck_md5_number(f"'{SEED}|' || coalesce('s' || source, '')")
ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, {_SEEDED} AS hash FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn FROM sized GROUP BY source
), cap AS (
  SELECT source, source_size, source_size * {MOST} AS cap, CASE turn WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS weight FROM src
), lev AS (
  SELECT *, cap / weight AS full_at,
    ({TOTAL} * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM cap
), tgt AS (
  SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, full_at) FROM lev WHERE level <= full_at) * weight, cap))::DOUBLE AS target FROM lev
), laid AS (
  SELECT s.doc_id, s.size, s.source, t.source_size, t.target,
    row_number() OVER (PARTITION BY s.source ORDER BY floor(log2(s.size + 1.0) * 8), s.hash, s.doc_id, s.size) AS place,
    CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, {MOST}) ELSE 0 END::DOUBLE AS rate, {_OFFSET.replace("source", "s.source")} / 4294967296.0::DOUBLE AS u
  FROM sized s JOIN tgt t ON s.source IS NOT DISTINCT FROM t.source
), taken AS (
  SELECT *, (floor(rate * place + u) - floor(rate * (place - 1) + u))::BIGINT AS copies FROM laid
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM taken
"""
