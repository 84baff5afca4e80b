"""SimHash near-duplicates through segment bit counts.

Fingerprint: XXH64 (seed 42) of every shingle of ``SHINGLE`` words, repeats included; a bit is 1 when it is set in
over half of the hashes.

Join: the 64 bits are 32 segments of 2 bits, and a fingerprint maps to the 32 counts of set bits. The Manhattan
distance of two such points is at most their Hamming distance. So fingerprints within ``BITS`` bits are points within
Manhattan distance ``BITS``, and one half of the counts is within half of that. Each half is a grid of unit cells.
A point goes to its own cell and to the cells next to it, so that two points within distance 2 meet in a cell between
them: own with own at distance 0, own with next at 1, next with next at 2, which keeps a pair from coming up in every
common cell. In the cell the distance of all counts is the first test, the exact Hamming distance the last.

Equal fingerprints are one point: copies are counted, never paired. Links between different fingerprints give
components; a document takes the component of its fingerprint. Cells are joined by sort-merge, which Spark may split.

Of random pairs about 1 in 14 000 share a half; they cost a comparison each and no row.

Edge cases: a null or empty text has fingerprint zero and links like any other; fewer words than a shingle make one
shingle; repeated rows share a component; a null id never becomes a component id unless its component has no other
(then it is null); an empty table gives no rows. Columns of the documents are kept under ``sh_doc``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rotorline.llm.base import cut, row_key, table
from rotorline.llm.components import components

SHINGLE, BITS, SEED = 4, 4, 42
CHUNK = 1 << 14
LOW = 0x5555555555555555
HALVES = (0x00000000FFFFFFFF, -0x100000000)  # as signed longs
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """As a signed 64-bit number."""
    words = text.encode().translate(ASCII_LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    count = max(1, len(words) - shingle + 1)
    starts, ends = starts[:count].tolist(), ends[min(shingle, len(words)) - 1:].tolist()
    digest, votes = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for i in range(0, count, CHUNK):
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[i:i + CHUNK], ends[i:i + CHUNK], strict=True)])
        votes += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > count).view(">i8")[0])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [fingerprint(t.as_py()) for t in batch.column("sh_text")]
        yield pa.RecordBatch.from_arrays([batch.column("sh_doc"), pa.array(prints, pa.int64())], names=["sh_doc", "fp"])


def fingerprints(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """sh_doc (the named columns, all by default), fp."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns or docs.columns]).alias("sh_doc"), F.col("text").cast("string").alias("sh_text"))
    return rows.mapInArrow(_hashed, T.StructType([rows.schema["sh_doc"]]).add("fp", "long"))


def bit_counts(fp: Column) -> Column:
    """The counts of the 32 segments, two bits each: the low bit where one is set, the high bit where both are."""
    odd, even = fp.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW))
    return odd.bitwiseXOR(even).bitwiseOR(F.shiftleft(odd.bitwiseAND(even), 1))


def manhattan(a: Column, b: Column) -> Column:
    """Of two packed count vectors: fields differ by 1 where their XOR has the low bit, by 2 where only the high one."""
    x = a.bitwiseXOR(b)
    high = F.shiftrightunsigned(x, 1).bitwiseAND(F.bitwise_not(x)).bitwiseAND(F.lit(LOW))
    return F.bit_count(x.bitwiseAND(F.lit(LOW))) + 2 * F.bit_count(high)


def cells(points: DataFrame) -> DataFrame:
    """fp, counts, half, step, cell: own cell (step 0) and the cells next to it (step 1), in both halves."""
    counts = points.select("fp", bit_counts(F.col("fp")).alias("counts"))
    parts = []
    for half, mask in enumerate(HALVES):
        own = F.col("counts").bitwiseAND(F.lit(mask))
        around = [F.struct(F.lit(half).alias("half"), F.lit(0).alias("step"), own.alias("cell"))]
        for i in range(half * 16, half * 16 + 16):
            count = F.shiftrightunsigned(F.col("counts"), 2 * i).bitwiseAND(F.lit(3).cast("long"))
            for there, other in ((count < 2, count + 1), (count > 0, count - 1)):
                moved = own.bitwiseXOR(F.shiftleft(count.bitwiseXOR(other), 2 * i))
                around.append(F.when(there, F.struct(F.lit(half).alias("half"), F.lit(1).alias("step"), moved.alias("cell"))))
        parts += around
    spread = counts.select("fp", "counts", F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("at"))
    return spread.select("fp", "counts", "at.half", "at.step", "at.cell")


def links(points: DataFrame, bits: int = BITS) -> DataFrame:
    """a, b: pairs of different fingerprints (column fp, distinct) that differ in at most ``bits`` <= 5 bits, each at least once."""
    spread = cells(points)
    x, y = spread.alias("x"), spread.alias("y")
    mask = F.when(F.col("x.half") == 0, F.lit(HALVES[0])).otherwise(F.lit(HALVES[1]))
    halfway = manhattan(F.col("x.counts").bitwiseAND(mask), F.col("y.counts").bitwiseAND(mask))
    meet = (
        (F.col("x.half") == F.col("y.half")) & (F.col("x.cell") == F.col("y.cell"))
        & (F.col("x.step") <= F.col("y.step")) & ((F.col("x.step") != F.col("y.step")) | (F.col("x.fp") < F.col("y.fp")))
        & (manhattan(F.col("x.counts"), F.col("y.counts")) <= bits)
        & (halfway == F.col("x.step") + F.col("y.step"))
        & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= bits)
    )
    return x.join(y, meet).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))


def roots(prints: DataFrame) -> DataFrame:
    """fp, component_id for every distinct fingerprint of ``prints`` (columns doc_id, fp)."""
    points = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    joined = components(links(points.select("fp")))
    rooted = points.join(joined, points["fp"] == joined["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(smallest, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id."""
    prints = cut(fingerprints(docs, ["doc_id"]).select("sh_doc.doc_id", "fp"))
    return prints.join(roots(prints), "fp")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, that with the smallest id (a null id comes last); columns as they were.

    Documents of one id but other text or source are told apart by their key; rows alike in all three leave one row.
    """
    keyed = docs.withColumn("_row_key", row_key())
    prints = cut(fingerprints(keyed, ["doc_id", "_row_key"]).select("sh_doc.doc_id", "sh_doc._row_key", "fp"))
    points = prints.join(roots(prints), "fp")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.col("_row_key").alias("key"))
    kept = points.groupBy(F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp"), "fp")).alias("component")).agg(F.min(order)["key"].alias("_kept"))
    left = keyed.join(kept.select("_kept"), F.col("_row_key") == F.col("_kept")).dropDuplicates(["_row_key"])
    return left.select(*[f"`{c}`" for c in docs.columns])


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
