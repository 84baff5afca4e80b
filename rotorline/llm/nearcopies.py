"""Near copies by fingerprints and by the exact similarity of word shingles.

Two documents are near copies when the Jaccard similarity of their sets of ``SHINGLE``-word shingles is ``SIMILARITY``
or more; links give components. Candidates come from the SimHash method of ``op10_simhash``, over shingles of this length,
and from MinHash bands for what is alike and yet further apart than the fingerprints reach. Every candidate pair is either
in one component already or compared exactly.

1. Documents of one shingle set are one point, known by the hash of the set. ``print`` is its SimHash fingerprint.
2. Fingerprints (``simhash.links``): segment bit counts, a grid of cells, the exact Hamming distance; pairs of up to
   ``simhash.BITS`` differing bits are candidates. Points of one fingerprint are candidates with the first of them.
3. Bands: a point's MinHash signature has ``BANDS`` bands of ``ROWS`` values; points that share a band may be near.
   A pair of similarity s shares none with probability (1 - s**8)**64: 8e-6 at 0.8, less above; at 0.5 one pair in five
   meets, at 0.4 one in 24. One bit of each value is kept as a sketch of 512 bits.
4. Hubs: in every band all points are compared with one of them, that which meets the most others over all its bands.
   In a crowd of edited copies that is the text they come from, or the copy closest to it, so that a crowd of any size
   joins in a comparison or a few for each point.
5. What is left: pairs of fingerprints whose points are still in two components, and bands whose points are still in several.
   For the bands, shingles that only one of all these points has are counted; since they are missing in every other one, u
   of them in a set of n leave room only for partners of up to ``(1 + 1/s) * (n - u) - n`` shingles. Points that find nobody
   that small in their band are done: a copy that is too far from a crowd's hub is too far from its other copies, for its own
   edits. Only bands that still hold several components are paired, and in them only pairs whose sizes and lone shingles fit
   both ways.
6. ``verified``: pairs whose sketches differ in over ``APART`` bits are put aside (at similarity 0.8 that is four standard
   deviations off, 3e-5); for the others both texts are read again and their shingle sets compared.

Steps after the first have a task for ``PER_TASK`` bands, not one for each of the session's shuffle partitions.

Edge cases: a null or empty text has no shingles and is a near copy of its like; fewer words than a shingle make one
shingle; a very long text is one set of eight bytes a shingle; repeated rows (id, text and source alike) leave one;
of equal ids the row with the smallest key stays; columns other than ``doc_id``, ``text`` and ``source`` are not looked
at and may have any names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotorline.llm.base import released as cut
from rotorline.llm.base import row_key
from rotorline.llm.components import components
from rotorline.llm.simhash import ASCII_LOWER, CHUNK as VOTED, SEED, links as fingerprint_links

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS, APART = 64, 8, 78
PER_TASK = 400_000  # bands
LINKS_PER_TASK = 100_000
WORDS = BANDS * ROWS // 64  # of the sketch
CHUNK = 256
HELD = 2_000_000  # shingles that a worker keeps for texts that come again
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SKETCH = [f"s{i}" for i in range(WORDS)]


def hashes_of(text: str | None) -> np.ndarray:
    """Hashes of the shingles, repeats included."""
    words = text.encode().translate(ASCII_LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:max(1, len(words) - SHINGLE + 1)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[min(SHINGLE, len(words)) - 1:].tolist(), strict=True)], np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the distinct shingles, ascending."""
    return np.unique(hashes_of(text))


def voted(hashes: np.ndarray) -> int:
    """``simhash.fingerprint`` of the text that has these shingles."""
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), VOTED):
        votes += np.unpackbits(hashes[i:i + VOTED].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes)).view(">i8")[0])


def signature(hashes: np.ndarray) -> np.ndarray:
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), CHUNK):
        np.minimum(least, (FACTORS[:, None] * hashes[None, i:i + CHUNK]).min(1), out=least)
    return least


def banded(signed: np.ndarray) -> list[int]:
    """One number for each band."""
    digest, width = xxhash.xxh64_intdigest, 8 * ROWS
    data = signed.tobytes()
    return np.array([digest(data[i * width:(i + 1) * width], i) for i in range(BANDS)], np.uint64).view(np.int64).tolist()


def sketched(signed: np.ndarray) -> list[int]:
    """A bit of each value."""
    return np.packbits((signed >> np.uint64(17)).astype(np.uint8) & 1).view(">i8").tolist()


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        said = [hashes_of(t.as_py()) for t in batch.column("text")]
        voices = pa.array([voted(h) for h in said], pa.int64())
        sets = [np.unique(h) for h in said]
        prints = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
        signed = [signature(s) for s in sets]
        sketches = np.array([sketched(s) for s in signed], np.int64).reshape(-1, WORDS)
        bands = pa.array([banded(s) for s in signed], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("key"), pa.array(prints, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), voices, bands, *[pa.array(sketches[:, i]) for i in range(WORDS)]],
            names=["doc_id", "key", "fp", "size", "print", "bands", *SKETCH])


def _near(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str | None, np.ndarray] = {}
        held = 0

        def known(text: str | None) -> np.ndarray:
            nonlocal held
            if text not in kept:
                if held > HELD:
                    kept.clear()
                    held = 0
                kept[text] = shingles(text)
                held += len(kept[text]) + len(text or "") // 8
            return kept[text]

        for batch in batches:
            near = [similarity_of(known(x.as_py()), known(y.as_py())) >= similarity for x, y in zip(batch.column("a_text"), batch.column("b_text"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))
    return run


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t.as_py()).view(np.int64) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.array(sets, pa.list_(pa.int64()))], names=["fp", "shingles"])


def _side(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """``fp`` and the columns named, as ``name`` and with that in front."""
    return df.select(F.col("fp").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])


def _sizes_fit(similarity: float, a: str = "a", b: str = "b") -> Column:
    return (F.col(f"{a}_size") >= similarity * F.col(f"{b}_size")) & (F.col(f"{b}_size") >= similarity * F.col(f"{a}_size"))


def _sketches_fit(a: str = "a", b: str = "b") -> Column:
    differ = F.lit(0)
    for c in SKETCH:
        differ = differ + F.bit_count(F.col(f"{a}_{c}").bitwiseXOR(F.col(f"{b}_{c}")))
    return differ <= APART


def bodies(fps: DataFrame, points: DataFrame, texts: DataFrame) -> DataFrame:
    """fp, text of the points listed. points: fp, key; texts: key, text."""
    return points.select("fp", "key").join(fps.select("fp").distinct(), "fp").join(texts, "key").select("fp", "text").dropDuplicates(["fp"])


def verified(likely: DataFrame, points: DataFrame, texts: DataFrame, similarity: float, tasks: int) -> DataFrame:
    """a, b: the pairs of points that are near copies."""
    likely = cut(likely.coalesce(tasks))
    read = cut(bodies(likely.select(F.col("a").alias("fp")).union(likely.select("b")), points, texts).coalesce(tasks))
    paired = likely.join(_side(read, "a", ["text"]), "a").join(_side(read, "b", ["text"]), "b").coalesce(tasks)
    return cut(paired.mapInArrow(_near(similarity), "a long, b long"))


def lone_shingles(fps: DataFrame, points: DataFrame, texts: DataFrame) -> DataFrame:
    """fp, lone: how many shingles of a point no other point of those listed has."""
    spread = bodies(fps, points, texts).mapInArrow(_listed, "fp long, shingles array<long>").select("fp", F.explode("shingles").alias("shingle"))
    alone = spread.groupBy("shingle").agg(F.min("fp").alias("fp"), F.count("*").alias("n")).where("n = 1")
    return alone.groupBy("fp").agg(F.count("*").alias("lone"))


def links(points: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """a, b: enough near pairs of points to join every component. points: fp, key, size, print, bands, sketch; texts: key, text."""
    tasks = points.count() * BANDS // PER_TASK + 1
    points = points.coalesce(tasks)
    # Fingerprints: pairs of them, each by the first of its points, and the other points of each.
    first = cut(points.groupBy("print").agg(F.min("fp").alias("fp")).coalesce(tasks))
    alike = fingerprint_links(first.select(F.col("print").alias("fp")))
    for side in ("a", "b"):
        alike = alike.join(first.select(F.col("print").alias(side), F.col("fp").alias(f"{side}_fp")), side).coalesce(tasks)
    alike = cut(alike.select(F.col("a_fp").alias("a"), F.col("b_fp").alias("b")))
    same = points.select("print", F.col("fp").alias("b")).join(first, "print").where("fp <> b").select(F.col("fp").alias("a"), "b")

    known = points.select("fp", "size", *SKETCH)
    spread = points.select("fp", F.explode("bands").alias("band"))
    shared = cut(spread.join(spread.groupBy("band").agg(F.count("*").alias("met")).where("met > 1"), "band").coalesce(tasks))
    degrees = shared.groupBy("fp").agg(F.sum("met").alias("degree")).coalesce(tasks)
    hubs = shared.join(degrees, "fp").coalesce(tasks).groupBy("band").agg(F.max(F.struct("degree", "fp"))["fp"].alias("hub")).coalesce(tasks)
    placed = cut(shared.join(hubs, "band").select("fp", "band", "hub").coalesce(tasks))
    star = placed.where("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b")).union(same).distinct().coalesce(tasks)
    columns = ["size", *SKETCH]

    def likely(pairs: DataFrame) -> DataFrame:
        both = pairs.join(_side(known, "a", columns), "a").coalesce(tasks).join(_side(known, "b", columns), "b")
        return both.where(_sizes_fit(similarity) & _sketches_fit()).select("a", "b").coalesce(tasks)

    found = verified(likely(star), points, texts, similarity, tasks)

    def mixed(rows: DataFrame) -> DataFrame:
        """The rows of bands with several components, with the smallest size there."""
        several = rows.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("size").alias("least")).where("low < high")
        return rows.join(several.select("band", "least"), "band").coalesce(tasks)

    roots = components(found, LINKS_PER_TASK)
    apart = alike
    for side in ("a", "b"):
        apart = apart.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root")), side, "left").coalesce(tasks)
    apart = apart.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")

    rooted = placed.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    left = cut(mixed(rooted.join(known, "fp").coalesce(tasks)))
    lone = lone_shingles(left.select("fp"), points, texts).coalesce(tasks)
    room = (1 + 1 / similarity) * (F.col("size") - F.coalesce("lone", F.lit(0))) - F.col("size")
    fitted = left.join(lone, "fp", "left").coalesce(tasks).withColumn("room", room + 1e-6).where(F.col("room") >= F.col("least")).drop("least")
    final = cut(mixed(fitted).where("fp <> hub").select("fp", "band", "root", "room", *columns))
    final = final.join(final.groupBy("fp").agg(F.collect_list("band").alias("all")), "fp").coalesce(tasks)  # 64 bands at most
    x, y = (final.select("band", *[F.col(c).alias(f"{n}_{c}") for c in final.columns if c != "band"]) for n in ("a", "b"))
    fit = _sizes_fit(similarity) & _sketches_fit() & (F.col("b_size") <= F.col("a_room")) & (F.col("a_size") <= F.col("b_room"))
    # A pair comes up in the first of its common bands only.
    once = x["band"] == F.array_min(F.array_intersect("a_all", "b_all"))
    rest = x.join(y, (x["band"] == y["band"]) & (F.col("a_fp") < F.col("b_fp")) & (F.col("a_root") != F.col("b_root")) & fit & once)
    rest = rest.select(F.col("a_fp").alias("a"), F.col("b_fp").alias("b")).union(likely(apart))
    return cut(found.union(verified(rest, points, texts, similarity, tasks)).coalesce(tasks))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each component, that with the smallest id (a null id comes last); columns as they were.

    Documents of one id but other text or source are told apart by their key; rows alike in all three leave one row.
    """
    packed = docs.select(row_key().alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    rows = docs.select("doc_id", row_key().alias("key"), F.col("text").cast("string").alias("text"))
    sketch = "".join(f", {c} long" for c in SKETCH)
    prints = cut(rows.mapInArrow(_hashed, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, key long, fp long, size long, print long, bands array<long>{sketch}"))
    points = cut(prints.groupBy("fp").agg(F.min("key").alias("key"), *[F.first(c).alias(c) for c in ("size", "print", "bands", *SKETCH)]))
    joined = components(links(points, rows.select("key", "text"), similarity), LINKS_PER_TASK)
    rooted = prints.select("doc_id", "key", "fp").join(joined.withColumnRenamed("node", "fp"), "fp", "left")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    kept = rooted.groupBy(F.coalesce("root", "fp").alias("component")).agg(F.min(order)["key"].alias("key"))
    return packed.join(kept.select("key"), "key").dropDuplicates(["key"]).select("doc.*")
