"""Benchmark decontamination with one Aho-Corasick automaton over the test items.

Texts are normalised to words: A-Z lower-cased, then maximal runs of ASCII digits, letters and non-ASCII characters.
Every item gives its windows of ``WINDOW`` consecutive words, an item with fewer its whole sequence. The automaton's
symbols are words, so it has one node per word of a window; a document is scanned once, words outside the test set
being one symbol that matches nothing. Matches are word ranges; ``spans`` maps them back to the original text.

Test sets are small and fixed, and that is checked, not assumed: their words are counted first, and items are dealt
into blocks of about ``BLOCK_WORDS`` words. Each block is broadcast and scanned in turn, with the table written to the
shared folder between blocks, so memory stays bounded for any benchmark.

Edge cases: a null or empty text has no words and is clean, and such an item has no windows; repeated items and equal
windows of several items count for each item id; items without an id are not looked for; repeated documents are judged
each for itself; empty tables give no rows or no hits. Added columns start with ``dc_``; of the document's own columns
all are kept, whatever they are called.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rotorline.llm.base import cut, table

WINDOW = 13
BLOCK_WORDS = 100_000
SHARE = 20  # contaminated when at least one word in so many is hit

# Bytes that end a word become spaces, A-Z become a-z, the rest stays.
FOLD = bytes(c if c in b"0123456789abcdefghijklmnopqrstuvwxyz" or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
WORD_IN_TEXT = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")

_automata: dict[str, tuple] = {}


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


def windows(words: list[bytes], window: int) -> list[tuple[bytes, ...]]:
    return [tuple(words[i:i + window]) for i in range(max(1, len(words) - window + 1))] if words else []


def automaton(key: str, items: list[tuple[str, str]], window: int) -> tuple:
    """Word numbers and the automaton; kept per worker, for one block at a time."""
    if key not in _automata:
        _automata.clear()
        numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            for w in windows(words_of(text), window):
                owners.setdefault(tuple(numbers.setdefault(x, len(numbers) + 1) for x in w), set()).add(item)
        machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for pattern, ids in owners.items():
            machine.add_word(pattern, (len(pattern), sorted(ids)))
        machine.make_automaton()
        _automata[key] = numbers, machine if owners else None
    return _automata[key]


def scan(words: list[bytes], numbers: dict[bytes, int], machine) -> dict[str, list[tuple[int, int]]]:
    """For each item the word ranges [first, end) where one of its windows occurs."""
    found: dict[str, list[tuple[int, int]]] = {}
    if machine is None:
        return found
    get = numbers.get
    for at, (length, ids) in machine.iter(tuple([get(w, 0) for w in words])):
        for item in ids:
            ranges = found.setdefault(item, [])
            if ranges and ranges[-1][1] >= at + 1 - length >= ranges[-1][0]:
                ranges[-1] = (ranges[-1][0], at + 1)
            else:
                ranges.append((at + 1 - length, at + 1))
    return found


def merged(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, end in sorted(ranges):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as character ranges of the original text."""
    starts: dict[int, int] = {}
    stops: dict[int, int] = {}
    wanted, last = {i for first, end in ranges for i in (first, end - 1)}, ranges[-1][1] - 1
    for i, m in enumerate(WORD_IN_TEXT.finditer(text)):
        if i in wanted:
            starts[i], stops[i] = m.start(), m.end()
        if i == last:
            break
    return [(starts[first], stops[end - 1]) for first, end in ranges]


RANGE = pa.list_(pa.struct([("item", pa.string()), ("first", pa.int32()), ("end", pa.int32())]))
PLACE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
RESULT = "dc_words long, dc_hit long, dc_items array<string>, dc_spans array<struct<start:int,end:int>>"


def scanner(block: Broadcast, window: int, last: bool):
    """Add the ranges that this block finds; after the last block turn them into hit words, items and places."""
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, machine = automaton(key, block.value, window)
        for batch in batches:
            counts, hits, items, places, ranges_out = [], [], [], [], []
            for value, before in zip(batch.column("dc_text"), batch.column("dc_ranges"), strict=True):
                text = value.as_py()
                words = words_of(text)
                found = [(x["item"], x["first"], x["end"]) for x in before.as_py() or []]
                found += [(item, a, b) for item, ranges in scan(words, numbers, machine).items() for a, b in ranges]
                if not last:
                    ranges_out.append([{"item": item, "first": a, "end": b} for item, a, b in found])
                    continue
                whole = merged((a, b) for _, a, b in found)
                counts.append(len(words))
                hits.append(sum(b - a for a, b in whole))
                items.append(sorted({item for item, _, _ in found}))
                places.append([{"start": a, "end": b} for a, b in spans(text, whole)] if whole else [])
            if last:
                arrays = [pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(places, PLACE)]
                yield pa.RecordBatch.from_arrays([batch.column("dc_doc"), *arrays], names=["dc_doc", "dc_words", "dc_hit", "dc_items", "dc_spans"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column("dc_doc"), batch.column("dc_text"), pa.array(ranges_out, RANGE)], names=["dc_doc", "dc_text", "dc_ranges"])

    return run


def mark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents (as struct ``dc_doc``) with words, hit words, items and spans."""
    context = docs.sparkSession.sparkContext
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("item is not null and text is not null")
    size = items.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0
    blocks = int(size // block_words) + 1
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("dc_doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("dc_text"),
        F.from_json(F.lit("[]"), "array<struct<item:string,first:int,end:int>>").alias("dc_ranges"))
    for i in range(blocks):
        part = [(r.item, r.text) for r in items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i).collect()]
        last = i == blocks - 1
        schema = T.StructType([rows.schema["dc_doc"], *T.StructType.fromDDL(RESULT).fields]) if last else rows.schema
        rows = rows.mapInArrow(scanner(context.broadcast(part), window, last), schema)
        rows = rows if last else cut(rows)
    return rows


def contaminated() -> Column:
    return (F.col("dc_hit") > 0) & (SHARE * F.col("dc_hit") >= F.col("dc_words"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    return mark(docs, benchmark).where(~contaminated()).select("dc_doc.*")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return marked.select(
        F.col("dc_doc.doc_id").alias("doc_id"), F.col("dc_words").alias("n_words"), F.col("dc_hit").alias("n_hit"),
        F.size("dc_items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("dc_items"), ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"))


def _duck_words(expr: str) -> str:
    return rf"coalesce(regexp_extract_all(translate({expr}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"


ORACLE = f"""
WITH item AS (SELECT item_id::VARCHAR AS item, {_duck_words("text")} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS k, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS p
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS i FROM item WHERE len(w) > 0 AND item IS NOT NULL)
), doc AS (
  SELECT row_number() OVER () AS r, doc_id, {_duck_words("text")} AS w FROM documents
), pos AS (
  SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS p FROM (
    SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)
), hit AS (SELECT r, pos.k, i, item FROM pos JOIN win ON pos.p = win.p AND pos.k = win.k),
cov AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + k)) AS j FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(cov.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items,
       sha256(coalesce(its.s, '')) AS items_sha256, coalesce(cov.n, 0) > 0 AND {SHARE} * coalesce(cov.n, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN cov USING (r) LEFT JOIN its USING (r)
"""
