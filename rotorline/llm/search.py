"""Ranked lexical search by range maxima over posting lists.

Terms are runs of ASCII digits, letters and non-ASCII characters, A-Z lower-cased. A document's score is the sum over an
item's distinct terms of ``weight * impact``; weights fall with the number of documents that hold the term, impacts rise
with its count in the document and fall with the document's length (all integers, see ``impacts`` and ``weights``).

1. One scan of the texts writes, per document, its length and the counts of the terms that any item asks for. Numbers of
   documents and words and the terms' document counts are sums over that table.
2. Each task takes blocks of ``BLOCK`` postings or so, sorts documents by id, and holds every term's postings with a sparse
   table of range maxima: the place of the largest impact of any stretch of a posting list in two look-ups.
3. For each item a queue holds intervals of documents under their bound, the sum of the weighted range maxima of all its
   terms in the interval. The best interval is split at the document with the largest single contribution: that
   document is scored exactly and both sides go back with their own bounds. Intervals whose bound is below the worst of
   the best ``top`` documents found so far by this task are dropped, and those that only tie and lie behind it.
4. The best ``top`` of every task are merged in two steps, first within groups of tasks.

Nothing is approximated: every document is indexed and every item gets its exact best documents. Items are dealt into
blocks of about ``ITEM_WORDS`` words (counted, not assumed), and for each the texts are scanned once, so that what is
broadcast stays bounded.

Edge cases: null texts and texts without terms match nothing and do not count; items without terms get no rows; long
texts have as many postings as the items have terms at most; equal scores go by ascending id, a null id last; repeated
documents are ranked each for itself, repeated items too; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rotorline.llm.base import fresh_path, table
from rotorline.llm.decontaminate import words_of

TOP = 10
BLOCK = 1_000_000
ITEM_WORDS = 200_000
AT_ONCE = 32  # intervals split together
GROUPED = 256  # tasks whose results are merged first


def counted(numbers: Broadcast):
    """Per document its number of terms, and numbers and counts of those that are asked for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = numbers.value.get
        for batch in batches:
            sizes, terms, counts = [], [], []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                found = Counter(map(get, words))
                found.pop(None, None)
                sizes.append(len(words))
                terms.append(np.fromiter(found.keys(), np.int32, len(found)))
                counts.append(np.fromiter(found.values(), np.int32, len(found)))
            arrays = [pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", "n", "terms", "counts"])

    return run


def weights(documents: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


def impacts(counts: np.ndarray, sizes: np.ndarray, documents: int, words: int) -> np.ndarray:
    length = 100 - 90 + (90 * sizes * documents) // words
    return (1_000_000_000 * counts) // (1000 * counts + 8 * length)


class Postings:
    """The posting lists of a block of documents, one after another, with their range-maximum table."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, terms: int, docs: int):
        order = np.lexsort((doc, term))
        self.docs, self.impact = docs, impact[order]
        self.key = term[order].astype(np.int64) * docs + doc[order]
        self.start = np.searchsorted(self.key, np.arange(terms + 1, dtype=np.int64) * docs)
        longest = int(np.diff(self.start).max()) if terms else 0
        #: best[j][i]: the place of the first largest impact of the 2**j postings from i
        self.best = [np.arange(len(order), dtype=np.int32)]
        while 2 << (len(self.best) - 1) <= longest:
            half, last = 1 << (len(self.best) - 1), self.best[-1]
            left, right = last[:len(last) - half], last[half:]
            self.best.append(np.where(self.impact[left] >= self.impact[right], left, right))

    def highest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The place of the first largest impact in each [low, high), none of them empty."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        left, right = np.empty_like(low), np.empty_like(low)
        for j in np.unique(level).tolist():
            at = level == j
            left[at], right[at] = self.best[j][low[at]], self.best[j][high[at] - (1 << j)]
        return np.where(self.impact[left] >= self.impact[right], left, right)

    def search(self, terms: np.ndarray, weight: np.ndarray, top: int, known: list[tuple[int, float]]) -> list[tuple[int, float]]:
        """The best documents as (-score, document), ascending, ``known`` ones of the same form included."""
        there = (self.start[terms] < self.start[terms + 1]) & (weight > 0)
        terms, weight = terms[there], weight[there]
        best, queue, ticket = list(known), [], count()
        if not len(terms):
            return best
        base = terms.astype(np.int64) * self.docs

        def hopeless(bound: int, first: int) -> bool:
            return len(best) >= top and (bound < -best[-1][0] or bound == -best[-1][0] and first > best[-1][1])

        def offer(low: np.ndarray, high: np.ndarray, first: np.ndarray) -> None:
            filled = low < high
            places = np.zeros_like(low)
            places[filled] = self.highest(low[filled], high[filled])
            worth = np.where(filled, self.impact[places] * weight, 0)
            bounds, leads = worth.sum(1).tolist(), worth.argmax(1)
            splits = self.key[places[np.arange(len(leads)), leads]] % self.docs
            for i, (bound, begin) in enumerate(zip(bounds, first.tolist(), strict=True)):
                if bound > 0 and not hopeless(bound, begin):
                    heapq.heappush(queue, (-bound, begin, next(ticket), int(splits[i]), low[i], high[i]))

        offer(self.start[terms][None, :], self.start[terms + 1][None, :], np.zeros(1, np.int64))
        at_once = 1
        while queue:
            taken = []
            while queue and len(taken) < at_once:
                item = heapq.heappop(queue)
                if hopeless(-item[0], item[1]):
                    if -item[0] < -best[-1][0]:
                        queue.clear()
                    continue
                taken.append(item)
            if not taken:
                break
            at_once = min(AT_ONCE, 2 * at_once)
            doc = np.array([t[3] for t in taken])
            low, high = np.array([t[4] for t in taken]), np.array([t[5] for t in taken])
            wanted = base[None, :] + doc[:, None]
            place = np.searchsorted(self.key, wanted)
            held = self.key[np.minimum(place, len(self.key) - 1)] == wanted
            scores = np.where(held, self.impact[np.minimum(place, len(self.key) - 1)] * weight, 0).sum(1)
            for score, own in zip(scores.tolist(), doc.tolist(), strict=True):
                insort(best, (-score, own))
            del best[top:]
            offer(np.concatenate((low, place + held)), np.concatenate((place, high)), np.concatenate(([t[1] for t in taken], doc + 1)))
        return best


def searcher(asked: Broadcast, top: int):
    """Per task, the best documents of every item: item, doc_id, score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight, documents, words = asked.value
        best: list[list[tuple[int, object]]] = [[] for _ in items]  # (-score, id) by score, then id
        rank = lambda pair: (pair[0], pair[1] is None, 0 if pair[1] is None else pair[1])
        kind = None

        def finish(gathered: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(gathered)
            rows = rows.take(pc.sort_indices(rows.column("doc_id"), null_placement="at_end")).combine_chunks()
            own, sizes = rows.column("doc_id").to_pylist(), rows.column("n").to_numpy()
            each = pc.list_value_length(rows.column("terms")).to_numpy()
            term, counts = (rows.column(c).combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("terms", "counts"))
            doc = np.repeat(np.arange(len(own)), each)
            postings = Postings(term, doc, impacts(counts, sizes[doc], documents, words), len(weight), len(own))
            keys = [(x is None, 0 if x is None else x) for x in own]
            for i, terms in enumerate(items):
                # What is known from earlier blocks takes part at its place between this block's documents.
                before = {}
                for score, x in best[i]:
                    place = bisect_left(keys, (x is None, 0 if x is None else x)) - 0.5
                    before.setdefault((score, place), []).append(x)
                known = sorted((score, place) for (score, place), xs in before.items() for _ in xs)
                found = postings.search(terms, weight[terms], top, known)
                best[i] = sorted(((score, before[score, place].pop(0) if (score, place) in before else own[int(place)]) for score, place in found), key=rank)

        gathered, size = [], 0
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            gathered.append(batch)
            size += len(batch.column("terms").flatten())
            if size >= BLOCK:
                finish(gathered)
                gathered, size = [], 0
        if gathered:
            finish(gathered)
        if kind is not None:
            rows = [(i, x, -score) for i, found in enumerate(best) for score, x in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.int64())], names=["item", "doc_id", "score"])

    return run


def _ranked(hits: DataFrame, keys: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, item_words: int = ITEM_WORDS) -> DataFrame:
    """item_id, rank, doc_id, score: for every row of ``items`` (item_id, text) its best rows of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    context, id_type = spark.sparkContext, docs.schema["doc_id"].dataType.simpleString()
    asked = items.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null")
    size = asked.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0
    blocks = int(size // item_words) + 1
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = None
    for i in range(blocks):
        part = [(r.item_id, list(dict.fromkeys(words_of(r.text)))) for r in asked.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == i).collect()]
        numbers: dict[bytes, int] = {}
        terms = [np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64) for _, words in part]
        path = fresh_path(spark, "postings")
        texts.mapInArrow(counted(context.broadcast(numbers)), f"doc_id {id_type}, n long, terms array<int>, counts array<int>").where("n > 0").write.parquet(path)
        rows = spark.read.parquet(path)
        documents, words = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(numbers), np.int64)
        for r in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one row a term of this block of items
            df[r.term] = r["count"]
        ask = context.broadcast((terms, weights(documents, df), documents, words))
        hits = rows.where(F.size("terms") > 0).mapInArrow(searcher(ask, top), f"item int, doc_id {id_type}, score long")
        near = _ranked(hits.withColumn("_group", F.floor(F.spark_partition_id() / GROUPED)), ["item", "_group"], top)
        names = spark.createDataFrame([(k, x[0]) for k, x in enumerate(part)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        found = _ranked(near.drop("rank", "_group"), ["item"], top).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.union(found)
    return out


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _duck_terms(expr: str) -> str:
    return rf"coalesce(regexp_extract_all(translate({expr}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), [])"


ORACLE = f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {_duck_terms("text")} AS w FROM documents),
dim AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_words FROM doc WHERE len(w) > 0),
asked AS (SELECT DISTINCT q, item_id, unnest(w) AS t FROM (SELECT row_number() OVER () AS q, item_id, {_duck_terms("text")} AS w FROM benchmark)),
tf AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS t FROM doc) SEMI JOIN asked USING (t) GROUP BY r, t),
wt AS (SELECT t, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, dim GROUP BY t),
hit AS (
  SELECT q, item_id, doc_id, r, sum(wt.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(doc.w)::BIGINT * n_docs) // n_words))))::BIGINT AS score
  FROM asked JOIN tf USING (t) JOIN wt USING (t) JOIN doc USING (r), dim GROUP BY q, item_id, doc_id, r
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM hit WHERE score > 0)
WHERE rank <= {TOP}
"""
