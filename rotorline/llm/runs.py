"""Periodic runs of words by block convolution.

A run is a stretch of words with smallest period q, at least ``max(LEAST, 2 * q)`` words long, which no neighbouring
word extends with that period. A text's runs are all found, whatever the period:

1. Scales double. At scale B the words are cut into aligned blocks of B words, and a run of a period from 2B-1 to 4B-2
   (from 1 to 6 at the first scale, B = 2) holds a whole block together with its copy one period on, because the run
   less one period has 2B-1 words or more.
2. A block's copies in the 4B-2 words after its start are the zeros of the sum of squared differences, taken for all
   distances at once as a correlation by number-theoretic transform: integers modulo a prime, no rounding. A sum that
   is zero is zero modulo the prime; the reverse is settled in step 4.
3. Blocks that cannot have a copy are left out first: one of their word groups does not come again within reach, or the
   whole window lies in a known run of a period up to B, where the copies are the period's multiples and nothing new.
4. Each distance seeds an extension: words are compared one distance apart to both sides until they differ. What is
   long enough is a run; of several periods of one stretch the smallest is its period.

Documents are searched together, one after another with separators that equal nothing, so that arrays stay long for
short texts; such a group holds ``GROUP`` words or one text. Blocks over ``CAP`` words are looked up by their first
``CAP`` words and the window piece by piece, so that a transform never grows beyond eight times that.

Edge cases: a null or empty text has no words and no runs; a very long text is one group and its memory a few dozen
bytes a word; of equal longest runs the first counts, then the shorter period; repeated documents are searched each for
itself; an empty table gives no rows; the document's columns are kept in ``pr_doc``, whatever they are called.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rotorline.llm.base import table

LEAST = 12
GROUP = 300_000
CAP = 1 << 14
SLICE = 1 << 18  # numbers in one transform array
PRIME, GENERATOR = 15 * 2**27 + 1, 31
MIX = np.uint64(0x9E3779B97F4A7C15)
Run = tuple[int, int, int]  # start, length, period


@lru_cache
def roots(size: int, inverse: bool) -> np.ndarray:
    """The first half of the powers of a root of unity of order ``size``, as a column."""
    step = pow(GENERATOR, (PRIME - 1) // size, PRIME)
    step = pow(step, -1, PRIME) if inverse else step
    out = np.ones(max(1, size // 2), np.uint64)
    done = 1
    while done < len(out):
        out[done:2 * done] = out[:done] * np.uint64(pow(step, done, PRIME)) % np.uint64(PRIME)
        done *= 2
    return out[:, None]


def transform(a: np.ndarray) -> np.ndarray:
    """In place down the columns; the result is in bit-reversed order."""
    prime, (n, width) = np.uint64(PRIME), a.shape
    size = n
    while size > 1:
        pairs = a.reshape(n // size, 2, size // 2, width)
        x, y = pairs[:, 0], pairs[:, 1]
        odd = (x + (prime - y)) * roots(size, False) % prime
        pairs[:, 0] = (x + y) % prime
        pairs[:, 1] = odd
        size //= 2
    return a


def restore(a: np.ndarray) -> np.ndarray:
    """The inverse of ``transform``, in place."""
    prime, (n, width) = np.uint64(PRIME), a.shape
    size = 2
    while size <= n:
        pairs = a.reshape(n // size, 2, size // 2, width)
        x, y = pairs[:, 0], pairs[:, 1] * roots(size, True) % prime
        odd = (x + (prime - y)) % prime
        pairs[:, 0] = (x + y) % prime
        pairs[:, 1] = odd
        size *= 2
    a *= np.uint64(pow(n, -1, PRIME))
    a %= prime
    return a


def copies(x: np.ndarray, at: np.ndarray, block: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the blocks x[at:at + block], the distances 1 .. reach at which they come again; x has no negative numbers.

    Returns the blocks' places and the distances.
    """
    prime, size = np.uint64(PRIME), 8 * block
    squares = np.concatenate(([0], np.cumsum(x * x % prime, dtype=np.uint64)))
    last = len(x) - 1
    places, distances = [], []
    for begin in range(0, len(at), max(1, SLICE // size)):
        own = at[begin:begin + max(1, SLICE // size)]
        pattern = np.zeros((size, len(own)), np.uint64)
        pattern[:block] = x[own[None, :] + np.arange(block - 1, -1, -1)[:, None]]
        transform(pattern)
        for first in range(1, reach + 1, size - block + 1):
            valid = min(size - block + 1, reach + 1 - first)
            spots = own[None, :] + first + np.arange(size)[:, None]
            window = np.where(spots <= last, x[np.minimum(spots, last)], np.uint64(0))
            cross = restore(transform(window) * pattern % prime)[block - 1:block - 1 + valid]
            starts = own[None, :] + first + np.arange(valid)[:, None]
            there = starts + block <= last + 1
            starts = np.where(there, starts, 0)
            sums = squares[starts + block] - squares[starts] + (squares[own + block] - squares[own])[None, :]
            zero = (sums % prime == 2 * cross % prime) & there
            distance, which = np.nonzero(zero)
            places.append(own[which])
            distances.append(distance + first)
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(distances)


def next_seen(hashes: np.ndarray) -> np.ndarray:
    """How far on each value comes again; a number beyond the end if never."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    out = np.full(len(hashes), 4 * len(hashes) + 4, np.int64)
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def stretch(x: np.ndarray, at: int, distance: int, low: int, high: int) -> tuple[int, int]:
    """The widest [a, b) around ``at`` within [low, high) in which x[i] == x[i + distance] for all i up to b - distance."""
    a, b, step = at, at, 16
    while b + distance < high:
        end = min(b + step, high - distance)
        differ = np.flatnonzero(x[b:end] != x[b + distance:end + distance])
        if len(differ):
            b += int(differ[0])
            break
        b, step = end, 4 * step
    step = 16
    while a > low:
        begin = max(low, a - step)
        differ = np.flatnonzero(x[begin:a] != x[begin + distance:a + distance])
        if len(differ):
            a = begin + int(differ[-1]) + 1
            break
        a, step = begin, 4 * step
    return a, b + distance


def runs_of(texts: list[np.ndarray], least: int = LEAST) -> list[list[Run]]:
    """The runs of each sequence of numbers from 0, by start and period."""
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    top = max((int(t.max()) + 1 for t in texts if len(t)), default=0)
    x = np.concatenate([part for i, t in enumerate(texts) for part in (t, [top + i])]).astype(np.uint64)
    n, longest = len(x), max(len(t) for t in texts)
    covered, period = np.zeros(n + 1, np.int64), np.ones(n + 1, np.int64)
    found: dict[tuple[int, int], int] = {}
    grams, seen = (x + np.uint64(1)) * MIX, np.zeros(0, np.int64)
    grams ^= grams >> np.uint64(29)
    block, width = 2, 1
    while block == 2 or 2 * (2 * block - 1) <= longest:
        reach = 4 * block - 2
        if width < min(block, 8):
            grams = grams[:-width] * (MIX + np.uint64(2 * width)) + grams[width:]
            width *= 2
            if not len(grams):
                break
            seen = next_seen(grams)
        soon = np.concatenate(([0], np.cumsum(seen <= reach)))
        at = np.arange(0, n - block + 1, block)
        if len(at):
            at = at[soon[at + block - width + 1] - soon[at] == block - width + 1]
        stops = bounds[np.searchsorted(bounds, at, "right")] - 1
        at = at[(covered[at] < np.minimum(at + reach + block, stops)) | (period[at] > block)]
        if len(at):
            spots, distances = copies(x, at, min(block, CAP), reach)
            fit = distances >= (1 if block == 2 else 2 * block - 1)
            order = np.lexsort((spots[fit], distances[fit]))
            done, end = 0, 0
            for spot, distance in zip(spots[fit][order].tolist(), distances[fit][order].tolist(), strict=True):
                if distance == done and spot + distance < end or covered[spot] >= spot + distance + block and distance % period[spot] == 0:
                    continue
                owner = int(np.searchsorted(bounds, spot, "right")) - 1
                begin, end = stretch(x, spot, distance, int(bounds[owner]), int(bounds[owner + 1]) - 1)
                done = distance
                if end - begin >= max(least, 2 * distance) and found.get((begin, end), distance + 1) > distance:
                    found[begin, end] = distance
                    wider = covered[begin:end] < end
                    covered[begin:end][wider] = end
                    period[begin:end][wider] = distance
        block *= 2
    out: list[list[Run]] = [[] for _ in texts]
    for (begin, end), q in found.items():
        owner = int(np.searchsorted(bounds, begin, "right")) - 1
        out[owner].append((begin - int(bounds[owner]), end - begin, q))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """True for the words that are in no run after its first period."""
    marks = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        marks[start + q] += 1
        marks[start + length] -= 1
    return np.cumsum(marks[:n]) == 0


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
RESULT = "pr_runs array<struct<start:long,length:long,period:long>>, pr_text string"


def _searcher(arrange: Callable[[str, int], np.ndarray | None] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("pr_id"), batch.column("pr_text")
            begin = 0
            while begin < len(batch):
                number: dict[bytes, int] = defaultdict(count().__next__)
                words, rows, size = [], [], 0
                while begin + len(rows) < len(batch) and size < GROUP:
                    own = texts[begin + len(rows)].as_py().encode().split()
                    if arrange and own:
                        order = arrange(ids[begin + len(rows)].as_py(), len(own))
                        own = own if order is None else [own[i] for i in order.tolist()]
                    words.append(own)
                    rows.append(np.fromiter(map(number.__getitem__, own), np.int64, len(own)))
                    size += len(own)
                found = runs_of(rows)
                kept = [b" ".join(w if not r else [w[i] for i in np.flatnonzero(kept_words(len(w), r)).tolist()]).decode() for w, r in zip(words, found, strict=True)]
                listed = [[{"start": a, "length": b, "period": q} for a, b, q in r] for r in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("pr_doc").slice(begin, len(rows)), pa.array(listed, RUNS), pa.array(kept, pa.string())], names=["pr_doc", "pr_runs", "pr_text"])
                begin += len(rows)

    return run


def periodic_runs(docs: DataFrame, arrange: Callable[[str, int], np.ndarray | None] | None = None) -> DataFrame:
    """Every document (struct ``pr_doc``) with its runs and its words without the repetitions, joined by a space.

    ``arrange`` may give, for a document's id as text (empty if null) and its number of words, the order in which its
    words are to be read, or None for the order they have.
    """
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("pr_doc"), id_text.alias("pr_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("pr_text"))
    return rows.mapInArrow(_searcher(arrange), T.StructType([rows.schema["pr_doc"], *T.StructType.fromDDL(RESULT).fields]))


def with_loop(doc_id: str, n: int) -> np.ndarray | None:
    """The order that gives every tenth document, by the hash of its id, a run up to its end."""
    h = crc32(doc_id.encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % p
    return order


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), with_loop)
    best = F.array_max(F.transform("pr_runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter"))))
    lines = F.transform("pr_runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    told = found.select(
        F.col("pr_doc.doc_id").alias("doc_id"), F.size("pr_runs").cast("long").alias("n_runs"), best.alias("best"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("pr_text", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.shorter")
    return told.select(
        "doc_id", "n_runs", (-F.col("best.before")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(F.lit(1000) * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
