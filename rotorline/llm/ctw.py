"""Language-model scoring by context-tree weighting over bytes.

A text is read as its lower-cased words, each with a closing space, and one end byte. A byte is eight binary decisions,
and a decision's contexts are the bytes before it, 0 to ``DEPTH`` of them (before the text there are spaces). Every
context and decision has a Krichevsky-Trofimov estimate from the training texts. Its weighted probability is half its
own estimate and half the product over its longer contexts; the ratio of the two says how much of the prediction stops
at this depth, so that a prediction mixes the estimates of all depths. A context that training never met hands its part
to the next shorter one. The tree is static once counted.

How it spreads:

1. ``contexts``: (context, next byte) pairs of all texts with training counts. Tasks give out sums of what they met.
2. ``predictions``: pairs are grouped by the last two context bytes, a whole subtree each. Bottom-up sums leave one
   small table for depths 0 and 1 (256 contexts of 255 decisions at most), which is solved on the driver; top-down
   every pair gets its log probability.
3. ``score``: a text adds up its bytes by look-up. The table of pairs is broadcast in blocks of at most ``BLOCK`` pairs
   (``WIDTH`` bytes each); a larger table takes as many passes over the texts, whose sums are added.
4. ``vocabulary``, for the base score: each distinct word of all texts with its training count. The ``HEAD`` most
   frequent words or fewer (by a count limit that a histogram gives) are broadcast, and a text adds them up in place;
   its other words go through a join. A text without others joins by its rarest word.

The code length in bits per byte is ``-log2(10) * score / n_bytes``.

Edge cases: a null text is empty, an empty text has only its end; null ids hash as empty text; repeated rows (same id,
same text) all get their score; without training texts every decision is 1/2; an empty table gives no rows. Columns
other than ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotorline.llm.base import cut, fold, table

FOLDS, HELD = 7, 2
DEPTH = 5
BLOCK, WIDTH = 2_000_000, 16
HEAD = 400_000
FLUSH = 300_000
SLICE = 1 << 19
END = b"\n"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
LOG2 = math.log(2)


def words_of(text: str | None) -> list[bytes]:
    """The text's tokens, the end among them."""
    return ((text.encode().translate(LOWER).split()) if text else []) + [END]


# Words


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, trained = set(), Counter()

    def out():
        words = list(seen)
        batch = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([trained[w] for w in words], pa.int64())], names=["word", "n"])
        seen.clear(), trained.clear()
        return batch

    for batch in batches:
        for text, held in zip(batch.column("text"), batch.column("held_out"), strict=True):
            words = words_of(text.as_py())
            seen.update(words)
            if not held.as_py():
                trained.update(words)
            if len(seen) > FLUSH:
                yield out()
    yield out()


def texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), F.col("text").cast("string").alias("text"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: training counts of all distinct words."""
    return texts(docs).select("text", "held_out").mapInArrow(_counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


# Contexts


def stream_of(tokens: list[bytes]) -> bytes:
    """The bytes that are predicted: words with closing spaces, then the end."""
    return b" ".join(tokens)


def windows(streams: Iterable[bytes], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For every byte its context and itself as one number, in slices of bounded size; which streams the numbers of a
    slice are of, and how many each has."""
    pad, pending, size = b" " * depth, [], 0

    def out():
        sizes = np.array([len(x) - depth for _, x in pending], np.int64)
        data = np.frombuffer(b"".join(x for _, x in pending), np.uint8)
        key = data[:len(data) - depth].astype(np.int64)
        for j in range(1, depth + 1):
            key <<= 8
            key |= data[j:len(data) - depth + j]
        # The padding between streams is no byte to predict.
        real = np.ones(len(key), bool)
        gaps = (np.cumsum(sizes + depth)[:-1] - depth)[:, None] + np.arange(depth)
        real[gaps] = False
        return key[real], np.array([i for i, _ in pending], np.int64), sizes

    for i, stream in enumerate(streams):
        for at in range(0, len(stream), SLICE):
            part = (pad + stream[:SLICE]) if at == 0 else (pad + stream[max(0, at - depth):at])[-depth:] + stream[at:at + SLICE]
            pending.append((i, part))
            size += len(part)
            if size >= SLICE:
                yield out()
                pending, size = [], 0
    if pending:
        yield out()


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often they occur."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def _paired(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def gathered():
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)

        def batch_of(keys, counts):
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "n"])

        for batch in batches:
            held = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            for rows, counts in ((np.flatnonzero(~held), True), (np.flatnonzero(held), False)):
                texts_in = batch.column("text").take(pa.array(rows))
                for key, _, _ in windows((stream_of(words_of(t.as_py())) for t in texts_in), depth):
                    keys, n = runs(key)
                    parts.append((keys, n if counts else np.zeros_like(n)))
                    if sum(len(k) for k, _ in parts) > 5 * FLUSH:
                        parts[:] = [gathered()]
                        if len(parts[0][0]) > 3 * FLUSH:
                            yield batch_of(*parts.pop())
        if parts:
            yield batch_of(*gathered())

    return run


def contexts(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """key, n: (context, next byte) pairs of all texts with training counts."""
    return texts(docs).select("text", "held_out").mapInArrow(_paired(depth), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


# The tree


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, eight steps up."""
    z = x + 8
    steps = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - steps


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability that the estimator gives to so many zeros and ones, in any order."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - math.log(math.pi) - log_gamma(zeros + ones + 1)


class Level:
    """The decisions at one depth: keys (context << 8 | node), counts, log estimate and log weighted probability."""

    def __init__(self, keys, zeros, ones, below=None):
        self.keys, self.zeros, self.ones = keys, zeros, ones
        self.own = log_kt(zeros, ones)
        self.weighted = self.own if below is None else np.logaddexp(self.own, below) - LOG2
        self.stop = np.ones(len(keys)) if below is None else np.exp(self.own - self.weighted) / 2
        self.seen = zeros + ones > 0

    def shorter(self, depth: int) -> tuple[Level, np.ndarray]:
        """The level of ``depth`` above this one, and where each decision's parent is in it."""
        mask = (1 << 8 * depth) - 1
        keys, at = np.unique(((self.keys >> 8 & mask) << 8) | (self.keys & 255), return_inverse=True)
        add = lambda x: np.bincount(at, x, len(keys))
        return Level(keys, add(self.zeros), add(self.ones), add(self.weighted)), at

    def predict(self, mass: np.ndarray, left: np.ndarray, above: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Carry on from the parents' mixture: probability of a one so far, weight left for longer contexts, estimate in force."""
        estimate = np.where(self.seen, (self.ones + 0.5) / (self.zeros + self.ones + 1), above)
        stop = np.where(self.seen, self.stop, 1.0)
        return mass + left * stop * estimate, left * (1 - stop), estimate


def decisions(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair its eight (context << 8 | node) keys and bits."""
    byte, step = key[:, None] & 255, np.arange(8)
    return ((key[:, None] >> 8) << 8) | (1 << step) | (byte >> (8 - step)), byte >> (7 - step) & 1


def bottom_up(key: np.ndarray, n: np.ndarray, depth: int, until: int) -> tuple[list[Level], list[np.ndarray]]:
    """Levels from ``depth`` to ``until``; with each, where the one before (at first the decisions of the pairs) points in it."""
    at, bit = decisions(key)
    keys, where = np.unique(at.ravel(), return_inverse=True)
    weights = np.repeat(n, 8).astype(float)
    bits = bit.ravel()
    levels, links = [Level(keys, np.bincount(where, weights * (1 - bits), len(keys)), np.bincount(where, weights * bits, len(keys)))], [where]
    for d in range(depth - 1, until - 1, -1):
        level, link = levels[-1].shorter(d)
        levels.append(level)
        links.append(link)
    return levels, links


def top_mixture(rows: pd.DataFrame) -> np.ndarray:
    """mass, left, estimate after depths 0 and 1, by last context byte and node."""
    out = np.zeros((3, 256, 256))
    if not len(rows):
        return out
    first = Level(rows["node_key"].to_numpy(np.int64), rows["zeros"].to_numpy(float), rows["ones"].to_numpy(float), rows["weighted"].to_numpy(float))
    root, at = first.shorter(0)
    half = np.full(len(root.keys), 0.5)
    mass, left, estimate = (x[at] for x in root.predict(np.zeros(len(half)), np.ones(len(half)), half))
    out[:, first.keys >> 8, first.keys & 255] = first.predict(mass, left, estimate)
    return out


def predictions(pairs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """key, log_p: natural log probability of the byte in its context."""
    grouped = pairs.withColumn("subtree", F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF).cast("long")))

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        level = bottom_up(rows["key"].to_numpy(), rows["n"].to_numpy(), depth, 2)[0][-1]
        return pd.DataFrame({"node_key": level.keys & 0xFFFF, "zeros": level.zeros, "ones": level.ones, "weighted": level.weighted})

    shape = "node_key long, zeros double, ones double, weighted double"
    small = grouped.groupBy("subtree").applyInPandas(summed, shape).groupBy("node_key").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "weighted")])
    top = pairs.sparkSession.sparkContext.broadcast(top_mixture(small.toPandas()))

    def solved(rows: pd.DataFrame) -> pd.DataFrame:
        key = rows["key"].to_numpy()
        levels, links = bottom_up(key, rows["n"].to_numpy(), depth, 2)
        last = levels[-1].keys
        state = [x[(last >> 8) & 255, last & 255] for x in top.value]
        for level, link in zip(levels[::-1], [*links[:0:-1], None], strict=True):
            state = level.predict(*state)
            if link is not None:
                state = [x[link] for x in state]
        ones = np.clip(state[0], 1e-12, 1 - 1e-12)[links[0]].reshape(-1, 8)
        return pd.DataFrame({"key": key, "log_p": np.log(np.where(decisions(key)[1] == 1, ones, 1 - ones)).sum(1)})

    return grouped.groupBy("subtree").applyInPandas(solved, "key long, log_p double")


# Scores

_held: dict[str, tuple] = {}


def held_once(name: str, build):
    """What a broadcast unpacks to, once per worker; only the latest of its kind stays."""
    kind = name.split(":")[0]
    if name not in _held:
        for old in [k for k in _held if k.split(":")[0] == kind]:
            del _held[old]
        _held[name] = build()
    return _held[name]


class Lookup:
    """Numbers by 64-bit key: an open-addressing table over sorted arrays, looked up a slice at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.bits = max(4, int(1.6 * len(keys)).bit_length())
        self.table = np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), self.slots(keys)
        while len(left):
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]
            missed = self.table[slot] != left
            left, slot = left[missed], (slot[missed] + 1) & (len(self.table) - 1)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values; 0 where there is no such key."""
        if not len(self.keys):
            return np.zeros(len(keys))
        slot = self.slots(keys)
        at = self.table[slot]
        hit = (self.keys[at] == keys) & (at >= 0)
        out = np.where(hit, self.values[at], 0.0)
        left = np.flatnonzero(~hit & (at >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.table) - 1)
            at = self.table[slot[left]]
            hit = (self.keys[at] == keys[left]) & (at >= 0)
            out[left[hit]] = self.values[at[hit]]
            left = left[~hit & (at >= 0)]
        return out


def packed(keys: np.ndarray, values: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted keys as differences and single-precision values, compressed: small to send, small on disk."""
    order = np.argsort(keys)
    squeeze = zstandard.ZstdCompressor(3).compress
    steps = np.diff(keys[order], prepend=0).view(np.uint8).reshape(-1, 8).T
    return squeeze(np.ascontiguousarray(steps).tobytes()), squeeze(values[order].astype(np.float32).tobytes())


def unpacked(pair: tuple[bytes, bytes]) -> Lookup:
    open_up = zstandard.ZstdDecompressor().decompress
    steps = np.frombuffer(open_up(pair[0]), np.uint8).reshape(8, -1)
    return Lookup(np.cumsum(np.ascontiguousarray(steps.T).view(np.int64).ravel()), np.frombuffer(open_up(pair[1]), np.float32))


SHAPE = ("mark long", "word binary", "times long", "tokens long", "known long", "base double", "log_p double", "rows long")


def _added(name: str, block, head, denominator: float, depth: int):
    """Per text one row with its sums, and one for each word outside the head; the first carries a word as well.

    Without a head (passes over further blocks) there is one row with the sum of log probabilities.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held_once(f"model:{name}", lambda: unpacked(block.value))
        words, counts = head.value if head else ([], np.zeros(0, np.int64))
        index = held_once(f"head:{name}", lambda: {w: i for i, w in enumerate(words)}).get
        base = np.log10((counts + 1) / denominator)
        for batch in batches:
            owner, word, times, sums, sign, streams = [], [], [], [], [], []
            for i, value in enumerate(batch.column("text")):
                text = value.as_py()
                tokens = words_of(text)
                streams.append(stream_of(tokens))
                others, known, base_sum = [(None, 0)], 0, 0.0
                if head:
                    tally = Counter(tokens)
                    keys, n = list(tally), np.fromiter(tally.values(), np.int64, len(tally))
                    at = np.fromiter((index(w, -1) for w in keys), np.int64, len(keys))
                    place, m = at[at >= 0], n[at >= 0]
                    known, base_sum = int(m[counts[place] > 0].sum()), float(m @ base[place])
                    others = [(keys[j], int(n[j])) for j in np.flatnonzero(at < 0)] or [(keys[int(np.argmin(counts[at]))], 0)]
                mark = zlib.crc32(text.encode()) if text else 0
                owner += [i] * len(others)
                sign += [mark] * len(others)
                word += [w for w, _ in others]
                times += [t for _, t in others]
                sums.append((len(sums) and sums[-1][0] + sums[-1][1], len(others), len(tokens) if head else 0, known, base_sum))
            rows = len(owner)
            total = np.zeros(batch.num_rows)
            for key, at, sizes in windows(streams, depth):
                np.add.at(total, at, np.add.reduceat(model.get(key), np.cumsum(sizes) - sizes))
            first = np.array([x[0] for x in sums], np.int64)

            def on_first(values, kind, rows=rows, first=first):
                column = np.zeros(rows, kind)
                column[first] = values
                return pa.array(column)

            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(sign, pa.int64()), pa.array(word, pa.binary()), pa.array(times, pa.int64()),
                 on_first([x[2] for x in sums], np.int64), on_first([x[3] for x in sums], np.int64), on_first([x[4] for x in sums], float),
                 on_first(total, float), on_first(int(bool(head)), np.int64)],
                names=["doc_id", *(x.split()[0] for x in SHAPE)])

    return run


def count_limit(vocab: DataFrame, head: int) -> int:
    """The least training count that at most ``head`` words reach, by bins an eighth of an octave wide."""
    bins = vocab.where("n > 0").groupBy(F.floor(F.log2("n") * 8).alias("bin")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect()
    limit, total = 1 << 62, 0
    for row in sorted(bins, key=lambda r: -r.bin):
        total += row.words
        if total > head:
            break
        limit = row.least
    return limit


def score(docs: DataFrame, vocab: DataFrame, predicted: DataFrame, head: int = HEAD, block: int = BLOCK, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, in decimal logarithms."""
    context = docs.sparkSession.sparkContext
    total, kinds = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    denominator = float(total + kinds + 1)
    common = vocab.where(F.col("n") >= count_limit(vocab, head)).toArrow()
    frequent = context.broadcast((common["word"].to_pylist(), common["n"].to_numpy()))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    shape = ", ".join([f"doc_id {rows.schema['doc_id'].dataType.simpleString()}", *SHAPE])
    blocks = predicted.count() // block + 1
    passes = []
    for i in range(blocks):
        part = predicted.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == i).select("key", F.col("log_p").cast("float")).toArrow()
        sent = context.broadcast(packed(part["key"].to_numpy(), part["log_p"].to_numpy()))
        passes.append(rows.mapInArrow(_added(uuid.uuid4().hex, sent, frequent if i == 0 else None, denominator, depth), shape))
    times, count = F.col("times"), F.col("n")
    kept = ("doc_id", "mark", "tokens", "rows", "log_p")
    sums = passes[0].join(vocab, "word").select(
        *kept, (F.col("known") + F.when(count > 0, times).otherwise(0)).alias("known"), (F.col("base") + times * F.log10((count + 1) / F.lit(denominator))).alias("base"))
    for more in passes[1:]:
        sums = sums.union(more.select(*kept, "known", "base"))
    sums = sums.groupBy("doc_id", "mark").agg(*[F.sum(c).alias(c) for c in ("tokens", "known", "base", "log_p", "rows")])
    each = sums.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    whole = lambda c: (F.col(c) / F.col("rows")).cast("long")
    return each.select(
        "doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), whole("tokens").alias("n_tokens"), whole("known").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") / F.col("rows")).alias("base_score"),
        (F.col("log_p") / F.col("rows") / math.log(10)).alias("score"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, cut(vocabulary(docs)), cut(predictions(cut(contexts(docs)))))
