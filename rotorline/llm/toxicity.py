"""Toxicity by weak supervision.

Voters look for one thing each: a word of a lexicon, or a word or word beginning mined from the open fold of the
labels (terms that are in many toxic texts and hardly any others). Some fire when the thing occurs, some only when it
occurs often: twice at least, and once in ``OFTEN`` words. Otherwise a voter stays silent.

Label model: texts are toxic or not, and each voter is right with an accuracy of its own, fitted by expectation
maximisation on votes alone. Voters that still move together within a class are correlated, and each
counts by one over the root of one plus its positive correlations, so that a crowd of echoes counts little more than
one; of voters that fire on almost the same texts only one is kept. The posteriors of the
model are the labels of a linear classifier over votes and hashed words, which scores every document.

Mining and both fits use bounded samples (``LABELLED``, ``UNLABELLED`` rows, chosen by hash) outside the held-out
fold; every document is scored on its whole text.

Edge cases: a null or empty text has no words and gets the score of no evidence; null ids hash as empty text; repeated
rows are scored each for itself; without labels only the lexicon votes; an empty table gives no rows. Columns other
than ``doc_id``, ``text`` and, in labels, ``toxic`` are not looked at; ``drop_toxic`` keeps all columns as they are.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rotorline.llm.base import fold, table
from rotorline.llm.decontaminate import words_of
from rotorline.llm.linear import adam, bounded, sigmoid

FOLDS, HELD, THRESHOLD = 4, 2, 0.3
LABELLED, UNLABELLED = 12_000, 8_000
VOTERS, SUPPORT, PART, PRECISION = 300, 3, 0.01, 0.9
BEGINNINGS = range(3, 10)
OFTEN = 125
BUCKETS = 1 << 13
STEPS, RATE, RIDGE = 150, 0.1, 1e-4

# Common English insults.
LEXICON = (
    "clown", "disgusting", "dumb", "fool", "garbage", "idiot", "imbecile", "loser", "moron", "pathetic", "scum", "stupid", "trash", "vermin", "worthless",
)


def terms_of(word: bytes) -> list[bytes]:
    """The word, and its beginnings marked with a star."""
    return [word] + [word[:n] + b"*" for n in BEGINNINGS if len(word) > n]


def head(term: bytes) -> bytes:
    return term.rstrip(b"*+")[:BEGINNINGS[0]]


def terms_in(words: list[bytes], heads: set[bytes] | None = None) -> list[bytes]:
    """Distinct terms, those that are frequent also with a plus; with ``heads``, only of words that begin so."""
    counts: Counter = Counter()
    for word, n in Counter(words).items():
        if heads is None or word[:BEGINNINGS[0]] in heads:
            for term in terms_of(word):
                counts[term] += n
    return list(counts) + [t + b"+" for t, n in counts.items() if n >= 2 and n * OFTEN >= len(words)]


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, toxic, clean: in how many texts of the task each term is; a bounded table, given out when full."""
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}

    def out():
        keys = list(counts[0].keys() | counts[1].keys())
        batch = pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())],
            names=["term", "toxic", "clean"])
        counts[0], counts[1] = Counter(), Counter()
        return batch

    for batch in batches:
        for text, toxic in zip(batch.column("text"), batch.column("toxic"), strict=True):
            counts[int(toxic.as_py() == 1)].update(terms_in(words_of(text.as_py())))
            if len(counts[0]) + len(counts[1]) > 300_000:
                yield out()
    yield out()


def mine(labelled: DataFrame, support: int, voters: int = VOTERS, precision: float = PRECISION) -> list[bytes]:
    """Terms of at least ``support`` toxic texts, most widespread first; labelled has text and toxic."""
    counts = labelled.mapInArrow(_term_counts, "term binary, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    good = counts.where((F.col("toxic") >= support) & (F.col("toxic") + 0.5 >= precision * (F.col("toxic") + F.col("clean") + 1)))
    return [bytes(r.term) for r in good.orderBy(F.desc("toxic"), "term").limit(voters).collect()]


def evidence(text: str | None, voters: dict[bytes, int], heads: set[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Which voters fire, and the hash buckets of the distinct words."""
    words = words_of(text)
    fired = [voters[t] for t in terms_in(words, heads) if t in voters]
    seen = set(words)
    return np.fromiter(sorted(fired), np.int32, len(fired)), np.fromiter((zlib.crc32(w) % BUCKETS for w in seen), np.int32, len(seen))


def _sampled(voters: dict[bytes, int]):
    heads = {head(t) for t in voters}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [evidence(t.as_py(), voters, heads) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v.tobytes() for v, _ in rows], pa.binary()), pa.array([np.unique(h).astype(np.int16).tobytes() for _, h in rows], pa.binary())],
                names=["votes", "words"])
    return run


def distinct_voters(votes: np.ndarray, alike: float = 0.9) -> np.ndarray:
    """Which voters to keep: of those that fire on almost the same texts, the first."""
    both = votes.T @ votes
    fires = both.diagonal()
    same = both / np.maximum(fires[:, None] + fires[None, :] - both, 1)
    kept: list[int] = []
    for j in range(votes.shape[1]):
        if not kept or same[j, kept].max() < alike:
            kept.append(j)
    return np.array(kept, np.int64)


def label_model(votes: np.ndarray, prior_accuracy: float = PRECISION, belief: float = 5.0, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of toxic for each row of 0/1 votes; the voters' accuracies; their weights.

    A voter that fires adds the log odds of its accuracy over those of the base rate. Its accuracy is how toxic the
    other voters find the texts it fires on, starting from ``prior_accuracy`` held by ``belief`` texts. Silence is
    evidence only when all are silent, at the rate the model finds for it.
    """
    n, k = votes.shape
    silent = votes.sum(1) == 0
    accuracy, weight, hush = np.full(k, prior_accuracy), np.ones(k), -2.0
    post = np.where(silent, 0.02, 0.8)
    for step in range(rounds):
        base = np.log(np.clip(post.mean(), 1e-3, 0.5) / (1 - np.clip(post.mean(), 1e-3, 0.5)))
        gain = weight * (np.log(accuracy / (1 - accuracy)) - base)
        odds = base + votes @ gain + hush * silent
        post = sigmoid(odds)
        others = np.array([sigmoid(odds[f] - gain[j]).sum() for j in range(k) for f in [votes[:, j] > 0]])
        accuracy = np.clip((others + belief * prior_accuracy) / (votes.sum(0) + belief), 0.05, 0.995)
        hush = np.log((post[silent].sum() + 1) / (post.sum() + 2)) - np.log(((1 - post)[silent].sum() + 1) / ((1 - post).sum() + 2))
        if step == 2:
            # What moves together beyond the class does so in both classes; weigh each crowd as one.
            rate = (post @ votes) / max(post.sum(), 1e-9), ((1 - post) @ votes) / max((1 - post).sum(), 1e-9)
            left = votes - (post[:, None] * rate[0] + (1 - post[:, None]) * rate[1])
            scale = np.sqrt((left**2).mean(0)) + 1e-9
            tied = (left.T @ left) / n / scale[:, None] / scale[None, :]
            np.fill_diagonal(tied, 0)
            weight = 1 / np.sqrt(1 + np.where(tied > 0.1, tied, 0).sum(1))
    return post, accuracy, weight


@dataclass(frozen=True)
class Model:
    voters: dict[bytes, int]
    heads: set[bytes]
    of_votes: np.ndarray
    of_words: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        fired, hashed = evidence(text, self.voters, self.heads)
        hashed = np.unique(hashed)
        z = self.bias + self.of_votes[fired].sum() + self.of_words[hashed].sum() / np.sqrt(len(hashed) + 1)
        return float(sigmoid(z))


def fit(voters: list[bytes], votes: list[np.ndarray], words: list[np.ndarray]) -> Model:
    """Label model, then a logistic regression on its posteriors."""
    n = len(votes)
    matrix = np.zeros((n, len(voters)), np.float32)
    for i, v in enumerate(votes):
        matrix[i, v] = 1
    kept = distinct_voters(matrix)
    matrix, voters = matrix[:, kept], [voters[j] for j in kept]
    index, k = {t: i for i, t in enumerate(voters)}, len(voters)
    post = label_model(matrix)[0] if n and k else np.zeros(n)
    at, row = np.concatenate([*words, np.zeros(0, np.int16)]).astype(np.int32), np.repeat(np.arange(n), [len(w) for w in words])
    part = 1 / np.sqrt(np.array([len(w) for w in words], np.float64) + 1)

    def gradient(w):
        z = w[-1] + matrix @ w[:k] + part * np.bincount(row, w[k:-1][at], n)
        e = (sigmoid(z) - post) / max(n, 1)
        return np.concatenate([e @ matrix + RIDGE * w[:k], np.bincount(at, (e * part)[row], BUCKETS) + 10 * RIDGE * w[k:-1], [e.sum()]])

    w = adam(gradient, k + BUCKETS + 1, STEPS, RATE)
    return Model(index, {head(t) for t in voters}, w[:k], w[k:-1], float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, unlabelled: int = UNLABELLED) -> Model:
    open_docs = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(fold("doc_id", FOLDS) != HELD)
    marks = labels.where("toxic is not null").where(fold("doc_id", FOLDS) != HELD).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = bounded(marks, labelled, "labelled")
    support = max(SUPPORT, int(PART * (chosen.agg(F.sum("toxic")).first()[0] or 0)))
    mined = mine(open_docs.join(F.broadcast(chosen), "doc_id").select("text", "toxic"), support)
    voters = list(dict.fromkeys([*mined, *(w.encode() for w in LEXICON)]))
    index = {t: i for i, t in enumerate(voters)}
    got = bounded(open_docs, unlabelled, "unlabelled").select("text").mapInArrow(_sampled(index), "votes binary, words binary").toArrow()
    return fit(voters, [np.frombuffer(x, np.int32) for x in got["votes"].to_pylist()], [np.frombuffer(x, np.int16) for x in got["words"].to_pylist()])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """The documents (as struct ``tx_doc``) with tx_score."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("tx_doc"), F.col("text").cast("string").alias("tx_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t.as_py()) for t in batch.column("tx_text")]
            yield pa.RecordBatch.from_arrays([batch.column("tx_doc"), pa.array(scores, pa.float64())], names=["tx_doc", "tx_score"])

    return rows.mapInArrow(run, T.StructType([rows.schema["tx_doc"]]).add("tx_score", "double"))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    return scored(docs, model).where(F.col("tx_score") < threshold).select("tx_doc.*")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    found = scored(docs.select("doc_id", "text"), model)
    doc_id = F.col("tx_doc.doc_id").alias("doc_id")
    return found.select(doc_id, F.col("tx_score").alias("score")).select(
        "doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
