"""Quality classifier by positive-unlabelled learning.

Features of a text, all per word or per character so that length does not decide: how often one class of character
follows another (letters, capitals, digits, white space and each kind of punctuation are classes), the share of
distinct words and of distinct lines, mean word length, log length.

Trusted positives are labelled rows with quality 1 outside the held-out fold; the unlabelled rows are any documents
outside that fold, labels unseen. A linear score with logistic loss minimises the non-negative unbiased risk

    prior * mean_P loss(+) + max(0, mean_U loss(-) - prior * mean_P loss(-)).

The prior is estimated first, by the best-bin rule: a plain classifier of P against U ranks texts, and at every rank
that keeps a share p of P and u of U, u / p bounds the share of positives in U; the least bound, with room for chance,
is taken. Both samples are bounded (``POSITIVES``, ``UNLABELLED`` rows, chosen by hash); every document is scored.

Edge cases: a null or empty text has all-zero frequencies and gets the score the model gives that; null ids hash as
empty text; repeated rows are scored each for itself; without positives the score is the prior 0.5; an empty table
gives no rows. Columns other than ``doc_id``, ``text`` and, in labels, ``quality`` are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotorline.llm.base import fold, table
from rotorline.llm.linear import adam, bounded, sigmoid

FOLDS, THRESHOLD = 5, 0.3
POSITIVES, UNLABELLED = 6_000, 12_000
STEPS, RATE, RIDGE = 300, 0.05, 1e-3

# Character classes by byte: each mark of punctuation its own where it is common in running text or in junk.
MARKS = b".,;:!?'\"()-|#$%&*/=<>@_+~^`[]{}\\"
_CLASS = np.full(256, 5, np.uint8)
for _byte in range(256):
    _c = bytes([_byte])
    _CLASS[_byte] = (0 if _c == b" " else 1 if _c == b"\n" else 2 if _c.isspace() else 3 if _c.isdigit() else 4 if _c.islower()
                     else 6 if _c.isupper() else 7 + MARKS.index(_c) if _c in MARKS else 5)
CLASS = _CLASS.tobytes()
KINDS = 7 + len(MARKS)
SIZE = KINDS * KINDS + 4
BLOCK = 1 << 20


def features(text: str | None) -> np.ndarray:
    """Frequencies of class pairs, then four shape features."""
    data = text.encode() if text else b""
    out = np.zeros(SIZE)
    if not data:
        return out
    pairs = np.zeros(KINDS * KINDS)
    classes = np.frombuffer(data.translate(CLASS), np.uint8)
    for i in range(0, len(classes), BLOCK):
        part = classes[i:i + BLOCK + 1].astype(np.int32)
        pairs += np.bincount(part[:-1] * KINDS + part[1:], minlength=KINDS * KINDS)
    out[:-4] = np.sqrt(pairs / max(1, len(data)))
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    out[-4:] = (len(set(words)) / max(1, len(words)), len(set(lines)) / max(1, len(lines)), len(data) / max(1, len(words)) / 10, np.log1p(len(words)) / 10)
    return out


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(((x - self.centre) / self.spread) @ self.weights[:-1] + self.weights[-1])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t.as_py()).astype(np.float32).tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["x"])


def matrix(docs: DataFrame) -> np.ndarray:
    """Features of a bounded sample, on the driver."""
    got = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_featured, "x binary").toArrow()
    return np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(-1, SIZE)


def scaled(x: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Standardised, with a last column of ones, in single precision."""
    out = np.ones((len(x), SIZE + 1), np.float32)
    np.subtract(x, centre, out=out[:, :-1])
    out[:, :-1] /= spread
    return out


def class_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Best-bin bound from scores of positives and unlabelled rows."""
    cuts = np.unique(np.quantile(p, np.linspace(0, 0.9, 91)))
    p_kept, u_kept = (p[None, :] >= cuts[:, None]).mean(1), (u[None, :] >= cuts[:, None]).mean(1)
    room = np.sqrt(np.log(20) / 2) * (len(p) ** -0.5 + len(u) ** -0.5)
    best = np.argmin((u_kept + room) / p_kept)
    return float(np.clip(u_kept[best] / p_kept[best], 0.01, 0.99))


def fit(p: np.ndarray, u: np.ndarray, steps: int = STEPS) -> Model:
    if not len(p) or not len(u):
        return Model(np.zeros(SIZE + 1), np.zeros(SIZE), np.ones(SIZE), 0.5)
    centre, spread = u.mean(0), u.std(0) + 0.02
    p, u = scaled(p, centre, spread), scaled(u, centre, spread)
    shrink = np.append(np.full(SIZE, RIDGE), 0)

    def plain(w):
        w = w.astype(np.float32)
        return -((1 - sigmoid(p @ w)) @ p) / len(p) + (sigmoid(u @ w) @ u) / len(u) + shrink * w

    ranked = adam(plain, SIZE + 1, steps // 3, RATE)
    prior = class_prior(p @ ranked.astype(np.float32), u @ ranked.astype(np.float32))

    def risk(w):
        w = w.astype(np.float32)
        zp, zu = p @ w, u @ w
        sp, su = sigmoid(zp), sigmoid(zu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        positive = -prior * ((1 - sp) @ p) / len(p)
        # Below zero the estimate has overfitted: only the positive part is followed until it is back.
        rest = (su @ u) / len(u) - prior * (sp @ p) / len(p) if negative >= 0 else 0
        return positive + rest + shrink * w

    return Model(adam(risk, SIZE + 1, steps, RATE), centre, spread, prior)


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    open_docs = docs.select("doc_id", "text").where(fold("doc_id", FOLDS) != 0)
    trusted = bounded(labels.where("quality = 1").select("doc_id").where(fold("doc_id", FOLDS) != 0).distinct(), positives, "positive")
    p = matrix(open_docs.join(F.broadcast(trusted), "doc_id", "left_semi"))
    return fit(p, matrix(bounded(open_docs, unlabelled, "unlabelled")))


def scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py()) for t in batch.column("text")]
            scores = model.score(np.vstack(rows)) if rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])
    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score."""
    rows = docs.select("doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scorer(model), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
