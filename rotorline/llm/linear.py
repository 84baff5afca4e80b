"""Bounded samples and small linear models for the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotorline.llm.base import id_text, md5_number


def bounded(df: DataFrame, bound: int, salt: str) -> DataFrame:
    """About ``bound`` rows, all if there are fewer: those whose salted hash of doc_id is below the matching share."""
    rows = df.select("doc_id").count()
    share = min(1.0, bound / max(rows, 1))
    return df.where(md5_number(F.concat_ws("|", F.lit(salt), id_text())) < int(share * 2**32))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def adam(gradient, size: int, steps: int, rate: float) -> np.ndarray:
    """Minimise from zero; ``gradient(w)`` returns the gradient at w."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w
