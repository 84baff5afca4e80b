"""Scalar rules as Column expressions: status, severity, health, season, distances."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rotorline.config import SEASON_MONTHS

# --- Fixed values -----------------------------------------------------------
STATUS_RANK = {"NORMAL": 0, "WARNING": 1, "ALARM": 2}
# (level-1 status, level-2 status) -> fused status.
STATUS_MATRIX = {
    ("NORMAL", "NORMAL"): "NORMAL",
    ("NORMAL", "WARNING"): "WARNING",
    ("NORMAL", "ALARM"): "ALARM",
    ("WARNING", "NORMAL"): "WARNING",
    ("WARNING", "WARNING"): "WARNING",
    ("WARNING", "ALARM"): "ALARM",
    ("ALARM", "NORMAL"): "ALARM",
    ("ALARM", "WARNING"): "ALARM",
    ("ALARM", "ALARM"): "ALARM",
}
# The variant used when thresholds are searched: two warnings confirm each other.
SEARCH_MATRIX = {**STATUS_MATRIX, ("WARNING", "WARNING"): "ALARM"}
HEALTH_SLOPE = 6.0
EXPONENT_LIMIT = 20.0
CORROBORATION = 0.3
WORSE_HEALTH_WEIGHT = 0.6
# ---------------------------------------------------------------------------


def as_col(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else (F.col(x) if isinstance(x, str) else F.lit(float(x)))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def status_of(score: Column, warning: Column, alarm: Column, strict: bool = True) -> Column:
    """NORMAL / WARNING / ALARM; thresholds in the wrong order are an error when ``strict``."""
    graded = (
        F.when(score.isNull(), F.lit(None))
        .when(score >= alarm, "ALARM")
        .when(score >= warning, "WARNING")
        .otherwise("NORMAL")
    )
    if not strict:
        return graded
    bad = F.raise_error(F.lit("alarm threshold must not be below the warning threshold")).cast("string")
    return F.when(alarm < warning, bad).otherwise(graded)


def status_rank(status: Column) -> Column:
    return F.when(status == "ALARM", 2).when(status == "WARNING", 1).when(status == "NORMAL", 0)


def rank_status(rank: Column) -> Column:
    return F.when(rank == 2, "ALARM").when(rank == 1, "WARNING").when(rank == 0, "NORMAL")


def fuse(level1: Column, level2: Column, matrix: Mapping[tuple[str, str], str] = STATUS_MATRIX) -> Column:
    """Fused status; level 1 alone when level 2 is missing."""
    expr = F.when(level2.isNull(), level1)
    for (one, two), fused in matrix.items():
        expr = expr.when((level1 == one) & (level2 == two), fused)
    return expr


def fusion_reason(level1: Column, level2: Column) -> Column:
    both = F.concat(F.lit("level 1 "), level1, F.lit(", level 2 "), level2)
    return F.coalesce(both, F.concat(F.lit("level 1 "), level1, F.lit(", level 2 missing")))


def severity(score: Column, alarm: Column) -> Column:
    return F.when(alarm <= 0, 0.0).otherwise(clamp(F.try_divide(score, alarm), 0.0, 2.0))


def combined_severity(one: Column, two: Column) -> Column:
    a, b = F.greatest(F.lit(0.0), one), F.greatest(F.lit(0.0), two)
    both = F.greatest(a, b) + CORROBORATION * F.least(a, b)
    return clamp(F.when(two.isNull(), one).otherwise(both), 0.0, 2.0)


def health(score: Column, mean: Column, alarm: Column, slope: float = HEALTH_SLOPE) -> Column:
    """0-100, falling sigmoid centred between the training mean and the alarm threshold."""
    x = F.try_divide(score - mean, alarm - mean)
    exponent = clamp(slope * (x - 0.5), -EXPONENT_LIMIT, EXPONENT_LIMIT)
    step = F.when(score <= mean, 100.0).otherwise(0.0)
    return F.when(alarm <= mean, step).otherwise(100.0 / (1.0 + F.exp(exponent)))


def combined_health(one: Column, two: Column) -> Column:
    mixed = WORSE_HEALTH_WEIGHT * F.least(one, two) + (1.0 - WORSE_HEALTH_WEIGHT) * F.greatest(one, two)
    return F.when(two.isNull(), one).otherwise(mixed)


def channel_z(residual: Column, std: Column, mean: Column) -> Column:
    return F.abs(residual - mean) / F.greatest(F.abs(std), F.lit(1e-9))


def channel_health(residual: Column, std: Column, p99_abs: Column, mean: Column) -> Column:
    """Health of one channel: 50 at its own 99th-percentile deviation."""
    safe_std = F.greatest(F.abs(std), F.lit(1e-9))
    band = 2.0 * (F.greatest(F.abs(p99_abs), F.lit(1e-9)) / safe_std)
    return health(channel_z(residual, std, mean), F.lit(0.0), band)


def season_of(date: Column) -> Column:
    expr = None
    for name, months in SEASON_MONTHS.items():
        test = F.month(date).isin(*months)
        expr = F.when(test, name) if expr is None else expr.when(test, name)
    return expr


def quadratic_form(delta: Mapping[str, Column], inverse: Column) -> Column:
    """``d' * inv * d`` with the matrix a struct of structs keyed by channel name."""
    terms = [delta[i] * inverse[i][j] * delta[j] for i in delta for j in delta]
    return sum(terms[1:], terms[0])


def mahalanobis(delta: Mapping[str, Column], inverse: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), quadratic_form(delta, inverse)))


def mean_square(columns: Sequence[Column]) -> Column:
    squares = [c * c for c in columns]
    return sum(squares[1:], squares[0]) / len(squares)


def evidence_score(y: Column, recon: Column, mu: Column, logvar: Column, weight: float) -> Column:
    """Mean squared reconstruction error plus ``weight`` times the divergence from a unit normal."""
    error = F.aggregate(F.zip_with(y, recon, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x) / F.size(y)
    terms = F.zip_with(mu, logvar, lambda m, v: _divergence(m, clamp(v, -30.0, 20.0)))
    return error + weight * (-0.5) * F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def _divergence(mu: Column, logvar: Column) -> Column:
    return 1.0 + logvar - mu * mu - F.exp(logvar)


def binomial_at_least_three(n: Column, p: Column) -> Column:
    """P(X >= 3) for X ~ Binomial(n, p), closed form; 0 for n < 3 or p <= 0."""
    q = 1.0 - p
    below = F.pow(q, n) + n * p * F.pow(q, n - 1) + (n * (n - 1) / 2.0) * p * p * F.pow(q, n - 2)
    return F.when((n < 3) | (p <= 0), 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - below))
