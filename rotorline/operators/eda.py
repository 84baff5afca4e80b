"""Exploratory statistics: histograms, box statistics, correlation, components, regimes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotorline.functions.ordered import exact_quantiles

# --- Fixed values -----------------------------------------------------------
N_BINS = 49
SPEED_BINS = 60
WHISKER = 1.5
# ---------------------------------------------------------------------------


def bin_of(value: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based equal-width bin; the top edge belongs to the last bin; NULL outside."""
    slot = F.floor(F.try_divide((value - low) * float(bins), high - low))
    return F.when((value >= low) & (value <= high), F.least(slot, F.lit(bins - 1)))


def density_histogram(df: DataFrame, channel: str, group: str, bins: int = N_BINS) -> DataFrame:
    """Density per group over a common range: the 0.5 % to 99.5 % quantiles of all groups (min/max if equal)."""
    rows = df.where(F.col(channel).isNotNull()).select(group, F.col(channel).alias("v"), F.lit(1).alias("_one"))
    q = exact_quantiles(rows, ["_one"], "v", {"_lo": 0.005, "_hi": 0.995})
    ends = rows.agg(F.min("v").alias("_min"), F.max("v").alias("_max"))
    flat = F.col("_hi") <= F.col("_lo")
    low = q.select(F.when(flat, ends.select("_min").scalar()).otherwise(F.col("_lo"))).scalar()
    high = q.select(F.when(flat, ends.select("_max").scalar()).otherwise(F.col("_hi"))).scalar()
    placed = rows.withColumns({"lo": low, "hi": high}).withColumn("bin", bin_of(F.col("v"), F.col("lo"), F.col("hi"), bins))
    counts = placed.where(F.col("bin").isNotNull()).groupBy(group, "bin", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(group).agg(F.sum("n").alias("_all"))
    width = (F.col("hi") - F.col("lo")) / bins
    return counts.join(total, group).select(group, "bin", "n", (F.col("n") / (F.col("_all") * width)).alias("density"))


def box_statistics(df: DataFrame, channel: str, keys: Sequence[str]) -> DataFrame:
    """Quartiles, 1.5*IQR whiskers (most extreme value inside) and the 1-99 % axis."""
    rows = df.where(F.col(channel).isNotNull()).select(*keys, F.col(channel).alias("v"))
    q = exact_quantiles(rows, keys, "v", {"q1": 0.25, "med": 0.5, "q3": 0.75, "axis_low": 0.01, "axis_high": 0.99})
    reach = WHISKER * (F.col("q3") - F.col("q1"))
    inside = (F.col("v") >= F.col("q1") - reach) & (F.col("v") <= F.col("q3") + reach)
    whiskers = rows.join(q, list(keys)).groupBy(*keys).agg(
        F.min(F.when(inside, F.col("v"))).alias("whisker_low"), F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
        F.count(F.lit(1)).alias("n"),
    )
    return q.join(whiskers, list(keys))


def correlation(df: DataFrame, channels: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation on complete rows, lower triangle, long; one aggregate for all pairs."""
    full = df.dropna(subset=list(channels))
    pairs = [(a, b) for i, a in enumerate(channels) for b in channels[:i]]
    row = full.groupBy(*keys).agg(*[F.corr(a, b).alias(f"_r{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(*[
        F.struct(F.lit(a).alias("channel_a"), F.lit(b).alias("channel_b"), F.col(f"_r{i}").alias("r")) for i, (a, b) in enumerate(pairs)
    ])
    return row.select(*keys, F.explode(cells).alias("_c")).select(*keys, "_c.*")


def correlation_difference(df: DataFrame, channels: Sequence[str], group: str, first: str, second: str) -> DataFrame:
    long = correlation(df, channels, [group])
    r = F.col("r")
    return long.groupBy("channel_a", "channel_b").agg(
        F.max(F.when(F.col(group) == first, r)).alias("r_first"), F.max(F.when(F.col(group) == second, r)).alias("r_second")
    ).withColumn("difference", F.col("r_second") - F.col("r_first"))


def _vectors(df: DataFrame, channels: Sequence[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(channels), outputCol="_x").transform(df.dropna(subset=list(channels)))


def principal_components(df: DataFrame, channels: Sequence[str], k: int = 3) -> tuple[DataFrame, DataFrame]:
    """Scores of every row and the loadings with explained share. The largest loading of a component is positive."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import vector_to_array

    data = _vectors(df, channels)
    scaler = StandardScaler(inputCol="_x", outputCol="_z", withMean=True, withStd=True).fit(data)
    scaled = scaler.transform(data)
    model = PCA(k=k, inputCol="_z", outputCol="_p").fit(scaled)
    scores = model.transform(scaled).withColumn("_a", vector_to_array("_p"))
    pc = model.pc.toArray()
    turn = [1.0 if pc[:, j].max() >= -pc[:, j].min() else -1.0 for j in range(k)]
    scores = scores.select(*df.columns, *[(F.col("_a")[i] * turn[i]).alias(f"pc{i + 1}") for i in range(k)])
    rows = [
        (f"pc{j + 1}", c, float(pc[i, j]) * turn[j], float(model.explainedVariance[j]))
        for j in range(k) for i, c in enumerate(channels)
    ]
    loadings = df.sparkSession.createDataFrame(rows, "component string, channel string, loading double, explained double")
    return scores, loadings


def speed_regimes(df: DataFrame, speed: str = "speed", k: int = 3, seed: int = 42) -> tuple[DataFrame, list[float]]:
    """Rows with their speed regime, numbered by ascending centre."""
    from pyspark.ml.clustering import KMeans

    data = _vectors(df, [speed])
    model = KMeans(k=k, seed=seed, featuresCol="_x", predictionCol="_k").fit(data)
    centres = [float(c[0]) for c in model.clusterCenters()]
    order = {old: new for new, old in enumerate(sorted(range(len(centres)), key=centres.__getitem__))}
    names = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    return model.transform(data).withColumn("regime", names[F.col("_k")]).drop("_x", "_k"), sorted(centres)


def speed_histogram(df: DataFrame, speed: str = "speed", bins: int = SPEED_BINS, key: str = "pump_id") -> DataFrame:
    """Counts per pump over the overall speed range."""
    ends = df.agg(F.struct(F.min(speed).alias("lo"), F.max(speed).alias("hi")).alias("e")).scalar()
    placed = df.where(F.col(speed).isNotNull()).withColumn("_e", ends)
    placed = placed.withColumn("bin", bin_of(F.col(speed), F.col("_e.lo"), F.col("_e.hi"), bins))
    return placed.groupBy(key, "bin").agg(F.count(F.lit(1)).alias("n"))


def month_counts(df: DataFrame, date: str = "date", key: str = "pump_id") -> DataFrame:
    """Rows per pump and month 1-12, zeros filled."""
    months = list(range(1, 13))
    return df.withColumn("_m", F.month(date)).groupBy(key).agg(*[F.count(F.when(F.col("_m") == m, 1)).alias(f"m{m:02d}") for m in months])
