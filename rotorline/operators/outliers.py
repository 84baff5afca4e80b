"""Outlier models that score any number of rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rotorline.config import SystemConfig
from rotorline.session import materialize

# --- Fixed values -----------------------------------------------------------
N_TREES, TREE_ROWS = 200, 256
LOF_NEIGHBOURS, LOF_REFERENCE, LOF_OFFSET = 20, 15_000, 1.5  # LOF_REFERENCE: rows that meet one tile in one task
KEEP_VARIANCE = 0.95
EULER = 0.5772156649015329
BLOCK_CELLS = 1_000_000  # distances held at a time, by rows and reference rows
CELL_BITS, TILE_BITS = 9, 13  # a cell holds 512 different vectors at most, a tile the cells of 8 192
AXIS_BITS, LAYOUT_BITS = 8, 128
# ---------------------------------------------------------------------------


def _matrix(column: pd.Series) -> np.ndarray:
    return np.vstack([np.asarray(v, dtype=float) for v in column]) if len(column) else np.empty((0, 0))


def _path_scale(n: float) -> float:
    if n <= 1:
        return 0.0
    return 2.0 * (np.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n if n > 2 else 1.0


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes (feature, cut, left, right, depth correction); a leaf has feature -1."""
    nodes: list[list] = []
    stack = [(x, 0, None, False)]
    while stack:
        rows, depth, parent, is_right = stack.pop()
        at = len(nodes)
        if parent is not None:
            nodes[parent][3 if is_right else 2] = at
        low, high = rows.min(axis=0), rows.max(axis=0)
        open_features = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(open_features):
            nodes.append([-1, 0.0, -1, -1, float(depth + _path_scale(len(rows)))])
            continue
        f = int(rng.choice(open_features))
        cut = float(rng.uniform(low[f], high[f]))
        nodes.append([f, cut, -1, -1, 0.0])
        left = rows[:, f] < cut
        stack.append((rows[~left], depth + 1, at, True))
        stack.append((rows[left], depth + 1, at, False))
    return [tuple(n) for n in nodes]


def _walk(x: np.ndarray, trees: list[np.ndarray]) -> np.ndarray:
    total = np.zeros(len(x))
    for t in trees:
        node = np.zeros(len(x), dtype=int)
        while True:
            feature = t[node, 0].astype(int)
            inner = feature >= 0
            if not inner.any():
                break
            idx = np.flatnonzero(inner)
            goes_left = x[idx, feature[idx]] < t[node[idx], 1]
            node[idx] = np.where(goes_left, t[node[idx], 2], t[node[idx], 3]).astype(int)
        total += t[node, 4]
    return total / len(trees)


def isolation_forest(train: DataFrame, df: DataFrame, vector: str, key: Sequence[str], n_trees: int = N_TREES,
                     seed: int = 42, out: str = "forest_score") -> DataFrame:
    """Trees grown in parallel on samples of 256 rows; every row scored against the broadcast forest.

    The forest is at most ``n_trees`` x 511 nodes whatever the data size. Higher is worse.
    """
    # Every tree draws from all rows: those whose hash with the tree is below a share that leaves twice as many as needed.
    share = min(1.0, 2.0 * TREE_ROWS / max(train.count(), 1))
    drawn = F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)), lambda t: F.pmod(F.xxhash64(t, *key, F.lit(seed)), F.lit(1 << 62)) < int(share * (1 << 62)))
    spread = train.select(*key, vector).withColumn("tree", F.explode(drawn)).withColumn("_h", F.xxhash64("tree", *key, F.lit(seed)))
    w = Window.partitionBy("tree").orderBy("_h", *key)
    picked = spread.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= TREE_ROWS).select("tree", "_k", vector)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = _matrix(pdf.sort_values("_k")[vector])
        limit = int(np.ceil(np.log2(max(len(x), 2))))
        nodes = _grow(x, np.random.default_rng([seed, tree]), limit)
        return pd.DataFrame({"tree": [tree], "rows": [len(x)], "nodes": [[list(map(float, n)) for n in nodes]]})

    built = picked.groupBy("tree").applyInPandas(build, "tree int, rows int, nodes array<array<double>>").collect()
    trees = [np.array(r["nodes"], dtype=float) for r in sorted(built, key=lambda r: r["tree"])]
    scale = _path_scale(max((r["rows"] for r in built), default=2))
    shared = df.sparkSession.sparkContext.broadcast((trees, scale))

    @F.pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        forest, c = shared.value
        if not len(column):
            return pd.Series([], dtype=float)
        return pd.Series(np.power(2.0, -_walk(_matrix(column), forest) / max(c, 1e-12)))

    return df.withColumn(out, score(vector))


def _nearest(x: np.ndarray, ref: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and positions of the k nearest reference rows, of equal distances the first positions.

    Products choose the candidates, with room for their rounding; the distances are sums of squared differences.
    """
    dist, pos = [np.empty((0, k))], [np.empty((0, k), dtype=int)]
    rows = max(1, BLOCK_CELLS // max(len(ref), 1))
    centre = ref.mean(axis=0)
    near_ref = ref - centre
    ref_norm = (near_ref**2).sum(axis=1)
    room = 16.0 * np.finfo(float).eps * (ref.shape[1] + 4)
    for start in range(0, len(x), rows):
        block = x[start:start + rows]
        shifted = block - centre
        norm = (shifted**2).sum(axis=1)
        d2 = norm[:, None] + ref_norm[None, :] - 2.0 * shifted @ near_ref.T
        limit = np.partition(d2, k - 1, axis=1)[:, k - 1] + room * (norm + ref_norm.max())
        row, col = np.nonzero(~(d2 > limit[:, None]))
        exact = _length(block, ref, row, col)
        order = np.lexsort((col, exact, row))
        row, col, exact = row[order], col[order], exact[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        dist.append(exact[first].reshape(-1, k))
        pos.append(col[first].reshape(-1, k))
    return np.vstack(dist), np.vstack(pos)


def _length(x: np.ndarray, ref: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    total = np.zeros(len(row))
    for a in range(x.shape[1]):
        total += (x[row, a] - ref[col, a]) ** 2
    return np.sqrt(total)


def _to_boxes(x: np.ndarray, low: np.ndarray, high: np.ndarray, far: bool = False) -> np.ndarray:
    """Distance of every row to the nearest (``far``: the farthest) point of every box. Summed as ``_length`` does, so that
    rounding cannot place a row of the box nearer."""
    total = np.zeros((len(x), len(low)))
    for a in range(x.shape[1]):
        below, above = low[None, :, a] - x[:, None, a], x[:, None, a] - high[None, :, a]
        total += (np.minimum(below, above) if far else np.maximum(np.maximum(below, above), 0.0)) ** 2
    return np.sqrt(total)


def _reach(dist: np.ndarray, copies: np.ndarray, want: int) -> np.ndarray:
    """Distance within which each row has ``want`` copies; infinite where there are fewer. Distances ascend in a row."""
    enough = np.cumsum(copies, axis=1) >= want
    return np.where(enough.any(axis=1), dist[np.arange(len(dist)), enough.argmax(axis=1)], np.inf)


def _layout(cuts: np.ndarray):
    """Codes that sort near vectors together: quantile steps of the axes, their bits interleaved, wide axes first."""
    spread = cuts[:, -1] - cuts[:, 0]
    used, turns = np.zeros(len(cuts), dtype=int), []
    for _ in range(min(LAYOUT_BITS, AXIS_BITS * len(cuts))):
        axis = int(np.argmax(np.where(used < AXIS_BITS, spread / 2.0**used, -1.0)))
        used[axis] += 1
        turns.append((axis, AXIS_BITS - int(used[axis])))

    @F.pandas_udf("binary")
    def code(column: pd.Series) -> pd.Series:
        if not len(column):
            return pd.Series([], dtype=object)
        x = _matrix(column)
        step = [np.searchsorted(c, x[:, a], side="right") for a, c in enumerate(cuts)]
        bits = np.stack([(step[a] >> b) & 1 for a, b in turns], axis=1).astype(np.uint8)
        return pd.Series([r.tobytes() for r in np.packbits(bits, axis=1)])

    return code


def _within(x: np.ndarray, radius: np.ndarray, tile: pd.DataFrame, want: int) -> tuple[np.ndarray, pd.DataFrame]:
    """The ``want`` nearest reference rows of a tile that lie within each row's radius, and the radii, shorter where the
    tile has ``want``. Cells are visited from the nearest box on, while the box is within the radius."""
    tile = tile[tile["_places"].map(len) > 0]
    tile = tile.iloc[np.argsort([p[0] for p in tile["_places"]])]
    ref, cell, held = _matrix(tile["_x"]), tile["_cell"].to_numpy(), np.append(tile["_places"].map(len), 0).astype(int)
    radius = radius.copy()
    dist, pos = np.full((len(x), want), np.inf), np.full((len(x), want), len(ref))
    members = [np.flatnonzero(cell == c) for c in np.unique(cell)]
    if members:
        gaps = _to_boxes(x, np.array([ref[m].min(axis=0) for m in members]), np.array([ref[m].max(axis=0) for m in members]))
        turns = np.argsort(gaps, axis=1)
    for turn in range(len(members)):
        visited = turns[:, turn]
        near = gaps[np.arange(len(x)), visited] <= radius
        for c in np.unique(visited[near]):
            rows = np.flatnonzero(near & (visited == c))
            d, p = _nearest(x[rows], ref[members[c]], min(want, len(members[c])))
            d, p = np.hstack([dist[rows], d]), np.hstack([pos[rows], members[c][p]])
            first = np.lexsort((p, d), axis=1)[:, :want]
            dist[rows], pos[rows] = np.take_along_axis(d, first, axis=1), np.take_along_axis(p, first, axis=1)
            radius[rows] = np.minimum(radius[rows], _reach(dist[rows], held[pos[rows]], want))
    row, slot = np.nonzero((dist <= radius[:, None]) & (pos < len(ref)))
    found = pos[row, slot]
    again = held[found]
    nth = np.arange(again.sum()) - np.repeat(np.cumsum(again) - again, again)
    places = np.concatenate([np.empty(0, dtype=np.int64), *tile["_places"]])
    return radius, pd.DataFrame({
        "row": np.repeat(row, again), "_d": np.repeat(dist[row, slot], again),
        "_place": places[np.repeat((np.cumsum(held) - held)[found], again) + nth], "_ref": np.repeat(tile["_id"].to_numpy()[found], again),
    })


def _neighbours(points: DataFrame, want: int, boxes: Sequence) -> DataFrame:
    """The ``want`` nearest reference rows of every point in the order of distance and place: ``_id``, ``_d``, ``_place``,
    ``_ref`` (the point whose copy it is), ``_k``.

    A point is searched in its own tile first, which gives it a radius (or the boxes of all do), and then in every other
    tile that has a box within the radius. No row is left out.
    """
    shared = points.sparkSession.sparkContext.broadcast((
        np.array([b["_cell"] for b in boxes], dtype=np.int64) >> (TILE_BITS - CELL_BITS), np.array([b["n"] for b in boxes], dtype=np.int64),
        np.array([b["low"] for b in boxes], dtype=float), np.array([b["high"] for b in boxes], dtype=float),
    ))
    lists = ["_d", "_place", "_ref"]

    def route(pdf: pd.DataFrame) -> pd.DataFrame:
        tiles, copies, low, high = shared.value
        pdf = pdf.sort_values("_id")
        x = _matrix(pdf["_x"])
        radius, found = _within(x, np.full(len(x), np.inf), pdf, want)
        ends = np.searchsorted(found["row"], np.arange(1, len(x)))
        rows = max(1, BLOCK_CELLS // len(tiles))
        open_rows = np.flatnonzero(np.isinf(radius))
        for start in range(0, len(open_rows), rows):
            some = open_rows[start:start + rows]
            far = _to_boxes(x[some], low, high, far=True)
            order = np.argsort(far, axis=1)
            radius[some] = _reach(np.take_along_axis(far, order, axis=1), copies[order], want)
        targets, cell = [], pdf["_cell"].to_numpy()
        for c in np.unique(cell):  # rows of one cell lie together: most boxes are too far for all of them
            own = np.flatnonzero(cell == c)
            apart = np.maximum(np.maximum(low - x[own].max(axis=0), x[own].min(axis=0) - high), 0.0)
            close = np.flatnonzero((_to_boxes(np.zeros((1, x.shape[1])), apart, apart)[0] <= radius[own].max()) & (tiles != pdf["_tile"].iloc[0]))
            for start in range(0, len(own), rows):
                some = own[start:start + rows]
                hit = _to_boxes(x[some], low[close], high[close]) <= radius[some, None]
                targets += [np.unique(tiles[close[h]]) for h in hit]
        return pd.DataFrame({"_id": pdf["_id"], "_x": pdf["_x"], "_radius": radius, "_tiles": targets, **{c: np.split(found[c].to_numpy(), ends) for c in lists}})

    routed = materialize(points.groupBy("_tile").applyInPandas(
        route, "_id long, _x array<double>, _radius double, _tiles array<long>, _d array<double>, _place array<long>, _ref array<long>"))
    visits = routed.select("_id", "_x", "_radius", F.explode("_tiles").alias("_tile"))
    # A tile that many points come near is searched in several tasks.
    tasks = visits.groupBy("_tile").agg(F.ceil(F.count(F.lit(1)) / LOF_REFERENCE).cast("int").alias("_tasks"))
    asked = visits.join(tasks, "_tile").withColumn("_task", F.pmod(F.xxhash64("_id"), F.col("_tasks")).cast("int"))
    held = points.join(tasks, "_tile").withColumn("_task", F.explode(F.sequence(F.lit(0), F.col("_tasks") - 1)))

    def search(rows: pd.DataFrame, tile: pd.DataFrame) -> pd.DataFrame:
        _, found = _within(_matrix(rows["_x"]), rows["_radius"].to_numpy(), tile, want)
        return found.assign(_id=rows["_id"].to_numpy()[found["row"]])[["_id", *lists]]

    far = asked.select("_tile", "_task", "_id", "_x", "_radius").groupBy("_tile", "_task").cogroup(
        held.where(F.size("_places") > 0).select("_tile", "_task", "_id", "_cell", "_x", "_places").groupBy("_tile", "_task")
    ).applyInPandas(search, "_id long, _d double, _place long, _ref long")
    near = routed.select("_id", F.inline(F.arrays_zip(*lists)))
    w = Window.partitionBy("_id").orderBy("_d", "_place")
    return near.unionByName(far).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= want)


def local_outlier_factor(train: DataFrame, df: DataFrame, vector: str, key: Sequence[str], k: int = LOF_NEIGHBOURS,
                         out: str = "lof") -> DataFrame:
    """Local outlier factor of every row against all training rows. Score = factor - 1.5, higher is worse.

    Neighbours are exact; of equal distances the rows with the smallest ``key`` count. Different vectors are searched
    once: of copies only the first k + 1 can be among k neighbours, and all copies have one density. The vectors lie
    in cells of up to 512 that follow each other in the layout, and 16 cells in a tile; the driver holds the cells' boxes
    (two corners and two numbers each), a task a tile and the boxes. Vectors with a null have no score, those with a NaN the score NaN, those with
    an infinite value an infinite one, and none of them is a neighbour; fewer than two training rows give no scores.
    """
    x = F.col(vector).cast("array<double>")
    usable = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    none = df.withColumn(out, F.lit(None).cast("double"))
    # Places follow the key: a sorted frame's row numbers.
    placed = train.where(usable).select(*key, x.alias("_x")).orderBy(*key, "_x").select("_x", F.monotonically_increasing_id().alias("_place"))
    kept = placed.withColumn("_n", F.row_number().over(Window.partitionBy("_x").orderBy("_place"))).where(F.col("_n") <= k + 1)
    every = kept.select("_x", "_place").unionByName(df.where(usable).select(x.alias("_x"), F.lit(None).cast("long").alias("_place")))
    vectors = materialize(every.groupBy("_x").agg(F.sort_array(F.collect_list("_place")).alias("_places")))

    steps = [i / 2**AXIS_BITS for i in range(1, 2**AXIS_BITS)]
    axes = vectors.select(F.posexplode("_x").alias("axis", "c")).groupBy("axis").agg(F.percentile_approx("c", steps).alias("cuts")).collect()
    if not axes:
        return none
    code = _layout(np.array([r["cuts"] for r in sorted(axes, key=lambda r: r["axis"])], dtype=float))
    parts = max(1, vectors.count() >> (TILE_BITS + 2))
    laid = vectors.withColumn("_code", code("_x")).repartitionByRange(parts, "_code", "_x").sortWithinPartitions("_code", "_x")
    laid = materialize(laid.select(F.monotonically_increasing_id().alias("_row"), "_x", "_places"))
    # Numbers without gaps, so that tiles are full however many tasks the layout has.
    sizes = laid.groupBy(F.shiftright("_row", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    number = F.col("_before") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    points = materialize(laid.join(before, F.shiftright("_row", 33) == F.col("_part")).select(number.alias("_id"), "_x", "_places").withColumns({
        "_cell": F.shiftright("_id", CELL_BITS), "_tile": F.shiftright("_id", TILE_BITS),
    }))

    def box(pdf: pd.DataFrame) -> pd.DataFrame:
        v = _matrix(pdf["_x"])
        return pd.DataFrame({"_cell": pdf["_cell"].iloc[:1], "n": [pdf["_places"].map(len).sum()], "low": [v.min(axis=0)], "high": [v.max(axis=0)]})

    filled = points.where(F.size("_places") > 0)
    boxes = filled.groupBy("_cell").applyInPandas(box, "_cell long, n long, low array<double>, high array<double>").collect()
    want = min(k + 1, sum(b["n"] for b in boxes))
    if want < 2:
        return none

    # A training row is its own neighbour in the list of its vector: one copy of it is left out for its density.
    last = Window.partitionBy("_id").orderBy((F.col("_ref") == F.col("_id")).desc(), F.col("_k").desc())
    near = materialize(_neighbours(points, want, boxes).withColumn("_other", F.row_number().over(last) > 1))
    reach = near.join(near.groupBy(F.col("_id").alias("_ref")).agg(F.max("_d").alias("_kd")), "_ref").withColumn("_reach", F.greatest("_d", "_kd"))
    spread = F.avg("_reach") + 1e-10
    density = reach.where("_other").groupBy(F.col("_id").alias("_ref")).agg((1.0 / spread).alias("_lrd"))
    factor = reach.where(F.col("_k") < want).join(density, "_ref").groupBy("_id").agg((F.avg("_lrd") * spread - LOF_OFFSET).alias("_score"))
    scores = points.select("_id", "_x").join(factor, "_id").select("_x", "_score")
    score = F.when(F.exists("_x", F.isnan), float("nan")).when(F.exists("_x", lambda c: F.abs(c) == float("inf")), float("inf")).otherwise(F.col("_score"))
    score = F.when(~F.exists("_x", F.isnull), score)
    return df.withColumn("_x", x).join(scores, "_x", "left").withColumn(out, score).select(*none.columns)


def pca_reconstruction(train: DataFrame, df: DataFrame, vector: str, keep: float = KEEP_VARIANCE,
                       out: str = "pca_error") -> DataFrame:
    """Mean absolute error after projection on the components that keep ``keep`` of the variance."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector

    data = train.select(array_to_vector(F.col(vector).cast("array<double>")).alias("_x"))
    scaler = StandardScaler(inputCol="_x", outputCol="_z", withMean=True, withStd=True).fit(data)
    mean, std = scaler.mean.toArray(), scaler.std.toArray()
    dims = len(mean)
    model = PCA(k=dims, inputCol="_z", outputCol="_p").fit(scaler.transform(data))
    share = np.cumsum(model.explainedVariance.toArray())
    n = int(np.searchsorted(share, keep - 1e-12) + 1)
    basis = model.pc.toArray()[:, : min(n, dims)]
    safe = np.where(std > 0, std, 1.0)

    @F.pandas_udf("double")
    def error(column: pd.Series) -> pd.Series:
        if not len(column):
            return pd.Series([], dtype=float)
        z = (_matrix(column) - mean) / safe
        return pd.Series(np.abs(z - z @ basis @ basis.T).mean(axis=1))

    return df.withColumn(out, error(vector))


def distance_flag(squared: Column, threshold: float) -> Column:
    return (squared > threshold).cast("int")


def vote_columns(cfg: SystemConfig) -> list[str]:
    """The steady-state vector of a period: speed, current, their ratio, pressure, up to five temperatures and
    mean and maximum of up to two vibrations (thirteen values on a fully equipped machine)."""
    c = cfg.columns
    names = [f"mean_{c.speed}", f"mean_{c.current}", "mean_ratio"]
    names += [f"mean_{c.pressure}"] if c.pressure else []
    names += [f"mean_{t}" for t in c.temps[:5]]
    names += [f"{part}_{v}" for v in c.vibrations[:2] for part in ("mean", "max")]
    return list(dict.fromkeys(names))


def period_votes(features: DataFrame, columns: Sequence[str], key: Sequence[str], normal: Column,
                 distance_limit: float, forest_limit: float = 0.5) -> DataFrame:
    """Three model votes per period (``vote_lof``, ``vote_forest``, ``vote_mahalanobis``).

    Models are trained on the periods marked ``normal``; periods with an incomplete vector get no votes.
    """
    from rotorline.operators.calibration import ALL_YEAR, GLOBAL, covariance, invert
    from rotorline.operators.scoring import distance

    full = features.dropna(subset=list(columns)).withColumn("_v", F.array(*[F.col(c).cast("double") for c in columns]))
    train = full.where(normal)
    scored = local_outlier_factor(train, full, "_v", key)
    scored = isolation_forest(train, scored, "_v", key)
    named = full.withColumns({f"res_{c}": F.col(c) for c in columns})
    scope = {"scope_season": F.lit(ALL_YEAR), "scope_pump": F.lit(GLOBAL)}
    block = invert(covariance(named.where(normal).withColumns(scope), columns), columns)
    holder = block.select(F.struct("mean_vec", "cov_inv")).scalar()
    scored = scored.withColumns({f"res_{c}": F.col(c) for c in columns}).withColumn("_b", holder)
    d = distance(columns, F.col("_b.mean_vec"), F.col("_b.cov_inv"))
    return scored.select(
        *key, (F.col("lof") > 0).cast("int").alias("vote_lof"),
        (F.col("forest_score") > forest_limit).cast("int").alias("vote_forest"),
        distance_flag(d * d, distance_limit).alias("vote_mahalanobis"),
    )
