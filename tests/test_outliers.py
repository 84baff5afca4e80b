"""Memory of the neighbour search; the outlier factor against plain comparisons of all rows."""

from __future__ import annotations

import tracemalloc

import numpy as np

from rotorline.operators import outliers


def test_neighbour_search_holds_few_distances():
    """A batch of rows against the whole reference: exact neighbours, and no matrix of a thousand rows by the reference."""
    rng = np.random.default_rng(1)
    ref, x = rng.normal(size=(outliers.LOF_REFERENCE, 6)), rng.normal(size=(1500, 6))
    tracemalloc.start()
    dist, pos = outliers._nearest(x, ref, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000
    for i in range(0, 1500, 300):
        every = np.sqrt(((ref - x[i]) ** 2).sum(1))
        want = np.argsort(every, kind="stable")[:5]
        assert (pos[i] == want).all() and np.allclose(dist[i], every[want])


def lof_of(train, x, k):
    """By definition, ``train`` in the order of its key: neighbours by distance, then by position."""
    def nearest(rows, own):
        total = np.zeros((len(rows), len(train)))
        for a in range(train.shape[1]):
            total += (rows[:, a, None] - train[None, :, a]) ** 2
        total = np.sqrt(total)
        if own is not None:
            total[np.arange(len(rows)), own] = np.inf
        kth = np.partition(total, n - 1, axis=1)[:, n - 1]
        found = [np.flatnonzero(t <= d) for t, d in zip(total, kth)]
        pos = np.array([f[np.argsort(t[f], kind="stable")[:n]] for t, f in zip(total, found)])
        return np.take_along_axis(total, pos, axis=1), pos

    def blocks(rows, own):
        parts = [nearest(rows[i:i + 500], None if own is None else own[i:i + 500]) for i in range(0, len(rows), 500)]
        return np.vstack([p[0] for p in parts]), np.vstack([p[1] for p in parts])

    n = min(k, len(train) - 1)
    d, pos = blocks(train, np.arange(len(train)))
    kd = d[:, -1]
    lrd = 1.0 / (np.maximum(d, kd[pos]).mean(axis=1) + 1e-10)
    d, pos = blocks(x, None)
    return lrd[pos].mean(axis=1) * (np.maximum(d, kd[pos]).mean(axis=1) + 1e-10) - 1.5


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), None if r is None else [None if v is None else float(v) for v in r]) for i, r in zip(ids, x)], "id long, v array<double>")


def scores(df):
    return {r["id"]: r["lof"] for r in df.collect()}


def test_outlier_factor_knows_every_training_row(spark):
    """More training rows than the 15 000 that a reference used to be drawn from."""
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(15_900, 3)) * [100.0, 5.0, 1.0], rng.normal(40.0, 0.1, size=(100, 3))])
    df = frame(spark, x)
    got = scores(outliers.local_outlier_factor(df, df, "v", ["id"]))
    assert np.allclose([got[i] for i in range(len(x))], lof_of(x, x, 20), rtol=1e-9, atol=1e-9)


def test_outlier_factor_of_copies_and_ties(spark, monkeypatch):
    """Grid points with up to forty copies, in cells of eight, tiles of 32 and tasks of thirty rows; other rows than the training's."""
    monkeypatch.setattr(outliers, "CELL_BITS", 3)
    monkeypatch.setattr(outliers, "TILE_BITS", 5)
    monkeypatch.setattr(outliers, "LOF_REFERENCE", 30)
    rng = np.random.default_rng(3)
    grid = rng.integers(0, 6, size=(500, 3)).astype(float)
    train = np.vstack([grid, np.tile(grid[:1], (40, 1)), -np.zeros((3, 3))])[rng.permutation(543)]
    x = np.vstack([rng.integers(-2, 9, size=(200, 3)), train[:50], [[1e6, 0.0, 0.0]]])
    got = scores(outliers.local_outlier_factor(frame(spark, train).repartition(5), frame(spark, x), "v", ["id"], k=7))
    assert np.allclose([got[i] for i in range(len(x))], lof_of(train, x, 7), rtol=1e-9, atol=1e-9)


def test_outlier_factor_of_odd_rows(spark):
    rng = np.random.default_rng(4)
    x = [*rng.normal(size=(30, 2)), None, [None, 1.0], [float("nan"), 1.0], [float("inf"), 1.0]]
    got = scores(outliers.local_outlier_factor(frame(spark, x), frame(spark, x), "v", ["id"], k=5))
    assert np.allclose([got[i] for i in range(30)], lof_of(np.vstack(x[:30]), np.vstack(x[:30]), 5))
    assert got[30] is None and got[31] is None and np.isnan(got[32]) and got[33] == np.inf
    few = scores(outliers.local_outlier_factor(frame(spark, x[:4]), frame(spark, x[:6]), "v", ["id"], k=5))
    assert np.allclose([few[i] for i in range(6)], lof_of(np.vstack(x[:4]), np.vstack(x[:6]), 5))
    for n in (0, 1):
        assert set(scores(outliers.local_outlier_factor(frame(spark, x[:n]), frame(spark, x), "v", ["id"])).values()) == {None}
    assert scores(outliers.local_outlier_factor(frame(spark, x), frame(spark, []), "v", ["id"])) == {}


def test_outlier_factor_fills_tiles(spark, monkeypatch):
    """One tile is enough for 300 vectors, also where the layout is dealt to many tasks: nothing is sent to another."""
    kind = type(spark.range(1))
    plain, sizes = kind.repartitionByRange, []
    monkeypatch.setattr(kind, "repartitionByRange", lambda df, n, *by: plain(df, 50, *by))
    inner = outliers._neighbours
    monkeypatch.setattr(outliers, "_neighbours", lambda points, *more: sizes.append(points.select("_tile").distinct().count()) or inner(points, *more))
    x = np.random.default_rng(6).normal(size=(300, 3))
    df = frame(spark, x)
    got = scores(outliers.local_outlier_factor(df, df, "v", ["id"], k=5))
    assert sizes == [1]
    assert np.allclose([got[i] for i in range(300)], lof_of(x, x, 5))
