"""Graphs over one shard of unit vectors: robust pruning and range search, all queries of a slice at once."""

from __future__ import annotations

import numpy as np

DEGREE, BEAM, STRIDE, ALPHA = 24, 48, 4, 1.2
SLICE = 512


def gap(x: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances from rows to the vectors ids (one list per row); infinite where an id is -1."""
    d = 2 - 2 * np.einsum("qd,qkd->qk", rows, x[ids])
    return np.where(ids < 0, np.inf, np.maximum(d, 0))


def without_repeats(ids: np.ndarray, far: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest ``keep`` different ids of each row, nearest first; -1 where there are fewer."""
    order = np.lexsort((far, ids), axis=1)
    ids, far = np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)
    again = np.zeros(ids.shape, bool)
    again[:, 1:] = ids[:, 1:] == ids[:, :-1]
    far = np.where(again | (ids < 0), np.inf, far)
    near = np.argsort(far, axis=1, kind="stable")[:, :keep]
    ids, far = np.take_along_axis(ids, near, 1), np.take_along_axis(far, near, 1)
    return np.where(np.isinf(far), -1, ids), far


def prune(x: np.ndarray, own: np.ndarray, ids: np.ndarray, far: np.ndarray, alpha: float, degree: int = DEGREE) -> np.ndarray:
    """Robust pruning: take the nearest candidate, drop those that it is ``alpha`` times nearer to, and so on."""
    out = np.full((len(own), degree), -1, np.int32)
    alive = (ids >= 0) & (ids != own[:, None])
    vectors = x[ids]
    rows = np.arange(len(own))
    for k in range(degree):
        if not alive.any():
            break
        pick = np.where(alive, far, np.inf).argmin(1)
        has = alive[rows, pick]
        out[has, k] = ids[rows, pick][has]
        between = 2 - 2 * np.einsum("qd,qkd->qk", vectors[rows, pick], vectors)
        alive &= ~(has[:, None] & (alpha**2 * between <= far))
        alive[rows, pick] = False
    return out


def greedy(x: np.ndarray, graph: np.ndarray, rows: np.ndarray, start: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search from ``start``: the ``beam`` nearest vectors met, and their squared distances."""
    count = len(rows)
    ids, far = np.full((count, beam), -1, np.int32), np.full((count, beam), np.inf)
    ids[:, 0] = start
    far[:, 0] = 2 - 2 * rows @ x[start]
    done = np.zeros((count, len(x)), bool)
    while True:
        open_far = np.where((ids >= 0) & ~np.take_along_axis(done, np.maximum(ids, 0), 1), far, np.inf)
        pick = np.argsort(open_far, axis=1)[:, :STRIDE]
        usable = np.isfinite(np.take_along_axis(open_far, pick, 1))
        busy = usable.any(1)
        if not busy.any():
            return ids, far
        at = np.where(usable, np.take_along_axis(ids, pick, 1), -1)[busy]
        q = np.flatnonzero(busy)
        for k in range(at.shape[1]):
            good = at[:, k] >= 0
            done[q[good], at[good, k]] = True
        near = np.where(at[:, :, None] >= 0, graph[at], -1).reshape(len(q), -1)
        ids[q], far[q] = without_repeats(np.hstack([ids[q], near]), np.hstack([far[q], gap(x, rows[q], near)]), beam)


def build(x: np.ndarray, seed: int = 7) -> tuple[np.ndarray, int]:
    """Neighbour lists (-1 where there are fewer) and the medoid."""
    count = len(x)
    medoid = int(np.argmax(x @ x.mean(0)))
    graph = np.random.default_rng(seed).integers(0, count, (count, DEGREE), dtype=np.int32)
    for alpha in (1.0, ALPHA):
        fresh = np.full((count, DEGREE), -1, np.int32)
        for a in range(0, count, SLICE):
            own = np.arange(a, min(a + SLICE, count))
            ids, far = greedy(x, graph, x[own], medoid)
            ids, far = without_repeats(np.hstack([ids, graph[own]]), np.hstack([far, gap(x, x[own], graph[own])]), BEAM + DEGREE)
            fresh[own] = prune(x, own, ids, far, alpha)
        graph = with_back_links(x, fresh, alpha)
    return graph, medoid


def with_back_links(x: np.ndarray, graph: np.ndarray, alpha: float) -> np.ndarray:
    """Every link also the other way; lists that get too long are pruned again."""
    source, slot = np.nonzero(graph >= 0)
    target = graph[source, slot]
    near = 2 - 2 * np.einsum("nd,nd->n", x[source], x[target])
    order = np.lexsort((near, target))
    target, source = target[order], source[order]
    rank = np.arange(len(target)) - np.searchsorted(target, target)
    back = np.full((len(x), 2 * DEGREE), -1, np.int32)
    fits = rank < back.shape[1]
    back[target[fits], rank[fits]] = source[fits]
    out = np.empty_like(graph)
    for a in range(0, len(x), SLICE):
        own = np.arange(a, min(a + SLICE, len(x)))
        both = np.hstack([graph[own], back[own]])
        ids, far = without_repeats(both, gap(x, x[own], both), both.shape[1])
        out[own] = prune(x, own, ids, far, alpha)
    return out


def in_range(x: np.ndarray, graph: np.ndarray, medoid: int, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b), a < b, within squared distance ``reach`` that either search finds: greedily from the medoid, then
    out from every find to its neighbours until none in range is left that has not been followed. On the way out links
    count in both directions: in a tight bunch most lists name the few vectors in the middle, whose own lists are short."""
    found = []
    source, slot = np.nonzero(graph >= 0)
    ends = np.concatenate([source, graph[source, slot]]), np.concatenate([graph[source, slot], source])
    order = np.argsort(ends[0], kind="stable")
    near, start = ends[1][order], np.searchsorted(ends[0][order], np.arange(len(x) + 1))
    for a in range(0, len(x), SLICE):
        own = np.arange(a, min(a + SLICE, len(x)))
        ids, far = greedy(x, graph, x[own], medoid)
        hit = np.zeros((len(own), len(x)), bool)
        # The query's own node is in range of itself and a second place to go out from.
        hit[np.arange(len(own)), own] = True
        row, slot = np.nonzero((far <= reach) & (ids >= 0))
        hit[row, ids[row, slot]] = True
        q, node = np.nonzero(hit)
        while len(q):
            many = start[node + 1] - start[node]
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start[node], many)
            pairs = np.unique(np.repeat(q, many) * len(x) + near[step])
            q, node = pairs // len(x), pairs % len(x)
            new = ~hit[q, node]
            q, node = q[new], node[new]
            inside = []
            for b in range(0, len(q), 1 << 17):
                part = slice(b, b + (1 << 17))
                inside.append(2 - 2 * np.einsum("nd,nd->n", x[own[q[part]]], x[node[part]]) <= reach)
            inside = np.concatenate(inside) if inside else np.zeros(0, bool)
            q, node = q[inside], node[inside]
            hit[q, node] = True
        q, node = np.nonzero(hit)
        other = own[q] != node
        found.append((np.minimum(own[q], node) * len(x) + np.maximum(own[q], node))[other])
    pairs = np.unique(np.concatenate(found))
    return pairs // len(x), pairs % len(x)
