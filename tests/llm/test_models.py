"""Classifiers, embedding links and the pipeline: held-out accuracy, brute force and edge cases."""

from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline
from rotorline.llm import embeddup, quality, registry, toxicity, vectorgraph

SF = "/root/testdata/sf0.01"


def test_registry_is_complete():
    assert [n.split("_")[0] for n in registry.QUERIES] == [f"op{i}" for i in range(1, 11)]
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def vectors_of(spark, x, labels, ids=None):
    rows = [(int(i), None if v is None else [None if a is None else float(a) for a in v], lab, 0) for i, v, lab in zip(ids or range(len(x)), x, labels, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links int")


def brute(x, labels, cosine=0.98):
    links = {i: set() for i in range(len(x))}
    for i, a in enumerate(x):
        for j, b in enumerate(x):
            ok = i != j and labels[i] == labels[j] and labels[i] is not None and a is not None and b is not None and len(a) == len(b)
            if ok:
                with np.errstate(all="ignore"):
                    p, q = np.array([np.nan if v is None else np.float32(v) for v in a], float), np.array([np.nan if v is None else np.float32(v) for v in b], float)
                    c = p @ q / np.sqrt((p @ p) * (q @ q))
                if np.isfinite(c) and c >= cosine:
                    links[i].add(j)
    root = list(range(len(x)))
    for _ in x:
        root = [min([root[i], *(root[j] for j in links[i])]) for i in range(len(x))]
    return links, root


@pytest.mark.parametrize("limit", [4096, 40])
def test_embedding_links(spark, monkeypatch, limit):
    monkeypatch.setattr(embeddup, "TARGET", limit // 2)
    monkeypatch.setattr(embeddup.sharded, "__defaults__", (embeddup.COPIES, limit))
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 12))
    x = [*base, *(base[:20] + 0.02 * rng.normal(size=(20, 12))), *(base[0] + 0.03 * rng.normal(size=(60, 12))), *base[:5], *(3 * base[5:8])]
    labels = [i % 2 for i in range(60)] + [i % 2 for i in range(20)] + [0] * 60 + [i % 2 for i in range(5)] + [1, 0, 1]
    x += [None, [], [0.0] * 12, [None] + [1.0] * 11, [float("nan")] * 12, [float("inf")] * 12, base[0], base[0][:6], [1e30] * 12]
    labels += [0, 0, 0, 0, 0, 0, None, 0, 0]
    links, root = brute(x, labels)
    got = {r.vec_id: r for r in embeddup.near_duplicates(vectors_of(spark, x, labels)).collect()}
    assert len(got) == len(x)
    found, true = sum(r.n_links for r in got.values()), sum(map(len, links.values()))
    assert found <= true and found >= 0.97 * true
    assert all(got[i].n_links <= len(links[i]) for i in links)
    if limit > 1000:
        assert [got[i].component_id for i in range(len(x))] == root


def test_embedding_rows_that_repeat_or_lack(spark):
    df = vectors_of(spark, [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]], [1, 1, 1], [7, 7, 5])
    got = sorted(map(tuple, embeddup.near_duplicates(df).collect()))
    assert got == [(5, 0, 5), (7, 1, 7), (7, 1, 7)]
    assert embeddup.near_duplicates(df.limit(0)).count() == 0
    assert all(r.n_links == 0 and r.component_id == r.vec_id for r in embeddup.near_duplicates(vectors_of(spark, [None, None], [1, None])).collect())


def test_embedding_links_that_every_attempt_loses(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 16))
    x = [*x, *(x[:3] + 0.01 * rng.normal(size=(3, 16)))]
    labels = [0] * len(x)
    links, root = brute(x, labels)
    assert sum(map(len, links.values())) == 6
    monkeypatch.setattr(embeddup, "AUDIT", 20)
    monkeypatch.setattr(embeddup.audit, "__defaults__", (embeddup.COSINE, 20, 5))
    monkeypatch.setattr(embeddup, "BLOCK", 250)
    monkeypatch.setattr(embeddup, "linked", lambda shards, cosine: shards.select(shards.node.alias("a"), shards.node.alias("b")).limit(0))
    got = {r.vec_id: r for r in embeddup.near_duplicates(vectors_of(spark, x, labels)).collect()}
    assert all(got[i].n_links == len(links[i]) and got[i].component_id == root[i] for i in range(len(x)))


def test_range_search_recall():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(150, 24))
    x = np.vstack([centres, centres[:100] + 0.02 * rng.normal(size=(100, 24)), centres[0] + 0.03 * rng.normal(size=(120, 24))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph, medoid = vectorgraph.build(x.astype(np.float32))
    a, b = vectorgraph.in_range(x.astype(np.float32), graph, medoid, 0.04)
    true = {(i, j) for i, j in zip(*np.nonzero(2 - 2 * x @ x.T <= 0.04), strict=True) if i < j}
    assert len(true & set(zip(a.tolist(), b.tolist(), strict=True))) >= 0.98 * len(true)


def texts(spark, kind):
    rng = np.random.default_rng(9)
    clean = [" ".join(rng.choice(["river", "stone", "cloud", "green", "tree", "walk", "slow"], rng.integers(5, 60))) + "." for _ in range(500)]
    rows, marks = [], []
    for i, t in enumerate(clean):
        bad = i % 5 == 0
        if bad:
            t = t.replace(" ", "!!%% ").upper() if kind == "quality" else t + (" you stupid idiot" if i % 10 else " you blorgface, blorgnose")
        rows.append((i, t, "c", 0.0))
        marks.append((i, int(not bad), int(bad)))
    rows += [(1000, None, "c", 0.0), (1001, "", "c", 0.0), (None, "river stone", "c", 0.0), (3, clean[3], "c", 0.0), (1002, "river stone tree " * 30000, "c", 0.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, held_out string, score double"), spark.createDataFrame(marks + [(2000, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")


def test_quality_of_held_out_texts(spark):
    docs, labels = texts(spark, "quality")
    model = quality.train(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    held = [(r.score >= quality.THRESHOLD) == (r.doc_id % 5 != 0) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 500]
    assert len(held) > 50 and np.mean(held) > 0.97
    assert 0.6 < model.prior < 0.95
    assert {r.score for r in quality.score(docs, quality.train(docs, labels.limit(0))).collect()} == {0.5}
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), labels)).count() == 0


def test_toxicity_of_held_out_texts(spark):
    docs, labels = texts(spark, "toxic")
    model = toxicity.train(docs, labels)
    assert any(v.startswith(b"blo") for v in model.voters)
    got = toxicity.scored(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.tx_score <= 1 for r in got)
    right = [(r.tx_score >= toxicity.THRESHOLD) == (r.tx_doc.doc_id % 5 == 0) for r in got if r.tx_doc.doc_id is not None and r.tx_doc.doc_id < 500]
    assert np.mean(right) > 0.98
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id is null or doc_id >= 1000").count() == 4
    bare = toxicity.train(docs, labels.limit(0))
    assert len(bare.voters) <= len(toxicity.LEXICON)
    assert toxicity.scored(docs.limit(0), toxicity.train(docs.limit(0), labels.limit(0))).count() == 0


def test_echoes_count_little():
    rng = np.random.default_rng(0)
    toxic = rng.random(2000) < 0.1
    solid = (toxic[:, None] & (rng.random((2000, 6)) < 0.5)).astype(np.float32)
    echo = np.repeat((rng.random(2000) < 0.05)[:, None], 10, 1)
    echo = (echo & (rng.random((2000, 10)) < 0.8)).astype(np.float32)
    post, accuracy, weight = toxicity.label_model(np.hstack([solid, echo]))
    assert weight[:6].min() > weight[6:].max()
    assert ((post > 0.5) == toxic)[solid.sum(1) > 1].mean() > 0.97


def test_pipeline_drops_near_copies(spark):
    rng = np.random.default_rng(8)
    texts = []
    for n, changed in [(100, 2), (300, 3), (300, 5), (1000, 10), (1000, 20), (100, 10)]:
        for _ in range(6):
            words = rng.integers(0, 5000, n)
            copy = words.copy()
            copy[rng.choice(n, changed, replace=False)] += 5000
            texts += [" ".join(f"w{w}" for w in x) for x in (words, copy)]
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    for i in range(0, len(texts), 2):
        if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1]):
            root[i + 1] = i
    assert len(texts) - len(set(root)) > 20
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, SF).collect()} == set(root)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(90001, None, "en", "x", 0), (90002, "", "en", None, 0), (90003, "", "en", "x", 0), (90004, "you idiot, you pathetic moron", "en", "x", 1), (None, "no id here", "en", "x", 1)], docs.schema)
    at = docs.unionByName(extra)
    assert len(corpus_pipeline.STAGES) == 5
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, SF).cache()
        assert (out.columns == docs.columns) == (name != "sharding")
        seen.append((name, at, out))
        at = out
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    assert 90004 not in ids(seen[0][2]) and {90001, 90002, None} <= ids(seen[0][2])
    assert 90002 not in ids(seen[1][2]) and None in ids(seen[1][2]) and 90001 in ids(seen[1][2])
    assert seen[1][2].count() == seen[1][2].select("doc_id").distinct().count()
    assert seen[2][2].count() < seen[1][2].count() and ids(seen[2][2]) <= ids(seen[1][2])
    assert seen[4][2].count() == seen[3][2].count() and {r[0] for r in seen[4][2].select("shard").distinct().collect()} <= set(range(8))
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
