"""Near copies by shingle similarity against comparing everything, on crowds, chains and the edge cases."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import DataFrame

from rotorline.llm import nearcopies, simhash


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    """The smallest id of every component, by all pairs."""
    sets = {i: plain_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            x, y = sets[a], sets[b]
            if len(x) >= 0.8 * len(y) and len(y) >= 0.8 * len(x) and find(a) != find(b):
                both = len(x & y)
                if (both / (len(x) + len(y) - both) if x or y else 1.0) >= 0.8:
                    root[max(find(a), find(b))] = min(find(a), find(b))
    return {find(i) for i in ids}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**9)}"
    return out


@pytest.fixture
def texts():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(20, 200))] for _ in range(40)]
    out = [" ".join(w) for w in base]
    out += [" ".join(edited(rng, base[i % 40], rng.choice([1, 2, 3, 6]))) for i in range(120)]
    out += [" ".join(w[rng.randint(0, 9):len(w) - rng.randint(0, 9)]) for w in base]
    return out + ["", " \t", "one", "One", "a b c d e", "A b c d e", "word " * 30_000, "word " * 30_000 + "end"]


def frame(spark, rows) -> DataFrame:
    return spark.createDataFrame([(i, t, "s", "clash", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, source string, key string, fp long")


def test_kept_documents_equal_all_pairs(spark, texts):
    rows = list(enumerate(texts))
    kept = nearcopies.keep_one(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "source", "key", "fp"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(plain_kept(rows))


def test_crowd_of_edited_copies_makes_few_rows(spark, monkeypatch):
    """A thousand copies of one text, each a few words away from it, and a chain of a hundred whose ends share little."""
    rng = random.Random(7)
    base = [f"b{i}" for i in range(150)]
    rows = [" ".join(edited(rng, base, rng.choice([1, 2, 3, 4, 5, 6]))) for _ in range(1000)]
    chain = [[f"c{i + k}" for i in range(60)] for k in range(100)]
    rows += [" ".join(w) for w in chain]
    rng.shuffle(rows)
    sizes = []
    cut = nearcopies.cut
    monkeypatch.setattr(nearcopies, "cut", lambda df: (sizes.append((out := cut(df)).count()), out)[1])
    kept = {r.doc_id for r in nearcopies.keep_one(frame(spark, enumerate(rows))).collect()}
    assert kept == plain_kept(list(enumerate(rows)))
    # Points times bands are 64 rows a point; pairs stay far below the half million that the crowd has.
    assert max(sizes) <= 70_400 and sum(s for s in sizes[4:]) < 200_000


def test_lone_shingles_are_those_of_one_point(spark):
    texts = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e g"), (3, "x"), (4, None)], "key long, text string")
    points = texts.selectExpr("key + 10 as fp", "key")
    got = {r.fp: r.lone for r in nearcopies.lone_shingles(points, points, texts).collect()}
    assert got == {11: 1, 12: 1, 13: 1}


def test_null_ids_repeated_rows_and_empty_table(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(None, long), (7, long), (7, long), (7, long + " x"), (3, None), (4, ""), (None, "alone it is")]
    kept = nearcopies.keep_one(frame(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept if r.doc_id != 7) == [(False, 3, ""), (True, 0, "alone it is")]
    assert sum(r.doc_id == 7 for r in kept) == 1 and len(kept) == 3
    assert nearcopies.keep_one(frame(spark, rows).limit(0)).count() == 0


def test_fingerprints_are_those_of_simhash(texts):
    for t in [*texts, None, "x " * 40_000]:
        assert nearcopies.voted(nearcopies.hashes_of(t)) == simhash.fingerprint(t, nearcopies.SHINGLE)


def test_fingerprint_pairs_are_candidates_of_their_own(spark):
    """Points that share no band still meet by equal or close fingerprints and are compared exactly."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(5000)}" for _ in range(3000)]
    texts = [" ".join(words), " ".join([*words, "end"]), " ".join(["begin", *words]), " ".join(f"x{w}" for w in words)]
    points = []
    for i, t in enumerate(texts):
        found = nearcopies.shingles(t)
        points.append((i, i, len(found), simhash.fingerprint(t, nearcopies.SHINGLE), [1000 * i + k for k in range(nearcopies.BANDS)], *nearcopies.sketched(nearcopies.signature(found))))
    assert all((points[0][3] ^ p[3]).bit_count() <= simhash.BITS for p in points[:3])
    sketch = "".join(f", {c} long" for c in nearcopies.SKETCH)
    known = spark.createDataFrame(points, f"fp long, key long, size long, print long, bands array<long>{sketch}")
    found = nearcopies.links(known, spark.createDataFrame(list(enumerate(texts)), "key long, text string"), 0.8)
    assert {x for r in found.collect() for x in (r["a"], r["b"])} == {0, 1, 2}


def test_steps_have_as_many_tasks_as_rows_need(spark, texts):
    """Many shuffle partitions do not make many tasks: each would leave files and an event of its own."""
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    parts = []
    cut = nearcopies.cut

    def noted(df):
        out = cut(df)
        parts.append(out.rdd.getNumPartitions())
        return out

    nearcopies.cut = noted
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        nearcopies.keep_one(frame(spark, list(enumerate(texts)))).count()
    finally:
        nearcopies.cut = cut
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    # The fingerprints and the points themselves come as they are dealt.
    assert max(parts[2:]) == 1
