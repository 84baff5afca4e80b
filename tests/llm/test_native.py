"""Mixing, sharding and the URL filter: SQL twins, laws, edge cases."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import duckdb
import pytest

from rotorline.llm import mixing, sharding, urlfilter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, size string"


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture
def docs(spark):
    many = [(i, "w " * (i % 37 + 1), "en", f"s{i % 3}", 1, "x", "y") for i in range(400)]
    odd = [(1000, None, None, None, None, None, None), (1001, "", "en", None, 0, "x", "y"), (1002, "a\tb\nc\x0bd e", "en", None, 0, "x", "y"),
           (1003, "same", "en", "s0", 0, "x", "y"), (1003, "same", "en", "s0", 0, "x", "y"), (None, "no id", "en", "s1", 0, "x", "y"), (1004, "z " * 30000, "en", "big", 0, "x", "y")]
    return spark.createDataFrame(many + odd, DOCS)


def test_targets_fill_up_to_twice(spark):
    sized = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 10), (None, 80)], "source string, size long")
    got = {r.source: (r.source_size, r.target) for r in mixing.targets(sized).collect()}
    # By hand: 1650 words; weights 5, 2, 1, 5; a and c stop at 20, null at 160, b takes the rest.
    assert got == {"a": (10, 20.0), "c": (10, 20.0), None: (80, 160.0), "b": (1000, 1450.0)}


def test_mix_comes_near_and_repeats(spark, docs):
    plan = mixing.plan(docs)
    first, again = sorted(rows(plan), key=str), sorted(rows(mixing.plan(docs.repartition(7))), key=str)
    assert first == again and len(first) == docs.count()
    taken, largest, target = Counter(), Counter(), {}
    for r in plan.join(docs.select("doc_id", "source").distinct(), "doc_id").collect():
        assert r.taken <= 2 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        target[r.source] = r.target
    for s, t in target.items():
        assert abs(taken[s] - t) <= largest[s] + 10


def test_emit_repeats_whole_rows(spark, docs):
    plan = mixing.plan(docs)
    mixed = mixing.emit(docs, plan)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in plan.collect())
    assert mixing.emit(docs.limit(0), mixing.plan(docs.limit(0))).count() == 0


def test_shards_by_hand(spark, docs):
    got = {(r.doc_id, r.text_crc32): r for r in sharding.assign(docs).collect()}
    for r in docs.collect():
        text = (r.text or "").encode()
        row = got[r.doc_id, zlib.crc32(text)]
        slot = int(hashlib.md5(str("" if r.doc_id is None else r.doc_id).encode()).hexdigest()[:8], 16) % sharding.SLOTS

        def shard(n, slot=slot):
            held = 0
            for k in range(1, n):
                if int(hashlib.md5(f"{slot}:{k}".encode()).hexdigest()[:8], 16) % (k + 1) == 0:
                    held = k
            return held

        assert (row["size"], row.virtual_slot, row["shard"], row.grown_shard) == (len(text) + 1, slot, shard(8), shard(9))
        assert row.grown_shard in (row["shard"], 8)
    places = {}
    for r in sharding.assign(docs).collect():
        places.setdefault(r["shard"], []).append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert sharding.assign(docs.limit(0)).count() == 0
    placed = sharding.placed(docs)
    assert set(docs.columns) <= set(placed.columns) and placed.count() == docs.count()


def test_map_is_stored_and_evened(spark, docs, tmp_path):
    first = sharding.slot_map(spark, 4, 256)
    loads = spark.createDataFrame([(i, 1, 1000 if i < 20 else 10) for i in range(256)], "vslot long, rows long, bytes long")
    second = sharding.rebalance(first, loads)
    sharding.save_map(first, str(tmp_path / "map"))
    sharding.save_map(second, str(tmp_path / "map"))
    assert sharding.load_map(spark, str(tmp_path / "map")).agg({"version": "max"}).first()[0] == 2
    assert sharding.load_map(spark, str(tmp_path / "map"), 1).count() == 256

    def spread(m):
        sums = [r[0] for r in m.join(loads, "vslot").groupBy("shard").sum("bytes").select("sum(bytes)").collect()]
        return max(sums) - min(sums)

    assert second.count() == 256 and second.select("vslot").distinct().count() == 256
    assert spread(second) < spread(first) and spread(second) <= 2100


PAGES = [
    (1, "https://Good.Example.ORG/en/2?x=/es/", '<a href="http://friend.net/x">f</a> <a class=c href=\'HTTP://spam.net\'>s</a>'),
    (2, "http://good.example.org/es/1", None),
    (3, "http://good.example.org/en/19", ""),
    (4, "http://bad.com/de/1#frag", '<A HREF="https://friend.net/">f</A>'),
    (5, "http://friend.net/a", ""),
    (6, "http://spam.net", '<a href="http://bad.com/de/1">b</a><a href="http://bad.com/de/2">b</a>'),
    (7, None, "x"), (8, "no scheme", "x"), (9, "x://notcom/fr/", "x"), (10, "http://a.com/fr/?q", "x"), (10, "http://a.com/fr/?q", "x"),
]


def test_url_filter_rules_and_graph(spark):
    pages = spark.createDataFrame([(*p, "clash", "clash") for p in PAGES], "page_id long, url string, html string, host string, rule string")
    got = {r.page_id: r for r in urlfilter.judge(pages).collect()}
    seen = {k: (r.host, r.path, r.rule, r.verdict) for k, r in got.items()}
    assert seen[1] == ("good.example.org", "/en/2", "org/", "allow")
    assert seen[2] == ("good.example.org", "/es/1", "example.org/es/", "block")
    assert seen[3] == ("good.example.org", "/en/19", "example.org/en/1", "block")
    assert seen[4] == ("bad.com", "/de/1", "com/de/", "block")
    assert seen[6] == ("spam.net", "", None, "block")  # links to what is blocked only
    assert seen[7] == seen[8] == ("", "", None, "allow")
    assert seen[9] == ("notcom", "/fr/", None, "allow")
    assert seen[10] == ("a.com", "/fr/", "com/fr/", "allow")
    assert urlfilter.judge(pages).count() == len(PAGES) and urlfilter.judge(pages.limit(0)).count() == 0
    con = duckdb.connect()
    con.register("pages", pages.select("page_id", "url", "html").toPandas())
    want = sorted(map(tuple, con.sql(urlfilter.ORACLE).limit(1000).fetchall()), key=str)
    assert want == sorted(rows(urlfilter.judge(pages).select("page_id", "host", "path", "rule", "verdict")), key=str)


def test_propagation_by_hand(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("a", "c", 3), ("b", "c", 1)], "src string, dst string, n long")
    seeds = spark.createDataFrame([("a", 1.0, 0.0), ("c", 0.0, 1.0)], "host string, trust double, distrust double")
    got = {r.host: (r.trust, r.distrust) for r in urlfilter.spread(edges, seeds, rounds=3).collect()}
    keep = 0.85
    assert got["b"][0] == pytest.approx(0.15 * keep / 4)
    assert got["c"][0] == pytest.approx(0.15 * (keep * 0.75 + keep * keep / 4))
    assert got["a"][1] == pytest.approx(0.15 * (keep * 0.75 + keep * keep * 0.25))
