"""Decontamination, SimHash, HTML text and language-model scores against brute force, with their edge cases."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from rotorline.llm import ctw, decontaminate, htmltext, simhash
from rotorline.llm.components import components

ITEM = "The quick brown fox jumps over the lazy dog and runs far away from the old grey house"


@pytest.fixture
def bench(spark):
    return spark.createDataFrame([("10", ITEM, 0), ("9", ITEM, 0), ("2", "Short one!", 0), ("3", None, 0), ("4", "...", 0), (None, "never looked for", 0)], "item_id string, text string, dc_hit int")


@pytest.fixture
def docs(spark):
    words = ITEM.split()
    texts = {
        1: "Lead-in, " + ITEM.upper() + " tail", 2: " ".join(words[:12]), 3: " ".join(words[2:15]) + ", x" * 400, 4: "a SHORT... one b", 5: None, 6: "", 7: "ünï çode short—one",
        8: ("filler " * 300 + ITEM + " ") * 3, 9: "shortone", 10: "never looked for",
    }
    return spark.createDataFrame([(k, v, "en", "s", 1, "clash") for k, v in texts.items()] + [(1, texts[1], "en", "s", 1, "clash")], "doc_id long, text string, lang string, source string, n_chars long, dc_words string")


@pytest.mark.parametrize("block_words", [100_000, 8])
def test_windows_are_found_in_one_or_many_blocks(spark, docs, bench, block_words):
    marked = decontaminate.mark(docs, bench, block_words=block_words).collect()
    got = {r.dc_doc.doc_id: r for r in marked}
    assert len(marked) == 11 and got[1].dc_doc.dc_words == "clash"
    assert (got[1].dc_words, got[1].dc_hit, got[1].dc_items) == (21, 18, ["10", "9"])
    assert [(s.start, s.end) for s in got[1].dc_spans] == [(9, 9 + len(ITEM))]
    assert (got[2].dc_hit, got[2].dc_items) == (0, [])
    assert (got[3].dc_hit, got[3].dc_words) == (13, 413)
    assert (got[4].dc_hit, got[4].dc_items) == (2, ["2"])
    assert got[5].dc_words == got[6].dc_words == 0 and got[9].dc_hit == got[10].dc_hit == 0
    assert got[7].dc_words == 3 and got[7].dc_hit == 0
    assert got[8].dc_hit == 54 and len(got[8].dc_spans) == 3
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {2, 3, 5, 6, 7, 9, 10}
    assert decontaminate.mark(docs.limit(0), bench).count() == 0 and decontaminate.mark(docs, bench.limit(0)).where("dc_hit > 0").count() == 0


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(spark):
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice([f"w{i}" for i in range(50)], 60)) for _ in range(40)]
    near = [t.replace("w7 ", "w8 ", 1) + " x" for t in base[:20]]
    texts = base + near + base[:5] + ["", None, " \t\n", "one", "One", "é É", "long " * 5000]
    df = spark.createDataFrame([(100 + i, t, "c") for i, t in enumerate(texts)] + [(None, base[0], "c")], "doc_id long, text string, fp string")
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(df).collect() if r.doc_id is not None}
    prints = {100 + i: plain_print(t) for i, t in enumerate(texts)}
    assert {k: v[0] % 2**64 for k, v in got.items()} == prints
    root = {k: k for k in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 4 and root[a] != min(root[a], root[b]):
                    root[a], changed = min(root[a], root[b]), True
    assert {k: v[1] for k, v in got.items()} == root
    kept = simhash.keep_one(df.withColumn("source", df.fp))
    assert {r.doc_id for r in kept.collect()} == set(root.values()) and kept.columns == ["doc_id", "text", "fp", "source"]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_grid_join_finds_every_pair(spark):
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 2**63, 60, dtype=np.int64)
    points = set(seeds.tolist())
    for s in seeds.tolist():
        for flips in range(1, 7):
            points.add(int(np.bitwise_xor.reduce([np.int64(s)] + [np.int64(1) << np.int64(b) for b in rng.choice(63, flips, replace=False)])))
    points |= {-1, 0, 1, -2, -(2**63), 2**63 - 1}
    x = np.array(sorted(points), np.int64)
    want = {(int(a), int(b)) for i, a in enumerate(x) for b in x[i + 1:] if (int(a ^ b) % 2**64).bit_count() <= 4}
    got = simhash.links(spark.createDataFrame([(int(v),) for v in x], "fp long")).collect()
    assert {(min(r.a, r.b), max(r.a, r.b)) for r in got} == want and len(want) > 100


def test_components_of_paths_and_stars(spark):
    pairs = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(200, 199), (199, 200), (300, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 51)}, **{i: 100 for i in range(101, 140)}, 200: 199}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header class="top"><h1>Site</h1></header><nav><ul><li><a href=x>menu</a></ul></nav><div class="ad">buy</div>
<div class="wrap has-sidebar"><div class="cookie-notice">We use cookies</div><article class="post-{i}"><h1>Title {i} &amp; more</h1>
<p>First&nbsp;para  with <a href="z">link</a> text<br>here, long enough to count.<p>Second > one &lt;b&gt; &#233;<form><input name=q> go</form><ul><li>one<li>two</ul>
<section id="comments"><p>I like it</p></section></article><aside>side</aside></div><footer>&copy; foot</footer></body></html>"""


def test_main_text_of_pages(spark):
    pages = [(i, f"http://h.com/{i}", PAGE.format(i=i), "c") for i in range(5)]
    cut_off = PAGE.format(i=9)[:PAGE.format(i=9).index("Second >") + 12] + "&am"
    pages += [(10, "http://h.com/x", cut_off, "c"), (11, None, None, "c"), (12, "u", "", "c"), (13, "http://k.com", "plain &lt;text&gt; only", "c"),
              (14, "http://k.com/2", "<div><p>unclosed <a href='x>hi</p><p>there", "c"), (14, "http://k.com/2", "<!-- x", "c"), (15, "http://l.com", "<p>" + "long text " * 20000, "c")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.text) for r in htmltext.extract(df).collect()))
    want = "Title {i} & more\nFirst para with link text here, long enough to count.\nSecond > one <b> é\none\ntwo"
    found = dict(got)
    assert len(got) == len(pages) and all(found[i] == want.format(i=i) for i in range(5))
    assert found[10] == "Title 9 & more\nFirst para with link text here, long enough to count.\nSecond > one&am"
    assert (found[11], found[12], found[13]) == ("", "", "plain <text> only")
    assert ("there" in dict(got[:-1])[14] or "there" in got[-2][1]) and len(found[15]) == 200000 - 1
    assert htmltext.extract(df.limit(0)).count() == 0


def plain_ctw(train, depth):
    """Context-tree weighting by its definition, on dictionaries: a function (context, byte) -> log probability."""
    counts = {}
    for stream in train:
        padded = b" " * depth + stream
        for i in range(depth, len(padded)):
            for k in range(8):
                node, bit = (1 << k) | (padded[i] >> (8 - k)), padded[i] >> (7 - k) & 1
                for d in range(depth + 1):
                    counts.setdefault((padded[i - d:i], node), [0, 0])[bit] += 1

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    weighted = {}
    for d in range(depth, -1, -1):
        below = Counter()
        for (c, n), v in weighted.items():
            if len(c) == d + 1:
                below[c[1:], n] += v
        for (c, n), (a, b) in counts.items():
            if len(c) == d:
                weighted[c, n] = kt(a, b) if d == depth else np.logaddexp(kt(a, b), below[c, n]) - math.log(2)

    def log_p(context, byte):
        total = 0.0
        for k in range(8):
            node, bit = (1 << k) | (byte >> (8 - k)), byte >> (7 - k) & 1
            mass, left, estimate = 0.0, 1.0, 0.5
            for d in range(depth + 1):
                key = context[len(context) - d:], node
                if key not in counts:
                    mass, left = mass + left * estimate, 0
                    break
                a, b = counts[key]
                estimate = (b + 0.5) / (a + b + 1)
                stop = 1.0 if d == depth else math.exp(kt(a, b) - weighted[key]) / 2
                mass, left = mass + left * stop * estimate, left * (1 - stop)
            total += math.log(mass if bit else 1 - mass)
        return total

    return log_p


def test_scores_follow_the_definition(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["the", "cat", "Sat", "on", "mät", "a"], rng.integers(1, 9))) for _ in range(40)] + ["", None, "unseen wörds", "the", " \t"]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(0, texts[0], "c"), (None, "null id", "c")], "doc_id long, text string, base string")
    depth = 3
    vocab = ctw.vocabulary(df)
    pairs = ctw.contexts(df, depth)
    got = ctw.score(df, vocab, ctw.predictions(pairs, depth), head=3, depth=depth).collect()
    blocks = ctw.score(df, vocab, ctw.predictions(pairs, depth), head=1000, block=40, depth=depth).collect()
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    known = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, "null id")]
    tokens = {i: (t or "").encode().lower().split() + [b"\n"] for i, t in known}
    train = [tokens[i] for i, _ in known if not held(i)]
    log_p = plain_ctw([b" ".join(t) for t in train], depth)
    count = Counter(w for t in train for w in t)
    n, v = sum(count.values()), len(count)
    assert len(got) == len(blocks) == len(known)
    for rows in (got, blocks):
        for r in rows:
            t = tokens[r.doc_id]
            stream = b" " * depth + b" ".join(t)
            want = sum(log_p(stream[i - depth:i], stream[i]) for i in range(depth, len(stream)))
            assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(count[w] > 0 for w in t), n, held(r.doc_id))
            assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t))
            assert r.score == pytest.approx(want / math.log(10), rel=1e-5)
    # Over all next bytes the probabilities of a context add up to one.
    for context in (b"the", b"   ", b"zzz"):
        assert sum(math.exp(log_p(context, b)) for b in range(256)) == pytest.approx(1)
    empty = df.limit(0)
    assert ctw.score(empty, ctw.vocabulary(empty), ctw.predictions(ctw.contexts(empty))).count() == 0


def test_long_streams_are_sliced_alike(monkeypatch):
    streams = [b"abc def ghi\n", b"\n", bytes(range(33, 120)) * 3 + b" \n"]
    whole = [(k, o, s) for k, o, s in ctw.windows(streams, 4)]
    monkeypatch.setattr(ctw, "SLICE", 10)
    sliced = [(k, o, s) for k, o, s in ctw.windows(streams, 4)]
    assert np.array_equal(np.concatenate([k for k, _, _ in whole]), np.concatenate([k for k, _, _ in sliced]))
    owners = [np.repeat(np.concatenate([o for _, o, _ in x]), np.concatenate([s for _, _, s in x])) for x in (whole, sliced)]
    assert np.array_equal(*owners)


def test_decontamination_twin(spark, docs, bench):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    con.register("benchmark", bench.select("item_id", "text").toPandas())
    want = sorted(con.sql("SELECT doc_id, n_words, n_hit, n_items FROM (" + decontaminate.ORACLE + ")").limit(100).fetchall())
    got = sorted((r.dc_doc.doc_id, r.dc_words, r.dc_hit, len(r.dc_items)) for r in decontaminate.mark(docs, bench).collect())
    assert got == want
