"""Ranked search, piece encoding and periodic runs against brute force and the library they must equal."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from rotorline.llm import pieces, runs, search

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- ranked search ----------------------------------------------------------------------------------------------


def plain_terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def plain_ranking(docs, items, top):
    counts = [(i, Counter(plain_terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n, words = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for (i, c), size in zip(counts, sizes, strict=True):
            m = 100 - 90 + 90 * size * n // words if words else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(plain_terms(text)) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scored, key=lambda s: s[:3])[:top])]
    return out


@pytest.fixture
def library():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(80)]
    texts = [" ".join(rng.choice(vocabulary[:rng.choice([3, 10, 80])]) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    texts[10:40] = [texts[9]] * 30  # a crowd of equal scores
    docs = list(enumerate(texts)) + [(300, None), (301, ""), (302, "... -"), (303, "W1, w1-É é! w2"), (None, texts[9]), (9, texts[9]), (304, "w3 " * 20000)]
    items = [(k, " ".join(rng.sample(vocabulary, rng.randint(1, 12))) + " W1.") for k in range(25)] + [(25, texts[9]), (26, None), (27, "!"), (28, "nowhere"), (24, "é w7"), (None, "w2")]
    rng.shuffle(docs)
    return docs, items


@pytest.mark.parametrize("block,item_words", [(1_000_000, 200_000), (150, 40)])
def test_search_equals_scoring_everything(spark, library, monkeypatch, block, item_words):
    docs, items = library
    monkeypatch.setattr(search, "BLOCK", block)
    frame = spark.createDataFrame([(i, t, "x", 7) for i, t in docs], "doc_id long, text string, terms string, n int").repartition(3)
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, score int")
    got = [tuple(r) for r in search.search(frame, asked, item_words=item_words).collect()]
    key = lambda r: tuple((x is None, 0 if x is None else x) for x in r)
    assert sorted(got, key=key) == sorted(plain_ranking(docs, items, 10), key=key)


def test_search_of_empty_tables(spark, library):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame(library[1], "item_id long, text string")
    assert search.search(docs, items).count() == 0
    assert search.search(spark.createDataFrame(library[0], docs.schema), items.limit(0)).count() == 0


def test_postings_search_within_a_block():
    """One block without Spark: any threshold known before takes part by its place, ties included."""
    rng = np.random.default_rng(5)
    for _ in range(60):
        docs, terms = int(rng.integers(1, 60)), int(rng.integers(1, 8))
        matrix = rng.integers(0, 4, (terms, docs)) * (rng.random((terms, docs)) < 0.5)
        term, doc = np.nonzero(matrix)
        weight = rng.integers(0, 3, terms)
        postings = search.Postings(term, doc, matrix[term, doc], terms, docs)
        known = sorted((-int(rng.integers(1, 12)), int(rng.integers(0, docs)) - 0.5) for _ in range(int(rng.integers(0, 4))))
        scores = (matrix * weight[:, None]).sum(0)
        want = sorted(known + [(-int(s), d) for d, s in enumerate(scores) if s > 0])[:4]
        assert postings.search(np.arange(terms), weight, 4, known)[:4] == want


# --- pieces -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(pieces.read_vocabulary(MODEL))


@pytest.fixture(scope="module")
def processor():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


ALPHABET = ["a", "b", "e", "t", "h", "in", "the", "  ", "   ", " ", "▁", "\n", "\t", "é", "ß", "中", "文", "😀", "\0", "<s>", "</s>", "<0x41>", "ing", "0", "12", "===", "...", "ا", "л", "​"]


def test_ids_and_text_equal_the_library(codec, processor):
    rng = random.Random(11)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["", " ", "a" * 50_000, "ab " * 20_000, " " * 30_001, "=" * 9_999 + "-" * 10_000, "theintheing" * 3_000, "😀" * 5_000]
    for text in texts:
        ids = processor.encode(text)
        assert codec.encode(text) == ids and codec.decode(ids) == processor.decode(ids)


def test_any_ids_decode_as_in_the_library(codec, processor):
    rng = random.Random(12)
    for _ in range(4000):
        ids = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(259, 32000), 13, 28705, 230, 200]) for _ in range(rng.randint(0, 8))]
        assert codec.decode(ids) == processor.decode(ids), ids


def test_backtracking_does_without_word_cuts(codec, processor):
    whole = pieces.Codec(pieces.read_vocabulary(MODEL))
    whole.part = re.compile(".+", re.DOTALL)
    text = "Thntblere of then, edtioner in inea  that esly\n ndstnd nter 😀 quéré " * 40
    assert whole.encode(text) == codec.encode(text) == processor.encode(text)


def test_small_caches_change_nothing(processor, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT", 4)
    monkeypatch.setattr(pieces, "PAIRS", 3)
    small = pieces.Codec(pieces.read_vocabulary(MODEL))
    texts = ["one two three two one four five six seven one", "eight nine one two ten eleven"] * 3
    assert [small.encode(t) for t in texts] == [processor.encode(t) for t in texts]


def test_tokens_of_documents(spark, processor):
    texts = ["Some text.", None, "", "Some text.", " é😀 ", "word " * 30_000]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, "x", "clash")], "doc_id long, text string, sp_ids string")
    got = {r.sp_doc.doc_id: r for r in pieces.tokens(docs, MODEL).collect()}
    for i, t in enumerate(texts):
        ids = processor.encode(t or "", add_eos=True)
        assert (got[i].sp_ids, got[i].sp_text, got[i].sp_doc.sp_ids) == (ids, processor.decode(ids), "clash")
    brief = {r.sp_doc.doc_id: r for r in pieces.token_digests(docs, MODEL).collect()}
    assert len(got) == len(brief) == 7 and brief[1].ids_sha256 == sha("2") and brief[1].decoded_sha256 == sha("")
    assert all((b.n_tokens, b.ids_sha256, b.decoded_sha256) == (len(g.sp_ids), sha(" ".join(map(str, g.sp_ids))), sha(g.sp_text)) for g, b in ((got[k], brief[k]) for k in got))
    assert pieces.tokens(docs.limit(0), MODEL).count() == 0


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    with open(MODEL, "rb") as file:
        model = sentencepiece_model_pb2.ModelProto.FromString(file.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    path = tmp_path / "other.model"
    path.write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        pieces.read_vocabulary(str(path))


# --- periodic runs ----------------------------------------------------------------------------------------------


def plain_runs(x, least=12):
    found = {}
    for q in range(1, len(x) // 2 + 1):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (x[:-q] == x[q:]).astype(int), [0]))))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a + q >= max(least, 2 * q):
                found.setdefault((a, b - a + q), q)
    return sorted(((a, n, q) for (a, n), q in found.items()), key=lambda r: (r[0], r[2]))


def noisy(rng, n):
    x = rng.integers(0, rng.integers(1, 5), n)
    for _ in range(3 if n else 0):
        s = int(rng.integers(0, n))
        x[s:] = x[s + np.arange(n - s) % int(rng.integers(1, max(2, (n - s) // 2)))]
        e = int(rng.integers(0, n))
        x[e:] = rng.integers(0, 4, n - e)
    return x


@pytest.mark.parametrize("cap,slice_", [(1 << 14, 1 << 18), (4, 64)])
def test_runs_equal_brute_force(monkeypatch, cap, slice_):
    monkeypatch.setattr(runs, "CAP", cap)
    monkeypatch.setattr(runs, "SLICE", slice_)
    rng = np.random.default_rng(1)
    for _ in range(120):
        texts = [noisy(rng, int(rng.integers(0, 200))) for _ in range(int(rng.integers(1, 6)))]
        assert runs.runs_of(texts) == [plain_runs(x) for x in texts]


@pytest.mark.parametrize("x", [np.zeros(5000, int), np.tile(np.arange(999), 6), np.repeat(np.arange(100), 50), np.random.default_rng(3).integers(0, 2, 5000)])
def test_runs_of_hard_texts(x):
    assert runs.runs_of([x]) == [plain_runs(x)]


def test_long_text_is_searched_in_time():
    assert runs.runs_of([np.zeros(1_000_000, int), np.arange(300_000) % 7_001]) == [[(0, 1_000_000, 1)], [(0, 300_000, 7_001)]]


def test_transform_multiplies_exactly():
    rng = np.random.default_rng(2)
    a, b = (rng.integers(0, runs.PRIME, (8, 3)).astype(np.uint64) for _ in range(2))
    want = [[sum(int(a[i, c]) * int(b[(k - i) % 8, c]) for i in range(8)) % runs.PRIME for c in range(3)] for k in range(8)]
    product = runs.transform(a.copy()) * runs.transform(b.copy()) % np.uint64(runs.PRIME)
    assert runs.restore(product).tolist() == want


def plain_digests(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    found = plain_runs(np.array([number[w] for w in words], int))
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (doc_id, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2],
            sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_periodic_runs_query(spark, tmp_path):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 150))) for _ in range(150)]
    texts += [None, "", " \t\n\x0b", "é\x1cz é\x1cz " * 30, "a b c " * 3000, "x " * 11, "x " * 12, "line one\n" * 6]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "a b " * 20)]
    spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, pr_doc string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in runs.op13_periodic_runs(spark, str(tmp_path)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=key) == sorted((plain_digests(*r) for r in rows), key=key)
    assert sum(crc32(str(i).encode()) % 10 == 0 for i in range(150)) > 5


def test_runs_keep_the_documents_columns(spark):
    docs = spark.createDataFrame([(1, "a b a b a b a b a b a b c", "clash")], "doc_id long, text string, pr_runs string")
    row = runs.periodic_runs(docs).first()
    assert row.pr_doc.pr_runs == "clash" and row.pr_text == "a b c" and [tuple(r) for r in row.pr_runs] == [(0, 12, 2)]
    assert runs.periodic_runs(docs.limit(0)).count() == 0


def test_search_query_equals_its_twin(spark):
    sf = "/root/testdata/sf0.001"
    base = duckdb.connect()
    for name in ("documents", "benchmark"):
        base.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    got = sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in search.op11_ranked_search(spark, sf).collect())
    assert got == sorted(base.sql(search.ORACLE).fetchall())
