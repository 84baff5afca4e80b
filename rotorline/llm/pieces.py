"""Exact merge-type SentencePiece encoding by backtracking, and decoding.

The library merges the adjacent pair whose concatenation is the piece of the highest score, the leftmost on ties, until
none is left. Here the same tokens come without a merge queue. Two facts carry it: a token sequence is the encoding of
its text exactly if every two neighbours are the encoding of their own two texts, and the tokens that end at a place
before which the encoding is complete are the only such ones. So, from left to right:

1. An Aho-Corasick automaton over the pieces tells for every place the longest piece that starts there. Pieces that do
   not encode to themselves are not in it: no encoding has them.
2. The longest piece is tried first, then its shorter prefixes. It is taken when it goes with the token before it, which
   is asked by merging the characters of the two again; the answers are kept.
3. When no piece goes, the place is marked as failed in a bit field, the token before is taken back and its shorter
   prefixes are tried; no token ends at a failed place again. Each place fails once at most, so time is linear.

Where all pieces have the space mark at their start only, no merge crosses from a word to the next, and words are
encoded one by one; the encodings of short ones are kept, at most ``KEPT`` of them. Characters that no piece has merge
with nothing and become their UTF-8 bytes.

The vocabulary (32 000 pieces here, ``MOST`` at most, which is checked) is read on the driver and broadcast. Supported
are merge-type models with byte fallback, no text normalisation, a space put in front of the text and all spaces kept;
others are refused.

Edge cases: a null or empty text has no tokens but the end id; a very long text is encoded whole, in memory of a few
dozen bytes a character; a text without spaces is one part; equal scores never meet in one vocabulary but for pieces
that no merge reaches, and equal places go to the left; repeated documents are encoded each for itself; an empty table
gives no rows; the document's columns are kept in ``sp_doc``, whatever they are called.
"""

from __future__ import annotations

import codecs
import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from hashlib import sha256
from itertools import groupby

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rotorline.llm.base import table

MARK = "▁"  # stands for a space
MOST = 1_000_000
KEPT, SHORT = 500_000, 32
PAIRS = 500_000


def read_vocabulary(path: str) -> dict:
    """What encoding needs of a model file: pieces, scores, the byte ids, control ids and the end id."""
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    with open(path, "rb") as file:
        model = sentencepiece_model_pb2.ModelProto.FromString(file.read())
    spec, kind = model.normalizer_spec, type(model.pieces[0])
    plain = spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces and not spec.precompiled_charsmap
    if not plain or model.trainer_spec.model_type != 2 or model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only merge-type models that keep the text as it is are supported")
    if len(model.pieces) > MOST:
        raise ValueError(f"more than {MOST} pieces")
    of = lambda *names: {i for i, p in enumerate(model.pieces) if p.type in [getattr(kind, n) for n in names]}
    if of("USER_DEFINED", "UNUSED") or len(of("BYTE")) != 256:
        raise ValueError("pieces of the user's own, unused ones, or bytes without a piece are not supported")
    pieces = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
    if not all(c in pieces for p in pieces for c in p):
        raise ValueError("every character of a piece must be a piece")
    return {
        "pieces": pieces, "bytes": {int(model.pieces[i].piece[1:-1], 16): i for i in of("BYTE")}, "silent": sorted(of("CONTROL")), "unknown": sorted(of("UNKNOWN")),
        "end": SentencePieceProcessor(model_file=path).eos_id()}


class Codec:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, vocabulary: dict):
        self.pieces: dict[str, tuple[int, float]] = vocabulary["pieces"]
        self.byte_id: dict[int, int] = vocabulary["bytes"]
        self.end: int = vocabulary["end"]
        whole = [p for p in self.pieces if len(self.merged(p)) == 1]
        known = set(whole)
        self.text = {self.pieces[p][0]: p for p in whole}
        #: the next shorter piece with which a piece begins, or -1
        self.shorter = {self.pieces[p][0]: next((self.pieces[p[:k]][0] for k in range(len(p) - 1, 0, -1) if p[:k] in known), -1) for p in whole}
        self.size = {i: len(p) for i, p in self.text.items()}
        self.machine = ahocorasick.Automaton()
        for p in whole:
            self.machine.add_word(p, (len(p) - 1, self.pieces[p][0]))
        self.machine.make_automaton()
        self.inside = {p[i:i + 2] for p in self.pieces for i in range(len(p) - 1)}
        self.single = {p for p in self.pieces if len(p) == 1}
        spaced = any(b == MARK and a != MARK for a, b in self.inside)
        self.part = re.compile(".+" if spaced else f"{MARK}+[^{MARK}]*|[^{MARK}]+", re.DOTALL)
        self.agree: dict[tuple[int, int], bool] = {}
        self.kept: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.surface = {i: p.replace(MARK, " ").encode() for p, (i, _) in self.pieces.items()}
        self.surface |= {i: bytes([b]) for b, i in self.byte_id.items()} | dict.fromkeys(vocabulary["silent"], b"") | dict.fromkeys(vocabulary["unknown"], " ⁇ ".encode())
        self.silent = set(vocabulary["silent"])
        self.fronted = {i for p, (i, _) in self.pieces.items() if p[0] == MARK}

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging, pair by pair."""
        parts, get = list(text), self.pieces.get
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = get(parts[i] + parts[i + 1])
                if found is not None and (best is None or found[1] > best):
                    best, at = found[1], i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the two tokens stay as they are when their texts are merged together."""
        x, y = self.text[a], self.text[b]
        found = x[-1] + y[0] not in self.inside or self.merged(x + y) == [x, y]
        if len(self.agree) >= PAIRS:
            self.agree.clear()
        self.agree[a, b] = found
        return found

    def backtracked(self, part: str) -> list[int]:
        """The tokens of a text whose characters are all pieces."""
        n = len(part)
        longest = [-1] * n
        for last, (before_last, token) in self.machine.iter(part):  # by ascending end: the longest of a start comes last
            longest[last - before_last] = token
        failed, any_failed, tokens, before, at, token = bytearray(n // 8 + 1), False, [], -1, 0, longest[0]
        size, shorter, agree = self.size, self.shorter, self.agree
        while True:
            while token >= 0:
                end = at + size[token]
                if not any_failed or not failed[end >> 3] >> (end & 7) & 1:
                    fits = before < 0 or agree.get((before, token))
                    if fits or fits is None and self.compatible(before, token):
                        break
                token = shorter[token]
            if token >= 0:
                tokens.append(token)
                if end == n:
                    return tokens
                before, at, token = token, end, longest[end]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                any_failed, token = True, tokens.pop()
                at -= size[token]
                before = tokens[-1] if tokens else -1

    def encoded(self, part: str) -> list[int]:
        """The ids of a text that nothing outside can merge with; characters without a piece merge with nothing."""
        if self.single.issuperset(part):
            return self.backtracked(part)
        out: list[int] = []
        for known, stretch in groupby(part, self.single.__contains__):
            text = "".join(stretch)
            out += self.backtracked(text) if known else [self.byte_id[b] for b in text.encode()]
        return out

    def encode(self, text: str | None) -> list[int]:
        """The ids without the end id."""
        out: list[int] = []
        if not text:
            return out
        kept = self.kept
        for part in self.part.findall(MARK + text.replace(" ", MARK)):
            ids = kept.get(part)
            if ids is None:
                ids = self.older.get(part) or tuple(self.encoded(part))
                if len(part) <= SHORT:
                    if len(kept) >= KEPT // 2:
                        self.older, kept = kept, {}
                        self.kept = kept
                    kept[part] = ids
            out += ids
        return out

    def decode(self, ids: Sequence[int]) -> str:
        """The text of any ids: control ids are silent, the space put in front is taken off, broken bytes are replaced."""
        stops = [k for k, i in enumerate(ids) if i in self.silent] if not self.silent.isdisjoint(ids) else []
        spans = [ids[a + 1:b] for a, b in zip([-1, *stops], [*stops, len(ids)], strict=True)]
        parts = [b"".join(map(self.surface.__getitem__, span)).decode(errors="rotorline-bytewise") for span in spans]
        text, first = "".join(parts), next((span[0] for span in spans if span), -1)
        return text[1:] if first in self.fronted else text

# A replacement character for every single byte that belongs to no character.
codecs.register_error("rotorline-bytewise", lambda error: ("\ufffd", error.start + 1))

_codecs: dict[str, Codec] = {}


def codec(key: str, vocabulary: dict) -> Codec:
    """One per worker."""
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(vocabulary)
    return _codecs[key]


def _mapped(vocabulary: Broadcast, columns: dict[str, tuple[pa.DataType, Callable[[list[int], str], object]]]):
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(key, vocabulary.value)
        for batch in batches:
            values: list[list] = [[] for _ in columns]
            for text in batch.column("sp_text"):
                ids = [*own.encode(text.as_py()), own.end]
                decoded = own.decode(ids)
                for out, (_, f) in zip(values, columns.values(), strict=True):
                    out.append(f(ids, decoded))
            arrays = [pa.array(v, kind) for v, (kind, _) in zip(values, columns.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("sp_doc"), *arrays], names=["sp_doc", *columns])

    return run


def _encoded(docs: DataFrame, path: str, columns: dict, schema: str) -> DataFrame:
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("sp_doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("sp_text"))
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    return rows.mapInArrow(_mapped(vocabulary, columns), T.StructType([rows.schema["sp_doc"], *T.StructType.fromDDL(schema).fields]))


def tokens(docs: DataFrame, path: str) -> DataFrame:
    """Every document (struct ``sp_doc``) with its ids, the end id included, and the text that they decode to."""
    columns = {"sp_ids": (pa.list_(pa.int32()), lambda ids, text: ids), "sp_text": (pa.string(), lambda ids, text: text)}
    return _encoded(docs, path, columns, "sp_ids array<int>, sp_text string")


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """The same in brief: number of ids and the digests of ids and decoded text."""
    columns = {
        "n_tokens": (pa.int64(), lambda ids, text: len(ids)), "ids_sha256": (pa.string(), lambda ids, text: sha256(" ".join(map(str, ids)).encode()).hexdigest()),
        "decoded_sha256": (pa.string(), lambda ids, text: sha256(text.encode()).hexdigest())}
    return _encoded(docs, path, columns, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    found = token_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), path("piece_bpe_32k.model"))
    return found.select(F.col("sp_doc.doc_id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")
