"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a one-pass Viterbi.

The model file is read with a few lines of protobuf parsing (pieces, scores, kinds, normaliser
flags). Text is escaped as the model asks (a leading space mark, spaces as marks); its normaliser must be
the identity. The automaton reports, at each position, every piece that ends there (it follows its
output links); each report relaxes the best score at that position. A character that no path
reaches is spelt in byte pieces. The segmentation of greatest total score is the result; on equal
scores the longer last piece wins. For a vocabulary learnt by merges this is by definition the
best-scoring segmentation, which may differ from replaying the merges.

No piece holds a space mark behind another character (checked when the model is loaded), so no
piece crosses from a word into the next mark and the best path splits there: each stretch
"marks + word" is solved alone and remembered in a bounded table.

Null texts give no tokens and decode to null; empty texts give no tokens and decode to "".
A space mark that stands in the input itself decodes to a space, as the format cannot tell them apart.
"""

from __future__ import annotations

import hashlib
import re
import struct
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from attesta.llm.common import small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
REMEMBERED = 150_000


def _fields(raw: bytes):
    i, n = 0, len(raw)

    def varint():
        nonlocal i
        v = shift = 0
        while True:
            c = raw[i]
            i += 1
            v |= (c & 127) << shift
            shift += 7
            if c < 128:
                return v

    while i < n:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {5: 4, 1: 8}.get(kind) or varint()
            yield key >> 3, raw[i : i + size]
            i += size


@dataclass
class Vocabulary:
    """Pieces by id, with scores and kinds (1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte)."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    dummy_prefix: bool = True
    whole_words: bool = field(init=False)

    def __post_init__(self) -> None:
        self.whole_words = not any(MARK in p.lstrip(MARK) for p, k in zip(self.pieces, self.kinds, strict=True) if k in (1, 4))

    @classmethod
    def load(cls, raw: bytes) -> Vocabulary:
        pieces, scores, kinds, dummy = [], [], [], True
        for f, v in _fields(raw):
            if f == 1:
                d = dict(_fields(v))
                pieces.append(d[1].decode())
                scores.append(struct.unpack("<f", d.get(2, b"\0\0\0\0"))[0])
                kinds.append(d.get(3, 1))
            elif f == 3:
                d = dict(_fields(v))
                if d.get(2) or d.get(4, 1):
                    raise ValueError("only models with the identity normaliser that keep all spaces are supported")
                dummy = bool(d.get(3, 1))
        return cls(pieces, scores, kinds, dummy)


class Codec:
    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.automaton = ahocorasick.Automaton()
        plain = [s for s, k in zip(vocab.scores, vocab.kinds, strict=True) if k == 1 and s > -1e8]
        self.unknown = min(plain, default=0.0) - 10.0
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(vocab.pieces, vocab.kinds, strict=True)) if k == 6}
        self.unk_id = next((i for i, k in enumerate(vocab.kinds) if k == 2), 0)
        for i, (p, s, k) in enumerate(zip(vocab.pieces, vocab.scores, vocab.kinds, strict=True)):
            if p and k in (1, 4):
                self.automaton.add_word(p, (len(p), s, i))
        self.automaton.make_automaton()
        self.stretch = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+", re.S)
        self.known: dict[str, list[int]] = {}

    def best(self, text: str) -> list[int]:
        """Single-pass Viterbi over one stretch."""
        n, gap = len(text), self.unknown
        score, last = [0.0] + [None] * n, [None] * (n + 1)
        at = 0
        for end, (size, s, i) in self.automaton.iter(text):
            end += 1
            while at < end - 1:  # settle positions that no piece ends at
                at += 1
                if score[at] is None:
                    score[at], last[at] = score[at - 1] + gap, (1, -1)
            v = score[end - size] + s
            if score[end] is None or v > score[end]:
                score[end], last[end] = v, (size, i)
        while at < n:
            at += 1
            if score[at] is None:
                score[at], last[at] = score[at - 1] + gap, (1, -1)
        out, end = [], n
        while end:
            size, i = last[end]
            if i >= 0:
                out.append(i)
            else:
                raw = text[end - 1].encode("utf-8", "replace")
                out += [self.bytes[b] for b in reversed(raw)] if self.bytes else [self.unk_id]
            end -= size
        out.reverse()
        return out

    def score(self, ids: list[int]) -> float:
        return sum(self.vocab.scores[i] for i in ids)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        text = text.replace(" ", MARK)
        if self.vocab.dummy_prefix:
            text = MARK + text
        if not self.vocab.whole_words:
            return self.best(text)
        known, out = self.known, []
        for part in self.stretch.findall(text):
            ids = known.get(part)
            if ids is None:
                ids = self.best(part)
                if len(part) <= 24:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[part] = ids
            out += ids
        return out

    def decode(self, ids: list[int] | None) -> str | None:
        if ids is None:
            return None
        out, raw = [], bytearray()
        pieces, kinds = self.vocab.pieces, self.vocab.kinds
        for i in ids:
            if kinds[i] == 6:
                raw.append(int(pieces[i][3:5], 16))
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if kinds[i] not in (2, 3):
                out.append(pieces[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        text = "".join(out).replace(MARK, " ")
        return text[1:] if self.vocab.dummy_prefix and text.startswith(" ") else text


def load(path: str = MODEL) -> bytes:
    """The model file's bytes, read on the driver; they travel with the tasks (half a megabyte)."""
    with open(path, "rb") as f:
        return f.read()


_CODECS: dict[bytes, Codec] = {}


def codec(raw: bytes) -> Codec:
    key = hashlib.sha256(raw).digest()
    if key not in _CODECS:
        _CODECS[key] = Codec(Vocabulary.load(raw))
    return _CODECS[key]


def encode(docs: DataFrame, model: bytes | None = None, digest: bool = False, with_ids: bool = True) -> DataFrame:
    """``docs`` with ``n_tokens``, ``token_ids`` (unless ``with_ids`` is off) and, if asked, ``ids_sha256`` (of the ids, comma-joined) and ``round_trip`` (decoding gives the text back)."""
    small_batches(docs.sparkSession)
    raw = model or load()
    new = ["n_tokens", *(["token_ids"] if with_ids else []), *(["ids_sha256", "round_trip"] if digest else [])]
    docs = docs.select(*(f"`{c}`" for c in docs.columns if c not in new))
    at, names = docs.columns.index("text"), docs.columns
    kinds = {"n_tokens": "bigint", "token_ids": "array<int>", "ids_sha256": "string", "round_trip": "boolean"}
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"{c} {kinds[c]}" for c in new)])

    def run(batches):
        own = codec(raw)
        for b in batches:
            texts = b.column(at).to_pylist()
            ids = [own.encode(t) for t in texts]
            made = {"n_tokens": pa.array([len(x) for x in ids], pa.int64())}
            if with_ids:
                made["token_ids"] = pa.array(ids, pa.list_(pa.int32()))
            if digest:
                made["ids_sha256"] = pa.array([hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in ids], pa.string())
                made["round_trip"] = pa.array([own.decode(x) == (t or "").replace(MARK, " ") for x, t in zip(ids, texts, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([*b.columns, *(made[c] for c in new)], [*names, *new])

    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, model: bytes | None = None) -> DataFrame:
    """``tokens`` (with ``token_ids``) with the decoded ``text``."""
    small_batches(tokens.sparkSession)
    raw = model or load()
    tokens = tokens.select(*(f"`{c}`" for c in tokens.columns if c != "text"))
    at, names = tokens.columns.index("token_ids"), tokens.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema), "text string"])

    def run(batches):
        own = codec(raw)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([own.decode(x) for x in b.column(at).to_pylist()], pa.string())], [*names, "text"])

    return tokens.mapInArrow(run, schema)
