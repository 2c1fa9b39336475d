"""Benchmark decontamination with a generalised suffix automaton of the test items.

Words are runs of letters and digits (every non-ASCII character counts as one) after lower-casing
A-Z. A window is ``WINDOW`` consecutive words of an item; an item with fewer words is one window as
a whole. Every occurrence of a window in a document marks its words as hit.

The automaton over word numbers of all items is built on the driver from the benchmark table, whose
size is checked: beyond ``SHARD_WORDS`` words the items are dealt to several automata, each read in
a pass of its own over the same documents; rows are numbered first, and the marks of a row are united before
anything is judged or cut. In a worker, a document is reduced to word numbers;
stretches in which two neighbouring words never stand side by side in an item cannot hold a window
and are skipped; the others stream through the automaton, which keeps the longest match ending at
each word and the state it leads to. The states that windows lead to carry the items they belong to, so a window is found by
climbing from a state to that of its last ``WINDOW`` words. Spark ships an automaton to the workers once, as a broadcast; ``SHARD_WORDS``
bounds it.

Null and empty texts have no words, no hits and are clean. Items without words have no window.
Repeated items are told apart by ``item_id``; items without one still mark words but are not listed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import small_batches, stored

WINDOW = 13
SHARD_WORDS = 250_000
#: A document is contaminated when ``COVERAGE`` times its hit words reach its words.
COVERAGE = 20

_KEEP = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: The same words with their place in the original text: A-Z count as letters there.
_PLACED = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().translate(_KEEP).split() if text else []


class Automaton:
    """Suffix automaton of several word sequences; ``match`` yields the state and the size of the longest match ending at each position."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]

    def add(self, seq: list[int]) -> None:
        last = 0
        for c in seq:
            last = self._extend(last, c)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def match(self, seq):
        nxt, link, length = self.next, self.link, self.len
        state = size = 0
        for c in seq:
            while state and c not in nxt[state]:
                state = link[state]
                size = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                size += 1
            yield state, size

    def shorter(self, state: int, size: int) -> int:
        """The state of the last ``size`` words of what led to ``state``."""
        while self.len[self.link[state]] >= size:
            state = self.link[state]
        return state


class Index:
    """Vocabulary, automaton, neighbouring pairs and windows of some items."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int) -> None:
        self.vocab: dict[bytes, int] = {}
        self.window, self.automaton = window, Automaton()
        pairs, lengths, seqs = set(), set(), []
        for item, words in items:
            if not words:
                continue
            seq = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
            self.automaton.add(seq)
            pairs.update(zip(seq, seq[1:], strict=False))
            seqs.append((item, seq))
            lengths.add(min(window, len(seq)))
        #: Items by the state and size of their windows.
        self.owners: dict[tuple[int, int], list] = {}
        for item, seq in seqs:
            size = min(window, len(seq))
            for state, _ in list(self.automaton.match(seq))[size - 1 :]:
                own = self.owners.setdefault((self.automaton.shorter(state, size), size), [])
                if item is not None and item not in own:
                    own.append(item)
        self.width = max(1, len(self.vocab))
        self.pairs = np.array(sorted(a * self.width + b for a, b in pairs), np.int64)
        self.order = sorted(lengths)

    def hits(self, words: list[bytes]) -> tuple[list[int], list]:
        """Positions of hit words and the items whose windows occur."""
        if not self.order or len(words) < self.order[0]:
            return [], []
        get, least = self.vocab.get, self.order[0]
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        if least == 1:
            alive = ids >= 0
            runs = _runs(alive, 1)
        else:
            code = ids[:-1] * self.width + ids[1:]
            at = np.searchsorted(self.pairs, code)
            alive = (ids[:-1] >= 0) & (ids[1:] >= 0) & (at < len(self.pairs))
            alive[alive] = self.pairs[at[alive]] == code[alive]
            runs = [(a, b + 1) for a, b in _runs(alive, least - 1)]
        marked, items = set(), set()
        for lo, hi in runs:
            seq = ids[lo:hi].tolist()
            for i, (state, size) in enumerate(self.automaton.match(seq)):
                if size < least:
                    continue
                for n in reversed(self.order):
                    if n > size:
                        continue
                    state = self.automaton.shorter(state, n)
                    own = self.owners.get((state, n))
                    if own is not None:
                        marked.update(range(lo + i - n + 1, lo + i + 1))
                        items.update(own)
        return sorted(marked), sorted(items)


def _runs(alive: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs of true, as half-open ranges, of at least ``least``."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], alive.view(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= least]


def indexes(benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> Iterator[Index]:
    """One index, or several of at most ``shard_words`` words (at least one item each), built as they are asked for."""
    part, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        words = words_of(row[1])
        if part and size + len(words) > shard_words:
            yield Index(part, window)
            part, size = [], 0
        part.append((row[0], words))
        size += len(words)
    yield Index(part, window)


def _pass(docs: DataFrame, index: Index, row: str = "", every: bool = True) -> DataFrame:
    """Marks of one automaton, with the column ``row`` where named; without ``every`` only of the rows it hits."""
    schema = "doc_id long, n_words long, hits array<int>, items array<long>" + (f", {row} long" if row else "")

    def run(batches):
        for b in batches:
            n, hits, items = [], [], []
            for t in b.column(1).to_pylist():
                words = words_of(t)
                h, i = index.hits(words)
                n.append(len(words))
                hits.append(h)
                items.append(i)
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.int64())), *b.columns[2:]], ["doc_id", "n_words", "hits", "items", *([row] if row else [])])
            yield out if every else out.filter(pa.array([bool(h) for h in hits], pa.bool_()))

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text", *([row] if row else [])).mapInArrow(run, schema)


_ROW = "__row"


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows under a number of their own; written, since a number given anew in each pass might differ."""
    return stored(docs.sparkSession, docs.withColumn(_ROW, F.monotonically_increasing_id()), "decontaminate-rows")


def _united(rows: DataFrame, shards: Iterator[Index], every: bool) -> DataFrame:
    """Marks of all automata by row number. Each pass is written before the next automaton is built."""
    both = None
    for index in shards:
        p = stored(rows.sparkSession, _pass(rows, index, _ROW, every and both is None), "decontaminate-marks")
        both = p if both is None else both.unionByName(p)
    all_of = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return both.groupBy(_ROW).agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), all_of("hits"), all_of("items"))


def _one_or_all(shards: Iterator[Index]) -> tuple[Index | None, Iterator[Index]]:
    """The index where there is only one, else all of them."""
    first, second = next(shards), next(shards, None)
    if second is None:
        return first, iter(())
    ahead = [second, first]

    def every():
        while ahead:
            yield ahead.pop()
        yield from shards

    return None, every()


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``doc_id``, ``n_words``, ``hits`` (numbers of hit words), ``items`` of each row."""
    small_batches(docs.sparkSession)
    index, shards = _one_or_all(indexes(benchmark, window, shard_words))
    if index:
        return _pass(docs, index)
    return _united(_numbered(docs.select("doc_id", "text")), shards, True).drop(_ROW)


def report(found: DataFrame, coverage: int = COVERAGE) -> DataFrame:
    """Digest columns of :func:`find`."""
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    n_hit = F.size("hits").cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), ((n_hit > 0) & (n_hit * coverage >= F.col("n_words"))).alias("contaminated"))


def cut(text: str, hits: list[int]) -> str:
    """``text`` without the hit words; what stood between neighbouring hit words goes too."""
    places = [m.span() for m in _PLACED.finditer(text)]
    out, done, gone = [], 0, set(hits)
    for i in hits:
        if i >= len(places):
            break
        start, end = places[i]
        if i - 1 in gone:
            start = places[i - 1][1]
        out.append(text[done:start])
        done = end
    return "".join(out) + text[done:]


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` without contaminated rows; in the others hit passages are cut out and ``n_chars``, where present, follows.

    One pass with one automaton; with several, their marks are joined to the rows and judged together.
    """
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")
    size_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    index, shards = _one_or_all(indexes(benchmark, window, shard_words))
    width, schema = len(docs.columns), docs.schema

    def run(batches):
        for b in batches:
            was = b.column(at).to_pylist()
            marks = [None] * len(was) if index else b.column(width).to_pylist()
            b = b.select(list(range(width)))
            keep, texts = [], []
            for t, h in zip(was, marks, strict=True):
                words = words_of(t) if index or h else []
                h = index.hits(words)[0] if index else h
                keep.append(not h or len(h) * coverage < len(words))
                texts.append(cut(t, h) if h and keep[-1] else t)
            new = pa.array(texts, b.schema.field(at).type)
            if size_at is not None:
                sizes = [len(x) if x is not None and x != o else n for x, o, n in zip(texts, was, b.column(size_at).to_pylist(), strict=True)]
                b = b.set_column(size_at, b.schema.field(size_at), pa.array(sizes, b.schema.field(size_at).type))
            yield b.set_column(at, b.schema.field(at), new).filter(pa.array(keep, pa.bool_()))

    if not index:
        rows = _numbered(docs)
        docs = rows.join(_united(rows, shards, False).select(_ROW, "hits"), _ROW, "left").select(*[rows[c] for c in schema.names], "hits")
    return docs.mapInArrow(run, schema)
