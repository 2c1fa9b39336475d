"""Toxic spans by a linear-chain conditional random field, aggregated to document scores.

Training (``train``): labels are per document, so token labels are derived first. A word, or a
prefix of four to six letters, that stands in toxic documents far more often than in clean ones
marks its tokens in toxic documents as toxic; every other token is clean. A two-tag CRF is fitted
on windows of those tokens by gradient ascent on its log-likelihood (forward-backward), with the
word and its prefixes as observations and a tag transition table. A logistic curve over
three aggregates of the marginals (expected number of toxic tokens, largest marginal, density) then
maps to a document score.

The fit uses at most ``MAX_TOXIC`` toxic and ``MAX_CLEAN`` clean labelled rows, the first by a hash
of their identifier, of either class as many as hold ``MAX_BYTES`` of text, and ``MAX_WINDOWS`` windows of them; scoring reads every row and whole texts. Labels, language, source and
identifier are never inputs of a score.

Null and empty texts have no tokens and get the curve's value at zero. Without both classes in the
labels nothing can be fitted and every score is 0. Repeated rows score alike.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.common import small_batches

MAX_TOXIC, MAX_CLEAN = 1500, 3000
#: Bytes of text of either class in the sample.
MAX_BYTES = 48 << 20
PREFIXES = (4, 5, 6)
WINDOW = 6
MAX_WINDOWS = 9000
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-case words, as many and at the same places as in the text itself (lower-casing may lengthen it)."""
    if not text:
        return []
    low = text.lower()
    return _WORD.findall(low) if len(low) == len(text) else [w.lower() for w in _WORD.findall(text)]


def features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}^" for k in PREFIXES if len(word) >= k)]


@dataclass
class Model:
    """``weights``: evidence of a feature for the toxic tag; ``trans``: log potentials [from, to]; ``curve``: bias and weights of the aggregates."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    trans: tuple = ((0.0, 0.0), (0.0, 0.0))
    curve: tuple | None = None


class _Evidence:
    """Unary log-odds of words. Most words share no first four letters with any feature; one set look-up settles those."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.keys = {f.rstrip("^")[:4] for f in model.weights}

    def of(self, word: str) -> float:
        w = self.model.weights
        return self.model.bias + sum(w.get(f, 0.0) for f in features(word))

    def chain(self, text: str | None) -> np.ndarray:
        words, keys = words_of(text), self.keys
        out = np.full(len(words), self.model.bias)
        for i in [i for i, w in enumerate(words) if w[:4] in keys]:
            out[i] = self.of(words[i])
        return out


def marginals(unary: np.ndarray, starts: np.ndarray, trans: np.ndarray, length: int = 128) -> np.ndarray:
    """P(toxic) of each token of many concatenated chains; ``starts``: positions where a chain begins.

    Exact forward-backward. The tokens are laid out as rows of ``length``; the products of 2x2
    potentials of each row are formed for all rows at once, then joined row after row.
    """
    n = len(unary)
    if n == 0:
        return np.zeros(0)
    rows = -(-n // length)
    e = np.ones((rows * length, 2))
    top = np.maximum(unary, 0.0)
    e[:n, 0], e[:n, 1] = np.exp(-top), np.exp(unary - top)
    first = np.zeros(rows * length, bool)
    first[starts] = True
    first[n:] = True
    t = np.exp(trans - trans.max())
    step = np.where(first[:, None, None], 1.0, t[None]) * e[:, None, :]  # [token, from, to]
    step = step.reshape(rows, length, 2, 2)

    def scan(mats: np.ndarray) -> np.ndarray:
        """Row vectors after each step, from (1, 1)."""
        prod = np.broadcast_to(np.eye(2), (rows, 2, 2)).copy()
        for i in range(length):
            prod = prod @ mats[:, i]
            prod /= prod.max(axis=(1, 2), keepdims=True)
        v, heads = np.ones(2), np.empty((rows, 2))
        for r in range(rows):
            heads[r] = v
            v = v @ prod[r]
            v = v / v.max()
        out, cur = np.empty((rows, length, 2)), heads
        for i in range(length):
            cur = np.einsum("rf,rft->rt", cur, mats[:, i])
            cur = cur / cur.max(axis=1, keepdims=True)
            out[:, i] = cur
        return out.reshape(-1, 2)

    ahead = scan(step)
    # Backward: the message into token i comes from token i+1's step, transposed and in reverse order.
    flat = step.reshape(-1, 2, 2)
    back_steps = np.concatenate([np.ones((1, 2, 2)), flat[:0:-1].transpose(0, 2, 1)])
    behind = scan(back_steps.reshape(rows, length, 2, 2))[::-1]
    p = ahead * behind
    return (p[:, 1] / p.sum(axis=1))[:n]


def reach(model: Model) -> int:
    """Tokens after which a message has forgotten its start, to 1e-9, over words without evidence."""
    step = np.exp(np.array(model.trans)) * np.exp([0.0, model.bias])
    small, large = sorted(np.abs(np.linalg.eigvals(step)))
    ratio = min(max(small / large, 1e-6), 0.97)
    return int(np.ceil(np.log(1e-9) / np.log(ratio))) + 1


def sparse_marginals(unary: np.ndarray, starts: np.ndarray, model: Model) -> np.ndarray:
    """:func:`marginals`, computed only within reach of evidence or of a chain's end; elsewhere the chain is in its steady state."""
    n = len(unary)
    if n == 0:
        return np.zeros(0)
    w, trans = reach(model), np.array(model.trans)
    steady = marginals(np.full(4 * w + 1, model.bias), np.array([0]), trans)[2 * w]
    odd = unary != model.bias
    odd[starts] = True
    odd[np.append(starts[1:], n) - 1] = True
    at = np.flatnonzero(odd)
    cover = np.zeros(n + 1, np.int32)
    # Values are wanted within one reach of evidence, and need one more reach around them.
    np.add.at(cover, np.maximum(at - 2 * w, 0), 1)
    np.add.at(cover, np.minimum(at + 2 * w + 1, n), -1)
    inside = np.cumsum(cover[:-1]) > 0
    picked = np.flatnonzero(inside)
    begins = np.zeros(n, bool)
    begins[starts] = True
    fresh = begins[picked]
    fresh[1:] |= np.diff(picked) > 1
    fresh[0] = True
    part = marginals(unary[picked], np.flatnonzero(fresh), trans)
    near = np.zeros(n + 1, np.int32)
    np.add.at(near, np.maximum(at - w, 0), 1)
    np.add.at(near, np.minimum(at + w + 1, n), -1)
    wanted = np.cumsum(near[:-1]) > 0
    out = np.full(n, steady)
    out[picked] = np.where(wanted[picked], part, steady)
    return out


def _aggregate(p: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sizes), 3))
    some = sizes > 0
    if some.any():
        at = starts[some]
        total = np.add.reduceat(p, at)
        out[some, 0], out[some, 1] = np.log1p(total), np.maximum.reduceat(p, at)
        out[some, 2] = total / sizes[some]
    return out


def _chains(texts: list[str | None], evidence: _Evidence) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lists = [evidence.chain(t) for t in texts]
    sizes = np.array([len(x) for x in lists], np.int64)
    starts = np.cumsum(sizes) - sizes
    return (np.concatenate(lists) if lists else np.zeros(0)), starts, sizes


def _score(model: Model, agg: np.ndarray) -> np.ndarray:
    if model.curve is None:
        return np.zeros(len(agg))
    c = np.array(model.curve)
    return 1 / (1 + np.exp(-np.clip(c[0] + agg @ c[1:], -30, 30)))


def score_texts(model: Model, texts: list[str | None], evidence: _Evidence | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(scores, token marginals, starts, sizes) of a batch of texts."""
    evidence = evidence if evidence is not None else _Evidence(model)
    unary, starts, sizes = _chains(texts, evidence)
    p = sparse_marginals(unary, starts[sizes > 0], model)
    return _score(model, _aggregate(p, starts, sizes)), p, starts, sizes


def _sketch(words: list[str]) -> int:
    """Smallest hash of three words in a row: near copies mostly share it."""
    return min((zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))), default=0)


def fit(rows: list[tuple[str | None, int]], steps: int = 50, l2: float = 2e-4) -> Model:
    """Fit from (text, label) rows; an empty model when a class is missing. Of near copies one teaches words."""
    docs = {}
    for t, y in rows:
        words = words_of(t)
        docs.setdefault((_sketch(words), int(y)), (words, int(y)))
    docs = list(docs.values())
    n = Counter(y for _, y in docs)
    if not n[0] or not n[1]:
        return Model()
    df = {0: Counter(), 1: Counter()}
    for words, y in docs:
        df[y].update({f for w in set(words) for f in features(w)})
    least = max(3, round(0.012 * n[1]))
    odds = {f: np.log((c / n[1]) / ((df[0][f] + 0.5) / n[0])) for f, c in df[1].items() if c >= least}
    marks = {f for f, o in odds.items() if o > np.log(12)}
    known = sorted(f for f, o in odds.items() if o > 1.0)
    ids = {f: i for i, f in enumerate(known)}
    # Windows: around marked tokens of toxic documents, and spread over clean ones.
    spans, tags = [], []
    for words, y in docs:
        hits = [i for i, w in enumerate(words) if y and not marks.isdisjoint(features(w))]
        seeds = hits if y else range(len(words) // 2, len(words), max(1, len(words)))
        done = -1
        for i in seeds:
            if i <= done:
                continue
            lo, hi = max(0, i - WINDOW), min(len(words), i + WINDOW + 1)
            spans.append(words[lo:hi])
            marked = set(hits)
            tags.append([int(j in marked) for j in range(lo, hi)])
            done = hi - 1
        # Words of clean documents that carry a toxic feature are the counterexamples that matter most.
        if not y:
            for i, w in enumerate(words):
                if not marks.isdisjoint(features(w)):
                    spans.append(words[max(0, i - 3) : i + 4])
                    tags.append([0] * len(spans[-1]))
    if not spans:
        return Model()
    stride = -(-len(spans) // MAX_WINDOWS)
    spans, tags = spans[::stride], tags[::stride]
    size = np.array([len(s) for s in spans])
    m, width = len(spans), int(size.max())
    mask = np.arange(width)[None, :] < size[:, None]
    y = np.zeros((m, width), np.int64)
    tok_of, feat_of = [], []
    for r, (s, t) in enumerate(zip(spans, tags, strict=True)):
        y[r, : len(t)] = t
        for c, w in enumerate(s):
            for f in features(w):
                if f in ids:
                    tok_of.append(r * width + c)
                    feat_of.append(ids[f])
    tok, feat = np.array(tok_of, np.int64), np.array(feat_of, np.int64)
    theta = np.zeros(len(known) + 1 + 4)
    mean, var = np.zeros_like(theta), np.zeros_like(theta)
    pair_mask = mask[:, 1:]
    gold_pairs = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & pair_mask).sum() for b in (0, 1)] for a in (0, 1)], float)
    for it in range(1, steps + 1):
        w, bias, tr = theta[: len(known)], theta[len(known)], theta[-4:].reshape(2, 2)
        un = bias + np.bincount(tok, w[feat], m * width).reshape(m, width) if len(tok) else np.full((m, width), bias)
        lu = np.stack([np.zeros_like(un), un], 2) * mask[:, :, None]
        fw, bw = np.empty((m, width, 2)), np.zeros((m, width, 2))
        fw[:, 0] = lu[:, 0]
        for i in range(1, width):
            new = np.logaddexp(fw[:, i - 1, 0, None] + tr[0], fw[:, i - 1, 1, None] + tr[1]) + lu[:, i]
            fw[:, i] = np.where(mask[:, i, None], new, fw[:, i - 1])
        for i in range(width - 2, -1, -1):
            nxt = lu[:, i + 1] + bw[:, i + 1]
            new = np.logaddexp(nxt[:, 0, None] + tr[:, 0], nxt[:, 1, None] + tr[:, 1])
            bw[:, i] = np.where(mask[:, i + 1, None], new, 0.0)
        z = np.logaddexp(fw[:, -1, 0], fw[:, -1, 1])
        post = np.exp(fw + bw - z[:, None, None])[:, :, 1] * mask
        gap = (y - post) * mask
        grad = np.empty_like(theta)
        grad[: len(known)] = np.bincount(feat, gap.reshape(-1)[tok], len(known)) if len(tok) else 0
        grad[len(known)] = gap.sum()
        pair = np.empty((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                lp = fw[:, :-1, a] + tr[a, b] + lu[:, 1:, b] + bw[:, 1:, b] - z[:, None]
                pair[a, b] = (np.exp(lp) * pair_mask).sum()
        grad[-4:] = (gold_pairs - pair).reshape(-1)
        grad = grad / m - l2 * theta
        mean, var = 0.9 * mean + 0.1 * grad, 0.99 * var + 0.01 * grad**2
        theta = theta + 0.2 * (mean / (1 - 0.9**it)) / (np.sqrt(var / (1 - 0.99**it)) + 1e-8)
    model = Model({f: float(v) for f, v in zip(known, theta, strict=False) if abs(v) > 1e-3}, float(theta[len(known)]), tuple(map(tuple, theta[-4:].reshape(2, 2))))
    model.curve = _fit_curve(model, rows)
    return model


def _fit_curve(model: Model, rows: list[tuple[str | None, int]]) -> tuple:
    """Logistic regression (Newton, ridge) of the labels on the aggregates."""
    evidence, parts = _Evidence(model), []
    for i in range(0, len(rows), 256):
        unary, starts, sizes = _chains([t for t, _ in rows[i : i + 256]], evidence)
        parts.append(_aggregate(sparse_marginals(unary, starts[sizes > 0], model), starts, sizes))
    x = np.concatenate([np.ones((len(rows), 1)), np.concatenate(parts)], 1)
    y = np.array([float(v) for _, v in rows])
    c = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        ridge = np.diag([1e-3, *[0.05] * (len(c) - 1)])
        c = c + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ c)
    return tuple(float(v) for v in c)


def held_out():
    """Column: the row's label may not be learnt (crc32 of the identifier's text, modulo 3, is 1)."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """Fit on a sample of the labelled rows that are not held out, bounded in rows and bytes; only that sample reaches the driver."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("toxic").cast("int").alias("y"))
    pick = lambda y, k: usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(k)
    chosen = pick(1, max_toxic).unionByName(pick(0, max_clean))
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")
    size = F.sum(F.octet_length(F.coalesce("text", F.lit("")))).over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = met.withColumn("size", size).where(F.col("size") <= MAX_BYTES).select("doc_id", "text", "y").collect()
    return fit([(r.text, r.y) for r in sorted(rows, key=lambda r: (r.doc_id, r.y, r.text or ""))])


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, spans: bool = True) -> DataFrame:
    """``docs`` columns ``keep`` with ``score``, ``expected`` (toxic tokens) and, if asked, ``toxic_spans`` (offsets of tokens whose marginal is at least one half)."""
    small_batches(docs.sparkSession)
    keep = [c for c in (keep or ["doc_id"]) if c not in {"score", "expected", "toxic_spans"}]
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "score double", "expected double", *(["toxic_spans array<struct<start:int,end:int,p:double>>"] if spans else [])])
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches):
        evidence = _Evidence(model)
        for b in batches:
            texts = b.column(len(keep)).to_pylist()
            s, p, starts, sizes = score_texts(model, texts, evidence)
            total = [float(p[a : a + n].sum()) for a, n in zip(starts, sizes, strict=True)]
            cols = [*(b.column(i) for i in range(len(keep))), pa.array(s), pa.array(total, pa.float64())]
            if spans:
                found = []
                for t, a, n in zip(texts, starts, sizes, strict=True):
                    own = p[a : a + n]
                    hot = np.flatnonzero(own >= 0.5)
                    if not len(hot):
                        found.append([])
                        continue
                    words = [m.span() for m in _WORD.finditer(t)]
                    found.append([{"start": words[i][0], "end": words[i][1], "p": float(own[i])} for i in hot])
                cols.append(pa.array(found, span_type))
            yield pa.RecordBatch.from_arrays(cols, [*keep, "score", "expected", *(["toxic_spans"] if spans else [])])

    return docs.select(*(f"`{c}`" for c in keep), F.col("text").cast("string").alias("__text")).mapInArrow(run, schema)


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score stays below ``threshold``, columns as they were."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        evidence = _Evidence(model)
        for b in batches:
            s = score_texts(model, b.column(at).to_pylist(), evidence)[0]
            yield b.filter(pa.array(s < threshold))

    return docs.mapInArrow(run, docs.schema)
