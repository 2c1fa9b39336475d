"""Similarity join of word-shingle sets by count vectors: links of Jaccard 0.8 and more, and their components.

A document's set holds its distinct shingles of ``SHINGLE`` words (bytes split at ASCII white space,
A-Z lower-cased); with fewer words the whole sequence is one shingle; without words the set is
empty and links with nothing. Two documents link when 100 * |A and B| >= 80 * |A or B|.

1. Equal sets form a class; its smallest identifier stands for it. Copies are met once a task, not expanded.
2. Tokens are hashed into groups, as many as a set's size class has elements. Linked sets differ in at
   most a quarter of the smaller one's size, D elements, which touch at most D groups: so of the contents of the non-empty
   groups, taken in one fixed order (fullest first), the first D + 1 of both sets share one. These group contents are the exact
   blocking keys; larger groups come first since they are shared least by chance.
   A set that fills too few groups for that (beyond six standard deviations) is held against all sets of fitting size.
3. Of the blocks a set is in, it first goes to the head (smallest identifier) it shares most of them with; many
   sets at one head are dealt to several tasks, each with the head. Where sets meet, an R-tree over their group-count vectors
   (hashing elements) proposes pairs: a node's upper corner bounds the overlap by the sum of coordinate
   minima, and nodes and points that cannot reach the overlap a link needs are pruned. Surviving pairs that nothing joins yet are
   verified on the sets themselves, and links give components: a group of near copies costs about one comparison a copy.
4. Blocks that still hold several components are searched by the R-tree once more, on stored vectors of ``GROUPS``
   coordinates; of blocks of the same documents one is enough. Components that
   survive together form a canopy, of which a task reports a spanning forest, not all pairs. The sets of
   a canopy's documents then meet (large canopies and blocks as pairs of tiles) as in 3.
5. Components come from alternating star contraction over the links, written to the shared folder each round.

No block, candidate list or component is capped. Rows with a null identifier link with nothing and get a null component;
rows that repeat an identifier are one document. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import shuffle_partitions, small_batches, spent, stored
from attesta.llm.url_filter import possible, without

SHINGLE = 5
NUM, DEN = 80, 100
GROUPS = 256
TILE = 2048
LEAF = 16
PROBES_PER_HEAD = 512
CANOPY_TILE = 512
#: Sets smaller than this use their elements as groups.
SMALL = 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 4096)
        for i, b in enumerate((_BASE, _INVERSE)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word, the same on every machine."""
    if not text:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(text.encode("utf-8", "replace").lower(), np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _power(len(raw) + 1)
    prefix = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    w = word_hashes(text)
    if not len(w):
        return w
    if len(w) < size:
        size, k = len(w), np.uint64(0xA0761D6478BD642F)
        h = np.full(1, len(w), np.uint64)
    else:
        k = np.uint64(0xE7037ED1A0B428DB)
        h = np.zeros(len(w) - size + 1, np.uint64)
    for i in range(size):
        h = h * k + w[i : len(w) - size + 1 + i]
    return np.unique(mix(h))


def size_classes(n: int) -> list[int]:
    """Size classes (powers of two) in which a set of ``n`` must meet its possible partners."""
    own = n.bit_length() - 1
    least = -(-n * NUM // DEN)  # size of the smallest partner
    return [own] if least.bit_length() - 1 == own else [own - 1, own]


def blocking_keys(s: np.ndarray) -> tuple[np.ndarray, bool]:
    """The group contents (hashed) under which a set meets every set it links with, and whether it fills too few groups for that to hold."""
    n, out, few = len(s), [], False
    if not n:
        return s, few
    limit = n * (DEN - NUM) // NUM  # most elements in which a linked set can differ
    for k in size_classes(n):
        tag = np.uint64((k * 0x2545F4914F6CDD1D + 0x1234567) & (2**64 - 1))
        if (1 << (k + 1)) <= SMALL:
            sums, counts = s, np.ones(n, np.int64)
        else:
            group = (mix(s ^ tag) % np.uint64(1 << k)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            g = group[order]
            head = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            sums = np.add.reduceat(mix(s[order] + np.uint64(0x5851F42D4C957F2D)), head)
            counts = np.diff(np.append(head, n))
        keys = mix(sums ^ tag)
        if len(keys) > limit + 1:
            best = np.lexsort((keys, -counts))[: limit + 1]
            keys = keys[best]
        elif len(keys) <= limit:
            few = True
        out.append(keys)
    return np.concatenate(out), few


def groups_for(least: int) -> int:
    """Coordinates that keep the bound sharp for sets of ``least`` elements and more: unrelated large sets would fill few coordinates alike."""
    return GROUPS << max(0, min(6, (least // (8 * GROUPS)).bit_length()))


def count_vector(s: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    return np.bincount((s % np.uint64(groups)).astype(np.int64), minlength=groups).astype("<u4")


def needed(n: np.ndarray | int, m: np.ndarray | int):
    """Least overlap of linked sets of sizes n and m: 100 i >= 80 (n + m - i)."""
    return -(-NUM * (n + m) // (DEN + NUM))


def sets(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n``, ``print`` (of the set) and, for the first of equal sets in a task, ``keys``, ``few`` and ``counts``."""
    schema = "doc_id long, n long, print binary, keys array<long>, few boolean, counts binary"

    def run(batches):
        seen: set[bytes] = set()
        for b in batches:
            rows = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingles(t)
                p = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                if p is None or d is None or p in seen:
                    rows.append((len(s), p, None, None, None))
                else:
                    seen.add(p)
                    keys, few = blocking_keys(s)
                    rows.append((len(s), p, keys.view(np.int64), few, count_vector(s).tobytes()))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n", "print", "keys", "few", "counts"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, schema)


def _blocks(base: DataFrame, parts: int) -> DataFrame:
    """``key``, ``doc_id``, ``head`` of every key that at least two sets share; ``head`` is the smallest identifier of the block."""
    rows = base.select(F.explode("keys").alias("key"), "doc_id").repartition(parts, "key").sortWithinPartitions("key", "doc_id")

    def run(batches):
        # Of the block that the last batch ended in: its key, its head, and whether only the head has been seen.
        at, head, alone = None, None, False
        for b in batches:
            key, doc = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            if not len(key):
                continue
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(first, len(key)))
            heads, shared = doc[first], size > 1
            if at is not None and key[0] == at:
                heads[0], shared[0] = head, True
                if alone:
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (at, head, head)], ["key", "doc_id", "head"])
            at, head, alone = key[-1], heads[-1], not shared[-1]
            keep = np.repeat(shared, size)
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, doc, np.repeat(heads, size))], ["key", "doc_id", "head"])

    return rows.mapInArrow(run, "key long, doc_id long, head long")


def _unblocked(base: DataFrame) -> DataFrame | None:
    """Pairs (``a``, ``b``) of the sets for which group contents promise nothing, and all that by their sizes can link with them."""
    few = base.where("few").select(F.col("doc_id").alias("b"), F.col("n").alias("m"))
    if few.isEmpty():
        return None
    # Sizes of linked sets lie in one class or in neighbouring ones.
    near = few.select("b", "m", F.explode(F.array(*[F.floor(F.log2("m")).cast("int") + d for d in (-1, 0, 1)])).alias("k"))
    sized = base.where("keys is not null").select(F.col("doc_id").alias("a"), "n", F.floor(F.log2("n")).cast("int").alias("k"))
    return sized.join(near.hint("merge"), "k").where((F.col("n") * DEN >= F.col("m") * NUM) & (F.col("m") * DEN >= F.col("n") * NUM) & (F.col("a") != F.col("b"))).select("a", "b").distinct()


def _with_text(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (stored; ``doc_id`` and more) with the ``text``; texts that cannot be wanted are left out before the exchange."""
    rows = docs.selectExpr("cast(doc_id as long) key", "cast(text as string) text").where("key is not null")
    return possible(rows, wanted.select(F.col("doc_id").alias("key")).distinct()).withColumnRenamed("key", "doc_id").hint("merge").join(wanted, "doc_id")


def links_between(a: np.ndarray, b: np.ndarray) -> bool:
    """Do two sorted sets link?"""
    if not len(a) or not len(b):
        return False
    i = np.searchsorted(a, b)
    i[i == len(a)] = 0
    common = int((a[i] == b).sum())
    return DEN * common >= NUM * (len(a) + len(b) - common)


def verify(docs: DataFrame, pairs: DataFrame, parts: int) -> DataFrame:
    """The rows of ``pairs`` (``a``, ``b``; distinct) whose sets link. A ``b`` with many partners is dealt to several tasks."""
    heads = pairs.groupBy("b").agg(F.ceil(F.count("*") / PROBES_PER_HEAD).cast("int").alias("salts"))
    probes = pairs.join(heads.hint("merge"), "b").select(F.col("a").alias("doc_id"), F.col("b").alias("head"), F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"))
    builds = heads.select(F.col("b").alias("doc_id"), F.col("b").alias("head"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"))
    roles = stored(docs.sparkSession, probes.unionByName(builds).groupBy("doc_id").agg(F.collect_list(F.struct("head", "salt", "role")).alias("roles")), "ngram-roles")

    def build(batches):
        for b in batches:
            out = [(r["head"], r["salt"], r["role"], d, s) for d, t, rs in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True) for s in [shingles(t).tobytes()] for r in rs]
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["head", "salt", "role", "doc_id", "s"])

    met = _with_text(docs, roles).select("doc_id", "text", "roles").mapInArrow(build, "head long, salt int, role int, doc_id long, s binary").repartition(parts, "head", "salt").sortWithinPartitions("head", "salt", "role")

    def check(batches):
        for rows in _groups(batches, 2, 5):
            yield _forest([r[3] for r in rows], [np.frombuffer(r[4], np.uint64) for r in rows])

    return met.mapInArrow(check, "a long, b long")


def _forest(names: list[int], sets_: list[np.ndarray], left: np.ndarray | None = None, right: np.ndarray | None = None) -> pa.RecordBatch:
    """Links ``a``, ``b`` that span what links among sets (or between two sides of them): an R-tree proposes pairs, the sets decide.

    Sets of one name are one, and pairs that are joined already are passed over. The first set is asked first, so that
    a group of near copies costs about one comparison a copy.
    """
    every = np.arange(len(names))
    left, right = every if left is None else left, every if right is None else right
    joined, out = np.unique(names, return_inverse=True)[1], []
    if len(left) and len(right):
        n = np.array([len(s) for s in sets_], np.int64)
        groups = groups_for(int(n.min()))
        points = np.stack([count_vector(s, groups) for s in sets_])
        for q, k in _proposed(points, n, joined, left, right):
            if joined[q] != joined[k] and links_between(sets_[q], sets_[k]):
                joined[joined == joined[k]] = joined[q]
                out.append((names[q], names[k]))
    cols = list(zip(*out, strict=True)) or [(), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])


def _proposed(points: np.ndarray, n: np.ndarray, joined: np.ndarray, left: np.ndarray, right: np.ndarray):
    """Pairs of numbers that the tree proposes and that ``joined`` (which may change meanwhile) holds apart."""
    tree = RTree(points[right], n[right])
    for q in left:
        if (joined[right] != joined[q]).any():
            found = right[tree.search(points[q], int(n[q]))]
            for k in found[joined[found] != joined[q]]:
                yield q, k


class RTree:
    """Packed R-tree of count vectors (upper corners only: the overlap bound needs no lower ones)."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, leaf: int = LEAF) -> None:
        # Packing by size, then by the coordinates that vary most, keeps corners low.
        spread = points.std(axis=0)
        axes = np.argsort(-spread)[:3]
        self.order = np.lexsort((*points[:, axes].T, sizes))
        self.points, self.sizes = points[self.order].astype(np.int32), sizes[self.order]
        cut = np.arange(0, len(points), leaf)
        levels = [(np.maximum.reduceat(self.points, cut), np.minimum.reduceat(self.sizes, cut), np.maximum.reduceat(self.sizes, cut))]
        while len(levels[-1][1]) > leaf:
            hi, lo_n, hi_n = levels[-1]
            cut = np.arange(0, len(lo_n), leaf)
            levels.append((np.maximum.reduceat(hi, cut), np.minimum.reduceat(lo_n, cut), np.maximum.reduceat(hi_n, cut)))
        self.levels, self.leaf = levels, leaf

    def search(self, q: np.ndarray, n: int) -> np.ndarray:
        """Numbers of the points whose summed coordinate minima with ``q`` reach the overlap a link needs."""
        q = q.astype(np.int32)
        nodes = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            hi, lo_n, hi_n = (x[nodes] for x in self.levels[depth])
            # Sizes outside 0.8 to 1.25 of n cannot link; within, the smallest size asks for the least overlap.
            least = np.maximum(lo_n, -(-n * NUM // DEN))
            fits = (hi_n * DEN >= n * NUM) & (lo_n * NUM <= n * DEN) & (np.minimum(hi, q).sum(axis=1) >= needed(n, least))
            nodes = nodes[fits]
            if not len(nodes):
                return nodes
            nodes = (nodes[:, None] * self.leaf + np.arange(self.leaf)).reshape(-1)
            top = len(self.points) if depth == 0 else len(self.levels[depth - 1][1])
            nodes = nodes[nodes < top]
        fits = np.minimum(self.points[nodes], q).sum(axis=1) >= needed(n, self.sizes[nodes])
        return self.order[nodes[fits]]


class Union:
    """Disjoint sets of identifiers."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        p = self.parent
        while (y := p.get(x, x)) != x:
            p[x] = x = p.get(y, y)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
        return x != y


def _groups(batches, keys: int, columns: int):
    """Rows of consecutive equal keys (the first ``keys`` columns), as lists of tuples."""
    own: list[tuple] = []
    for b in batches:
        for r in zip(*(b.column(i).to_pylist() for i in range(columns)), strict=True):
            if own and own[0][:keys] != r[:keys]:
                yield own
                own = []
            own.append(r)
    if own:
        yield own


def _sides(tile: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    every = np.arange(len(tile))
    return (every, every) if i == j else (np.flatnonzero(tile == i), np.flatnonzero(tile == j))


def _tiled(rows: DataFrame, group: str, *cols: str) -> DataFrame:
    """``rows`` (with ``tiles`` of their group) dealt as pairs of tiles: ``group``, ``i``, ``j``, ``t`` and ``cols``."""
    each = rows.withColumn("t", F.pmod(F.xxhash64("doc_id"), F.col("tiles")).cast("int"))
    dealt = each.select(group, "t", *cols, F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("u"))
    return dealt.select(group, F.least("t", "u").alias("i"), F.greatest("t", "u").alias("j"), "t", *cols)


def _mixed(blocks: DataFrame, comp: DataFrame) -> DataFrame:
    """Rows of the blocks that hold several components: ``key``, ``doc_id``, ``comp``, ``tiles``; of blocks of the same documents one is kept."""
    placed = stored(blocks.sparkSession, blocks.select("key", "doc_id").join(comp.hint("merge"), "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id")), "ngram-placed")
    own = F.xxhash64("doc_id")
    seen = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m"), F.bit_xor(own).alias("x"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("y"), F.min("doc_id").alias("z")).where("lo < hi")
    mixed = seen.groupBy("m", "x", "y", "z").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("m") / TILE).cast("int").alias("tiles"))
    out = stored(blocks.sparkSession, placed.join(mixed.hint("merge"), "key"), "ngram-mixed")
    spent(placed)
    return out


def _canopies(base: DataFrame, mixed: DataFrame, parts: int) -> DataFrame:
    """Pairs of components (``a``, ``b``) that the R-tree cannot keep apart: a spanning forest of each task's, which holds the same groups as all pairs would."""
    points = base.where("counts is not null").select("doc_id", "n", "counts").distinct()
    dealt = _tiled(mixed.join(points.hint("merge"), "doc_id"), "key", "doc_id", "comp", "n", "counts").repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches):
        near, out = Union(), []
        for rows in _groups(batches, 3, 8):
            comps = [r[5] for r in rows]
            if len({near.find(c) for c in set(comps)}) < 2:
                continue
            n, points_ = np.array([r[6] for r in rows], np.int64), np.stack([np.frombuffer(r[7], "<u4") for r in rows])
            left, right = _sides(np.array([r[3] for r in rows]), rows[0][1], rows[0][2])
            if not len(left) or not len(right):
                continue
            joined = np.array([near.find(c) for c in comps], np.int64)
            for q, k in _proposed(points_, n, joined, left, right):
                if near.join(comps[q], comps[k]):
                    joined[joined == joined[k]] = joined[q]
                    out.append((comps[q], comps[k]))
        cols = list(zip(*out, strict=True)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _links_within(docs: DataFrame, members: DataFrame, parts: int) -> DataFrame:
    """Links (``a``, ``b``) between components of one canopy: the R-tree proposes, sets decide, and pairs already joined are passed over.

    ``members``: ``doc_id``, ``comp``, ``canopy``. Each task returns a spanning forest of its links.
    """
    sizes = members.groupBy("canopy").agg(F.ceil(F.count("*") / CANOPY_TILE).cast("int").alias("tiles"))
    wanted = stored(docs.sparkSession, members.join(sizes.hint("merge"), "canopy"), "ngram-members")

    def build(batches):
        for b in batches:
            s = [shingles(t).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.binary()), *(b.column(i) for i in range(2, 5))], ["doc_id", "s", "comp", "canopy", "tiles"])

    held = _with_text(docs, wanted).select("doc_id", "text", "comp", "canopy", "tiles").mapInArrow(build, "doc_id long, s binary, comp long, canopy long, tiles int")
    dealt = _tiled(held, "canopy", "doc_id", "comp", "s").repartition(parts, "canopy", "i", "j").sortWithinPartitions("canopy", "i", "j")

    def run(batches):
        for rows in _groups(batches, 3, 7):
            yield _forest([r[5] for r in rows], [np.frombuffer(r[6], np.uint64) for r in rows], *_sides(np.array([r[3] for r in rows]), rows[0][1], rows[0][2]))

    return dealt.mapInArrow(run, "a long, b long")


def connect(spark: SparkSession, links: DataFrame) -> DataFrame:
    """Components of ``links`` (``a``, ``b``) by alternating large and small stars: ``doc_id``, ``comp`` (smallest identifier); nodes without links are left out."""
    edges = stored(spark, links.where("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct(), "ngram-edges")
    before = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("m").alias("y")), F.struct(F.col("v").alias("x"), F.col("m").alias("y")))).alias("e")).select(F.col("e.x").alias("u"), F.col("e.y").alias("v")).where("u <> v").distinct()
        last, edges = edges, stored(spark, small, "ngram-edges")
        spent(last)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    out = stored(spark, edges.select(F.col("u").alias("doc_id"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("doc_id"), F.col("v").alias("comp")).distinct()), "ngram-components")
    spent(edges)
    return out


def components(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = shuffle_partitions(spark)
    base = stored(spark, sets(docs), "ngram-sets")
    # Written, so that the joins by print exchange plain rows, of which Spark can split a hot one.
    classes = stored(spark, base.where("print is not null and doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("rep")), "ngram-classes")
    blocks = stored(spark, _blocks(base, parts), "ngram-blocks")
    # Equal sets met in different tasks are linked without looking.
    same = base.where("keys is not null").select("doc_id", "print").join(classes.hint("merge"), "print").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    stars = blocks.where("doc_id <> head").groupBy("doc_id", "head").agg(F.count("*").alias("k")).groupBy("doc_id").agg(F.max_by("head", F.struct("k", -F.col("head"))).alias("head"))
    pairs, more = stars.select(F.col("doc_id").alias("a"), F.col("head").alias("b")), _unblocked(base)
    links = stored(spark, verify(docs, pairs.unionByName(more) if more else pairs, parts).unionByName(same), "ngram-links")
    comp = connect(spark, links)
    mixed = _mixed(blocks, comp)
    spent(blocks)
    near = stored(spark, _canopies(base, mixed, parts), "ngram-near")
    if not near.isEmpty():
        canopy = connect(spark, near).withColumnRenamed("doc_id", "comp_").withColumnRenamed("comp", "canopy")
        members = mixed.select("doc_id", "comp").distinct().join(canopy.hint("merge"), F.col("comp") == F.col("comp_")).select("doc_id", "comp", "canopy")
        more = stored(spark, links.unionByName(_links_within(docs, members, parts)), "ngram-links")
        spent(comp, links)
        comp, links = connect(spark, more), more
    spent(near, mixed, links)
    out = base.select("doc_id", F.col("n").alias("n_shingles"), "print").join(classes.hint("merge"), "print", "left").join(comp.select(F.col("doc_id").alias("rep"), "comp").hint("merge"), "rep", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "rep", "doc_id")).alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that are not the first, by identifier, of their component."""
    found = components(docs)
    return without(docs, found.where("component_id <> doc_id").select("doc_id"), {"doc_id": docs["doc_id"].cast("long")})
