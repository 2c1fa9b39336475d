"""Removal of byte strings that occur twice, by suffix arrays of shards with induced sorting.

Every byte covered by a ``LENGTH``-byte string that also starts anywhere else goes, in the same text or
another; strings are judged on the input. Texts are UTF-8 bytes; null counts as empty.

1. Equal texts are one unit with a count; a unit that occurs twice is removed whole if it is long enough.
2. A string of ``LENGTH`` bytes is named after the ``GRAM``-byte gram of least hash in it, so equal strings have equal names.
   Consecutive starts with equal names form a segment; each start lies in one segment only. Names that one segment
   alone bears, in which the gram stands once, cannot belong to a repeated string and go no further.
3. Segments of equal bytes are met by partial aggregation, not expanded: a segment that occurs twice repeats as a whole,
   and one of its places stands for all. Of names that segments of different bytes bear, one place of each goes,
   with its bytes, to the shard of its name; a name with very many goes to several tiles.
4. Each shard is suffix-sorted by induced sorting: suffixes are classified, the leftmost smaller
   substrings are sorted and named, the string of names is sorted in turn (by doubling, to the depth
   that ``LENGTH`` needs), and the rest is induced bucket by bucket with array operations. Permuted common
   prefixes with the neighbour in the suffix array, taken in text order and on the bytes themselves, give the repeats.
   Tiles of one name then exchange digests of their distinct strings.
5. Intervals return to their row, are merged and cut out.

Rows that repeat an identifier are separate texts; a null identifier is one as any other. Rows are found
again by a hash of identifier and text, and the text's digest is compared before anything is cut.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import shuffle_partitions, small_batches, spent, stored
from attesta.llm.ngram_join import _power, mix
from attesta.llm.url_filter import possible

LENGTH = 200
GRAM = 64
#: Bytes sorted at once, unless one name alone has more.
SHARD_BYTES = 2_000_000
#: Bytes of one name's segments in a tile.
TILE_BYTES = 8_000_000


def _extreme(x: np.ndarray, w: int, op) -> np.ndarray:
    """Sliding minimum or maximum over windows of ``w``."""
    n = len(x) - w + 1
    pad = -len(x) % w
    fill = x[-1:]
    rows = np.concatenate([x, np.repeat(fill, pad)]).reshape(-1, w)
    ahead = op.accumulate(rows, axis=1).reshape(-1)
    behind = op.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return op(behind[:n], ahead[w - 1 : w - 1 + n])


def segments(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of one text's segments: names, hashes of their bytes, first starts, numbers of starts, and whether the naming gram stands in them twice."""
    n = len(raw)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, bool)
    up, down = _power(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], out=prefix[1:])
    h = mix((prefix[gram:] - prefix[:-gram]) * down[: n - gram + 1])
    w = length - gram + 1
    least = _extreme(h, w, np.minimum)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    count = np.diff(np.append(first, len(least)))
    # The grams that are the least of some window, in text order: as many runs of equal ones as there are segments.
    edge = np.zeros(w - 1, np.uint64)
    top = _extreme(np.concatenate([edge, least, edge]), w, np.maximum)
    at = h[top == h]
    run = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    tied = np.diff(np.append(run, len(at))) > 1
    end = first + count + length - 1
    content = mix((prefix[end] - prefix[first]) * down[first] + (end - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return least[first].view(np.int64), content.view(np.int64), first.astype(np.int32), count.astype(np.int32), tied


_SEGMENT = pa.struct([("name", pa.int64()), ("content", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("tied", pa.bool_())])


def units(docs: DataFrame) -> DataFrame:
    """``row`` (a number), ``key`` (of identifier and text), ``doc_id``, ``sha``, ``n_bytes`` and, for the first of equal texts in a task, ``segments``."""
    schema = "key long, doc_id long, sha binary, n_bytes long, segments array<struct<name:long,content:long,start:int,n:int,tied:boolean>>"

    def run(batches):
        seen: set[bytes] = set()
        for b in batches:
            shas, sizes, ends, found = [], [], [0], []
            for t in b.column(2).to_pylist():
                raw = (t or "").encode("utf-8", "replace")
                sha = hashlib.sha256(raw).digest()
                shas.append(sha)
                sizes.append(len(raw))
                own = 0
                if len(raw) >= LENGTH and sha not in seen:
                    seen.add(sha)
                    found.append(segments(np.frombuffer(raw, np.uint8)))
                    own = len(found[-1][0])
                ends.append(ends[-1] + own)
            cols = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, k) for k in ("<i8", "<i8", "<i4", "<i4", "?")]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in cols], fields=list(_SEGMENT)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shas, pa.binary()), pa.array(sizes, pa.int64()), lists], ["key", "doc_id", "sha", "n_bytes", "segments"])

    return _keyed(docs).mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())


def _keyed(docs: DataFrame) -> DataFrame:
    own = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return own.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")


# --- suffix sorting -------------------------------------------------------------------------


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (S-type); the last symbol is the unique smallest."""
    n = len(t)
    rise = np.zeros(n, bool)
    rise[:-1] = t[:-1] < t[1:]
    differs = np.ones(n, bool)
    differs[:-1] = t[:-1] != t[1:]
    nxt = np.where(differs, np.arange(n), n)
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]
    s = rise[nxt]
    s[-1] = True
    return s


def _induce(t: np.ndarray, s: np.ndarray, sa: np.ndarray, ends: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Suffix order induced from ``lms`` (leftmost smaller suffixes in order). ``ends``: bucket bounds."""
    k = len(ends) - 1
    sa[:] = -1
    lms = lms[np.argsort(t[lms], kind="stable")]
    sym = t[lms]
    count = np.bincount(sym, minlength=k)
    tail = ends[1:] - count
    sa[tail[sym] + np.arange(len(lms)) - (np.cumsum(count) - count)[sym]] = lms
    head = ends[:-1].copy()
    used = np.flatnonzero(np.diff(ends))

    def spread(items: np.ndarray, want: bool, ptr: np.ndarray, sign: int) -> None:
        j = items[items > 0] - 1
        j = j[s[j] == want]
        if not len(j):
            return
        c = t[j]
        order = np.argsort(c, kind="stable")
        j, c = j[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        size = np.diff(np.append(first, len(c)))
        within = np.arange(len(c)) - np.repeat(first, size)
        sa[ptr[c] + sign * within - (sign < 0)] = j
        ptr[c[first]] += sign * size

    for c in used:
        done = ends[c]
        while done < head[c]:
            stop = head[c]
            spread(sa[done:stop].copy(), False, head, 1)
            done = stop
        spread(sa[tail[c] : ends[c + 1]].copy(), False, head, 1)
    bottom = ends[1:].copy()
    for c in used[::-1]:
        done = ends[c + 1]
        while bottom[c] < done:
            start = bottom[c]
            spread(sa[start:done][::-1].copy(), True, bottom, -1)
            done = start
        spread(sa[ends[c] : head[c]][::-1].copy(), True, bottom, -1)
    # The last symbol's suffix, the smallest of all, is preceded by none and stays first.
    sa[0] = len(t) - 1
    return sa


def _words(t: np.ndarray) -> np.ndarray:
    """Eight symbols at each position as one number (symbols below 2**16: four at a time)."""
    pad = np.concatenate([t.astype(np.uint64), np.zeros(4, np.uint64)])
    n = len(t)
    return (pad[:n] << np.uint64(48)) | (pad[1 : n + 1] << np.uint64(32)) | (pad[2 : n + 2] << np.uint64(16)) | pad[3 : n + 3]


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array of ``t`` (uint16, its last symbol 0 and nowhere else), right to ``depth`` symbols; deeper ties by place."""
    n = len(t)
    if n < 3:
        return np.arange(n)[::-1].copy()
    s = _types(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    ends = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=int(t.max()) + 1))])
    sa = np.empty(n, np.int64)
    if len(lms) > 1:
        _induce(t, s, sa, ends, lms)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        order = sa[is_lms[sa]]
        # Names: neighbours in order are equal substrings if symbols agree up to and with the next leftmost smaller place.
        nxt = np.empty(n, np.int64)
        nxt[lms] = np.append(lms[1:], n - 1)
        size = np.minimum(nxt[order] - order + 1, depth)
        w = _words(t)
        equal = size[1:] == size[:-1]
        at = np.flatnonzero(equal)
        off = 0
        while len(at):
            a, b, left = order[at] + off, order[at + 1] + off, size[at] - off
            x, y = w[a], w[b]
            cut = np.uint64(16) * np.clip(4 - left, 0, 3).astype(np.uint64)
            same = (x >> cut) == (y >> cut)
            equal[at[~same]] = False
            at = at[same & (left > 4)]
            off += 4
        name = np.cumsum(np.concatenate([[0], ~equal]))
        rank = np.empty(n, np.int64)
        rank[order] = name
        r = rank[lms]
        h = 1
        while r.max() + 1 < len(r) and 2 * h <= 2 * depth:
            nx = np.zeros(len(r), np.int64)
            nx[: len(r) - h] = r[h:] + 1
            key = r * (len(r) + 2) + nx
            by = np.argsort(key, kind="stable")
            key = key[by]
            new = np.empty(len(r), np.int64)
            new[by] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
            r, h = new, 2 * h
        lms = lms[np.argsort(r, kind="stable")]
    return _induce(t, s, sa, ends, lms)


def permuted_prefixes(t: np.ndarray, sa: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """For the places ``at``, in text order: symbols shared with the suffix that stands before in the array, ``depth`` at most."""
    n = len(t)
    before = np.empty(n, np.int64)
    before[sa[1:]], before[sa[0]] = sa[:-1], n - 1
    before = before[at]
    w, out, live = _words(t), np.zeros(len(at), np.int64), np.arange(len(at))
    for off in range(0, depth, 4):
        x, y = at[live] + off, before[live] + off
        inside = (x < n) & (y < n)
        live, x, y = live[inside], x[inside], y[inside]
        if not len(live):
            break
        differ = w[x] ^ w[y]
        out[live] += np.select([differ >> np.uint64(s) != 0 for s in (48, 32, 16, 0)], [0, 1, 2, 3], 4)
        live = live[differ == 0]
    return np.minimum(out, depth)


def repeats(texts: list[bytes], length: int = LENGTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the starts of its ``length``-byte strings that also start elsewhere in ``texts``, and those at which a string first stands in the suffix array."""
    sizes = np.array([len(x) for x in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    n = int((sizes + 1).sum()) + 1
    t = np.zeros(n, np.uint16)
    t[: n - 1] = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8).astype(np.uint16) + 1
    sa = suffix_array(t, length)
    whole = np.zeros(n, bool)
    whole[: n - 1] = (np.arange(n - 1) - np.repeat(starts, sizes + 1)) + length <= np.repeat(sizes, sizes + 1)
    at = np.flatnonzero(whole)
    joined = np.zeros(n + 1, bool)  # the suffix agrees with the one before it in the array, of a whole string too
    joined[at] = permuted_prefixes(t, sa, at, length) >= length
    rank = sa[whole[sa]]
    follows = joined[rank]
    hit, first = np.zeros(n, bool), np.zeros(n, bool)
    hit[rank] = follows | np.append(follows[1:], False)
    first[rank[~follows]] = True
    return [(np.flatnonzero(hit[a : a + m]), np.flatnonzero(first[a : a + m])) for a, m in zip(starts, sizes, strict=True)]


def spans_of(starts: np.ndarray, length: int = LENGTH) -> list[tuple[int, int]]:
    """Merged ranges covered by strings that begin at ``starts`` (sorted)."""
    if not len(starts):
        return []
    brk = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.concatenate([[0], brk + 1])].tolist(), (starts[np.append(brk, len(starts) - 1)] + length).tolist(), strict=True))


# --- the operator ------------------------------------------------------------------------------


def _with_text(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (stored; ``key``, ``sha`` and more) with the ``text``; texts that cannot be wanted are left out before the exchange."""
    return possible(_keyed(docs).select("key", "text"), wanted.select("key").distinct()).hint("merge").join(wanted, "key")


def _bytes_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``name``, ``tile``, ``tiles``, ``row``, ``start``, ``bytes``, ``twice`` of the segments in ``wanted``."""

    def run(batches):
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.bool_())
        for b in batches:
            out: list[tuple] = []
            for t, sha, row, own in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                raw = (t or "").encode("utf-8", "replace")
                if hashlib.sha256(raw).digest() == sha:
                    out.extend((s["name"], s["tile"], s["tiles"], row, s["start"], raw[s["start"] : s["start"] + s["n"] + LENGTH - 1], s["twice"]) for s in own)
            for i in range(0, len(out), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[i : i + 4096], strict=True), kinds, strict=True)], ["name", "tile", "tiles", "row", "start", "bytes", "twice"])

    return _with_text(docs, wanted).select("text", "sha", "row", "own").mapInArrow(run, "name long, tile int, tiles int, row long, start int, bytes binary, twice boolean")


def _shard(batches, most: int):
    """Intervals (``row``, ``lo``, ``hi``) from the segments of whole names or tiles; about ``most`` bytes are sorted at once.

    Rows with a ``digest`` (and a null ``hi``) are strings of names dealt to several tiles: each string that the tile holds once
    with its place, each other one without.
    """
    held: list[tuple] = []
    out: list[tuple] = []
    size = 0

    def sort() -> None:
        nonlocal size
        for (_, _, tiles, row, start, raw, twice), (starts, first) in zip(held, repeats([r[5] for r in held]), strict=True):
            if not twice:
                out.extend((row, start + a, start + b, None) for a, b in spans_of(starts))
            if tiles > 1:
                alone = set() if twice else {*first.tolist()} - {*starts.tolist()}
                for i in first.tolist():
                    own = hashlib.blake2b(raw[i : i + LENGTH], digest_size=16).digest()
                    out.append((row, start + i, None, own) if i in alone else (None, None, None, own))
        held.clear()
        size = 0

    def emit():
        for i in range(0, len(out), 8192):
            cols = zip(*out[i : i + 8192], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["row", "lo", "hi", "digest"])
        out.clear()

    last = None
    for b in batches:
        for r in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
            if r[:2] != last and size > most:
                sort()
                yield from emit()
            last = r[:2]
            held.append(r)
            size += len(r[5])
    if held:
        sort()
        yield from emit()


def intervals(docs: DataFrame, base: DataFrame, parts: int) -> DataFrame:
    """``row``, ``lo``, ``hi`` that cover the repeated strings of each row with segments."""
    spark, most = docs.sparkSession, SHARD_BYTES
    every = base.select("row", F.inline("segments"))
    # Per name one row a task: whether two segments bear it, and segments of different bytes.
    names = every.groupBy("name").agg(F.count("*").alias("m"), F.min("content").alias("lo"), F.max("content").alias("hi"), F.max("tied").alias("t")).where("m > 1 or t")
    live = stored(spark, every.join(names.select("name", F.expr("lo <> hi or t").alias("mixed")).hint("merge"), "name"), "suffix-live")
    kinds = stored(spark, live.groupBy("name", "content").agg(F.count("*").alias("m"), F.max("mixed").alias("mixed"), F.min(F.struct("row", "start", "n")).alias("at")), "suffix-kinds")
    whole = live.join(kinds.where("m > 1").select("name", "content").hint("merge"), ["name", "content"]).select("row", F.col("start").alias("lo"), (F.col("start") + F.col("n") + (LENGTH - 1)).alias("hi"))
    mixed = kinds.where("mixed")
    tiles = mixed.groupBy("name").agg(F.ceil(F.sum(F.col("at.n") + LENGTH) / TILE_BYTES).cast("int").alias("tiles"))
    dealt = mixed.join(tiles.hint("merge"), "name").withColumn("tile", F.pmod(F.xxhash64("content"), F.col("tiles")).cast("int"))
    own = dealt.groupBy(F.col("at.row").alias("row")).agg(F.collect_list(F.struct("name", "tile", "tiles", F.col("at.start").alias("start"), F.col("at.n").alias("n"), (F.col("m") > 1).alias("twice"))).alias("own"))
    wanted = stored(spark, own.hint("merge").join(base.select("row", "key", "sha"), "row"), "suffix-wanted")
    sorted_ = _bytes_of(docs, wanted).repartition(parts, "name", "tile").sortWithinPartitions("name", "tile").mapInArrow(lambda batches: _shard(batches, most), "row long, lo int, hi int, digest binary")
    found = stored(spark, sorted_, "suffix-found")
    shared = found.where("digest is not null").groupBy("digest").agg(F.count("*").alias("m")).where("m > 1").select("digest")
    across = found.where("row is not null").join(shared.hint("merge"), "digest").select("row", "lo", (F.col("lo") + LENGTH).alias("hi"))
    out = stored(spark, found.where("hi is not null").select("row", "lo", "hi").unionByName(whole).unionByName(across), "suffix-intervals")
    spent(live, kinds, wanted, found)
    return out


def cut(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(remaining bytes, bytes removed, runs removed) for any overlapping ranges."""
    out, done, gone, runs, end = [], 0, 0, 0, -1
    for lo, hi in sorted(spans):
        if lo > end:
            out.append(raw[done:lo])
            runs += 1
            gone += hi - lo
        elif hi > end:
            gone += hi - end
        end = max(end, hi)
        done = end
    return b"".join(out) + raw[max(done, 0) :], gone, runs


def report(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = shuffle_partitions(spark)
    base = stored(spark, units(docs), "suffix-units")
    copies = base.groupBy("sha").agg(F.count("*").alias("copies"))
    rows = stored(spark, base.select("row", "key", "doc_id", "sha", "n_bytes").join(copies.hint("merge"), "sha"), "suffix-rows")
    covered = intervals(docs, base, parts)
    spans = covered.groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    wanted = stored(spark, spans.hint("merge").join(rows.where("copies = 1").select("row", "key", "sha"), "row"), "suffix-spans")
    spent(base, covered)

    def run(batches):
        for b in batches:
            out = []
            for t, sha, row, own in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                raw = (t or "").encode("utf-8", "replace")
                if hashlib.sha256(raw).digest() == sha:
                    left, gone, runs = cut(raw, [(s["lo"], s["hi"]) for s in own])
                    out.append((row, gone, runs, hashlib.sha256(left).digest()))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["row", "gone", "runs", "left_sha"])

    done = _with_text(docs, wanted).select("text", "sha", "row", "spans").mapInArrow(run, "row long, gone long, runs long, left_sha binary")
    out = rows.join(done.hint("merge"), "row", "left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    empty = F.lit(hashlib.sha256(b"").digest())
    pick = lambda a, b, c: F.when(whole, a).otherwise(F.coalesce(F.col(b), c))
    return out.select("doc_id", "n_bytes", pick(F.col("n_bytes"), "gone", F.lit(0)).cast("long").alias("n_removed"), pick(F.lit(1), "runs", F.lit(0)).cast("long").alias("n_spans"), F.lower(F.hex(pick(empty, "left_sha", F.col("sha")))).alias("kept_sha256"))
