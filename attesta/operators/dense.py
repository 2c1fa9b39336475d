"""Dense retrieval: normalisation, exact cosine top-k, max-pooling by article, centring.

Vectors are multiplied in Arrow batches: each batch of passages meets a block of the queries tile by tile, and a task
keeps its best per query, and only those candidates are shuffled. Nothing of size queries x passages is ever a row,
and neither a block, a tile nor what a task keeps grows with the tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values (queries x dimensions) of the block of queries that travels with the tasks.
MAX_QUERY_VALUES = 4_000_000
#: Scores of one matrix product.
TILE = 2_000_000
DEPTH = 50


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def normalise(v: Column) -> Column:
    """Unit length; a norm below 1e-12 counts as that."""
    return F.transform(v, lambda x: x / F.greatest(norm(v), F.lit(1e-12)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def mean_vector(vectors: DataFrame) -> DataFrame:
    """One row ``mean``: the average of ``v``."""
    each = vectors.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"))
    return each.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s.m).alias("mean"))


def centred(vectors: DataFrame, mean: DataFrame) -> DataFrame:
    """``v`` minus the mean, renormalised; the same mean serves queries and passages."""
    placed = vectors.withColumn("__mean", mean.select("mean").scalar())
    return placed.withColumn("v", F.zip_with("v", "__mean", lambda x, m: x - m)).withColumn("v", normalise(F.col("v"))).drop("__mean")


def _query_blocks(queries: DataFrame) -> list[DataFrame]:
    """The queries in blocks of about ``MAX_QUERY_VALUES`` values: what travels with the tasks stays bounded, and every block meets all passages."""
    size = queries.agg(F.sum(F.size("v"))).first()[0] or 0
    blocks = -(-size // MAX_QUERY_VALUES)
    if blocks <= 1:
        return [queries]
    return [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) for i in range(blocks)]


def _query_matrix(queries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = queries.select("query_id", "v").orderBy("query_id").collect()
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float)


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column, all of one size, straight from its values."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _cut(found: tuple[np.ndarray, ...], depth: int, digits: int, unique: bool) -> tuple[np.ndarray, ...]:
    """Of each query (places in its block) the ``depth`` best names, ties by name; ``unique``: a name counts once, at its best."""
    place, names, scores = found
    if unique:
        order = np.lexsort((-scores, names, place))
        place, names, scores = place[order], names[order], scores[order]
        first = np.r_[True, (place[1:] != place[:-1]) | (names[1:] != names[:-1])] if len(place) else np.zeros(0, bool)
        place, names, scores = place[first], names[first], scores[first]
    order = np.lexsort((names, -np.round(scores, digits), place))
    place, names, scores = place[order], names[order], scores[order]
    starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.zeros(0, np.int64)
    rank = np.arange(len(place)) - np.repeat(starts, np.diff(np.r_[starts, len(place)]))
    kept = rank < depth
    return place[kept], names[kept], scores[kept]


def _pool(names: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximum of the columns of each name."""
    order = np.argsort(names, kind="stable")
    names, starts = np.unique(names[order], return_index=True)
    return names, np.maximum.reduceat(scores[:, order], starts, axis=1)


def _scan(passages: DataFrame, name: str, queries: DataFrame, depth: int, digits: int, pool: bool) -> DataFrame:
    """``query_id``, ``doc_id`` (``name``), ``score``: of every task and query the ``depth`` best. No name outside a task's best can be among the best of all."""
    rows, out = passages.select(F.col(name).cast("long").alias("name"), F.col("v").cast("array<double>").alias("v")).where("v is not null"), None
    near = 2 * 10.0**-digits
    for block in _query_blocks(queries):
        ids, q = _query_matrix(block)

        def run(batches, ids=ids, q=q, depth=depth, digits=digits, pool=pool, near=near, tile=TILE):
            best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            floor = np.full(len(ids), -np.inf)  # what a score must reach nearly: a query's depth-th best so far
            for b in batches:
                if not (b.num_rows and len(ids)):
                    continue
                all_names, m, found = b.column(0).to_numpy(zero_copy_only=False), _matrix(b.column(1)).T, [best]
                step = max(1, tile // b.num_rows)
                for at in range(0, len(ids), step):
                    names, scores = all_names, q[at : at + step] @ m
                    if pool:
                        names, scores = _pool(names, scores)
                    low = floor[at : at + step]
                    if scores.shape[1] > depth and np.isneginf(low).any():
                        low = np.maximum(low, np.partition(scores, -depth, axis=1)[:, -depth])
                    i, j = np.nonzero(scores >= (low - near)[:, None])
                    piece = (i + at, names[j], scores[i, j])
                    found.append(_cut(piece, depth, digits, pool))
                best = _cut(tuple(map(np.concatenate, zip(*found, strict=True))), depth, digits, pool)
                full = np.bincount(best[0], minlength=len(ids)) >= depth
                worst = np.full(len(ids), np.inf)
                np.minimum.at(worst, best[0], best[2])
                floor = np.where(full, worst, -np.inf)
            if len(best[0]):
                yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]]), pa.array(best[1]), pa.array(best[2])], ["query_id", "doc_id", "score"])

        part = rows.mapInArrow(run, "query_id long, doc_id long, score double")
        out = part if out is None else out.unionByName(part)
    return out


def cosine(passages: DataFrame, queries: DataFrame, depth: int = DEPTH, digits: int = 6) -> DataFrame:
    """``query_id``, ``doc_id``, ``score``: for each query a superset of its ``depth`` best passages (``doc_id``, ``v``), ties by identifier.

    Each task drops what cannot be among the best ``depth``; the exact cut is one window over what is left.
    """
    return _scan(passages, "doc_id", queries, depth, digits, False).select("query_id", "doc_id", F.round("score", digits).alias("score"))


def pooled(scores: DataFrame, article: DataFrame) -> DataFrame:
    """Best passage per article: ``article`` maps ``doc_id`` to ``numero``."""
    return scores.join(article, "doc_id").groupBy("query_id", F.col("numero").alias("doc_id")).agg(F.max("score").alias("score"))


def pooled_cosine(passages: DataFrame, queries: DataFrame, depth: int = DEPTH, digits: int = 6) -> DataFrame:
    """Maximum over the passages of each article (``numero``): for each query a superset of its ``depth`` best articles.

    A task pools its passages and sends its best articles only: the task that holds a best article's best passage
    ranks it at least as high as all tasks together do.
    """
    return _scan(passages, "numero", queries, depth, digits, True).groupBy("query_id", "doc_id").agg(F.round(F.max("score"), digits).alias("score"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Largest absolute difference and mean absolute component of two versions of the same vectors (``doc_id``, ``v``)."""
    pair = a.select("doc_id", F.col("v").alias("x")).join(b.select("doc_id", F.col("v").alias("y")), "doc_id")
    each = pair.select(F.explode(F.arrays_zip("x", "y")).alias("p"))
    return each.agg(F.round(F.max(F.abs(F.col("p.x") - F.col("p.y"))), 9).alias("max_abs"), F.round(F.avg(F.abs(F.col("p.x"))), 9).alias("mean_abs"))
