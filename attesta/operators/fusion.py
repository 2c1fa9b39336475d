"""Fusion of rankings. A ranking has ``query_id``, ``doc_id``, ``score``, ``rank``; arms are united and grouped once per query and document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.operators.lexical import top

ABSENT_RANK = 1_000_000
RRF_K = 60


def stack(*arms: DataFrame) -> DataFrame:
    """The arms as one table with ``arm`` (0, 1, ...)."""
    return reduce(DataFrame.unionByName, [a.select("query_id", "doc_id", "score", "rank", F.lit(i).alias("arm")) for i, a in enumerate(arms)])


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("tie"), F.asc("doc_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("tie")


def rrf(*arms: DataFrame, k: int = 5, constant: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion; ties by the first arm's rank. Also returns each of the first two arms' ranks."""
    place = lambda i: F.max(F.when(F.col("arm") == i, F.col("rank")))
    scored = stack(*arms).groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("score"), place(0).alias("rank_first"), place(1).alias("rank_second"))
    return _ranked(scored.withColumn("tie", F.coalesce("rank_first", F.lit(ABSENT_RANK))), k)


def min_max(*arms: DataFrame, k: int = 5) -> DataFrame:
    """Sum of scores scaled to [0, 1] within query and arm; a range of zero scales to 1."""
    w = Window.partitionBy("query_id", "arm")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    scaled = stack(*arms).withColumn("scaled", F.when(hi <= lo, 1.0).otherwise(F.try_divide(F.col("score") - lo, hi - lo)))
    scored = scaled.groupBy("query_id", "doc_id").agg(F.round(F.sum("scaled"), 6).alias("score"), F.max(F.when(F.col("arm") == 0, F.col("rank"))).alias("rank_first"))
    return _ranked(scored.withColumn("tie", F.coalesce("rank_first", F.lit(ABSENT_RANK))).drop("rank_first"), k)


def compose(dense: DataFrame, lexical: DataFrame, k: int = 5, head: int = 3, complete: bool = True) -> DataFrame:
    """Dense head, lexical tail, then the rest of the dense arm; a document counts once, at its first place. ``arm`` says where it came from."""
    first = F.col("rank") <= min(head, k)
    parts = [dense.where(first).withColumn("prio", F.lit(0)).withColumn("arm", F.lit("dense")), lexical.withColumn("prio", F.lit(1)).withColumn("arm", F.lit("lexical"))]
    if complete:
        parts.append(dense.where(~first).withColumn("prio", F.lit(2)).withColumn("arm", F.lit("dense")))
    rows = reduce(DataFrame.unionByName, [p.select("query_id", "doc_id", "score", "rank", "prio", "arm") for p in parts])
    best = rows.groupBy("query_id", "doc_id").agg(F.min(F.struct("prio", "rank", "score", "arm")).alias("b"))
    order = Window.partitionBy("query_id").orderBy("prio", "rank")
    flat = best.select("query_id", "doc_id", F.col("b.prio").alias("prio"), F.col("b.rank").alias("rank"), F.col("b.score").alias("score"), F.col("b.arm").alias("arm"))
    return flat.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query_id", "doc_id", "score", "arm", F.col("place").alias("rank"))


def first_ranks(ranking: DataFrame, expected: DataFrame) -> DataFrame:
    """``query_id``, ``first_rank``: place of the first expected document, for queries that find one."""
    return ranking.join(expected, ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("first_rank"))


def best_arm(a: DataFrame, b: DataFrame, expected: DataFrame, name_a: str = "lexical", name_b: str = "dense") -> DataFrame:
    """The better place of either arm, as an oracle that always chose right would get."""
    x, y = first_ranks(a, expected).withColumnRenamed("first_rank", f"rank_{name_a}"), first_ranks(b, expected).withColumnRenamed("first_rank", f"rank_{name_b}")
    return x.join(y, "query_id", "full").withColumn("rank_best", F.least(f"rank_{name_a}", f"rank_{name_b}"))


__all__ = ["ABSENT_RANK", "RRF_K", "best_arm", "compose", "first_ranks", "min_max", "rrf", "stack", "top"]
