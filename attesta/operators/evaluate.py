"""Retrieval metrics over one row a question: ``want`` and ``got`` (identifiers, ``got`` in order, empty when silent).

An undefined metric is null, and silence on an answerable question is recall 0. Counts accompany every rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUTS = (1, 3, 5)


def returned(ids: Column, k: int) -> Column:
    """First occurrences kept, then cut at ``k``."""
    return F.slice(F.array_distinct(ids), 1, k)


def recall(got: Column, want: Column, k: int) -> Column:
    return F.when(F.size(want) > 0, F.size(F.array_intersect(F.slice(got, 1, k), want)) / F.size(want))


def hit(got: Column, want: Column, k: int) -> Column:
    return F.when(F.size(want) > 0, F.coalesce(F.arrays_overlap(F.slice(got, 1, k), want), F.lit(False)).cast("int"))


def recall_report(rows: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """Macro recall and hit rate at each cut, with the questions found in full and not at all."""
    got, want = F.col("got"), F.col("want")
    out = [F.sum((F.size(want) > 0).cast("int")).alias("n_answerable"), F.count("*").alias("n")]
    for k in cuts:
        r, t = recall(got, want, k), hit(got, want, k)
        out += [F.round(F.avg(r), 6).alias(f"recall{k}"), F.round(F.avg(t), 6).alias(f"hit{k}"), F.count_if(r == 1).alias(f"all{k}"), F.count_if(t == 0).alias(f"none{k}")]
    return rows.agg(*out)


def abstention_report(rows: DataFrame) -> DataFrame:
    """Silence and noise on foreign questions, evasion on answerable ones."""
    foreign, silent = F.size("want") == 0, (F.size("got") == 0).cast("int")
    return rows.agg(
        F.count_if(foreign).alias("n_foreign"),
        F.round(F.avg(F.when(foreign, silent)), 6).alias("abstention"),
        F.round(F.avg(F.when(foreign, F.size("got"))), 6).alias("noise"),
        F.count_if(~foreign).alias("n_answerable"),
        F.round(F.avg(F.when(~foreign, silent)), 6).alias("evasion"),
    )


def by_label(rows: DataFrame, k: int = 5) -> DataFrame:
    """Recall and silence by label and half, by label, and in total."""
    base = rows.select("label", "half", recall(F.col("got"), F.col("want"), k).alias("r"), (F.size("got") == 0).cast("int").alias("s"))
    sets = base.groupingSets([["label", "half"], ["label"], []], "label", "half")
    return sets.agg(F.count("*").alias("n"), F.round(F.avg("r"), 6).alias(f"recall{k}"), F.round(F.avg("s"), 6).alias("silence")).withColumns({"label": F.coalesce("label", F.lit("total")), "half": F.coalesce("half", F.lit("tous"))})


def misses(rows: DataFrame, k: int = 5) -> DataFrame:
    """Answerable questions of which nothing expected is returned: ``query_id``, ``label``, ``want``, ``got``."""
    return rows.where(hit(F.col("got"), F.col("want"), k) == 0).select("query_id", "label", "want", "got")


def set_sizes(rows: DataFrame) -> DataFrame:
    """One row: questions, answerable and foreign ones, and expected identifiers, all and distinct."""
    own = F.size("want") > 0
    return rows.agg(F.count("*").alias("n"), F.count_if(own).alias("answerable"), F.count_if(~own).alias("foreign"), F.sum(F.size("want")).alias("n_expected"), F.size(F.array_distinct(F.flatten(F.collect_set("want")))).cast("long").alias("n_distinct"))


def service(rows: DataFrame, accepted: Column) -> DataFrame:
    """One row: share of answerable questions served, accuracy at 1 and 3 among those (null without any), absolute numbers, and silence on foreign ones."""
    own = F.size("want") > 0
    speaks = own & accepted
    right = lambda k: speaks & (hit(F.col("got"), F.col("want"), k) == 1)
    return rows.agg(
        F.round(F.try_divide(F.count_if(speaks), F.count_if(own)), 6).alias("service"), F.round(F.try_divide(F.count_if(right(1)), F.count_if(speaks)), 6).alias("accuracy1"), F.round(F.try_divide(F.count_if(right(3)), F.count_if(speaks)), 6).alias("accuracy3"),
        F.count_if(right(1)).alias("useful1"), F.count_if(right(3)).alias("useful3"), F.count_if(speaks).alias("spoken"),
        F.round(F.try_divide(F.count_if(~own & ~accepted), F.count_if(~own)), 6).alias("abstention"), F.count_if(~own & ~accepted).alias("foreign_refused"), F.count_if(own & ~accepted).alias("falsely_refused"),
    )


def traps(ranking: DataFrame, decoys: DataFrame, expected: DataFrame) -> DataFrame:
    """``query_id``, ``trapped`` (the first answer is the declared decoy), ``right_rank`` (place of the first expected one; null: not returned). ``decoys``: ``query_id``, ``decoy``."""
    first = ranking.where("rank = 1").select("query_id", F.col("doc_id").alias("head"))
    right = ranking.join(expected, ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("right_rank"))
    return decoys.join(first, "query_id", "left").join(right, "query_id", "left").select("query_id", F.coalesce(F.col("head") == F.col("decoy"), F.lit(False)).alias("trapped"), "right_rank")


def displacement(pairs: DataFrame, rankings: DataFrame) -> DataFrame:
    """For pairs (``a``, ``b``): same first three, documents in common at 3 and 5; pairs silent on both sides are left out."""
    none = F.array().cast("array<bigint>")
    x, y = rankings.select(F.col("query_id").alias("a"), F.col("got").alias("ga")), rankings.select(F.col("query_id").alias("b"), F.col("got").alias("gb"))
    both = pairs.join(x, "a", "left").join(y, "b", "left").withColumns({"ga": F.coalesce("ga", none), "gb": F.coalesce("gb", none)}).where(F.size("ga") + F.size("gb") > 0)
    cut = lambda c, k: F.slice(c, 1, k)
    return both.select("a", "b", (cut("ga", 3) == cut("gb", 3)).alias("same_top3"), F.size(F.array_intersect(cut("ga", 3), cut("gb", 3))).alias("common3"), F.size(F.array_intersect(cut("ga", 5), cut("gb", 5))).alias("common5"))
