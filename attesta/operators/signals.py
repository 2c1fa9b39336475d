"""Confidence signals of a ranking, the decision to answer, and its sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import french_number

#: The default belongs to one embedding model; pass the one measured for yours.
PROXIMITY = 0.46
COVERAGE_FLOOR = 0.6


def ranked_list(ranking: DataFrame, name: str, k: int | None = None) -> DataFrame:
    """``query_id`` and the array ``name`` of identifiers in order of rank."""
    rows = ranking if k is None else ranking.where(F.col("rank") <= k)
    return rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda s: s.doc_id).alias(name))


def margin(first: Column, second: Column, n: Column, degenerate: float = 0.0) -> Column:
    """(s1 - s2) / s1; ``degenerate`` with fewer than two scores or a first one that is not positive."""
    return F.when((n < 2) | (first <= 0), F.lit(degenerate)).otherwise(F.try_divide(first - second, first))


def of_dense(queries: DataFrame, dense: DataFrame, degenerate: float = 0.0) -> DataFrame:
    """``proximity`` (0 for an empty ranking), ``margin``, ``gap``, ``mass3``, ``mass5`` per query, unrounded."""
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("score")))
    agg = dense.groupBy("query_id").agg(
        at(1).alias("s1"), at(2).alias("s2"), F.count("*").alias("n"), F.avg(F.when(F.col("rank") <= 3, F.col("score"))).alias("mass3"), F.avg(F.when(F.col("rank") <= 5, F.col("score"))).alias("mass5")
    )
    out = queries.select("query_id").join(agg, "query_id", "left")
    n = F.coalesce("n", F.lit(0))
    return out.select(
        "query_id",
        F.coalesce("s1", F.lit(0.0)).alias("proximity"),
        F.coalesce(margin(F.col("s1"), F.col("s2"), n, degenerate), F.lit(degenerate)).alias("margin"),
        F.coalesce(F.col("s1") - F.col("s2"), F.lit(0.0)).alias("gap"),
        F.coalesce("mass3", F.lit(0.0)).alias("mass3"),
        F.coalesce("mass5", F.lit(0.0)).alias("mass5"),
    )


def agreement(queries: DataFrame, dense: DataFrame, lexical: DataFrame, k: int = 5) -> DataFrame:
    """Number of documents that both arms have among their first ``k``."""
    both = dense.where(F.col("rank") <= k).select("query_id", "doc_id").join(lexical.where(F.col("rank") <= k).select("query_id", "doc_id"), ["query_id", "doc_id"])
    return queries.select("query_id").join(both.groupBy("query_id").agg(F.count("*").alias("agree")), "query_id", "left").select("query_id", F.coalesce("agree", F.lit(0)).alias("agree"))


def decide(proximity: Column, n_articles: Column, threshold: float = PROXIMITY) -> Column:
    """Answer only with articles and on the unrounded proximity."""
    return (n_articles > 0) & (proximity >= threshold)


def gated(ranking: DataFrame, queries: DataFrame, least_margin: float = 0.0, agreeing: DataFrame | None = None, degenerate: float = 1.0) -> DataFrame:
    """``ranking`` of the queries whose own margin reaches ``least_margin`` and, where given, whose arms agree (``agree`` above 0); a single result is sure of itself."""
    kept = of_dense(queries, ranking, degenerate).where(F.round("margin", 9) >= least_margin).select("query_id")
    if agreeing is not None:
        kept = kept.join(agreeing.where("agree > 0").select("query_id"), "query_id", "left_semi")
    return ranking.join(kept, "query_id", "left_semi")


def refusal(coverage: Column, agree: Column, unknown: Column, floor: float = COVERAGE_FLOOR) -> Column:
    """Reasons to refuse, joined; empty when there is none. ``unknown``: array of words."""
    few = F.when(coverage < floor, F.concat(F.lit("mots absents du Code du travail : "), F.array_join(unknown, ", ")))
    apart = F.when(agree == 0, F.lit("les deux methodes de recherche ne designent aucun article commun"))
    return F.array_join(F.array_compact(F.array(few, apart)), " ; ")


# Sentences shown to the user; %1$s head article, %2$s proximity, %3$s threshold.
NOTHING = "Aucun article du Code ne ressort de cette question : il n'y a pas de candidat à présenter."
WORDS_ONLY = "La recherche par le sens n'a rien rendu sur cette question : l'article %1$s ne vient que des mots qu'il partage avec elle, et rien ne le désigne comme la réponse."
NEAR = "L'article %1$s ressemble d'assez près à la question (proximité de %2$s, pour un seuil de %3$s)."
FAR = "Aucun article du Code ne ressemble d'assez près à cette question (au mieux %2$s, pour un seuil de %3$s) : l'article %1$s et les suivants sont des pistes, pas la réponse."
UNKNOWN = " Le Code ne connaît pas ces mots de la question : %1$s."


def explain(head: Column, head_arm: Column, proximity: Column, unknown: Column, threshold: float = PROXIMITY) -> Column:
    """The sentence for a decision; ``head`` null: no article. At most four unknown words are named."""
    say = lambda form: F.format_string(form, head, french_number(proximity), french_number(F.lit(threshold)))
    more = F.when(F.size(unknown) > 0, F.format_string(UNKNOWN, F.array_join(F.slice(unknown, 1, 4), ", "))).otherwise("")
    return F.when(head.isNull(), NOTHING).when(head_arm != "dense", say(WORDS_ONLY)).when(proximity >= threshold, say(NEAR)).otherwise(F.concat(say(FAR), more))
