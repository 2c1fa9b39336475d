"""Lexical retrieval: term statistics, Okapi BM25 and its variants, overlap floors, coverage.

Documents come as ``bags`` (``doc_id``, ``toks``), tokenized as they are read, or as a stored ``Index`` of them.
The query side is small and checked; its vocabulary prunes the exploded tokens before anything is
shuffled, so a batch of queries moves only the postings it needs. Scores are ranked on their rounded value
and the document's rank, since sums of shuffled partials may differ in the last bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Query terms beyond this many are joined by shuffle instead of being broadcast.
BROADCAST_TERMS = 500_000


@dataclass(frozen=True)
class Index:
    """A stored inverted index: ``postings`` (``term``, ``doc_id``, ``f``, ``dl``) and ``lengths`` (``doc_id``, ``dl``, empty documents included)."""

    postings: DataFrame
    lengths: DataFrame


@dataclass(frozen=True)
class Okapi:
    k1: float = 1.2
    b: float = 0.75
    title_weight: int = 2


PRODUCTION, WITNESS = Okapi(), Okapi(k1=1.5, title_weight=0)


def few(df: DataFrame, rows: int = BROADCAST_TERMS) -> bool:
    """Whether ``df`` has at most ``rows`` rows (counted)."""
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int = BROADCAST_TERMS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if few(df, rows) else df


def weighted_tokens(body: Column, title: Column | None, weight: int) -> Column:
    """Body tokens followed by the title's tokens ``weight`` times."""
    if title is None or weight <= 0:
        return body
    return F.concat(body, *([title] * weight))


def build_index(bags: DataFrame, path: str, parts: int = 0, pieces: Callable[[Column], Column] | None = None) -> None:
    """Write the index of ``bags`` in one pass over the texts, in ``parts`` buckets by document, as many as ``bags`` were dealt to by ``doc_id`` (0: they are dealt here). Each document adds a row under the empty term, which holds its length.

    ``bags`` may have a second bag ``title``, counted apart (``g``, ``tl``), so that one index serves every weight of the title. ``pieces`` cuts
    a word into terms: words are counted first, so repeats are cut once. A bucket holds whole documents: counting here and scoring later
    need no shuffle of postings, and what a task holds depends on ``parts`` only.
    """
    if not parts:
        parts = bags.sparkSession.sparkContext.defaultParallelism
        bags = bags.repartition(parts, "doc_id")
    title = F.col("title") if "title" in bags.columns else F.array().cast("array<string>")
    length = (lambda t: F.size(t)) if pieces is None else lambda t: F.aggregate(t, F.lit(0), lambda a, x: a + F.size(pieces(x)))
    # Lengths stand in a projection of their own: beside the generator they would be worked out, and the words copied, once a word.
    sized = bags.select("doc_id", F.size("toks").alias("n"), length(F.col("toks")).alias("dl"), length(title).alias("tl"), F.concat(F.array(F.lit("")), "toks", title).alias("all"))
    # Outer, though no bag is empty here: else Spark would infer a filter that tokenizes every text once more.
    dealt = sized.select("doc_id", "n", "dl", "tl", F.posexplode_outer("all").alias("p", "term"))
    of_title = F.col("p") > F.col("n")
    counted = dealt.groupBy("doc_id", "term").agg(F.count_if(~of_title).alias("f"), F.count_if(of_title).alias("g"), F.first("dl").alias("dl"), F.first("tl").alias("tl"))
    if pieces is not None:
        cut = F.when(F.col("term") == "", F.array(F.lit(""))).otherwise(pieces(F.col("term")))
        counted = counted.select("doc_id", "f", "g", "dl", "tl", F.explode(cut).alias("term")).groupBy("doc_id", "term").agg(F.sum("f").alias("f"), F.sum("g").alias("g"), F.first("dl").alias("dl"), F.first("tl").alias("tl"))
    rows = counted.select("term", "doc_id", F.col("f").cast("int").alias("f"), F.col("g").cast("int").alias("g"), "dl", "tl")
    rows.write.format("parquet").bucketBy(parts, "doc_id").option("path", path).mode("overwrite").saveAsTable(_table_of(path))


def _table_of(path: str) -> str:
    return "default.attesta_index_" + hashlib.sha256(path.encode()).hexdigest()[:24]


def open_index(spark: SparkSession, path: str, title_weight: int = 0) -> Index:
    """The index at ``path``, written in this session; a title's terms count ``title_weight`` times."""
    table = spark.table(_table_of(path))
    f, dl = F.col("f") + title_weight * F.col("g"), (F.col("dl") + title_weight * F.col("tl")).alias("dl")
    return Index(table.where("term > ''").select("term", "doc_id", f.cast("long").alias("f"), dl).where("f > 0"), table.where("term = ''").select("doc_id", dl))


def statistics(bags: DataFrame | Index) -> DataFrame:
    """One row: ``n`` documents (empty ones included) and their mean length ``avgdl``."""
    if isinstance(bags, Index):
        return bags.lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    return bags.agg(F.count("*").alias("n"), F.avg(F.size("toks")).alias("avgdl"))


def postings(bags: DataFrame | Index, vocabulary: DataFrame | None = None) -> DataFrame:
    """``doc_id``, ``term``, ``f`` and the document's length ``dl``; only terms of ``vocabulary`` where given."""
    if isinstance(bags, Index):
        kept = bags.postings if vocabulary is None else bags.postings.join(vocabulary, "term")
        return kept.select("doc_id", "term", "f", "dl")
    rows = bags.select("doc_id", F.size("toks").alias("dl"), "toks").select("doc_id", "dl", F.explode("toks").alias("term"))
    if vocabulary is not None:
        rows = rows.join(vocabulary, "term")
    return rows.groupBy("doc_id", "term").agg(F.count("*").alias("f"), F.first("dl").alias("dl"))


def document_frequency(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def idf_rsj(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def idf_classic(n: Column, df: Column) -> Column:
    return F.log(n / (1 + df))


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id``, ``term``, ``qtf``: multiplicity counts."""
    return queries.select("query_id", F.explode("toks").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def _weights(bags: DataFrame | Index, q: DataFrame, weight: Callable[[Column, Column], Column]) -> tuple[DataFrame, DataFrame]:
    """The postings to score, and ``q`` (one row a query and term) with ``idf`` of the terms that occur, marked for broadcast if ``q`` is small.

    Postings meet the weights once: none is shuffled by term, however frequent.
    """
    hint = F.broadcast if few(q) else lambda df: df
    vocabulary = hint(q.select("term").distinct())
    tf = postings(bags, vocabulary)
    n = statistics(bags).select("n").scalar()
    idf = document_frequency(tf).select("term", weight(n, F.col("df")).alias("idf"))
    return (postings(bags) if isinstance(bags, Index) else tf), hint(q.join(hint(idf), "term"))


def contributions(bags: DataFrame | Index, queries: DataFrame, okapi: Okapi = PRODUCTION) -> DataFrame:
    """``query_id``, ``doc_id``, ``term``, ``part``: what each query term adds to each document."""
    tf, weights = _weights(bags, query_terms(queries), idf_rsj)
    avgdl = statistics(bags).select("avgdl").scalar()
    share = F.col("f") * (okapi.k1 + 1) / (F.col("f") + okapi.k1 * (1 - okapi.b + okapi.b * F.col("dl") / avgdl))
    # Share per posting once, then the fan-out to queries.
    shared = tf.select("doc_id", "term", share.alias("share"))
    return shared.join(weights, "term").select("query_id", "doc_id", "term", (F.col("qtf") * (F.col("idf") * F.col("share"))).alias("part"))


def bm25(bags: DataFrame | Index, queries: DataFrame, okapi: Okapi = PRODUCTION, digits: int = 6) -> DataFrame:
    """``query_id``, ``doc_id``, ``score`` (rounded), positive scores only."""
    parts = contributions(bags, queries, okapi)
    return parts.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), digits).alias("score")).where("score > 0")


def top(scored: DataFrame, k: int, tie: str = "doc_id") -> DataFrame:
    """The first ``k`` of each query by score, then ``tie``, with ``rank``."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(tie))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def coverage(bags: DataFrame | Index, queries: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``query_id``, ``n_terms`` and ``n_known`` (distinct), ``coverage`` (0 without terms), ``unknown`` (sorted). ``known``: the terms that occur, where they have been found already."""
    q = query_terms(queries).select("query_id", "term")
    hint = F.broadcast if few(q) else lambda df: df
    known = (postings(bags, hint(q.select("term").distinct())).select("term").distinct() if known is None else known).withColumn("known", F.lit(1))
    per = q.join(hint(known), "term", "left").groupBy("query_id").agg(
        F.count("*").alias("n_terms"), F.count("known").alias("n_known"), F.array_sort(F.collect_list(F.when(F.col("known").isNull(), F.col("term")))).alias("unknown")
    )
    return queries.select("query_id").join(per, "query_id", "left").select(
        "query_id",
        F.coalesce("n_terms", F.lit(0)).alias("n_terms"),
        F.coalesce("n_known", F.lit(0)).alias("n_known"),
        F.coalesce(F.round(F.col("n_known") / F.col("n_terms"), 3), F.lit(0.0)).alias("coverage"),
        F.coalesce("unknown", F.array().cast("array<string>")).alias("unknown"),
    )


def saturation(bags: DataFrame | Index, queries: DataFrame, okapi: Okapi = PRODUCTION) -> DataFrame:
    """``query_id``, ``first``, ``second``, ``margin`` and ``saturation`` (best score over the idf mass of known terms)."""
    q = query_terms(queries).select("query_id", "term")
    _, weights = _weights(bags, q, idf_rsj)
    return saturated(top(bm25(bags, queries, okapi), 2), weights.groupBy("query_id").agg(F.sum("idf").alias("mass")))


def saturated(ranked: DataFrame, mass: DataFrame) -> DataFrame:
    """``saturation`` from the first two of every query and its idf mass."""
    best = ranked.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("first"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0.0)).alias("second"))
    return best.join(mass, "query_id").select("query_id", "first", "second", F.round(F.try_divide(F.col("first") - F.col("second"), F.col("first")), 3).alias("margin"), F.round(F.try_divide("first", "mass"), 3).alias("saturation"))


def overlap(bags: DataFrame | Index, queries: DataFrame) -> DataFrame:
    """Word-overlap floor: number of distinct shared words."""
    q = small(query_terms(queries).select("query_id", "term"))
    tf = postings(bags) if isinstance(bags, Index) else postings(bags, small(q.select("term").distinct()))
    return tf.select("doc_id", "term").join(q, "term").groupBy("query_id", "doc_id").agg(F.count("*").cast("double").alias("score"))


def idf_overlap(bags: DataFrame | Index, queries: DataFrame, digits: int = 6) -> DataFrame:
    """Idf-overlap floor: classic idf of the distinct shared words, positive sums only."""
    tf, weights = _weights(bags, query_terms(queries).select("query_id", "term"), idf_classic)
    return tf.select("doc_id", "term").join(weights, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum("idf"), digits).alias("score")).where("score > 0")


def expand(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Query tokens with the synonyms of their words appended, never removed (``synonyms``: ``term``, ``more`` array)."""
    extra = queries.select("query_id", F.explode(F.array_distinct("toks")).alias("term")).join(small(synonyms), "term").groupBy("query_id").agg(F.array_sort(F.flatten(F.collect_list("more"))).alias("more"))
    return queries.join(extra, "query_id", "left").select("query_id", F.concat("toks", F.coalesce("more", F.array().cast("array<string>"))).alias("toks"))


def mute(queries: DataFrame) -> DataFrame:
    """The retriever that returns nothing, in the form of a ranking."""
    return queries.where("false").select("query_id", F.lit(0).cast("long").alias("doc_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
