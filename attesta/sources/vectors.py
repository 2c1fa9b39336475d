"""Sealed vector index: vectors with metadata, refused when they do not belong to the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class IndexRefused(ValueError):
    """The stored index is missing, stale or malformed."""


def fingerprint(passages: DataFrame, order: str, text: str) -> DataFrame:
    """One row, ``fingerprint`` and ``n``: SHA-256 over the passages in order, NUL between parts.

    A digest of an ordered concatenation is sequential by nature: this seals one index's corpus, which
    fits a task; :func:`tree_fingerprint` seals any size.
    """
    parts = passages.select(F.struct(F.col(order).alias("k"), F.concat(F.col(order).cast("string"), F.lit("\x00"), F.col(text)).alias("t")).alias("p"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p.t), "\x00")
    return parts.agg(F.sha2(whole.cast("binary"), 256).alias("fingerprint"), F.count("*").alias("n"))


def tree_fingerprint(passages: DataFrame, order: str, text: str, width: int = 4096) -> DataFrame:
    """Order-independent in layout and bounded per task: digests of passages, of buckets of them, then of the buckets."""
    each = passages.select(F.pmod(F.col(order), F.lit(width)).cast("long").alias("bucket"), F.sha2(F.concat(F.col(order).cast("string"), F.lit("\x00"), F.col(text)).cast("binary"), 256).alias("h"))
    buckets = each.groupBy("bucket").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "").cast("binary"), 256).alias("h"), F.count("*").alias("n"))
    return buckets.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "h"))), lambda p: p.h), "").cast("binary"), 256).alias("fingerprint"), F.sum("n").alias("n"))


def write_index(vectors: DataFrame, seal: str, path: str, model: str, prefix: str = "") -> None:
    """``vectors`` (``numero``, ``v``) and one metadata row beside them."""
    spark = vectors.sparkSession
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    shape = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    spark.createDataFrame([(model, seal, shape.n, shape.d or 0, prefix)], "model string, fingerprint string, passages long, dimension int, prefix string").write.mode("overwrite").json(f"{path}/meta")


def read_index(spark: SparkSession, path: str, seal: str, model: str) -> DataFrame:
    """The vectors, if their seal, model and count agree with the metadata."""
    try:
        meta = spark.read.schema("model string, fingerprint string, passages long, dimension int, prefix string").json(f"{path}/meta").first()
    except Exception as e:
        raise IndexRefused(f"no index at {path}") from e
    if meta is None or meta.fingerprint != seal:
        raise IndexRefused("the index was built from another corpus")
    if meta.model != model:
        raise IndexRefused(f"the index was built with {meta.model}")
    vectors = spark.read.parquet(f"{path}/vectors")
    if vectors.count() != meta.passages:
        raise IndexRefused("identifiers and vectors differ in number")
    return vectors


#: Session setting that overrides where an index lies.
PATH_SETTING = "spark.attesta.index.path"


def index_path(spark: SparkSession, default: str) -> str:
    """Where the index lies: as the session's setting says, else ``default``."""
    return (spark.conf.get(PATH_SETTING, "") or default).rstrip("/")


# Models with the prefixes their queries and passages take, as their authors publish them.
PREFIXES = {
    "google/embeddinggemma-300m": ("task: search result | query: ", "title: none | text: "),
    "intfloat/multilingual-e5-large": ("query: ", "passage: "),
    "minishlab/potion-multilingual-128M": ("", ""),
    "sentence-transformers/paraphrase-multilingual-MiniLM-L12-v2": ("", ""),
}


def prefixed(text: Column, model: str, query: bool) -> Column:
    """What a model is given: its prefix for the role, then the text."""
    if model not in PREFIXES:
        raise KeyError(f"no prefixes registered for {model}")
    return F.concat(F.lit(PREFIXES[model][0 if query else 1]), text)


def adopt(vectors: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Existing vectors, if all have unit norm within ``tolerance``."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    if not vectors.where(F.abs(norm - 1) > tolerance).isEmpty():
        raise IndexRefused("vectors are not of unit norm")
    return vectors


def cached_vectors(spark: SparkSession, root: str, key: tuple[str, bool, int | None], build) -> DataFrame:
    """Vectors of a (model, header, cut) configuration: read if stored, else built and stored."""
    path = f"{root}/model={key[0]}/header={key[1]}/cut={key[2]}"
    try:
        return spark.read.parquet(path)
    except Exception:
        build().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
