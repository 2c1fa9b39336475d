"""Exact deduplication over a stream with disk-backed keyed state; DataFrame functions only.

One pass over the texts writes a keyed table (identifier, size, digest of the normalised text, content
locator), which then streams in as files. For each digest (all characters of ``[\\x20\\x09-\\x0D]`` deleted) a state that never expires keeps the size of the group and the row that stays:
most code points in the original text, then the smallest identifier, together with a content locator
(file and row number). Each micro-batch sums up its own rows by digest, looks every digest up in the state as it stands, and
writes the values it changes as a layer of the state, in files of the shared folder beside the stream's
progress; so a restarted or moved task goes on where it was, and a replayed batch overwrites its layer. ``availableNow`` reads all that is there
in bounded micro-batches. (Spark's RocksDB store would do the same; it sets aside 4 MB of local disk for
every state partition, whatever the data.)

Digests that more than one row carries are hits, and their bytes are compared in full: texts of such digests are
grouped by the whole normalised text, beginning in each task, so that equal copies travel once a task and
no task gathers a hot group. A digest under which two texts are found (a collision) is settled by the text: the row that the state holds is
read by its locator, and rows that differ from it form groups of their own.

Null texts count as empty; all empty texts are one group. Rows that repeat an identifier and its text are
counted each, and are all marked as kept if it is the identifier that stays.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import shared_dir, stored
from attesta.llm.url_filter import possible, without

FILES_PER_BATCH = 65_536
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
STATE = "digest string, group_size long, keep_id long, keep_size int, locator string"


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def sha256(norm: Column) -> Column:
    return F.sha2(norm.cast("binary"), 256)


def located(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``size`` (code points of the original), ``norm`` and ``locator`` (file and row, where the rows come straight from files)."""
    where = F.concat_ws("#", "_metadata.file_path", F.col("_metadata.row_index").cast("string"))
    try:
        docs.select(where).schema  # noqa: B018  analysed here
    except AnalysisException:
        where = F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(F.coalesce("text", F.lit(""))).alias("size"), normalised(F.col("text")).alias("norm"), where.alias("locator"))


def keyed(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """``doc_id``, ``size``, ``digest`` and ``locator`` of every row."""
    return located(docs).select("doc_id", "size", digest(F.col("norm")).alias("digest"), "locator")


def _latest(layers: DataFrame) -> DataFrame:
    """The state: of each key the value of its last layer."""
    return layers.groupBy("digest").agg(F.max_by(F.struct("best", "group_size"), "batch").alias("v")).select("digest", "v.best", "v.group_size")


def stream_state(spark: SparkSession, keys_path: str, at: str) -> DataFrame:
    """Stream what is new in the keyed table into the state at ``at``; return every key's value (columns of ``STATE``)."""
    layers = f"{at}/layers"

    def add_layer(batch: DataFrame, number: int) -> None:
        own = F.struct("size", (-F.col("doc_id")).alias("minus_id"), "locator")
        fresh = batch.groupBy("digest").agg(F.max(own).alias("best"), F.count("*").alias("group_size"))
        if number:
            known = _latest(spark.read.parquet(layers).where(F.col("batch") < number)).select("digest", F.col("best").alias("was"), F.col("group_size").alias("n"))
            fresh = fresh.join(known, "digest", "left").select("digest", F.greatest("best", "was").alias("best"), (F.col("group_size") + F.coalesce("n", F.lit(0))).alias("group_size"))
        fresh.write.mode("overwrite").parquet(f"{layers}/batch={number}")

    source = spark.readStream.schema("doc_id long, size int, digest string, locator string").option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(keys_path)
    query = source.writeStream.option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).foreachBatch(add_layer).start()
    query.awaitTermination()
    root = spark._jvm.org.apache.hadoop.fs.Path(layers)
    if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        return spark.createDataFrame([], STATE)
    kept = spark.read.parquet(layers)
    state = _latest(kept) if kept.where("batch > 0").limit(1).count() else kept
    return state.select("digest", "group_size", (-F.col("best.minus_id")).alias("keep_id"), F.col("best.size").alias("keep_size"), F.col("best.locator").alias("locator"))


def differing(docs: DataFrame, state: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Rows whose bytes differ from those of the row that would stay: ``doc_id``, ``digest``, ``size``, ``norm``.

    Only texts whose digest may be shared travel: a blocked Bloom filter of the shared digests,
    of bounded size, stands before the exchange.
    """
    shared = state.where("group_size > 1").select("digest", "keep_id", F.col("locator").alias("keep_at"))
    rows = possible(located(docs).withColumn("key", digest(F.col("norm"))), shared.select(F.col("digest").alias("key"))).withColumnRenamed("key", "digest")
    texts = rows.groupBy("digest", "norm").agg(F.count("*").alias("n"))
    collisions = stored(docs.sparkSession, texts.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest"), "dedup-collisions")
    if collisions.isEmpty():
        return docs.sparkSession.createDataFrame([], "doc_id long, digest string, size int, norm string")
    hits = rows.join(shared.join(collisions, "digest"), "digest")
    held = F.when(F.col("keep_at").isNull(), F.col("doc_id") == F.col("keep_id")).otherwise(F.col("locator") == F.col("keep_at"))
    keepers = hits.where(held).groupBy("digest").agg(F.first("norm").alias("keep_norm"))
    return hits.join(keepers, "digest").where(F.col("norm") != F.col("keep_norm")).select("doc_id", "digest", "size", "norm")


def deduplicate(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``digest``, ``locator`` (of the row that stays) of every row."""
    spark = docs.sparkSession
    at = f"{shared_dir(spark)}/dedup-{uuid.uuid4().hex}"
    keyed(docs, digest).write.parquet(f"{at}/keys")
    keys = spark.read.parquet(f"{at}/keys")
    state = stream_state(spark, f"{at}/keys", at)
    odd = stored(spark, differing(docs, state, digest), "dedup-differing")
    out = keys.drop("locator").join(state, "digest")
    if odd.isEmpty():
        return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest", "locator")
    own = odd.groupBy("digest", "norm").agg(F.max(F.struct("size", (-F.col("doc_id")).alias("minus_id"))).alias("best"), F.count("*").alias("n"))
    moved = odd.join(own, ["digest", "norm"]).select("doc_id", "digest", (-F.col("best.minus_id")).alias("new_keep"), F.col("n").alias("new_size"))
    less = odd.groupBy("digest").agg(F.count("*").alias("gone"))
    out = out.join(moved.dropDuplicates(["doc_id", "digest"]), ["doc_id", "digest"], "left").join(less, "digest", "left")
    keep = F.coalesce("new_keep", "keep_id")
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce(F.col("new_size"), F.col("group_size") - F.coalesce("gone", F.lit(0))).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "digest", F.when(F.col("new_keep").isNull(), F.col("locator")).alias("locator"))


def unique(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, columns as they were."""
    gone = deduplicate(docs).where("not kept").select("doc_id", "digest")
    return without(docs, gone, {"doc_id": docs["doc_id"].cast("long"), "digest": sha256(normalised(docs["text"]))})


def sql() -> str:
    """The result of the query as SQL for the oracle."""
    return r"""
with n as (select doc_id, length(coalesce(text, '')) as size, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents),
g as (select norm, count(*) as group_size, arg_max(doc_id, (size, -doc_id)) as keep_id from n group by norm)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from n join g using (norm)"""
