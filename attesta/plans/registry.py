"""Plug-in retrievers and writers by name, comparison of retrievers, and the gates of an evaluation run."""

from __future__ import annotations

import importlib
import inspect
import statistics
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.operators import evaluate as E
from attesta.operators import guard as K
from attesta.operators import signals as G


class Retriever(Protocol):
    """Questions (``query_id``, ``text``) and articles in, a ranking (``query_id``, ``doc_id``, ``score``, ``rank``) out."""

    def __call__(self, questions: DataFrame, articles: DataFrame) -> DataFrame: ...


def resolve(name: str, *args):
    """``module:attribute`` as a callable; a class is built with ``args`` first."""
    module, _, attribute = name.partition(":")
    if not attribute:
        raise ValueError(f"{name!r} is not of the form module:attribute")
    found = getattr(importlib.import_module(module), attribute)
    return found(*args) if inspect.isclass(found) else found


def checked(ranking: DataFrame, k: int) -> DataFrame:
    """The first ``k`` distinct identifiers of each query, whatever a plug-in returned (``score`` and repeats are optional)."""
    best = ranking.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    return G.ranked_list(best, "got").select("query_id", E.returned(F.col("got"), k).alias("got"))


def compare(retrievers: dict[str, Callable[[], DataFrame]], wanted: DataFrame, k: int = 5) -> DataFrame:
    """One row a retriever: recall, hits, silence, and the seconds its ranking took. ``wanted``: ``query_id``, ``want``."""
    out = None
    none = F.array().cast("array<bigint>")
    for name, build in retrievers.items():
        began = time.time()
        got = checked(build(), k).persist()
        got.count()
        seconds = time.time() - began
        rows = wanted.join(got, "query_id", "left").withColumn("got", F.coalesce("got", none))
        one = E.recall_report(rows).crossJoin(E.abstention_report(rows).select("abstention", "evasion")).select(F.lit(name).alias("retriever"), F.lit(round(seconds, 3)).alias("seconds"), "*")
        out = one if out is None else out.unionByName(one)
    return out


#: Exit codes of an evaluation run: nothing wrong, an invariant or gate broken, nothing could be measured.
OK, BROKEN, UNMEASURED = 0, 1, 2


def gate(report: DataFrame, anomalies: DataFrame | None = None, **least: float) -> int:
    """Exit code for a report row: anomalies mean unmeasured; a metric below its least value, or undefined, means broken."""
    if anomalies is not None and not anomalies.isEmpty():
        return UNMEASURED
    row = report.first()
    if row is None:
        return UNMEASURED
    return BROKEN if any(row[m] is None or row[m] < v for m, v in least.items()) else OK


def timed(build: Callable[[], DataFrame], passes: int = 50) -> float:
    """Median seconds of ``passes`` runs of ``build``, results thrown away."""
    took = []
    for _ in range(passes):
        began = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - began)
    return statistics.median(took)


def adapted(writer: Callable) -> Callable[[str, list[str]], str]:
    """A writer of one argument (the question) or two (and what was retrieved), as one of two."""
    wanted = [p for p in inspect.signature(writer).parameters.values() if p.default is p.empty and p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD)]
    if len(wanted) not in (1, 2):
        raise TypeError(f"a writer takes the question, or the question and what was retrieved; this one takes {len(wanted)} arguments")
    return (lambda question, retrieved: writer(question)) if len(wanted) == 1 else writer


class Writer(Protocol):
    """A question and the retrieved identifiers in, a draft out; failures are ``WriterError``."""

    def __call__(self, question: str, retrieved: list[str]) -> str: ...


class Searcher(Protocol):
    """Questions in, a ranking with its signals out (``proximity``, ``margin``)."""

    def __call__(self, questions: DataFrame) -> DataFrame: ...


def register(spark: SparkSession) -> None:
    """The functions a SQL user needs, as temporary SQL functions: no Python runs behind them.

    ``strip_accents(text)``, ``text_tokens(text)``, ``dot_product(a, b)``, and the table functions
    ``article_range(first, last)`` and ``text_chunks(text, size)`` (paragraphs cut at ``size``).
    """
    quote = lambda s: s.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"create or replace temporary function strip_accents(t string) returns string return lower(translate(t, '{quote(T.FOLD_FROM)}', '{quote(T.FOLD_TO)}'))")
    spark.sql("create or replace temporary function text_tokens(t string) returns array<string> return filter(split(strip_accents(t), '[^0-9a-z]+'), x -> x <> '')")
    spark.sql("create or replace temporary function dot_product(a array<double>, b array<double>) returns double return aggregate(zip_with(a, b, (x, y) -> x * y), cast(0 as double), (s, x) -> s + x)")
    spark.sql(f"create or replace temporary function article_range(a int, b int) returns table(numero string) return select case when i = 1 then 'premier' else cast(i as string) end from (select explode(case when b > a and b - a <= {K.WIDEST_RANGE} then sequence(a, b) else array(a, b) end) as i)")
    spark.sql("create or replace temporary function text_chunks(t string, size int) returns table(place int, chunk string) return select p, substr(t, p * size + 1, size) from (select explode(sequence(0, greatest((length(t) - 1) div size, 0))) as p)")


class WriterError(RuntimeError):
    """A writer failed. Not an abstention: the cause is kept with the row."""


def written(rows: DataFrame, writer: Callable[[str, list[str]], str], question: str = "text", retrieved: str = "retrieved") -> DataFrame:
    """``rows`` (already filtered to those that may be answered) with ``draft`` and ``failure``; the writer is called once a row, in Arrow batches."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "draft string", "failure string"])
    write = adapted(writer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            drafts, failures = [], []
            for q, r in zip(b[question], b[retrieved], strict=True):
                try:
                    drafts.append(write(q, list(r)))
                    failures.append(None)
                except WriterError as e:
                    drafts.append(None)
                    failures.append(str(e))
            yield b.assign(draft=drafts, failure=failures)

    return rows.mapInPandas(run, schema)
