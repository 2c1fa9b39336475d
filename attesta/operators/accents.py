"""Accent lexicon of a corpus, and giving a text back the accents the corpus does not dispute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import case_like, fold

WORD = r"[\p{L}]+"


def forms(passages: DataFrame, text: str = "text") -> DataFrame:
    """``form``, ``n``: lower-case words and how often they occur."""
    found = F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), F.lit(0))
    return passages.select(F.explode(found).alias("form")).groupBy("form").agg(F.count("*").alias("n"))


def lexicon(counted: DataFrame) -> DataFrame:
    """``bare``, ``accented``, ``ambiguous``: the commonest accented form of each bare one (ties: alphabetical); ambiguous when the bare form occurs itself."""
    rows = counted.withColumn("bare", fold(F.col("form")))
    best = rows.where("bare <> form").groupBy("bare").agg(F.min(F.struct((-F.col("n")).alias("m"), "form")).alias("b"))
    plain = counted.select(F.col("form").alias("bare")).withColumn("plain", F.lit(True))
    return best.join(plain, "bare", "left").select("bare", F.col("b.form").alias("accented"), F.coalesce("plain", F.lit(False)).alias("ambiguous"))


def reaccented(texts: DataFrame, lex: DataFrame, column: str = "text", out: str = "reaccented") -> DataFrame:
    """``texts`` with ``out``: words without accents replaced by the lexicon's form, in the case they were written; ambiguous words stay.

    The distinct words of each text meet the lexicon in a join; a text then gets the few forms it needs as a map.
    """
    low = lambda w: F.lower(w)
    words = F.array_distinct(F.transform(F.regexp_extract_all(F.col(column), F.lit(WORD), F.lit(0)), low))
    keyed = texts.withColumn("__key", F.sha2(F.col(column).cast("binary"), 256))
    asked = keyed.select("__key", F.explode(words).alias("bare")).distinct()
    found = asked.join(lex.where("not ambiguous").select("bare", "accented"), "bare").groupBy("__key").agg(F.map_from_entries(F.collect_list(F.struct("bare", "accented"))).alias("__forms"))
    # Letters, and what stands between them, in order and without loss.
    pieces = F.regexp_extract_all(F.col(column), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    new = F.array_join(F.transform(pieces, lambda p: F.coalesce(case_like(p, F.try_element_at(F.col("__forms"), low(p))), p)), "")
    return keyed.join(found, "__key", "left").withColumn(out, new).drop("__key", "__forms")


def spellings(questions: DataFrame, lex: DataFrame, column: str = "text") -> DataFrame:
    """Four spellings a question: as typed, without accents, and both with accents given back; one row each (``spelling``, ``text``)."""
    from attesta.functions.text import unaccent

    bare = reaccented(questions.withColumn("bare", unaccent(F.col(column))), lex, "bare", "bare_re")
    rows = reaccented(bare, lex, column, "typed_re")
    parts = [F.struct(F.lit(n).alias("spelling"), F.col(c).alias("text")) for n, c in (("typed", column), ("bare", "bare"), ("bare_reaccented", "bare_re"), ("typed_reaccented", "typed_re"))]
    return rows.select("query_id", F.explode(F.array(*parts)).alias("x")).select("query_id", "x.*")


def max_rule(a: Column, b: Column, ranked_a: Column, ranked_b: Column) -> tuple[Column, Column]:
    """(proximity, ranking) under two spellings: the greater proximity, with the ranking it came from (ties: the second)."""
    return F.greatest(a, b), F.when(b >= a, ranked_b).otherwise(ranked_a)


#: The six rules over proximities of the spellings: ``a`` accented, ``d`` without accents, ``r`` those given back, ``ar`` given back to the accented one.
RULES = {"accentuee": ("a",), "sans_accents": ("d",), "max_brute_depouillee": ("d", "d"), "reaccentuee": ("r",), "max_brute_reaccentuee": ("d", "r"), "accentuee_reaccentuee": ("ar",)}


def under_rules(cases: DataFrame, threshold: float) -> DataFrame:
    """``rule``, ``n``, ``served``, ``mean``, ``lost`` (cases served as typed and not under the rule) of the six rules (``cases``: columns a, d, r, ar); one pass."""
    value = lambda cs: F.greatest(*[F.col(c) for c in cs]) if len(set(cs)) > 1 else F.col(cs[0])
    aggs = [x for k, cs in RULES.items() for v in [value(cs)] for x in (F.count_if(v >= threshold).alias(f"s_{k}"), F.round(F.avg(v), 6).alias(f"m_{k}"), F.count_if((F.col("a") >= threshold) & (v < threshold)).alias(f"l_{k}"))]
    row = cases.agg(F.count("*").alias("n"), *aggs)
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col("n"), F.col(f"s_{k}").alias("served"), F.col(f"m_{k}").alias("mean"), F.col(f"l_{k}").alias("lost")) for k in RULES])).alias("x")).select("x.*")
