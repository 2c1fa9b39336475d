"""Controls over a whole extraction: counts, levels, headings, empty articles, form statistics, exclusive classes.

Every control returns its faults as rows (an empty result passes) or one report row; the numbers expected of a
source are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.operators.extract import FOOTER_INSIDE, ROMAN, repealed

SHORT_ARTICLE = 40
#: Nothing but spaces, of any width.
BLANK = r"\A\p{Zs}*\z"


def unknown_values(rows: DataFrame, column: str, known: tuple) -> DataFrame:
    """``value``, ``n``: values of ``column`` that are not among ``known`` (font sizes a source is known to use, say)."""
    return rows.where(F.col(column).isNotNull() & ~F.col(column).isin(*known)).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def row_count(rows: DataFrame, wanted: int) -> DataFrame:
    """One row: ``n``, ``wanted``, ``ok``."""
    return rows.agg(F.count("*").alias("n"), F.lit(wanted).cast("long").alias("wanted"), (F.count("*") == wanted).alias("ok"))


def unplaced(articles: DataFrame, upper: str, middle: str, lower: str) -> DataFrame:
    """One row: articles without the upper level (a fault), without the middle one, and without either of the lower two, with the first and last of those by ``rang``."""
    bare = F.col(middle).isNull() & F.col(lower).isNull()
    return articles.agg(
        F.count_if(F.col(upper).isNull()).alias("without_upper"), F.count_if(F.col(middle).isNull()).alias("without_middle"), F.count_if(bare).alias("without_both"),
        F.min(F.when(bare, F.col("rang"))).alias("first_without_both"), F.max(F.when(bare, F.col("rang"))).alias("last_without_both"),
    )


def empty_or_short(articles: DataFrame, notes: DataFrame, least: int = SHORT_ARTICLE) -> DataFrame:
    """``numero``, ``fault``, ``n_chars``: blank articles that no repeal note explains (``vide``), and others below ``least`` characters (``court``)."""
    blank = F.coalesce("texte", F.lit("")).rlike(BLANK)
    excused = articles.join(repealed(articles, notes).select("numero").withColumn("excused", F.lit(True)), "numero", "left")
    fault = F.when(blank, F.when(F.col("excused").isNull(), "vide")).when(F.length("texte") < least, "court")
    return excused.select("numero", fault.alias("fault"), F.length(F.coalesce("texte", F.lit(""))).alias("n_chars")).where("fault is not null")


#: What makes a heading (``reference``, ``title``) unclean, by name.
HEADING_CONTROLS = {
    "appel_colle": lambda r, t: t.rlike(r"\d\s*$"),
    "pied_de_page": lambda r, t: t.rlike(FOOTER_INSIDE),
    "sans_reference": lambda r, t: F.coalesce(F.trim(r), F.lit("")) == "",
    "romain_confondu": lambda r, t: r.rlike(ROMAN),
}


def heading_faults(headings: DataFrame) -> DataFrame:
    """``id``, ``fault`` of every control a heading breaks."""
    r, t = F.col("reference"), F.coalesce("title", F.lit(""))
    found = F.array_compact(F.array(*[F.when(c(r, t), F.lit(k)) for k, c in HEADING_CONTROLS.items()]))
    return headings.select("id", F.explode(found).alias("fault"))


def level_counts(articles: DataFrame, levels: tuple[str, ...], wanted: dict[str, int] | None = None) -> DataFrame:
    """``level``, ``n`` (distinct headings, each counted under all that stand above it), and ``ok`` against ``wanted``."""
    paths = [F.count_distinct(F.when(F.col(level).isNotNull(), F.struct(*levels[: i + 1]))).alias(level) for i, level in enumerate(levels)]
    row = articles.agg(*paths)
    each = row.select(F.explode(F.array(*[F.struct(F.lit(x).alias("level"), F.col(x).alias("n")) for x in levels])).alias("x")).select("x.*")
    table = F.create_map(*[y for k, v in (wanted or {"": 0}).items() for y in (F.lit(k), F.lit(v).cast("long"))])
    return each.withColumn("ok", F.coalesce(F.try_element_at(table, F.col("level")) == F.col("n"), F.lit(wanted is None)))


def form_statistics(articles: DataFrame, key: str, text: str) -> DataFrame:
    """One row over articles that are not blank: how many, median length, the shortest and the longest (ties: smallest key) with their paragraphs."""
    rows = articles.where(F.trim(text) != "").select(F.col(key).alias("k"), F.length(text).alias("n"), F.size(F.split(text, "\n")).alias("p"))
    low, high = F.min(F.struct("n", "p", "k")), F.max(F.struct("n", "p", (-F.col("k")).alias("k")))
    out = rows.agg(F.count("*").alias("non_empty"), F.percentile("n", F.lit(0.5)).alias("median"), low.alias("lo"), high.alias("hi"))
    return out.select(
        "non_empty", "median", F.col("lo.k").alias("shortest"), F.col("lo.n").alias("shortest_chars"), F.col("lo.p").alias("shortest_paragraphs"),
        (-F.col("hi.k")).alias("longest"), F.col("hi.n").alias("longest_chars"), F.col("hi.p").alias("longest_paragraphs"),
    )


def exclusive_classes(rows: DataFrame, classes: dict[str, Column], rest: str = "inexplique") -> DataFrame:
    """``class``, ``n``: each row counts under the first class that holds, or under ``rest``; the counts sum to the rows."""
    which = F.lit(None).cast("string")
    for name, holds in reversed(classes.items()):
        which = F.when(F.coalesce(holds, F.lit(False)), F.lit(name)).otherwise(which)
    return rows.groupBy(F.coalesce(which, F.lit(rest)).alias("class")).agg(F.count("*").alias("n"))


def overlap_of(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``left`` whose ``key`` stands in ``right`` too, once each."""
    return left.join(right.select(key), key, "left_semi")
