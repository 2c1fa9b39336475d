"""Readers and writers of corpora and question sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LEVEL = "struct<reference:string,intitule:string,appels_de_note:array<int>>"
ARTICLE = f"numero string, rang int, reference string, texte string, abroge boolean, motif_abrogation string, page_pdf int, appels_de_note array<int>, position struct<livre:{_LEVEL},titre:{_LEVEL},chapitre:{_LEVEL},section:{_LEVEL},sous_section:{_LEVEL}>, citation string"
CORPUS = f"source struct<intitule:string,fichier:string,portail:string,date_consolidation:string,avertissement:string>, articles array<struct<{', '.join(':'.join(x.split(' ', 1)) for x in ARTICLE.split(', '))}>>, notes_de_bas_de_page map<string,string>"
QUESTION = "id string, question string, etiquettes array<string>, articles_attendus array<string>, articles_toleres array<string>, famille_hors_corpus string, volet string, paire array<string>"
LEVELS = ("livre", "titre", "chapitre", "section", "sous_section")


def read_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(articles, header) of a corpus file; a header without a warning is refused."""
    whole = spark.read.schema(CORPUS).json(path, multiLine=True)
    head = whole.select("source.*", "notes_de_bas_de_page")
    if not head.where("avertissement is null or trim(avertissement) = ''").isEmpty():
        raise ValueError("the corpus has no consolidation warning")
    return whole.select(F.explode("articles").alias("a")).select("a.*"), head


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"questions array<struct<{', '.join(':'.join(x.split(' ', 1)) for x in QUESTION.split(', '))}>>").json(path, multiLine=True).select(F.explode("questions").alias("q")).select("q.*")


def title_path(sep: str = " > "):
    """Titles of the levels that are there, joined."""
    titles = F.array(*[F.col(f"position.{x}.intitule") for x in LEVELS])
    return F.array_join(F.filter(titles, lambda t: t.isNotNull() & (t != "")), sep)


def write_corpus(articles: DataFrame, header: DataFrame, path: str) -> None:
    """Articles as JSON lines with their header beside them; both read back with fixed schemas."""
    articles.write.mode("overwrite").json(f"{path}/articles")
    header.write.mode("overwrite").json(f"{path}/header")


def as_lines(report: DataFrame, title: str) -> DataFrame:
    """``line``: a report table as text: a title, the column names, and a row a line, columns of equal width."""
    names = report.columns
    text = report.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("–")).alias(c) for c in names])
    row = text.agg(*[F.greatest(F.max(F.length(c)), F.lit(len(c))).alias(c) for c in names]).first()
    widths = {c: row[c] or len(c) for c in names}
    line = F.concat_ws("  ", *[F.rpad(c, widths[c], " ") for c in names])
    head = report.sparkSession.createDataFrame([(0, title), (1, "  ".join(c.ljust(widths[c]) for c in names))], "n int, line string")
    return head.unionByName(text.orderBy(*names).select(F.lit(2).alias("n"), line.alias("line"))).orderBy("n", "line").select(F.rtrim("line").alias("line"))


def write_text_report(report: DataFrame, title: str, path: str) -> None:
    """The report as one text file: reports are small, one row a measure."""
    as_lines(report, title).coalesce(1).write.mode("overwrite").text(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def validate_questions(questions: DataFrame, articles: DataFrame) -> DataFrame:
    """``id``, ``anomaly`` of every rule the set breaks; an empty result is a valid set."""
    none = F.array().cast("array<string>")
    q = questions.withColumns({c: F.coalesce(c, none) for c in ("etiquettes", "articles_attendus", "articles_toleres", "paire")})
    want, label = F.col("articles_attendus"), F.col("etiquettes")
    mark = lambda df, what: df.select("id", F.lit(what).alias("anomaly"))
    own = F.size(want) > 0
    checks = {
        "question_vide": F.col("question").isNull() | (F.trim("question") == ""),
        "attendu_et_tolere": F.arrays_overlap(want, "articles_toleres"),
        "attendus_en_double": F.size(F.array_distinct(want)) < F.size(want),
        "repondable_marquee_sans_reponse": own & F.array_contains(label, "sans_reponse"),
        "sans_reponse_non_marquee": ~own & ~F.array_contains(label, "sans_reponse"),
        "famille_sur_repondable": own & F.col("famille_hors_corpus").isNotNull(),
        "famille_ou_volet_absent": ~own & (F.col("famille_hors_corpus").isNull() | F.col("volet").isNull()),
    }
    found = q.select("id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]))).alias("anomaly"))
    twice = mark(q.groupBy("id").count().where("count > 1"), "identifiant_en_double")
    cited = q.select("id", F.explode(F.concat(want, "articles_toleres")).alias("numero"))
    absent = mark(cited.join(articles.select("numero"), "numero", "left_anti").distinct(), "article_inconnu")
    pairs = q.select("id", F.explode("paire").alias("other"))
    missing = mark(pairs.join(q.select(F.col("id").alias("other")), "other", "left_anti").distinct(), "paire_absente")
    one_way = mark(pairs.join(pairs.select(F.col("other").alias("id"), F.col("id").alias("other")), ["id", "other"], "left_anti").distinct(), "paire_non_reciproque")
    halves = q.where(~own & F.col("famille_hors_corpus").isNotNull()).groupBy(F.col("famille_hors_corpus").alias("id")).agg(F.count_if(F.col("volet") == "reglage").alias("r"), F.count("*").alias("n"))
    uneven = mark(halves.where(F.abs(2 * F.col("r") - F.col("n")) > 1), "volets_desequilibres")
    out = found
    for part in (twice, absent, missing, one_way, uneven):
        out = out.unionByName(part)
    return out
