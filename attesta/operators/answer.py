"""From a decision to a served answer: prompt, stand-in writers, guard, registers, public form, and the bench's accounting."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.operators import guard

# Texts of the stand-in writers (%1$s head article, %2$s intruder).
FAITHFUL = "D'après l'article %1$s du Code du travail, la réponse à votre question se lit dans ce texte."
LIAR = "L'article %2$s du Code du travail règle ce point, et il est formel sur ce que vous demandez."
MIXED = "Les articles %1$s et %2$s du Code du travail se complètent : le premier pose la règle, le second l'étend."
MUTE = "Le Code du travail traite de cette question, et la réponse ne fait pas de doute dans la pratique."
MODES = ("fidele", "inventee", "muette", "melangee")


def digest(text: Column) -> Column:
    """BLAKE2b of 64 bits, big endian, as a decimal string (it exceeds a signed long)."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else str(int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big")))

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(text)


def fallback(mode: Column, head: Column, intruder: Column) -> Column:
    """A mode that lacks its article falls back: no head makes the faithful and the mixed mute; no intruder makes liars faithful, or mute."""
    m = F.when(head.isNull() & mode.isin("fidele", "melangee"), "muette").otherwise(mode)
    return F.when(intruder.isNull() & m.isin("inventee", "melangee"), F.when(head.isNotNull(), "fidele").otherwise("muette")).otherwise(m)


def draft(mode: Column, head: Column, intruder: Column) -> Column:
    say = lambda form: F.format_string(form, F.coalesce(head, F.lit("")), F.coalesce(intruder, F.lit("")))
    m = fallback(mode, head, intruder)
    return F.when(m == "fidele", say(FAITHFUL)).when(m == "inventee", say(LIAR)).when(m == "melangee", say(MIXED)).otherwise(MUTE)


def intruder(start: Column, n_corpus: int, retrieved: Column) -> Column:
    """First identifier from ``start`` on, round the corpus 0..n-1, that was not retrieved: among size + 1 tries one must be free."""
    tries = F.transform(F.sequence(F.lit(0), F.size(retrieved)), lambda i: ((start + i) % n_corpus).cast("string"))
    return F.when(F.lit(n_corpus) > F.size(retrieved), F.get(F.filter(tries, lambda t: ~F.array_contains(retrieved, t)), F.lit(0)))


def prompt(question: Column, passages: Column, warning: Column, token: Column, observation: Column) -> Column:
    """Blocks delimited by a random token given as a column; null when the token stands in the data or the warning is blank."""
    block = lambda name, body: F.concat(F.lit(f"<{name} "), token, F.lit(">\n"), body, F.lit(f"\n</{name} "), token, F.lit(">"))
    body = F.concat_ws("\n", block("QUESTION", question), block("ARTICLES", passages), block("AVERTISSEMENT", warning), observation)
    unsafe = F.contains(question, token) | F.contains(passages, token) | (F.trim(warning) == "")
    return F.when(~unsafe, body)


def contained(text: Column, token: Column) -> Column:
    """The question's block opens before and closes before the articles' block opens: forged blocks stay inside."""
    at = lambda s: F.instr(text, s)
    opens, closes, articles = (at(F.concat(F.lit(x), token, F.lit(">"))) for x in ("<QUESTION ", "</QUESTION ", "<ARTICLES "))
    return (opens > 0) & (opens < closes) & (closes < articles)


def compose(decided: DataFrame) -> DataFrame:
    """Answers from rows ``sure``, ``draft``, ``cited``, ``unreadable``, ``retrieved``: nothing is drafted when unsure, and a rejected draft is silence."""
    v = guard.verdict(F.col("draft"), F.col("cited"), F.col("unreadable"), F.col("retrieved"))
    out = decided.withColumn("v", F.when(F.col("sure"), v))
    served = F.coalesce(F.col("v.accepted"), F.lit(False))
    cause = F.when(~F.col("sure"), "doute").when(~served, F.col("v.motive"))
    return out.withColumns({"served": served, "answer": F.when(served, F.col("draft")), "citations": F.when(served, F.col("cited")).otherwise(F.array().cast("array<string>")), "cause": cause, "reason": F.col("v.reason")}).drop("v")


def register(served: Column, cause: Column) -> Column:
    return F.when(served, "reponse").when(cause == "doute", "doute").otherwise("rejet")


def public(columns: list[str]) -> Column:
    """The public JSON of an answer: no score of single articles leaves."""
    return F.to_json(F.struct(*columns))


# Error codes and their HTTP status.
ERRORS = {"question_vide": 400, "question_trop_longue": 413, "corps_illisible": 422, "trop_de_requetes": 429, "chargement_en_cours": 503, "index_absent": 503, "modele_absent": 503, "redaction_en_panne": 503}
LONGEST_QUESTION = 500


def validated(question: Column) -> Column:
    """Null for a valid question, else its error code."""
    return F.when(question.isNull() | (F.trim(question) == ""), "question_vide").when(F.length(question) > LONGEST_QUESTION, "question_trop_longue")


def status(code: Column) -> Column:
    table = F.create_map(*[x for k, v in ERRORS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, code), F.lit(200))


def accounted(rows: DataFrame) -> DataFrame:
    """Flags of the end-to-end bench from ``expected``, ``tolerated``, ``retrieved``, ``cited`` (read in the draft), ``citations`` (announced), ``drafted``, ``served``."""
    has = lambda a: F.size(a) > 0
    outside = F.array_except("cited", "retrieved")
    right = F.array_intersect("citations", "expected")
    wrong = F.array_except(F.array_except("citations", "expected"), "tolerated")
    out = rows.withColumns(
        {
            "hallucinated": F.col("drafted") & has(outside),
            "uncited": F.col("drafted") & ~has("cited"),
            "loyal": F.col("drafted") & has("cited") & ~has(outside),
            "leak": F.col("served") & has(F.array_except(F.array_union("citations", F.when(F.col("drafted"), F.col("cited")).otherwise(F.array().cast("array<string>"))), "retrieved")),
            "n_right": F.size(right),
            "n_wrong": F.size(wrong),
            "ceiling": F.coalesce(F.arrays_overlap("expected", "retrieved"), F.lit(False)),
        }
    )
    return out.withColumns({"wrongly_rejected": ~F.col("served") & F.col("loyal"), "precision": F.try_divide("n_right", F.col("n_right") + F.col("n_wrong")), "coverage": F.when(F.size("expected") > 0, F.col("n_right") / F.size("expected"))})


def rates(flagged: DataFrame) -> DataFrame:
    """One row: counts with every rate; an empty denominator gives null."""
    own = F.size("expected") > 0
    c = F.count_if
    return flagged.agg(
        F.count("*").alias("n"), c(own).alias("n_answerable"), c("served").alias("n_served"), c("drafted").alias("n_drafted"), c("hallucinated").alias("n_hallucinated"), c("uncited").alias("n_uncited"), c("leak").alias("n_leaks"), c("wrongly_rejected").alias("n_wrongly_rejected"),
        F.round(F.avg(F.when(F.col("served"), F.col("precision"))), 6).alias("precision"), F.round(F.avg(F.when(F.col("served") & own, F.col("coverage"))), 6).alias("coverage"),
        F.round(F.try_divide(c(F.col("drafted") & ~F.col("served")), c("drafted")), 6).alias("rejection"), F.round(F.try_divide(c("hallucinated"), c("drafted")), 6).alias("hallucination"),
        F.round(F.avg(F.when(own, F.col("ceiling").cast("int"))), 6).alias("ceiling"), F.round(F.try_divide(c(~own & ~F.col("served")), c(~own)), 6).alias("abstention"), F.round(F.try_divide(c(own & ~F.col("served")), c(own)), 6).alias("evasion"),
    )


def anomalies(answers: DataFrame) -> DataFrame:
    """Rows that break an invariant of answers, with its name; must be empty."""
    checks = {
        "servie_sans_texte": F.col("served") & F.col("answer").isNull(),
        "servie_sans_citation": F.col("served") & (F.size("citations") == 0),
        "abstenue_avec_texte": ~F.col("served") & F.col("answer").isNotNull(),
        "abstenue_sans_cause": ~F.col("served") & F.col("cause").isNull(),
        "citation_hors_recuperes": F.size(F.array_except("citations", "retrieved")) > 0,
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]))
    return answers.select("query_id", F.explode(found).alias("anomaly"))


def latest(journal: DataFrame, key: str, order: str) -> DataFrame:
    """Last journal entry per key."""
    rest = [c for c in journal.columns if c != key]
    return journal.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("e")).select(key, "e.*")
