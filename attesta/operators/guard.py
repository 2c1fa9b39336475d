"""Citation guard: what a drafted text cites, whether all of it was retrieved, and the whole-draft verdict.

All of it is column expressions. Every announcement ("article", "art.") is found together with the chain of
numbers behind it, which a look-ahead captures without consuming it; a chain is then cut into steps
(a number, its neighbour, whether a range leads to it), ranges are unfolded as sequences, and
the first step that cannot be read ends the chain. A draft is accepted or rejected whole, never repaired.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions.text import FIRST, FIRST_SPELLINGS

# What announces, chains, ends and disqualifies an article number.
SEPARATORS = r"[\s*_`:«»\"'()\[\]]*"
ANNOUNCE = r"\b(?:articles?|art\.?)" + SEPARATORS + r"(?:n[°o]" + SEPARATORS + r")?"
DIGITS = 4
SPELLED = r"(?:un|deux|trois|quatre|cinq|six|sept|huit|neuf|dix|onze|douze|treize|quatorze|quinze|seize|vingts?|trente|quarante|cinquante|soixante|cents?|mille)"
UNREADABLE_WORDS = SPELLED + r"(?:[-\s](?:et[-\s])?" + SPELLED + r")*\b"
LINK = r"\s*(?:,|et|ou|&)\s*"
QUANTITY = r"\d+,\d|\d+\s+\d|\d+\s*%|\d+\s*(?:heures?|jours?|mois|ans?|années?|semaines?|alinéas?|dirhams?|fois|minutes?)\b"
RANGE = r"\s*(?:jusqu['’]à|à)\s+(?:l['’]\s*)?(?:articles?\s*)?(?:n[°o]\s*)?"
WIDEST_RANGE = 600
SHOWN = 5

# The independent reader of the bench.
BENCH_PROSE = r"\d+,\d|\d+\s+\d|\d+\s*%|\d+\s*(?:heures?|jours?|mois|ans?|années?|semaines?|alinéas?|dirhams?|fois|minutes?)\b"
BENCH_CITATION = (
    r"\b(?:articles?|art\.?)[\s:]*(?:n[°o][\s:]*)?((?:premier|\d{1,3})(?![\d-])(?:\s*(?:,|et|ou|à)\s*(?!(?:" + BENCH_PROSE + r"))(?:premier|\d{1,3})(?![\d-]))*)"
)
BENCH_WIDEST_RANGE = 50

# Flags: case-insensitive, all alphabets.
_FLAGS = "(?iuU)"
_BRIDGE = rf"(?:{RANGE}|{LINK})(?!{QUANTITY})"
_BENCH_STEP = rf"{_FLAGS}(?:(à)|,|et|ou|^)\s*(premier|\d{{1,3}})"


def _patterns(digits: int) -> tuple[str, str, str]:
    """A reference as one pattern, what follows the announcement as far as it chains; its steps; what ends it unread. Numbers have at most ``digits`` digits."""
    number = rf"(?:premier|1(?:er|ᵉʳ)|\d{{1,{digits}}})(?![^\W_]|-)"
    unreadable = rf"\d{{{digits + 1},}}|\d+(?:-\d+)+|\d+\s*(?:bis|ter|quater)\b|L\.?\s*\d+(?:-\d+)*"
    chain = rf"{number}(?:{_BRIDGE}{number})*(?:{_BRIDGE}(?:{unreadable}))?|{unreadable}|{UNREADABLE_WORDS}"
    return rf"{_FLAGS}({ANNOUNCE})(?=({chain}))", rf"{_FLAGS}(?:({RANGE})|{LINK}|^)({number})", rf"{_FLAGS}^(?:{number}(?:{_BRIDGE}{number})*{_BRIDGE})?({unreadable}|{UNREADABLE_WORDS})$"


def _value(raw: Column) -> Column:
    """The number a readable reference stands for."""
    t = F.lower(F.translate(raw, " ", ""))
    return F.when(t.isin(*FIRST_SPELLINGS), 1).otherwise(t.try_cast("long"))


def named(number: Column) -> Column:
    return F.when(number == 1, FIRST).otherwise(number.cast("string"))


def _steps(chain: Column, pattern: str) -> Column:
    """The numbers of a chain, each with its left neighbour (``a``, null at first), itself (``b``) and whether a range leads to it."""
    ranged = F.transform(F.regexp_extract_all(chain, F.lit(pattern), F.lit(1)), lambda x: x != "")
    number = F.transform(F.regexp_extract_all(chain, F.lit(pattern), F.lit(2)), _value)
    left = F.concat(F.array(F.lit(None).cast("long")), number)
    return F.filter(F.arrays_zip(left.alias("a"), number.alias("b"), ranged.alias("ranged")), lambda x: x.b.isNotNull())


def _spelled_out(step: Column, widest: int) -> Column:
    wide = step.ranged & (step.a >= 1) & (step.b > step.a) & (step.b - step.a <= widest)
    return F.when(wide, F.sequence(step.a, F.greatest(step.a, step.b))).otherwise(F.array(step.b))


def _of_chain(head: Column, step: str, unread: str) -> Column:
    """struct(cites, bad) of one announced chain: numbers up to the first range that cannot be read, and what cannot."""
    steps = _steps(head.chain, step)
    broken = lambda x: F.coalesce(x.ranged & ~((x.a >= 1) & (x.b > x.a) & (x.b - x.a <= WIDEST_RANGE)), F.lit(False))
    stop = F.array_position(F.transform(steps, broken), True)
    whole = F.when(stop > 0, F.slice(steps, 1, F.greatest(stop - 1, F.lit(0)).cast("int"))).otherwise(steps)
    at = F.get(steps, (stop - 1).cast("int"))
    rest = F.regexp_extract(head.chain, unread, 1)
    lead = F.when(F.size(steps) == 0, F.trim(F.regexp_replace(head.announced, r"(?U)^\s+|\s+$", ""))).otherwise("article")
    bad = F.when(stop > 0, F.concat(F.lit("articles "), named(at.a), F.lit(" à "), named(at.b))).when(rest != "", F.concat(lead, F.lit(" "), rest))
    return F.struct(F.flatten(F.transform(whole, lambda x: _spelled_out(x, WIDEST_RANGE))).alias("cites"), bad.alias("bad"))


def citations(text: Column, digits: int = DIGITS) -> Column:
    """struct(citations, unreadable) of a text column, each without repeats and in reading order. ``digits``: of the longest number that the corpus can hold (at most 18)."""
    t = F.coalesce(text, F.lit(""))
    head, step, unread = _patterns(digits)
    heads = F.arrays_zip(F.regexp_extract_all(t, F.lit(head), F.lit(1)).alias("announced"), F.regexp_extract_all(t, F.lit(head), F.lit(2)).alias("chain"))
    found = F.transform(heads, lambda h: _of_chain(h, step, unread))
    cites = F.array_distinct(F.transform(F.flatten(F.transform(found, lambda x: x.cites)), named))
    return F.struct(cites.alias("citations"), F.array_distinct(F.array_compact(F.transform(found, lambda x: x.bad))).alias("unreadable"))


def bench_citations(text: Column, corpus: Column | None = None) -> Column:
    """The bench's own reader: one pattern, ranges of at most 50 unfolded (else both ends), known identifiers only."""
    groups = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_FLAGS + BENCH_CITATION), F.lit(1))
    plain = lambda raw: F.when(F.lower(raw) == FIRST, FIRST).otherwise(raw)

    def spread(group: Column) -> Column:
        raw = F.transform(F.regexp_extract_all(group, F.lit(_BENCH_STEP), F.lit(2)), plain)
        ranged = F.transform(F.regexp_extract_all(group, F.lit(_BENCH_STEP), F.lit(1)), lambda x: x != "")
        pairs = F.arrays_zip(F.concat(F.array(F.lit(None).cast("string")), raw).alias("a"), raw.alias("b"), ranged.alias("ranged"))
        a, b = (lambda x: x.a.try_cast("int")), (lambda x: x.b.try_cast("int"))
        wide = lambda x: x.ranged & (b(x) - a(x)).between(1, BENCH_WIDEST_RANGE)
        inner = lambda x: F.transform(F.sequence(a(x), F.greatest(a(x), b(x))), lambda i: i.cast("string"))
        return F.flatten(F.transform(F.filter(pairs, lambda x: x.b.isNotNull()), lambda x: F.when(wide(x), inner(x)).otherwise(F.array(x.b))))

    out = F.array_distinct(F.flatten(F.transform(groups, spread)))
    return out if corpus is None else F.array_intersect(out, corpus)


def expanded(first: Column, last: Column, widest: int = WIDEST_RANGE) -> Column:
    """Identifiers of a range of two numbers; null when it cannot be read."""
    ok = (last > first) & (last - first <= widest)
    ids = F.transform(F.sequence(first, F.greatest(last, first)), lambda i: F.when(i == 1, FIRST).otherwise(i.cast("string")))
    return F.when(ok, ids)


# Motives and the sentences of a verdict.
EMPTY, UNCITED, INVENTED, UNREAD = "texte_vide", "sans_citation", "citation_inventee", "citation_illisible"
SAY_EMPTY = "Le rédacteur n'a rien écrit : il n'y a pas de réponse à vérifier, donc pas de réponse à afficher."
SAY_UNCITED = "La réponse rédigée ne cite aucun article : une affirmation juridique sans source ne peut pas être vérifiée, elle n'est donc pas servie."
SAY_INVENTED = "Réponse rejetée en entier : elle cite %s %s, qui %s parmi %s pour cette question. Une citation que le système n'a pas récupérée ne peut pas être vérifiée, et une réponse à moitié inventée n'est pas rapiécée."
SAY_UNREAD = "Réponse rejetée en entier : elle porte la référence%s %s, qu'aucune lecture ne résout en numéro d'article du Code du travail marocain. Une référence que le système ne peut pas comparer à ce qu'il a récupéré est traitée comme une citation inventée, parce que la servir serait affirmer un contrôle qui n'a pas eu lieu."


def invented(cited: Column, allowed: Column) -> Column:
    return F.array_except(cited, allowed)


def _named(items: Column, quoted: bool = False) -> Column:
    shown = F.slice(items, 1, SHOWN)
    if quoted:
        shown = F.transform(shown, lambda x: F.concat(F.lit("« "), x, F.lit(" »")))
    rest = F.size(items) - F.size(shown)
    return F.concat(F.array_join(shown, ", "), F.when(rest > 0, F.format_string(" et %d autres", rest)).otherwise(""))


def invented_reason(wrong: Column, allowed: Column) -> Column:
    many = F.size(wrong) > 1
    fund = F.when(F.size(allowed) == 1, "le seul article retrouvé").otherwise(F.format_string("les %d articles retrouvés", F.size(allowed)))
    return F.format_string(SAY_INVENTED, F.when(many, "les articles").otherwise("l'article"), _named(wrong), F.when(many, "ne figurent pas").otherwise("ne figure pas"), fund)


def unread_reason(bad: Column) -> Column:
    return F.format_string(SAY_UNREAD, F.when(F.size(bad) > 1, "s").otherwise(""), _named(bad, True))


def verdict(text: Column, cited: Column, unreadable: Column, allowed: Column) -> Column:
    """struct(accepted, motive, reason, invented): the first failing test decides. ``allowed`` is exactly what the writer was given, as an array."""
    wrong = invented(cited, allowed)
    motive = F.when(F.coalesce(F.trim(text), F.lit("")) == "", EMPTY).when(F.size(unreadable) > 0, UNREAD).when(F.size(cited) == 0, UNCITED).when(F.size(wrong) > 0, INVENTED)
    reason = F.when(motive == EMPTY, SAY_EMPTY).when(motive == UNREAD, unread_reason(unreadable)).when(motive == UNCITED, SAY_UNCITED).when(motive == INVENTED, invented_reason(wrong, allowed))
    return F.struct(motive.isNull().alias("accepted"), motive.alias("motive"), reason.alias("reason"), F.when(motive == INVENTED, wrong).otherwise(F.array().cast("array<string>")).alias("invented"))


def rejectable_share(n_corpus: Column, retrieved: Column) -> Column:
    """Share of the corpus that a draft could not cite unnoticed."""
    return F.try_divide(n_corpus - F.size(F.array_distinct(retrieved)), n_corpus)
