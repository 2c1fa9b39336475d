"""Text as columns: accent folding, tokenizers, light stemmers, n-grams, identifiers, headers.

Everything is a Column expression, so it stays in the JVM. ``fold`` maps precomposed letters of the
Latin blocks; ``nfd_fold`` is the Arrow function for texts that may hold combining marks.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of the production lexical arm (both sides).
STOP_PRODUCTION = tuple(
    """
    a au aux avec ce ces dans de des du elle en et eux il ils je la le les leur
    lui ma mais me meme mes moi mon ne nos notre nous on ou par pas pour qu que
    qui sa se ses son sur ta te tes toi ton tu un une vos votre vous y est sont
    etre ete suis es sommes etes etait etaient soit d l n s c j m t
    ai as avons avez ont avait avaient si plus moins tout tous toute toutes
    comme quel quelle quels quelles quoi dont lorsque quand combien
    """.split()
)
# Stop words of the floor retrievers (hyphenated entries never match a token and are kept as data).
STOP_FLOOR = tuple(
    """
    a ai au aux avec ce ces cet cette c d dans de des du elle elles en encore est
    et etre eux il ils j je l la le les leur lui ma mais me mes moi mon n ne nos
    notre nous on ou par pas plus pour qu que quel quelle quelles quels qui quoi s
    sa sans se ses si son sont sur ta te tes toi ton tu un une vos votre vous y
    alors apres aussi autre avoir bien car cela comme comment combien donc donne
    droit est-ce etait fait faire ici jamais la-bas meme mon-patron ont peut
    peuvent peux pourquoi puis quand sous tout toute toutes tous tres
    """.split()
)
# Stop words of the k1 = 1.5 witness.
STOP_WITNESS = tuple(
    """
    a au aux avec ce ces cet cette dans de des du elle en est et eux il ils je la le les leur
    lui ma mais me meme mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses
    son sur ta te tes toi ton tu un une vos votre vous c d j l m n s t y ete etre avoir
    si sont etait aussi plus tout tous toute toutes
    """.split()
)
# Suffixes of the light stemmer, in the order tried.
SUFFIXES = (
    "issements", "issement", "ements", "ement", "ations", "ation", "ateurs", "ateur", "atrices", "atrice",
    "ances", "ance", "ences", "ence", "aires", "aire", "elles", "elle", "eurs", "euse", "euses",
    "ees", "ee", "es", "er", "ir", "aux", "als", "s", "x",
)


def _fold_table() -> tuple[str, str]:
    """Letters of the Latin blocks that decompose into one plain letter and marks, with that letter."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn")
        if len(plain) == 1 and plain != chr(code):
            pairs.append((chr(code), plain))
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(a for a, _ in pairs) + marks, "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _fold_table()


def unaccent(text: Column) -> Column:
    """Accents dropped, case kept (combining marks are deleted as ``translate`` has no partner for them)."""
    return F.translate(text, FOLD_FROM, FOLD_TO)


def fold(text: Column) -> Column:
    """Accents dropped, then lower case."""
    return F.lower(unaccent(text))


def fold_lower_first(text: Column) -> Column:
    """Lower case, then accents dropped."""
    return unaccent(F.lower(text))


def nfd_fold(text: Column) -> Column:
    """Full decomposition for any script, in Arrow batches: canonical decomposition, marks removed, lower case."""

    def run(s: pd.Series) -> pd.Series:
        plain = lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn").lower()
        return s.map(plain, na_action="ignore")

    return F.pandas_udf(run, "string")(text)


def tokens(text: Column, stop: tuple[str, ...] = STOP_PRODUCTION, least: int = 1, folded: Column | None = None) -> Column:
    """Runs of ``[0-9a-z]`` of the folded text of at least ``least`` characters, without stop words, in order."""
    parts = F.split(folded if folded is not None else fold(text), "[^0-9a-z]+")
    keep = lambda t: (F.length(t) >= least) & ~t.isin(*stop) if stop else F.length(t) >= least
    return F.coalesce(F.filter(parts, keep), F.array().cast("array<string>"))


def floor_tokens(text: Column) -> Column:
    return tokens(text, STOP_FLOOR, 2, fold_lower_first(text))


def witness_tokens(text: Column) -> Column:
    return tokens(text, STOP_WITNESS, 2, fold_lower_first(text))


def words(text: Column) -> Column:
    """All words, elisions cut, no stop list."""
    return tokens(text, (), 1, fold_lower_first(text))


_TABLE = str.maketrans({a: FOLD_TO[i] if i < len(FOLD_TO) else None for i, a in reversed(list(enumerate(FOLD_FROM)))})
_PLAIN = re.compile("[0-9a-z]+").findall


@dataclass(frozen=True)
class Rule:
    """A tokenizer as plain values, for code that reads words in Python: what ``tokens`` takes, and whether case goes before accents do."""

    stop: frozenset[str] = frozenset(STOP_PRODUCTION)
    least: int = 1
    lower_first: bool = False

    def read(self, text: str) -> list[str]:
        folded = text.lower() if text.isascii() else text.lower().translate(_TABLE) if self.lower_first else text.translate(_TABLE).lower()
        parts = [folded] if folded.isascii() and folded.isalnum() else _PLAIN(folded)
        return [t for t in parts if len(t) >= self.least and t not in self.stop]


#: The rules of tokenizers above.
RULES = {tokens: Rule(), floor_tokens: Rule(frozenset(STOP_FLOOR), 2, True), witness_tokens: Rule(frozenset(STOP_WITNESS), 2, True), words: Rule(frozenset(), 1, True)}


def stem(token: Column, least: int = 3) -> Column:
    """Light stemmer: the first suffix that fits decides, even when what is left would be too short; digits stay."""
    out = F.when(token.rlike("^[0-9]+$"), token)
    for s in SUFFIXES:
        left = F.substring(token, F.lit(1), F.length(token) - len(s))
        out = out.when(token.endswith(s), F.when(F.length(token) - len(s) >= least, left).otherwise(token))
    return out.otherwise(token)


def short_stem(token: Column) -> Column:
    """Plural and feminine only."""
    cut = lambda n: F.substring(token, F.lit(1), F.length(token) - n)
    long = F.length(token)
    return (
        F.when((long > 4) & token.endswith("aux"), F.concat(cut(3), F.lit("al")))
        .when((long > 4) & token.endswith("es"), cut(2))
        .when((long > 3) & token.endswith("s"), cut(1))
        .when((long > 4) & token.endswith("e"), cut(1))
        .otherwise(token)
    )


def stemmed(toks: Column, least: int = 3) -> Column:
    return F.transform(toks, lambda t: stem(t, least))


def grams(word: Column, size: int = 4) -> Column:
    """Overlapping slices of a word between underscores; a short word whole."""
    padded = F.concat(F.lit("_"), word, F.lit("_"))
    return F.when(F.length(padded) <= size, F.array(padded)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - size + 1, F.lit(1))), lambda i: F.substring(padded, i, F.lit(size))))


def char_ngrams(text: Column, size: int = 4) -> Column:
    """The slices of every word."""
    return F.flatten(F.transform(words(text), lambda w: grams(w, size)))


def squeeze(text: Column) -> Column:
    """White space runs to one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def no_blanks(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def duplicate_key(text: Column) -> Column:
    return squeeze(F.lower(text))


def clean(text: Column) -> Column:
    """No-break and thin spaces to spaces, runs squeezed, trimmed."""
    return F.trim(F.regexp_replace(F.translate(text, "   ", "   "), "[ \t]+", " "))


def close_punctuation(text: Column) -> Column:
    """No space before a full stop or comma."""
    return F.regexp_replace(text, " +([.,])", "$1")


def apostrophes(text: Column) -> Column:
    return F.translate(text, "’‘ʼ", "'''")


def examined(text: Column) -> Column:
    """Form read by most injection rules: folded, apostrophes unified, white space squeezed."""
    return F.regexp_replace(apostrophes(fold(text)), r"(?U)\s+", " ")


def examined_lines(text: Column) -> Column:
    """The same with line ends kept."""
    flat = F.regexp_replace(apostrophes(fold(text)), r"(?U)[^\S\n\r]+", " ")
    return F.trim(F.regexp_replace(flat, r"(?U)\s*[\n\r]+\s*", "\n"))


# Spellings of the first article.
FIRST, FIRST_SPELLINGS = "premier", ("premier", "1", "1er", "1ᵉʳ")


def article_id(raw: Column) -> Column:
    """Identifier as the corpus writes it: lower case, no blanks, no leading zeros, one spelling of the first."""
    t = F.replace(F.lower(F.trim(raw)), F.lit(" "), F.lit(""))
    t = F.when(t.rlike("^[0-9]+$"), F.coalesce(F.nullif(F.regexp_replace(t, "^0+", ""), F.lit("")), F.lit("0"))).otherwise(t)
    return F.when(t.isin(*FIRST_SPELLINGS), FIRST).otherwise(t)


def numeric_order(identifier: Column) -> Column:
    """Sort key of identifiers: ``premier`` first, numbers by value, then everything else by name."""
    n = F.when(F.lower(identifier).isin(*FIRST_SPELLINGS), 1).otherwise(identifier.try_cast("int"))
    return F.struct(n.isNull().alias("other"), F.coalesce(n, F.lit(0)).alias("n"), identifier.alias("name"))


def header(*titles: Column, sep: str = " — ") -> Column:
    """Non-empty titles joined."""
    return F.array_join(F.filter(F.array(*titles), lambda t: t.isNotNull() & (t != "")), sep)


def case_like(origin: Column, word: Column) -> Column:
    """``word`` in the case of ``origin``: all capitals, first capital, or as it is."""
    first = F.substring(origin, 1, 1)
    return (
        F.when((F.length(origin) > 1) & (F.upper(origin) == origin) & (F.lower(origin) != origin), F.upper(word))
        .when((F.upper(first) == first) & (F.lower(first) != first), F.concat(F.upper(F.substring(word, 1, 1)), F.expr("''"), F.substring(word, F.lit(2), F.length(word))))
        .otherwise(word)
    )


def french_number(value: Column, digits: int = 2) -> Column:
    """A decimal comma, fixed digits; ties go to the even digit."""
    return F.replace(F.format_string(f"%.{digits}f", F.bround(value.cast("double"), digits)), F.lit("."), F.lit(","))


def percent(value: Column) -> Column:
    return F.when(value.isNull(), "–").otherwise(F.concat(french_number(value * 100, 1), F.lit(" %")))


def first_line(text: Column, limit: int = 220) -> Column:
    return F.substring(F.split(text, "\n")[0], 1, limit)


def indented_line(message: Column) -> Column:
    """The first indented, non-blank line of a message, trimmed."""
    return F.get(F.transform(F.filter(F.split(message, "\n"), lambda x: x.rlike(r"^\s+\S")), lambda x: F.trim(x)), F.lit(0))


def caller(client: Column, forwarded: Column) -> Column:
    """The first address of a forwarded list, else the client, else "inconnue"."""
    head = F.trim(F.split(forwarded, ",")[0])
    return F.coalesce(F.when(head != "", head), client, F.lit("inconnue"))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
