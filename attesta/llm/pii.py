"""Personal data: regular expressions propose spans, checksums confirm them, context adjusts the score.

Base kinds (always kept once their own check holds): ``email``, ``ip`` (parts at most 255),
``card`` (13 to 19 digits, Luhn), ``phone`` (9 to 15 digits). The method adds ``iban`` (mod-97)
and ``secret`` (a long key next to a word such as *token*); those need a score of at least
``MIN_SCORE``. Every span carries a score: a prior per kind, more when the checksum holds or a
context word stands nearby, less when a word that speaks against it does.

Null and empty texts give no spans; repeated rows are independent; other columns are not read.
All patterns run in linear time: runs are matched possessively and the local part of an address
is found backwards from its ``@``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from attesta.llm.common import small_batches

KINDS = ("email", "ip", "card", "phone", "iban", "secret")
MIN_SCORE = 0.5
CONTEXT_CHARS = 48

_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+")
_IBAN_END = re.compile(r"(?<=[A-Z0-9])(?![A-Za-z0-9])")
_SECRET = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9_-]{24,}+")
#: Characters of an IBAN by country, as registered.
_IBAN_CHARS = {
    country: n
    for n, countries in {
        15: "NO",
        16: "BE",
        18: "DK FO FI GL NL FK SD",
        19: "MK SI",
        20: "AT BA EE KZ LT LU XK MN",
        21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST",
        26: "IS TR",
        27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA",
        30: "JO KW MU YE",
        31: "MT SC",
        32: "LC",
        33: "RU",
    }.items()
    for country in countries.split()
}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "secret": 0.3}
_FOR = {
    "email": re.compile(r"(?i)mail|contact|write|reply"),
    "ip": re.compile(r"(?i)\bip\b|host|server|address|addr"),
    "card": re.compile(r"(?i)card|visa|master|amex|credit|payment|karte|carte|tarjeta"),
    "phone": re.compile(r"(?i)phone|tel|call|fax|mobile|handy"),
    "iban": re.compile(r"(?i)iban|account|bank|konto|compte|cuenta"),
    "secret": re.compile(r"(?i)token|secret|api.?key|passw|bearer|credential"),
}
_AGAINST = {
    "ip": re.compile(r"(?i)version|release|section|chapter"),
    "card": re.compile(r"(?i)isbn|order|serial|tracking|invoice"),
    "phone": re.compile(r"(?i)isbn|version"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    compact = iban.replace(" ", "")
    if not 15 <= len(compact) <= 34:
        return False
    turned = compact[4:] + compact[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in _AT.finditer(text):
        at = start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            done = m.end()
            yield start, done


def _ibans(text: str) -> list[tuple[int, int]]:
    """What follows may look like more of the number: the end at its country's length counts first, then, clear of those, the longest that passes."""
    due, other, at = [], [], 0
    while m := _IBAN.search(text, at):
        start, at = m.start(), m.start() + 4
        ends = [e for e in range(m.end(), at, -1) if _IBAN_END.match(text, e)]
        size = _IBAN_CHARS.get(m[0][:2])
        exact = next((e for e in ends if len(text[start:e].replace(" ", "")) == size and mod97(text[start:e])), None)
        if exact:
            due.append((start, exact))
            at = exact
        else:
            other += [(start, e) for e in ends if mod97(text[start:e])][:1]
    kept, done = [], 0
    for start, end in other:
        k = bisect_left(due, (start, end))
        if start >= done and (k == 0 or due[k - 1][1] <= start) and (k == len(due) or due[k][0] >= end):
            kept.append((start, end))
            done = end
    return sorted(due + kept)


def _score(kind: str, text: str, start: int, end: int, confirmed: bool) -> float:
    """Prior of the kind, plus checksum and context; between 0 and 1."""
    around = text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS // 2]
    score = _PRIOR[kind] + 0.15 * confirmed
    if _FOR[kind].search(around):
        score += 0.25
    if kind in _AGAINST and _AGAINST[kind].search(around):
        score -= 0.2
    return round(min(1.0, max(0.0, score)), 3)


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """All spans of one text, by kind and then start: (kind, start, end, score); ends are exclusive, in code points."""
    if not text:
        return []
    out = []

    def add(kind: str, start: int, end: int, confirmed: bool) -> None:
        out.append((kind, start, end, _score(kind, text, start, end, confirmed)))

    if "@" in text:
        for start, end in _emails(text):
            add("email", start, end, False)
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            add("ip", m.start(), m.end(), True)
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() and 13 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            add("card", m.start(), m.end(), True)
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                add("phone", m.start(), m.end(), False)
    for start, end in _ibans(text):
        if _score("iban", text, start, end, True) >= MIN_SCORE:
            add("iban", start, end, True)
    for m in _SECRET.finditer(text):
        if _looks_random(m[0]) and _score("secret", text, m.start(), m.end(), False) >= MIN_SCORE:
            add("secret", m.start(), m.end(), False)
    return out


def _looks_random(token: str) -> bool:
    """A key mixes digits and letters; words and numbers do not."""
    digits = sum(c.isdigit() for c in token)
    return 4 <= digits < len(token) and sum(c.isalpha() for c in token) >= 4


def listing(spans: list[tuple[str, int, int, float]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, _ in spans)


SCHEMA = "doc_id long, spans array<struct<kind:string,start:int,end:int,score:double>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its spans (``doc_id``, ``spans``); no shuffle."""
    small_batches(docs.sparkSession)

    def scan(batches):
        for b in batches:
            found = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in find(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, _SPAN)], ["doc_id", "spans"])

    return docs.selectExpr(f"cast({id_col} as long) doc_id", f"cast({text_col} as string) text").mapInArrow(scan, SCHEMA)


def report(docs: DataFrame) -> DataFrame:
    """Digest columns of :func:`detect`, made in the same pass so that spans need not travel twice."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, max_score double"

    def scan(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for t in b.column(1).to_pylist():
                spans = find(t)
                base = [s for s in spans if s[0] in KINDS[:4]]
                for i, k in enumerate(KINDS[:4]):
                    cols[i].append(sum(s[0] == k for s in base))
                cols[4].append(hashlib.sha256(listing(base).encode()).hexdigest())
                cols[5].append(listing(spans))
                cols[6].append(max((s[3] for s in spans), default=0.0))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "max_score"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(scan, schema)


def redact(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` with every span of at least ``min_score`` replaced by ``[KIND]`` (overlaps: the leftmost, then longest)."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def clean(t: str | None) -> str | None:
        out, done = [], 0
        for k, s, e, v in sorted(find(t), key=lambda x: (x[1], -x[2])):
            if s >= done and v >= min_score:
                out += [t[done:s], f"[{k.upper()}]"]
                done = e
        return t if t is None else "".join(out) + t[done:]

    def scan(batches):
        for b in batches:
            yield b.set_column(at, b.schema.field(at), pa.array([clean(t) for t in b.column(at).to_pylist()], b.schema.field(at).type))

    return docs.mapInArrow(scan, docs.schema)
