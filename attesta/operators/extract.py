"""From physical lines to articles: visual lines, paragraphs, hierarchy, corrections, quality controls.

Lines have ``doc``, ``n`` (reading order), ``text``, ``bold``, ``x0``, ``x1``. Paragraphs and hierarchy are
windows within a document; the signal that opens a paragraph looks at the previous physical line,
headings included, so it is taken before anything is filtered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Geometry of the source, words that open a level, named corrections (pattern, replacement, recovered note).
RIGHT_EDGE, LEFT_EDGE = 523.0, 85.0
LEVELS = ("Livre", "Titre", "Chapitre", "Section", "Sous-section")
CORRECTIONS = ((r"\b(articles?)(\d)", "$1 $2", None), (r"\bà1000\b", "à 1000", None), (r"\bprofessionnels102\b", "professionnels", 102))
ROMAN = r"\b(?=[IVXl]*l)(?=[IVXl]*[IVX])[IVXl]{2,}\b"
REPEAL = r"(?i)^\s*Abrog"
FOOTER_LINE = r"^[\s\-–—]*\d{1,3}[\s\-–—]*$"
FOOTER_INSIDE = r"(?:^|\s)-\s*\d{1,3}\s*-(?:\s|$)"


def corrected(text: Column) -> tuple[Column, Column, Column]:
    """(text, recovered notes, number of substitutions) after the named corrections."""
    total, notes = F.lit(0), []
    for pattern, replacement, note in CORRECTIONS:
        n = F.regexp_count(text, F.lit(pattern))
        total = total + n
        if note is not None:
            notes.append(F.array_repeat(F.lit(note), n))
        text = F.regexp_replace(text, pattern, replacement)
    return text, F.concat(*notes), total


def glued(spans: DataFrame) -> DataFrame:
    """Visual lines from spans (``page``, ``y``, ``x0``, ``x1``, ``text``): grouped by rounded ordinate (half to even), joined left to right, a space where a gap of more than one point has none."""
    line = Window.partitionBy("page", "line").orderBy("x0")
    rows = spans.withColumn("line", F.bround("y", 0).cast("int"))
    before, edge = F.lag("text").over(line), F.lag("x1").over(line)
    gap = (F.col("x0") - edge > 1.0) & ~before.endswith(" ") & ~F.col("text").startswith(" ")
    rows = rows.withColumn("piece", F.when(gap, F.concat(F.lit(" "), "text")).otherwise(F.col("text")))
    return rows.groupBy("page", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "piece"))), lambda s: s.piece), "").alias("text"))


def split_heading(text: Column) -> tuple[Column, Column, Column]:
    """(reference, title, fixed): cut at the first colon; a lower-case l among Roman capitals becomes I."""
    raw = F.trim(F.when(F.instr(text, ":") > 0, F.substring_index(text, ":", 1)).otherwise(text))
    title = F.trim(F.when(F.instr(text, ":") > 0, F.substr(text, F.instr(text, ":") + 1)).otherwise(""))
    # Each confused numeral is a whole word: words are rewritten one by one.
    parts = F.transform(F.split(raw, " "), lambda w: F.when(w.rlike(r"^(?=[IVXl]*l)(?=[IVXl]*[IVX])[IVXl]{2,}$"), F.replace(w, F.lit("l"), F.lit("I"))).otherwise(w))
    return F.array_join(parts, " "), title, raw.rlike(ROMAN)


def opens(text_before: Column, bold: Column, bold_before: Column, x0: Column, x0_before: Column, x1_before: Column, started: Column) -> Column:
    """Does this line open a paragraph?"""
    indented = x0 > LEFT_EDGE
    return (
        F.when(~started | text_before.isNull(), True)
        .when(bold & ~bold_before, True)
        .when(text_before.endswith("-"), False)
        .when(x1_before < RIGHT_EDGE, True)
        .when(indented & (x0_before <= LEFT_EDGE), True)
        .otherwise(indented & (x0 < x0_before - 5))
    )


def paragraphs(lines: DataFrame, article: str = "article") -> DataFrame:
    """``doc``, ``article``, ``paragraph`` (from 1), ``text``: body lines (``article`` not null, ``heading`` false) joined; a hyphen at the end of a line joins without a space."""
    order = Window.partitionBy("doc").orderBy("n")
    prev = lambda c: F.lag(c).over(order)
    rows = lines.withColumns({"p_text": prev("text"), "p_bold": prev("bold"), "p_x0": prev("x0"), "p_x1": prev("x1"), "p_head": prev("heading")})
    body = rows.where(F.col(article).isNotNull() & ~F.col("heading"))
    within = Window.partitionBy("doc", article).orderBy("n")
    started = F.row_number().over(within) > 1
    flag = opens(F.col("p_text"), F.col("bold"), F.col("p_bold"), F.col("x0"), F.col("p_x0"), F.col("p_x1"), started)
    numbered = body.withColumn("open", flag.cast("int")).withColumn("paragraph", F.sum("open").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda s: s.text)
    joined = F.aggregate(parts, F.lit(""), lambda a, t: F.when(a == "", t).when(a.endswith("-"), F.concat(a, t)).otherwise(F.concat(a, F.lit(" "), t)))
    return numbered.groupBy("doc", article, "paragraph").agg(joined.alias("text"), F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("n_letters"))


def hierarchy(lines: DataFrame, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """``lines`` with one column a level: the heading in force. A new upper level clears the lower ones.

    The running count of upper headings partitions the look-back of each lower level.
    """
    word = F.split(F.split("text", ":")[0], " ")[0]
    out, above = lines, []
    for level in levels:
        w = Window.partitionBy("doc", *above).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
        mine = F.when(F.col("bold") & (word == level), F.col("text"))
        name = level.lower().replace("-", "_")
        out = out.withColumn(name, F.last(mine, ignorenulls=True).over(w))
        counter = f"__{name}"
        out = out.withColumn(counter, F.sum(F.when(mine.isNotNull(), 1).otherwise(0)).over(w))
        above.append(counter)
    return out.drop(*above)


def display(numero: Column, levels: list[tuple[Column, Column]]) -> Column:
    """``article N, reference — title, ...`` over the levels that are there."""
    parts = [F.when(r.isNotNull(), F.when(F.coalesce(t, F.lit("")) != "", F.concat(r, F.lit(" — "), t)).otherwise(r)) for r, t in levels]
    return F.concat_ws(", ", F.concat(F.lit("article "), numero), *parts)


def repealed(articles: DataFrame, notes: DataFrame) -> DataFrame:
    """``numero``, ``motif``: the note that explains an empty article (``notes``: ``note``, ``text``)."""
    calls = articles.select("numero", F.explode("notes").alias("note"))
    return calls.join(notes.where(F.col("text").rlike(REPEAL)), "note").groupBy("numero").agg(F.min(F.struct("note", "text")).alias("m")).select("numero", F.col("m.text").alias("motif"))


def numbering(articles: DataFrame) -> DataFrame:
    """Gaps (``missing``) and repeats (``repeated``) of ``rang``, without listing all numbers: gaps are read between neighbours.

    Neighbours are taken inside ranges of 1,000 numbers and between the ranges' ends.
    """
    each = articles.groupBy("rang").agg(F.count("*").alias("n")).withColumn("bucket", F.floor(F.col("rang") / 1000))
    inside = Window.partitionBy("bucket").orderBy("rang")
    ends = each.groupBy("bucket").agg(F.max("rang").alias("hi"))
    between = Window.orderBy("bucket")
    before = ends.select("bucket", F.coalesce(F.lag("hi").over(between), F.lit(0)).alias("from"))
    gaps = each.join(F.broadcast(before), "bucket").withColumn("prev", F.coalesce(F.lag("rang").over(inside), F.col("from")))
    missing = gaps.where(F.col("rang") - F.col("prev") > 1).select(F.explode(F.sequence(F.col("prev") + 1, F.col("rang") - 1)).alias("rang"), F.lit("missing").alias("fault"))
    return missing.unionByName(each.where("n > 1").select("rang", F.lit("repeated").alias("fault")))


def notes_check(called: DataFrame, defined: DataFrame) -> DataFrame:
    """Notes called but not defined, and defined but never called (``note`` columns)."""
    a, b = called.select("note").distinct(), defined.select("note").distinct()
    return a.join(b, "note", "left_anti").withColumn("fault", F.lit("undefined")).unionByName(b.join(a, "note", "left_anti").withColumn("fault", F.lit("uncalled")))


#: Controls over paragraphs (``text``): name and the condition that breaks it.
PARAGRAPH_CONTROLS = {
    "pied_residuel": lambda t: t.rlike(FOOTER_LINE),
    "pied_intercale": lambda t: t.rlike(FOOTER_INSIDE),
    "espace_double": lambda t: F.contains(t, F.lit("  ")),
    "alinea_vide": lambda t: F.trim(t) == "",
    "chiffre_colle": lambda t: t.rlike(r"[A-Za-zÀ-ÿ]\d+"),
    "mot_coupe": lambda t: t.rlike(r"(?U)\w- \w"),
    "sans_ponctuation": lambda t: ~t.rlike(r"[.;:,!?»)]$"),
    "espace_avant_ponctuation": lambda t: t.rlike(r"\s[.,]"),
}


def quality(paragraphs_: DataFrame, min_volume: int = 250_000) -> DataFrame:
    """``control``, ``faults`` over all paragraphs in one pass, with the volume control."""
    t = F.col("text")
    row = paragraphs_.agg(*[F.count_if(c(t)).alias(k) for k, c in PARAGRAPH_CONTROLS.items()], F.when(F.coalesce(F.sum(F.length(t)), F.lit(0)) > min_volume, 0).otherwise(1).cast("long").alias("volume"))
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("control"), F.col(k).alias("faults")) for k in (*PARAGRAPH_CONTROLS, "volume")])).alias("x")).select("x.*")


def must_be_empty(faults: DataFrame, what: str) -> None:
    """Refuse to go on when a control found faults."""
    found = faults.limit(10).collect()
    if found:
        raise ValueError(f"{what}: {[r.asDict() for r in found]}")


def chunks(text: Column, limit: int, header: Column | None = None) -> Column:
    """Paragraphs packed greedily into pieces of at most ``limit`` characters (a longer paragraph stays whole); at least one piece."""
    paras = F.filter(F.split(text, "\n"), lambda p: F.trim(p) != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(s: Column, p: Column) -> Column:
        full = (s.cur != "") & (F.length(s.cur) + F.length(p) + 1 > limit)
        return F.struct(F.when(full, F.concat(s.done, F.array(s.cur))).otherwise(s.done).alias("done"), F.when(full | (s.cur == ""), p).otherwise(F.concat(s.cur, F.lit("\n"), p)).alias("cur"))

    out = F.aggregate(paras, start, step, lambda s: F.when(s.cur != "", F.concat(s.done, F.array(s.cur))).otherwise(s.done))
    out = F.when(F.size(out) > 0, out).otherwise(F.array(text))
    return out if header is None else F.transform(out, lambda p: F.concat(header, F.lit("\n"), p))


def headed_chunks(text: Column, header: Column, limit: int = 600) -> Column:
    """Paragraphs joined by spaces under a repeated header; only paragraph lengths count; an empty article keeps its header."""
    paras = F.filter(F.transform(F.split(text, "\n"), lambda p: F.trim(p)), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), F.lit(0).alias("n"))

    def step(s: Column, p: Column) -> Column:
        full = (s.cur != "") & (s.n + F.length(p) > limit)
        return F.struct(
            F.when(full, F.concat(s.done, F.array(s.cur))).otherwise(s.done).alias("done"),
            F.when(full | (s.cur == ""), p).otherwise(F.concat(s.cur, F.lit(" "), p)).alias("cur"),
            F.when(full, F.length(p)).otherwise(s.n + F.length(p)).alias("n"),
        )

    out = F.aggregate(paras, start, step, lambda s: F.when(s.cur != "", F.concat(s.done, F.array(s.cur))).otherwise(s.done))
    return F.when(F.size(out) > 0, F.transform(out, lambda p: F.concat(header, p))).otherwise(F.array(F.trim(header)))


def granular(text: Column, header: Column, headed: bool = True, cut: int | None = None) -> Column:
    """The passages of an article: whole or cut to pieces of ``cut`` characters, each under its header or bare."""
    pieces = F.array(text) if cut is None else chunks(text, cut)
    return F.transform(pieces, lambda p: F.concat(header, F.lit("\n"), p)) if headed else pieces


def without_header(passage: Column, header: Column) -> Column:
    """The passage without its exact header, for ablations."""
    return F.when(F.startswith(passage, header), F.substr(passage, F.length(header) + 1)).otherwise(passage)


def footnotes(lines: DataFrame) -> DataFrame:
    """``doc``, ``note``, ``text`` from footnote lines (``doc``, ``n``, ``text``): a line opens a note only if its number is the next one; any other line continues the open note.

    Sequential within a document, so the document's lines are folded in order.
    """
    start = r"^(\d{1,3})\s*[-–—]?\s+(.*)$"
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda s: s.text)
    zero = F.struct(F.array().cast("array<struct<note:int,text:string>>").alias("done"), F.lit(0).alias("note"), F.lit("").alias("text"))

    def step(s: Column, t: Column) -> Column:
        number = F.regexp_extract(t, start, 1)
        opens_ = (number != "") & (number.try_cast("int") == s.note + 1)
        closed = F.when(s.note > 0, F.concat(s.done, F.array(F.struct(s.note.alias("note"), s.text.alias("text"))))).otherwise(s.done)
        return F.struct(
            F.when(opens_, closed).otherwise(s.done).alias("done"),
            F.when(opens_, s.note + 1).otherwise(s.note).alias("note"),
            F.when(opens_, F.regexp_extract(t, start, 2)).when(s.note > 0, F.concat(s.text, F.lit(" "), t)).otherwise(s.text).alias("text"),
        )

    end = lambda s: F.when(s.note > 0, F.concat(s.done, F.array(F.struct(s.note.alias("note"), s.text.alias("text"))))).otherwise(s.done)
    folded = lines.groupBy("doc").agg(F.aggregate(ordered, zero, step, end).alias("notes"))
    return folded.select("doc", F.explode("notes").alias("x")).select("doc", "x.note", "x.text")
