"""Remaining queries: expansion, hydration and public form, displacement, top-1 studies, witnesses, footnotes, streaming inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import answer as W
from attesta.operators import evaluate as E
from attesta.operators import extract as X
from attesta.operators import lexical as L
from attesta.operators import matrix as M
from attesta.operators import signals as G
from attesta.plans import answer_queries as Q
from attesta.plans import inputs as I
from attesta.plans import retrieval_queries as R
from attesta.plans import sql as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


SYNONYMS = (("the", ["this"]), ("that", ["this", "these"]), ("with", ["by"]))
_SYN = "syn(term, more) as (values " + ", ".join(f"('{t}', {m})" for t, m in SYNONYMS) + ")"


@query(f"""with {S.bags()}, {_SYN}, q0 as (select item_id as query_id, unnest({S.toks('text')}) as term from benchmark),
q1 as (select * from q0 union all select query_id, unnest(more) from (select distinct query_id, term from q0) join syn using (term)), q as (select query_id, term, count(*) as qtf from q1 group by all), {S.scored()}, {S.top(5)} select query_id, doc_id, score, rank from ranked""")
def synonym_expansion(spark, d):
    syn = spark.createDataFrame(list(SYNONYMS), "term string, more array<string>")
    return L.top(L.bm25(I.index(spark, d), L.expand(I.questions(spark, d), syn)), 5).select("query_id", "doc_id", "score", "rank")


@query(f"with {R._arms()}, {R._composed()} select query_id, cast(doc_id as varchar) as numero, arm, rank, d.source as titre, left(split_part(d.text, chr(10), 1), 220) as extrait from comp join documents d using (doc_id)")
def hydrated_results(spark, d):
    from attesta.functions.text import first_line

    docs = I.table(spark, d, "documents").select("doc_id", F.col("source").alias("titre"), first_line(F.col("text")).alias("extrait"))
    return R.composed(spark, d).join(docs, "doc_id").select("query_id", F.col("doc_id").cast("string").alias("numero"), "arm", "rank", "titre", "extrait")


@query()
def public_answers(spark, d):
    """Public JSON of every answer: register, text, citations; no score leaves."""
    a = Q.answered(spark, d).withColumn("registre", W.register(F.col("served"), F.col("cause")))
    return a.select("query_id", W.public(["registre", "answer", "citations", "cause", "reason"]).alias("json"))


_PAY = " the that with of and"


@query(f"""with {S.bags()}, base as (with {S.questions()}, {S.scored()}, {S.top(5)} select query_id, list(doc_id order by rank) as got from ranked group by 1),
paid as (with q as (select query_id, term, count(*) as qtf from (select item_id as query_id, unnest({S.toks(f"(text || '{_PAY}')")}) as term from benchmark) group by all), {S.scored()}, {S.top(5)} select query_id, list(doc_id order by rank) as got from ranked group by 1)
select query_id, a.got[1:3] = b.got[1:3] as same_top3, cast(len(list_intersect(a.got[1:3], b.got[1:3])) as int) as common3, cast(len(list_intersect(a.got, b.got)) as int) as common5 from base a join paid b using (query_id)""")
def payload_displacement(spark, d):
    from attesta.functions.text import tokens

    bags, b = I.counts(spark, d, more=_PAY), I.table(spark, d, "benchmark")
    paid = b.select(F.col("item_id").alias("query_id"), tokens(F.concat("text", F.lit(_PAY))).alias("toks"))
    rank = lambda q: L.top(M.bm25(bags, q, 5), 5)
    plain = G.ranked_list(rank(I.questions(spark, d)), "got")
    moved = G.ranked_list(rank(paid), "got").withColumn("query_id", F.col("query_id") + 1_000_000)
    pairs = b.select(F.col("item_id").alias("a"), (F.col("item_id") + 1_000_000).alias("b"))
    return E.displacement(pairs, plain.unionByName(moved)).select(F.col("a").alias("query_id"), "same_top3", "common3", "common5")


@query(f"with {R._arms()}, {R._SIGNALS}, {S.EXPECTED}, t as (select query_id, doc_id from lex where rank = 1), m as (select query_id, max(score) filter (rank = 1) - coalesce(max(score) filter (rank = 2), 0) as gap from lex where rank <= 2 group by 1), r as (select t.query_id, gap, exists (select 1 from expected e where e.query_id = t.query_id and e.doc_id = t.doc_id) as correct from t join m using (query_id)) select correct, count(*) as n, round(min(gap), 6) as lo, round(max(gap), 6) as hi from r group by 1")
def top1_gap_separation(spark, d):
    """Absolute gap of the first two scores, for right and wrong first answers."""
    lex = R.lexical_arm(spark, d)
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("score")))
    gap = lex.where("rank <= 2").groupBy("query_id").agg((at(1) - F.coalesce(at(2), F.lit(0.0))).alias("gap"))
    right = lex.where("rank = 1").join(I.expected(spark, d).withColumn("ok", F.lit(True)), ["query_id", "doc_id"], "left").select("query_id", F.coalesce("ok", F.lit(False)).alias("correct"))
    return gap.join(right, "query_id").groupBy("correct").agg(F.count("*").alias("n"), F.round(F.min("gap"), 6).alias("lo"), F.round(F.max("gap"), 6).alias("hi"))


@query(R._ALL + ", g as (select coalesce(want, []) as want, [] as got from ev) select (select count(*) from ev where len(want) = 0) as foreign_silent_right, (select count(*) from ev where len(want) > 0) as own_silent_wrong, (select round(avg(case when len(want) > 0 then len(list_intersect(coalesce(g.got, []), want))::double / len(want) end), 6) from ev left join got g using (query_id)) as recall_answer_all")
def degenerate_witnesses(spark, d):
    """Always silent, and answer all: the two ends of any threshold."""
    none = F.array().cast("array<bigint>")
    rows = R.evaluated(spark, d).drop("got").join(G.ranked_list(R.composed(spark, d), "all"), "query_id", "left").withColumn("all", F.coalesce("all", none))
    return rows.agg(F.count_if(F.size("want") == 0).alias("foreign_silent_right"), F.count_if(F.size("want") > 0).alias("own_silent_wrong"), F.round(F.avg(E.recall(F.col("all"), F.col("want"), 5)), 6).alias("recall_answer_all"))


@query(f"with {R._arms()}, {S.EXPECTED} select query_id, doc_id, score from lex where rank = 1 and query_id not in (select query_id from expected)")
def foreign_top_scores(spark, d):
    return R.lexical_arm(spark, d).where("rank = 1").join(I.expected(spark, d).select("query_id").distinct(), "query_id", "left_anti").select("query_id", "doc_id", "score")


@query("select b.item_id as query_id, count(*) as n_articles from benchmark b join documents d on contains(lower(strip_accents(d.text)), lower(strip_accents(split_part(b.text, ' ', 1) || ' ' || split_part(b.text, ' ', 2) || ' ' || split_part(b.text, ' ', 3)))) group by 1")
def foreign_term_check(spark, d):
    """Articles in which the first three words of a question stand, folded; the questions are few and broadcast after a count."""
    from attesta.functions.text import fold

    b = I.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), fold(F.array_join(F.slice(F.split("text", " "), 1, 3), " ")).alias("term"))
    docs = I.table(spark, d, "documents").select(fold(F.col("text")).alias("folded"))
    return docs.join(L.small(b, 10_000), F.contains(F.col("folded"), F.col("term"))).groupBy("query_id").agg(F.count("*").alias("n_articles"))


@query()
def footnote_sequence(spark, d):
    """Notes of every document, its lines read as footnotes whose numbers come from their place; held by literal tests."""
    ln = Q.lines(spark, d)
    text = F.when(F.col("n") % 3 == 0, F.concat((F.floor(F.col("n") / 3) + 1).cast("string"), F.lit(" - "), "text")).otherwise(F.col("text"))
    return X.footnotes(ln.select("doc", "n", text.alias("text"))).select("doc", "note", F.length("text").alias("n_chars"))


@query("select count(*) as n, count(*) filter (len(regexp_extract_all(text, '\\b(articles?)(\\d)')) > 0) as n_touched, cast(0 as bigint) as n_notes from documents")
def named_corrections(spark, d):
    _, notes, total = X.corrected(F.col("text"))
    return I.table(spark, d, "documents").select(total.alias("t"), F.size(notes).alias("k")).agg(F.count("*").alias("n"), F.count_if(F.col("t") > 0).alias("n_touched"), F.sum(F.col("k").cast("long")).alias("n_notes"))


@query("select doc_id, 'article ' || doc_id || case when source is not null then ', ' || source || ' — ' || lang else '' end as citation from documents")
def display_citation(spark, d):
    docs = I.table(spark, d, "documents")
    return docs.select("doc_id", X.display(F.col("doc_id").cast("string"), [(F.col("source"), F.col("lang"))]).alias("citation"))


@query("select conv_id, turn, coalesce(nullif(trim(split_part(f, ',', 1)), ''), 'direct') as caller from (select conv_id, turn, case when turn % 2 = 0 then ' 10.0.0.' || turn || ', 10.1.1.1' else '' end as f from conversations)")
def forwarded_caller(spark, d):
    from attesta.functions.text import caller

    f = F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" 10.0.0."), F.col("turn").cast("string"), F.lit(", 10.1.1.1"))).otherwise("")
    return I.table(spark, d, "conversations").select("conv_id", "turn", caller(F.lit("direct"), f).alias("caller"))
