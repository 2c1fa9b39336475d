"""Text and lexical queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.operators import lexical as L
from attesta.operators import matrix as M
from attesta.plans import inputs as I
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


_WITH = f"with {S.bags()}, {S.questions()}, {S.scored()}"


@query(_WITH + f", {S.top(5)} select query_id, doc_id, score, rank from ranked")
def bm25_topk(spark, d):
    return L.top(L.bm25(I.index(spark, d), I.questions(spark, d)), 5).select("query_id", "doc_id", "score", "rank")


@query(f"with {S.bags(0, T.STOP_WITNESS, 2)}, {S.questions(T.STOP_WITNESS, 2)}, {S.scored(1.5)}, {S.top(5)} select query_id, doc_id, score, rank from ranked")
def bm25_k15_witness(spark, d):
    return L.top(L.bm25(I.index(spark, d, T.witness_tokens, 0), I.questions(spark, d, T.witness_tokens), L.WITNESS), 5).select("query_id", "doc_id", "score", "rank")


@query(" union all ".join(f"select {w} as title_weight, * from (with {S.bags(w)}, {S.questions()}, {S.scored()}, {S.top(3)} select query_id, doc_id, score, rank from ranked)" for w in (0, 1, 3, 5)))
def bm25_title_weights(spark, d):
    out = None
    for w in (0, 1, 3, 5):
        part = L.top(L.bm25(I.index(spark, d, title_weight=w), I.questions(spark, d), L.Okapi(title_weight=w)), 3).select(F.lit(w).alias("title_weight"), "query_id", "doc_id", "score", "rank")
        out = part if out is None else out.unionByName(part)
    return out


def _no_stop(c):
    return T.tokens(c, ())


def _no_stop_sql(c):
    return S.toks(c, ())


@query(f"with {S.bags(2, ())}, {S.questions(())}, {S.scored()}, {S.top(5)} select query_id, doc_id, score, rank from ranked")
def bm25_without_stop_list(spark, d):
    return L.top(L.bm25(I.index(spark, d, _no_stop), I.questions(spark, d, _no_stop)), 5).select("query_id", "doc_id", "score", "rank")


_GRID = ((0.9, 0.4), (1.2, 0.5), (2.0, 0.75))


@query(" union all ".join(f"select {k1}::double as k1, {b}::double as b, * from (with {S.bags()}, {S.questions()}, {S.scored(k1, b)}, {S.top(3)} select query_id, doc_id, score, rank from ranked)" for k1, b in _GRID))
def bm25_parameter_grid(spark, d):
    out = None
    for k1, b in _GRID:
        part = L.top(M.bm25(I.counts(spark, d), I.questions(spark, d), 3, L.Okapi(k1, b)), 3).select(F.lit(k1).alias("k1"), F.lit(b).alias("b"), "query_id", "doc_id", "score", "rank")
        out = part if out is None else out.unionByName(part)
    return out


def _stem_sql(x: str, least: int = 3) -> str:
    cases = " ".join(f"when ends_with({x}, '{s}') then (case when length({x}) - {len(s)} >= {least} then left({x}, length({x}) - {len(s)}) else {x} end)" for s in T.SUFFIXES)
    return f"(case when regexp_full_match({x}, '[0-9]+') then {x} {cases} else {x} end)"


def _stem_toks_sql(c: str, least: int = 3) -> str:
    return f"list_transform({S.toks(c)}, lambda y: {_stem_sql('y', least)})"


def _stem_toks(c):
    return T.stemmed(T.tokens(c))


@query(f"with {S.bags(2, body=_stem_toks_sql)}, {S.questions(body=_stem_toks_sql)}, {S.scored()}, {S.top(5)} select query_id, doc_id, score, rank from ranked")
def bm25_stemmed(spark, d):
    return L.top(L.bm25(I.index(spark, d, _stem_toks), I.questions(spark, d, _stem_toks)), 5).select("query_id", "doc_id", "score", "rank")


def _short(c):
    return F.transform(T.words(c), T.short_stem)


def _short_query(c):
    return F.transform(T.tokens(c, T.STOP_FLOOR), T.short_stem)


_SHORT = "(case when length(y) > 4 and ends_with(y, 'aux') then left(y, length(y) - 3) || 'al' when length(y) > 4 and ends_with(y, 'es') then left(y, length(y) - 2) when length(y) > 3 and ends_with(y, 's') then left(y, length(y) - 1) when length(y) > 4 and ends_with(y, 'e') then left(y, length(y) - 1) else y end)"


@query(f"with {S.bags(1, body=lambda c: f'list_transform({S.toks(c, ())}, lambda y: {_SHORT})')}, {S.questions(body=lambda c: f'list_transform({S.toks(c, T.STOP_FLOOR)}, lambda y: {_SHORT})')}, {S.scored()}, {S.top(5)} select query_id, doc_id, score, rank from ranked")
def bm25_query_side_stops(spark, d):
    return L.top(L.bm25(I.index(spark, d, _short, 1), I.questions(spark, d, _short_query), L.Okapi(title_weight=1)), 5).select("query_id", "doc_id", "score", "rank")


_SLICES = "(case when length(y) + 2 <= 4 then ['_' || y || '_'] else list_transform(range(1, length(y) + 2 - 4 + 2), lambda i: substr('_' || y || '_', i, 4)) end)"


def _grams_sql(c: str) -> str:
    return f"flatten(list_transform({S.toks(c, ())}, lambda y: {_SLICES}))"


@query(f"select doc_id, cast(len(g) as int) as n_grams, cast(len(list_distinct(g)) as int) as n_distinct from (select doc_id, {_grams_sql('text')} as g from documents)")
def char_ngrams(spark, d):
    g = T.char_ngrams(F.col("text"))
    return I.documents(spark, d).select("doc_id", g.alias("g")).select("doc_id", F.size("g").alias("n_grams"), F.size(F.array_distinct("g")).alias("n_distinct"))


@query(f"with {S.bags(0, body=_grams_sql)}, {S.questions(body=_grams_sql)}, {S.scored()}, {S.top(5)} select query_id, doc_id, score, rank from ranked")
def bm25_char_ngrams(spark, d):
    return L.top(L.bm25(I.index(spark, d, T.words, 0, T.grams), I.questions(spark, d, T.char_ngrams), L.Okapi(title_weight=0)), 5).select("query_id", "doc_id", "score", "rank")


@query(_WITH + f""", {S.top(5)}, p as (select query_id, doc_id, term, round(sum(part), 3) as part, row_number() over (partition by query_id, doc_id order by round(sum(part), 3) desc, term) as r
  from parts semi join ranked using (query_id, doc_id) group by query_id, doc_id, term qualify r <= 6) select query_id, doc_id, term, part, cast(r as int) as place from p""")
def bm25_contributions(spark, d):
    from pyspark.sql import Window

    docs, q = I.index(spark, d), I.questions(spark, d)
    parts = L.contributions(docs, q)
    kept = L.top(parts.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score")).where("score > 0"), 5)
    each = parts.join(kept.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi").groupBy("query_id", "doc_id", "term").agg(F.round(F.sum("part"), 3).alias("part"))
    order = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("part"), "term")
    return each.withColumn("place", F.row_number().over(order)).where("place <= 6")


@query(_WITH + f""", {S.top(2)}, mass as (select query_id, sum({S.IDF}) as mass from q join dfs using (term) cross join st group by query_id),
best as (select query_id, max(case when rank = 1 then score end) as first, coalesce(max(case when rank = 2 then score end), 0) as second from ranked group by query_id)
select query_id, first, second, round((first - second) / first, 3) as margin, round(first / mass, 3) as saturation from best join mass using (query_id)""")
def saturation_margin(spark, d):
    return L.saturation(I.index(spark, d), I.questions(spark, d))


_FLOOR = f"with {S.bags(0, T.STOP_FLOOR, 2)}, {S.questions(T.STOP_FLOOR, 2)}"


@query(_FLOOR + f", scored as (select query_id, doc_id, cast(count(*) as double) as score from d join q using (term) group by all), {S.top(5)} select query_id, doc_id, score, rank from ranked")
def overlap_topk(spark, d):
    return L.top(M.overlap(I.counts(spark, d, T.floor_tokens, 0), I.questions(spark, d, T.floor_tokens), 5), 5).select("query_id", "doc_id", "score", "rank")


@query(_FLOOR + f", scored as (select query_id, doc_id, round(sum(ln(n / (1.0::double + df))), 6) as score from d join dfs using (term) join q using (term) cross join st group by query_id, doc_id having round(sum(ln(n / (1.0::double + df))), 6) > 0), {S.top(5)} select query_id, doc_id, score, rank from ranked")
def idf_overlap_topk(spark, d):
    return L.top(L.idf_overlap(I.index(spark, d, T.floor_tokens, 0), I.questions(spark, d, T.floor_tokens)), 5).select("query_id", "doc_id", "score", "rank")


@query(f"""with {S.bags()}, {S.questions()}, p as (select query_id, count(*) as n_terms, count(df) as n_known, list_sort(list(term) filter (df is null)) as unknown from q left join dfs using (term) group by query_id)
select item_id as query_id, coalesce(n_terms, 0) as n_terms, coalesce(n_known, 0) as n_known, coalesce(round(n_known::double / n_terms, 3), 0) as coverage, coalesce(array_to_string(unknown, ' '), '') as unknown from benchmark left join p on query_id = item_id""")
def coverage_unknown_terms(spark, d):
    return L.coverage(I.index(spark, d), I.questions(spark, d)).withColumn("unknown", F.array_join("unknown", " "))


@query(f"with {S.bags()} select term, df, round({S.IDF}, 6) as idf, round(ln(n / (1.0::double + df)), 6) as idf_classic from dfs cross join st")
def idf_table(spark, d):
    b = I.index(spark, d)
    n = L.statistics(b).select("n").scalar()
    return L.document_frequency(L.postings(b)).select("term", "df", F.round(L.idf_rsj(n, F.col("df")), 6).alias("idf"), F.round(L.idf_classic(n, F.col("df")), 6).alias("idf_classic"))


@query(f"with {S.bags()} select doc_id, cast(len(toks) as int) as dl, n, round(avgdl, 6) as avgdl from bag cross join st")
def doc_lengths(spark, d):
    b = I.index(spark, d)
    st = L.statistics(b)
    return b.lengths.select("doc_id", "dl", st.select("n").scalar().alias("n"), F.round(st.select("avgdl").scalar(), 6).alias("avgdl"))


@query(f"select doc_id, cast(len({S.toks('text', ())}) as int) as n_words, cast(len({S.toks('text')}) as int) as n_kept, cast(len({S.toks('text', T.STOP_FLOOR, 2)}) as int) as n_floor, cast(len({S.toks('text', T.STOP_WITNESS, 2)}) as int) as n_witness from documents")
def tokenize_stats(spark, d):
    x = F.col("text")
    return I.documents(spark, d).select("doc_id", F.size(T.words(x)).alias("n_words"), F.size(T.tokens(x)).alias("n_kept"), F.size(T.floor_tokens(x)).alias("n_floor"), F.size(T.witness_tokens(x)).alias("n_witness"))


@query(f"select word, {_stem_sql('word')} as stem, {_stem_sql('word', 4)} as stem4, {_stem_sql('word', 2)} as stem2, {_SHORT.replace('y', 'word')} as short from (select distinct unnest({S.toks('text', ())}) as word from documents)".replace("sepwordal", "sepal"))
def light_stem(spark, d):
    w = I.documents(spark, d).select(F.explode(T.words(F.col("text"))).alias("word")).distinct()
    c = F.col("word")
    return w.select("word", T.stem(c).alias("stem"), T.stem(c, 4).alias("stem4"), T.stem(c, 2).alias("stem2"), T.short_stem(c).alias("short"))


@query("select doc_id, lang || ' — ' || source || chr(10) || text as passage from documents where trim(text) <> ''")
def passages(spark, d):
    docs = I.documents(spark, d).where(F.trim("text") != "")
    return docs.select("doc_id", F.concat(T.header(F.col("lang"), F.col("source")), F.lit("\n"), F.col("text")).alias("passage"))


@query("select item_id, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) as key_sha, length(regexp_replace(text, '\\s+', '', 'g')) as n_solid, left(split_part(text, chr(10), 1), 160) as summary, regexp_replace(text, ' +([.,])', '\\1', 'g') as closed from benchmark")
def text_forms(spark, d):
    x = F.col("text")
    return I.table(spark, d, "benchmark").select("item_id", F.sha2(T.duplicate_key(x).cast("binary"), 256).alias("key_sha"), F.length(T.no_blanks(x)).cast("long").alias("n_solid"), T.first_line(x, 160).alias("summary"), T.close_punctuation(x).alias("closed"))


@query("""select id, case when t = '1' or t = 'premier' or t = '1er' then 'premier' else t end as numero from (select id, case when regexp_full_match(raw, '[0-9]+') then cast(cast(raw as bigint) as varchar) else replace(lower(trim(raw)), ' ', '') end as t
from (select item_id as id, case when item_id % 4 = 0 then '00' || item_id when item_id % 4 = 1 then 'Premier ' when item_id % 4 = 2 then '1er' else cast(item_id as varchar) end as raw from benchmark))""")
def article_id_normalise(spark, d):
    i = F.col("item_id")
    raw = F.when(i % 4 == 0, F.concat(F.lit("00"), i.cast("string"))).when(i % 4 == 1, "Premier ").when(i % 4 == 2, "1er").otherwise(i.cast("string"))
    return I.table(spark, d, "benchmark").select(i.alias("id"), T.article_id(raw).alias("numero"))


@query("""with h as (select doc_id % 4096 as bucket, sha256(cast(doc_id as varchar) || chr(0) || text) as h from documents),
b as (select bucket, sha256(string_agg(h, '' order by h)) as h, count(*) as n from h group by bucket)
select sha256(string_agg(h, '' order by bucket)) as fingerprint, cast(sum(n) as bigint) as n from b""")
def corpus_fingerprint(spark, d):
    from attesta.sources.vectors import tree_fingerprint

    return tree_fingerprint(I.documents(spark, d), "doc_id", "text")


@query("select key, count(*) as n, min(doc_id) as first from (select lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as k, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) as key, doc_id from documents) group by key having count(*) > 1")
def overlap_duplicates(spark, d):
    keyed = I.documents(spark, d).select(F.sha2(T.duplicate_key(F.col("text")).cast("binary"), 256).alias("key"), "doc_id")
    return keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")
