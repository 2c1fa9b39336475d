"""Dense, fusion, signal and evaluation queries with their SQL twins."""

from __future__ import annotations


from pyspark.sql import functions as F

from attesta.operators import dense as D
from attesta.operators import evaluate as E
from attesta.operators import fusion as U
from attesta.operators import lexical as L
from attesta.operators import matrix as M
from attesta.operators import signals as G
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


# --- dense ------------------------------------------------------------------------------------


def _passages(spark, d):
    return I.vectors(spark, d).select(F.col("vec_id").alias("doc_id"), "v", F.col("label").cast("long").alias("numero"))


def _vqueries(spark, d):
    return I.vectors(spark, d).where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "v")


_V = """p as (select vec_id as doc_id, embedding::double[] as v, label from embeddings),
vq as (select vec_id as query_id, embedding::double[] as qv from embeddings where vec_id % 20 = 0)"""


@query(f"with {_V}, scored as (select query_id, doc_id, round(list_dot_product(v, qv), 6) as score from p cross join vq), {S.top(5)} select query_id, doc_id, score, rank from ranked")
def cosine_topk(spark, d):
    return L.top(D.cosine(_passages(spark, d), _vqueries(spark, d), 5), 5).select("query_id", "doc_id", "score", "rank")


@query(f"with {_V}, scored as (select query_id, label::bigint as doc_id, round(max(list_dot_product(v, qv)), 6) as score from p cross join vq group by all), {S.top(5)} select query_id, doc_id, score, rank from ranked")
def cosine_maxpool(spark, d):
    return L.top(D.pooled_cosine(_passages(spark, d), _vqueries(spark, d)), 5).select("query_id", "doc_id", "score", "rank")


_CENTRED = f"""with {_V}, m as (select list(a order by i) as mean from (select i, avg(x) as a from (select unnest(v) as x, generate_subscripts(v, 1) as i from p) group by i)),
cp as (select doc_id, list_transform(list_zip(v, mean), lambda z: z[1] - z[2]) as v from p cross join m),
cq as (select query_id, list_transform(list_zip(qv, mean), lambda z: z[1] - z[2]) as qv from vq cross join m),
scored as (select query_id, doc_id, round(list_dot_product(v, qv) / greatest(sqrt(list_dot_product(v, v)), 1e-12::double) / greatest(sqrt(list_dot_product(qv, qv)), 1e-12::double), 6) as score from cp cross join cq)"""


@query(f"{_CENTRED}, {S.top(5)} select query_id, doc_id, score, rank from ranked")
def centered_cosine_topk(spark, d):
    p, q = _passages(spark, d), _vqueries(spark, d)
    mean = D.mean_vector(p)
    return L.top(D.cosine(D.centred(p, mean), D.centred(q, mean), 5), 5).select("query_id", "doc_id", "score", "rank")


@query("select vec_id, cast(len(embedding) as int) as dim, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as norm, abs(sqrt(list_dot_product(embedding::double[], embedding::double[])) - 1) <= 1e-4 as unit from embeddings")
def norm_audit(spark, d):
    n = D.norm(F.col("v"))
    return I.vectors(spark, d).select("vec_id", F.size("v").alias("dim"), F.round(n, 6).alias("norm"), (F.abs(n - 1) <= 1e-4).alias("unit"))


@query("select round(max(abs(a - b)), 9) as max_abs, round(avg(abs(a)), 9) as mean_abs from (select unnest(embedding::double[]) as a, unnest(list_transform(embedding::double[], lambda x: x / greatest(sqrt(list_dot_product(embedding::double[], embedding::double[])), 1e-12::double))) as b from embeddings)")
def vector_equivalence(spark, d):
    v = I.vectors(spark, d).select(F.col("vec_id").alias("doc_id"), "v")
    return D.difference(v, v.withColumn("v", D.normalise(F.col("v"))))


# --- two arms over the question set -----------------------------------------------------------------

DEPTH = 50


def lexical_arm(spark, d, depth=DEPTH):
    return I.once(spark, ("lexical", d, depth), lambda: L.top(M.bm25(I.counts(spark, d), I.questions(spark, d), depth), depth))


def dense_arm(spark, d, depth=DEPTH):
    return I.once(spark, ("dense", d, depth), lambda: _dense_arm(spark, d, depth))


def _dense_arm(spark, d, depth):
    """Without an embedding model the idf floor stands in for the dense arm, scaled into [0, 1] as cosines are."""
    from attesta.functions import text as T

    arm = L.top(M.idf_overlap(I.counts(spark, d, T.floor_tokens, 0), I.questions(spark, d, T.floor_tokens), depth), depth)
    return arm.withColumn("score", F.round(F.col("score") / (F.col("score") + 100), 6))


def _arms(depth: int = DEPTH) -> str:
    from attesta.functions import text as T

    floor = f"{S.bags(0, T.STOP_FLOOR, 2)}, {S.questions(T.STOP_FLOOR, 2)}, s0 as (select query_id, doc_id, round(sum(ln(n / (1.0::double + df))), 6) as score from d join dfs using (term) join q using (term) cross join st group by query_id, doc_id having round(sum(ln(n / (1.0::double + df))), 6) > 0), {S.top(depth, 's0')}"
    return f"""lex as (with {S.bags()}, {S.questions()}, {S.scored()}, {S.top(depth)} select query_id, doc_id, score, rank from ranked),
den as (with {floor} select query_id, doc_id, round(score / (score + 100), 6) as score, rank from ranked),
qs as (select item_id as query_id from benchmark)"""


_FULL = "lex full join den on lex.query_id = den.query_id and lex.doc_id = den.doc_id"
_KEYS = "coalesce(lex.query_id, den.query_id) as query_id, coalesce(lex.doc_id, den.doc_id) as doc_id"


def _rank(k: int, source: str = "f") -> str:
    return f"select query_id, doc_id, score, cast(row_number() over (partition by query_id order by score desc, coalesce(rl, 1000000), doc_id) as int) as rank from {source} qualify rank <= {k}"


def _rrf(c: int = 60, k: int = 5) -> str:
    return f"f as (select {_KEYS}, round(coalesce(1.0::double / ({c} + lex.rank), 0) + coalesce(1.0::double / ({c} + den.rank), 0), 9) as score, lex.rank as rl, den.rank as rd from {_FULL}), rrf as ({_rank(k)})"


@query(f"with {_arms()}, {_rrf()} select * from rrf")
def rrf_fusion(spark, d):
    return U.rrf(lexical_arm(spark, d), dense_arm(spark, d)).select("query_id", "doc_id", "score", "rank")


@query("with " + _arms() + ", " + f"ovl as (with {S.bags(0)}, {S.questions()}, sc as (select query_id, doc_id, cast(count(*) as double) as score from d join q using (term) group by all), {S.top(50, 'sc')} select query_id, doc_id, score, rank from ranked), u as (select query_id, doc_id, rank, 0 as arm from lex union all select query_id, doc_id, rank, 1 from den union all select query_id, doc_id, rank, 2 from ovl), f as (select query_id, doc_id, round(sum(1.0::double / (60 + rank)), 9) as score, max(case when arm = 0 then rank end) as rl from u group by all) " + _rank(5))
def rrf_nway(spark, d):
    third = L.top(M.overlap(I.counts(spark, d, title_weight=0), I.questions(spark, d), DEPTH), DEPTH)
    return U.rrf(lexical_arm(spark, d), dense_arm(spark, d), third).select("query_id", "doc_id", "score", "rank")


_SCALE = "case when max(score) over (partition by query_id) <= min(score) over (partition by query_id) then 1.0::double else (score - min(score) over (partition by query_id)) / (max(score) over (partition by query_id) - min(score) over (partition by query_id)) end"


@query(f"with {_arms()}, u as (select query_id, doc_id, rank, 0 as arm, {_SCALE} as s from lex union all select query_id, doc_id, rank, 1, {_SCALE} from den), f as (select query_id, doc_id, round(sum(s), 6) as score, max(case when arm = 0 then rank end) as rl from u group by query_id, doc_id) " + _rank(5))
def minmax_fusion(spark, d):
    return U.min_max(lexical_arm(spark, d), dense_arm(spark, d)).select("query_id", "doc_id", "score", "rank")


def _composed(head: int = 3, k: int = 5, complete: bool = True) -> str:
    rest = f" union all select query_id, doc_id, score, rank, 2, 'dense' from den where rank > {min(head, k)}" if complete else ""
    return f"""cu as (select query_id, doc_id, score, rank, 0 as prio, 'dense' as arm from den where rank <= {min(head, k)} union all select query_id, doc_id, score, rank, 1, 'lexical' from lex{rest}),
cb as (select query_id, doc_id, min(row(prio, rank, score, arm)) as b from cu group by all),
comp as (select query_id, doc_id, b[3] as score, b[4] as arm, cast(row_number() over (partition by query_id order by b[1], b[2]) as int) as rank from cb qualify rank <= {k})"""


def composed(spark, d, head=3, k=5, complete=True):
    return U.compose(dense_arm(spark, d), lexical_arm(spark, d), k, head, complete)


@query(f"with {_arms()}, {_composed()} select query_id, doc_id, score, arm, rank from comp")
def head_tail_compose(spark, d):
    return composed(spark, d)


@query(" union all ".join(f"select {h} as head, * from (with {_arms()}, {_composed(h, 5, False)} select query_id, doc_id, score, arm, rank from comp)" for h in (2, 4)))
def head_tail_variants(spark, d):
    return composed(spark, d, 2, 5, False).select(F.lit(2).alias("head"), "*").unionByName(composed(spark, d, 4, 5, False).select(F.lit(4).alias("head"), "*"))


@query(f"with {_arms()}, {S.EXPECTED}, a as (select query_id, min(rank) as rank_lexical from lex join expected using (query_id, doc_id) group by 1), b as (select query_id, min(rank) as rank_dense from den join expected using (query_id, doc_id) group by 1) select coalesce(a.query_id, b.query_id) as query_id, rank_lexical, rank_dense, least(rank_lexical, rank_dense) as rank_best from a full join b on a.query_id = b.query_id")
def oracle_arm(spark, d):
    return U.best_arm(lexical_arm(spark, d), dense_arm(spark, d), I.expected(spark, d))


SWEEP = (1, 2, 5, 10, 20, 120)


@query(" union all ".join(f"select {c} as constant, {dep} as depth, * from (with {_arms(dep)}, {_rrf(c, 3)} select * from rrf)" for c in SWEEP for dep in (10, 20)))
def rrf_sweep(spark, d):
    out = None
    for c, dep in [(c, dep) for c in SWEEP for dep in (10, 20)]:
        part = U.rrf(lexical_arm(spark, d, dep), dense_arm(spark, d, dep), k=3, constant=c).select(F.lit(c).alias("constant"), F.lit(dep).alias("depth"), "query_id", "doc_id", "score", "rank")
        out = part if out is None else out.unionByName(part)
    return out


# --- signals and decision ---------------------------------------------------------------------------

_SIGNALS = f"""sig as (select qs.query_id, coalesce(max(score) filter (rank = 1), 0) as proximity,
 case when count(rank) < 2 or max(score) filter (rank = 1) <= 0 then 0 else (max(score) filter (rank = 1) - max(score) filter (rank = 2)) / max(score) filter (rank = 1) end as margin,
 coalesce(max(score) filter (rank = 1) - max(score) filter (rank = 2), 0) as gap, coalesce(avg(score) filter (rank <= 3), 0) as mass3, coalesce(avg(score) filter (rank <= 5), 0) as mass5 from qs left join den using (query_id) group by 1),
agr as (select qs.query_id, count(a.doc_id) as agree from qs left join (select den.query_id, den.doc_id from den join lex using (query_id, doc_id) where den.rank <= 5 and lex.rank <= 5) a using (query_id) group by 1),
cov as (with {S.bags()}, {S.questions()}, p as (select query_id, count(*) as n_terms, count(df) as n_known, list_sort(list(term) filter (df is null)) as unknown from q left join dfs using (term) group by query_id)
 select qs.query_id, coalesce(round(n_known::double / n_terms, 3), 0) as coverage, coalesce(unknown, []) as unknown from qs left join p using (query_id))"""


def signals(spark, d):
    q = I.questions(spark, d)
    lex, den = lexical_arm(spark, d), dense_arm(spark, d)
    return G.of_dense(q, den).join(G.agreement(q, den, lex), "query_id").join(I.once(spark, ("coverage", d), lambda: M.coverage(I.counts(spark, d), q).select("query_id", "coverage", "unknown")), "query_id")


@query(f"with {_arms()}, {_SIGNALS} select query_id, round(proximity, 6) as proximity, round(margin, 6) as margin, round(gap, 6) as gap, round(mass3, 6) as mass3, round(mass5, 6) as mass5, agree, round(agree / 5.0::double, 6) as agreement, coverage, -cast(len(unknown) as int) as minus_unknown from sig join agr using (query_id) join cov using (query_id)")
def abstention_signals(spark, d):
    r = lambda c: F.round(c, 6).alias(c)
    return signals(spark, d).select("query_id", *map(r, ("proximity", "margin", "gap", "mass3", "mass5")), "agree", F.round(F.col("agree") / 5, 6).alias("agreement"), "coverage", (-F.size("unknown")).alias("minus_unknown"))


THRESHOLD = 0.6


def _fr(x: str) -> str:
    return f"replace(format('{{:.2f}}', {x}), '.', ',')"


_NOTHING, _NEAR, _FAR = (x.replace("'", "''") for x in (G.NOTHING, G.NEAR, G.FAR))
_WORDS_ONLY, _UNKNOWN = G.WORDS_ONLY.replace("'", "''"), G.UNKNOWN.replace("'", "''")


def _fill(form: str) -> str:
    return f"replace(replace(replace('{form}', '%1$s', cast(head as varchar)), '%2$s', {_fr('proximity')}), '%3$s', {_fr(str(THRESHOLD) + '::double')})"


_DECIDED = f"""{_composed()}, hd as (select query_id, max(doc_id) filter (rank = 1) as head, max(arm) filter (rank = 1) as head_arm, count(*) as n_articles from comp group by 1),
dec as (select qs.query_id, head, head_arm, coalesce(n_articles, 0) as n_articles, proximity, unknown, coalesce(n_articles, 0) > 0 and proximity >= {THRESHOLD} as sure from qs left join hd using (query_id) join sig using (query_id) join cov using (query_id))"""


def decided(spark, d, threshold=THRESHOLD):
    at = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c)))
    heads = composed(spark, d).groupBy("query_id").agg(at("doc_id").alias("head"), at("arm").alias("head_arm"), F.count("*").alias("n_articles"))
    out = signals(spark, d).join(heads, "query_id", "left").withColumn("n_articles", F.coalesce("n_articles", F.lit(0)))
    return out.withColumn("sure", G.decide(F.col("proximity"), F.col("n_articles"), threshold))


@query(f"""with {_arms()}, {_SIGNALS}, {_DECIDED} select query_id, head, n_articles, sure,
case when head is null then '{_NOTHING}' when head_arm <> 'dense' then {_fill(_WORDS_ONLY)} when proximity >= {THRESHOLD} then {_fill(_NEAR)}
else {_fill(_FAR)} || case when len(unknown) > 0 then replace('{_UNKNOWN}', '%1$s', array_to_string(unknown[1:4], ', ')) else '' end end as why from dec""")
def decision_and_reason(spark, d):
    why = G.explain(F.col("head"), F.col("head_arm"), F.col("proximity"), F.col("unknown"), THRESHOLD)
    return decided(spark, d).select("query_id", "head", "n_articles", "sure", why.alias("why"))


@query(f"with {_arms()}, {_SIGNALS} select query_id, reason <> '' as refused, reason from (select query_id, array_to_string(list_filter([case when coverage < 0.6 then 'mots absents du Code du travail : ' || array_to_string(unknown, ', ') end, case when agree = 0 then 'les deux methodes de recherche ne designent aucun article commun' end], lambda x: x is not null), ' ; ') as reason from agr join cov using (query_id))")
def refusal_rule(spark, d):
    reason = G.refusal(F.col("coverage"), F.col("agree"), F.col("unknown"))
    return signals(spark, d).select("query_id", (reason != "").alias("refused"), reason.alias("reason"))


@query(f"with {_arms()}, {_rrf()}, {_SIGNALS} select query_id, doc_id, score, rank from rrf join agr using (query_id) join cov using (query_id) where not (coverage < 0.6 or agree = 0)")
def rrf_with_refusal(spark, d):
    ok = signals(spark, d).where("not (coverage < 0.6 or agree = 0)").select("query_id")
    return U.rrf(lexical_arm(spark, d), dense_arm(spark, d)).select("query_id", "doc_id", "score", "rank").join(ok, "query_id", "left_semi")


@query(f"with {_arms()}, m as (select query_id, case when count(*) < 2 then 0 else (max(score) filter (rank = 1) - max(score) filter (rank = 2)) / max(score) filter (rank = 1) end as margin from lex where rank <= 2 group by 1) select query_id, doc_id, score, rank, round(margin, 6) as margin from lex join m using (query_id) where rank <= 5 and round(margin, 9) >= 0.04")
def lexical_gated_by_margin(spark, d):
    lex = lexical_arm(spark, d)
    m = G.of_dense(I.questions(spark, d), lex).select("query_id", "margin")
    return lex.where("rank <= 5").join(m, "query_id").where(F.round("margin", 9) >= 0.04).select("query_id", "doc_id", "score", "rank", F.round("margin", 6).alias("margin"))


# --- evaluation -------------------------------------------------------------------------------------

_EVAL = f"""{S.EXPECTED}, ex as (select query_id, list_sort(list(doc_id)) as want from expected group by 1),
got as (select query_id, list(doc_id order by rank) as got from comp group by 1),
ev as (select qs.query_id, coalesce(want, []::bigint[]) as want, case when sure then coalesce(got, []::bigint[]) else []::bigint[] end as got, case when qs.query_id % 2 = 0 then 'reglage' else 'controle' end as half, sure from qs left join ex using (query_id) left join got using (query_id) join dec using (query_id))"""
_ALL = f"with {_arms()}, {_SIGNALS}, {_DECIDED}, {_EVAL}"


def evaluated(spark, d, threshold=THRESHOLD):
    """One row a question: expected and returned identifiers (empty when not sure), half."""
    want = I.expected(spark, d).groupBy("query_id").agg(F.array_sort(F.collect_list("doc_id")).alias("want"))
    got = G.ranked_list(composed(spark, d), "got")
    none = F.array().cast("array<bigint>")
    rows = decided(spark, d, threshold).select("query_id", "sure", "proximity", "margin", "mass5").join(want, "query_id", "left").join(got, "query_id", "left")
    return rows.select("query_id", "sure", "proximity", "margin", "mass5", F.coalesce("want", none).alias("want"), F.when(F.col("sure"), F.coalesce("got", none)).otherwise(none).alias("got"), F.when(F.col("query_id") % 2 == 0, "reglage").otherwise("controle").alias("half"))


def _recall_sql(k: int) -> str:
    return f"case when len(want) > 0 then len(list_intersect(got[1:{k}], want))::double / len(want) end"


@query(_ALL + ", r as (select query_id, " + ", ".join(f"{_recall_sql(k)} as r{k}, case when len(want) > 0 then list_has_any(got[1:{k}], want)::int end as t{k}" for k in (1, 3, 5)) + " from ev) select count(r1) as n_answerable, count(*) as n, " + ", ".join(f"round(avg(r{k}), 6) as recall{k}, round(avg(t{k}), 6) as hit{k}, count(*) filter (r{k} = 1) as all{k}, count(*) filter (t{k} = 0) as none{k}" for k in (1, 3, 5)) + " from r")
def recall_hit_at_k(spark, d):
    return E.recall_report(evaluated(spark, d))


@query(_ALL + " select count(*) filter (len(want) = 0) as n_foreign, round(avg((len(got) = 0)::int) filter (len(want) = 0), 6) as abstention, round(avg(len(got)) filter (len(want) = 0), 6) as noise, count(*) filter (len(want) > 0) as n_answerable, round(avg((len(got) = 0)::int) filter (len(want) > 0), 6) as evasion from ev")
def abstention_rates(spark, d):
    return E.abstention_report(evaluated(spark, d))


@query(_ALL + f", r as (select half, case when len(want) > 1 then 'plusieurs' when len(want) = 1 then 'un' else 'aucun' end as label, {_recall_sql(5)} as r5, (len(got) = 0)::int as silent from ev) select coalesce(label, 'total') as label, coalesce(half, 'tous') as half, count(*) as n, round(avg(r5), 6) as recall5, round(avg(silent), 6) as silence from r group by grouping sets ((label, half), (label), ())")
def per_label_recall(spark, d):
    label = F.when(F.size("want") > 1, "plusieurs").when(F.size("want") == 1, "un").otherwise("aucun")
    return E.by_label(evaluated(spark, d).withColumn("label", label))


@query(_ALL + ", x as (select query_id, unnest(got) as doc_id, generate_subscripts(got, 1) as place from ev) select query_id, cast(min(place) as int) as first_rank from x join expected using (query_id, doc_id) group by 1")
def first_hit_rank(spark, d):
    got = evaluated(spark, d).select("query_id", F.posexplode("got").alias("p", "doc_id")).select("query_id", "doc_id", (F.col("p") + 1).alias("rank"))
    return U.first_ranks(got, I.expected(spark, d))


@query(f"with {_arms()}, pr as (select a.item_id as a, b.item_id as b from benchmark a join benchmark b on b.item_id = a.item_id + 1), g as (select query_id, list(doc_id order by rank) as got from lex where rank <= 5 group by 1) select a, b, ga[1:3] = gb[1:3] as same_top3, cast(len(list_intersect(ga[1:3], gb[1:3])) as int) as common3, cast(len(list_intersect(ga, gb)) as int) as common5 from (select a, b, coalesce(x.got, []) as ga, coalesce(y.got, []) as gb from pr left join g x on x.query_id = a left join g y on y.query_id = b) where len(ga) + len(gb) > 0")
def pair_displacement(spark, d):
    q = I.table(spark, d, "benchmark").select(F.col("item_id").alias("a"))
    pairs = q.join(q.select(F.col("a").alias("b")), F.col("b") == F.col("a") + 1)
    return E.displacement(pairs, G.ranked_list(lexical_arm(spark, d), "got", 5))


@query("select lang, source, count(*) as n, count(distinct text) as n_texts, grouping(source) as level from documents group by rollup (lang, source)")
def coverage_rollup(spark, d):
    docs = I.table(spark, d, "documents")
    h = F.sha2(F.col("text").cast("binary"), 256)
    return docs.select("lang", "source", h.alias("h")).rollup("lang", "source").agg(F.count("*").alias("n"), F.count_distinct("h").alias("n_texts"), F.grouping("source").cast("long").alias("level"))


@query("select lang, sum((source = 'src0')::int) as src0, sum((source = 'src1')::int) as src1, count(*) as total from documents group by cube (lang)".replace("sum((source = 'src0')::int)", "cast(sum((source = 'src0')::int) as bigint)").replace("sum((source = 'src1')::int)", "cast(sum((source = 'src1')::int) as bigint)"))
def composition_pivot(spark, d):
    docs = I.table(spark, d, "documents").select("lang", "source")
    return docs.cube("lang").agg(F.sum((F.col("source") == "src0").cast("int")).alias("src0"), F.sum((F.col("source") == "src1").cast("int")).alias("src1"), F.count("*").alias("total"))


@query(f"with {S.EXPECTED}, t as (select query_id, doc_id from expected union select query_id, doc_id + 1 from expected) select (select count(*) from expected) as n_expected, (select count(distinct doc_id) from expected) as n_distinct, (select count(distinct doc_id) from t) as n_union")
def expected_accounting(spark, d):
    e = I.expected(spark, d)
    tolerated = e.select("query_id", (F.col("doc_id") + 1).alias("doc_id"))
    marked = e.withColumn("own", F.lit(1)).unionByName(tolerated.withColumn("own", F.lit(0)))
    return marked.agg(F.sum("own").alias("n_expected"), F.count_distinct(F.when(F.col("own") == 1, F.col("doc_id"))).alias("n_distinct"), F.count_distinct("doc_id").alias("n_union"))


@query(_ALL + ", s as (select query_id, half, proximity, len(want) > 0 as own, coalesce(list_has_any(got[1:1], want), false) as right1 from ev join sig using (query_id)) select half, own, count(*) as n, round(avg(right1::int), 6) as accuracy1, round(min(proximity), 6) as lo, round(max(proximity), 6) as hi from s group by half, own")
def register_split(spark, d):
    ev = evaluated(spark, d)
    right = F.coalesce(F.arrays_overlap(F.slice("got", 1, 1), "want"), F.lit(False))
    return ev.select("half", (F.size("want") > 0).alias("own"), right.cast("int").alias("r"), "proximity").groupBy("half", "own").agg(F.count("*").alias("n"), F.round(F.avg("r"), 6).alias("accuracy1"), F.round(F.min("proximity"), 6).alias("lo"), F.round(F.max("proximity"), 6).alias("hi"))


