"""Threshold studies with their SQL twins. Cases: labelled documents; own = good quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import thresholds as P
from attesta.plans import inputs as I

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def cases(spark, d):
    """id, own, signals: length (thousands of characters), density (words a character), blend (mean of both); half; recall."""
    docs = I.table(spark, d, "documents").select("doc_id", "text")
    labels = I.table(spark, d, "labels").select("doc_id", "quality", "toxic")
    x = F.col("text")
    length = F.round(F.length(x) / 1000, 3)
    density = F.round(F.try_divide(F.size(F.split(x, " ")), F.length(x)), 4)
    rows = docs.select("doc_id", length.alias("length"), density.alias("density")).join(labels, "doc_id")
    return rows.select(
        F.col("doc_id").alias("id"),
        (F.col("quality") == 1).alias("own"),
        "length",
        "density",
        F.round((F.col("length") + F.col("density")) / 2, 4).alias("blend"),
        F.when(F.col("doc_id") % 2 == 0, "reglage").otherwise("controle").alias("half"),
        (1.0 - F.col("toxic")).alias("recall"),
    )


_C = """c as (select l.doc_id as id, quality = 1 as own, length, density, round((length + density) / 2, 4) as blend, case when l.doc_id % 2 = 0 then 'reglage' else 'controle' end as half, 1.0::double - toxic as recall
 from (select doc_id, round(length(text) / 1000.0::double, 3) as length, round(len(string_split(text, ' '))::double / nullif(length(text), 0), 4) as density from documents) x join labels l using (doc_id))"""


def _auc(s: str) -> str:
    return f"select '{s}' as signal, (select count(*) from c where own and {s} is not null) as n_pos, (select count(*) from c where not own and {s} is not null) as n_neg, round(avg(case when p.{s} > n.{s} then 1.0::double when p.{s} = n.{s} then 0.5::double else 0 end), 9) as auc from c p join c n on p.own and not n.own"


@query(f"with {_C}, a as ({_auc('length')} union all {_auc('density')} union all {_auc('blend')}) select *, auc < 0.5 as inverted from a")
def auc_rank_sum(spark, d):
    return P.leaderboard(cases(spark, d), ("length", "density", "blend"))


_SWEEP = "t as (select distinct length + 1e-12::double as threshold from c union all select '-infinity'::double), sw as (select threshold, count(*) filter (not own and length >= threshold) as false_accepts, count(*) filter (own and length < threshold) as false_refusals from t cross join c group by 1)"


@query(f"with {_C}, {_SWEEP} select false_accepts, (min(row(false_refusals, threshold)))[1] as false_refusals, round((min(row(false_refusals, threshold)))[2], 6) as threshold from sw group by 1")
def pareto_frontier(spark, d):
    return P.frontier(P.sweep(cases(spark, d), "length")).withColumn("threshold", F.round("threshold", 6))


@query(f"with {_C}, e as (select own, cast(floor(length) as bigint) as l, cast(floor(density * 100) as bigint) as r from c), g as (select a, b, count(*) filter (not own and l >= a and r >= b) as false_accepts, (select count(*) from e where own) - count(*) filter (own and l >= a and r >= b) as false_refusals, count(*) filter (l >= a and r >= b) as kept from e cross join (select distinct l as a from e) cross join (select distinct r as b from e where r is not null) group by a, b having count(*) filter (l >= a and r >= b) > 0) select false_accepts, m[1] as false_refusals, m[2] as a, m[3] as b from (select false_accepts, min(row(false_refusals, a, b)) as m from g group by 1)")
def pareto_two_signal(spark, d):
    """Signals in whole classes (thousands of characters, hundredths of a word a character)."""
    rounded = cases(spark, d).select("own", F.floor("length").alias("l"), F.floor(F.col("density") * 100).alias("r"))
    return P.frontier_of_two(rounded, "l", "r")


_RULES = {"tout": "true", "rien": "false", "longueur": "length >= 1", "densite": "density >= 0.15", "les_deux": "length >= 1 and density >= 0.15", "l_un": "length >= 3 or density >= 0.17"}


@query(f"with {_C} " + " union all ".join(f"select '{n}' as rule, round(avg(case when {r} then recall else 0 end) filter (own), 6) as recall, count(*) filter (own) as n_own from c where half = 'controle'" for n, r in _RULES.items()))
def recall_under_rule(spark, d):
    held = cases(spark, d).where("half = 'controle'")
    row = held.agg(F.count_if("own").alias("n_own"), *[P.recall_under(held, F.expr(r), "recall")[0].alias(f"r{i}") for i, r in enumerate(_RULES.values())])
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").alias("recall"), F.col("n_own")) for i, n in enumerate(_RULES)])).alias("x")).select("x.*")


@query(f"with {_C} " + " union all ".join(f"select '{n}' as rule, count(*) filter ({r}) as answered, count(*) filter (({r}) and not own) as false_accepts, count(*) filter (not ({r}) and own) as false_refusals, round(avg(({r})::int) filter (own), 6) as service from c" for n, r in _RULES.items()))
def rule_table(spark, d):
    return P.rule_table(cases(spark, d), {n: F.expr(r) for n, r in _RULES.items()})


@query(f"with {_C}, k as (select count(*) as n, corr(length, density) as c from c) select n, round(c, 6) as correlation, case when c is null then 'indefinie' when c > 0.3 then 'positive' when c < -0.3 then 'negative' else 'nulle' end as band from k")
def signal_correlation(spark, d):
    return P.correlation(cases(spark, d), "length", "density")


@query(f"with {_C}, s as (select own as g, list(length order by length) as v, count(*) as n, quantile_cont(length, 0.5) as median, quantile_cont(length, 0.95) as p95 from c where length is not null group by own) select g, n, round(v[1], 6) as lo, round(median, 6) as median, round(v[n // 2 + 1], 6) as upper_median, round(p95, 6) as p95, round(v[cast(floor(n * 0.95::double) as bigint) + 1], 6) as p95_index, round(v[-1], 6) as hi from s")
def signal_quantiles(spark, d):
    return P.quantiles(cases(spark, d), "length", "own")


_EDGES = (0.0, 0.5, 1.0, 2.0, 4.0, 8.0, 1000.0)


@query(f"with {_C}, h as (select own as g, case " + " ".join(f"when length >= {a} and length < {b} then {a}::double" for a, b in zip(_EDGES, _EDGES[1:], strict=False)) + " end as lo from c) select g, lo, count(*) as n from h where lo is not null group by all")
def signal_histogram(spark, d):
    return P.histogram(cases(spark, d), "length", _EDGES, "own")


@query(f"with {_C}, s as (select own as g, list(length order by length) as v, count(*) as n from c group by own having count(*) > 1), q as (select g, n, v, p, least(greatest(p * (n + 1), 1.0::double), n::double) as pos from s cross join (select unnest([0.1::double, 0.25, 0.5, 0.75, 0.9]) as p)) select g, p, round(v[floor(pos)::bigint] + (v[least(floor(pos)::bigint + 1, n)] - v[floor(pos)::bigint]) * (pos - floor(pos)), 6) as value from q")
def exclusive_quantiles(spark, d):
    return P.exclusive_quantiles(cases(spark, d), "length", "own", (0.1, 0.25, 0.5, 0.75, 0.9))


@query(f"with {_C}, o as (select distinct length as v from c), n as (select v, row_number() over (order by v) - 1 as i, count(*) over () as m from o), k as (select v from n where i % greatest(m // 10, 1) = 0) select v as threshold, count(*) filter (not own and length >= v) as false_accepts, count(*) filter (own and length < v) as false_refusals from k cross join c group by v")
def threshold_table(spark, d):
    """About ten thresholds, evenly spaced over the distinct values; the stride runs over the bucketed running count."""
    c = P.counts(cases(spark, d), "length").withColumn("one", F.lit(1).cast("long"))
    run = P.running(c, "v", "one", "pos", "neg")
    m = c.agg(F.count("*").alias("m"), F.sum("neg").alias("neg"))
    stride = F.greatest(F.floor(m.select("m").scalar() / 10), F.lit(1))
    return run.where((F.col("upto_one") - 1) % stride == 0).select(F.col("v").alias("threshold"), (m.select("neg").scalar() - F.col("upto_neg") + F.col("neg")).alias("false_accepts"), (F.col("upto_pos") - F.col("pos")).alias("false_refusals"))


@query(f"with {_C} select side, m[2] as id, round(m[3], 6) as v from (select case when length >= 1 then 'au-dessus' else 'en dessous' end as side, min(row(abs(length - 1), id, length)) as m from c group by 1)")
def nearest_to_threshold(spark, d):
    return P.nearest(cases(spark, d), "length", 1.0)


@query(f"with {_C} select id, own, case when own = (density * 6 >= 1) then 'gagne' else 'perdu' end as effect from c where (length >= 1) <> (density * 6 >= 1)")
def decision_flips(spark, d):
    return P.flips(cases(spark, d).withColumn("scaled", F.col("density") * 6), "length", "scaled", 1.0)


@query(f"with {_C} select id, round(length - blend, 6) as drop from c order by drop desc, id limit 8")
def worst_drops(spark, d):
    return P.worst(cases(spark, d), "length", "blend")


@query(f"with {_C} select coalesce(cast(own as varchar), 'tous') as camp, coalesce(half, 'tous') as half, count(*) as n, round(avg(length), 6) as mean_length from c group by cube (own, half)")
def camp_composition(spark, d):
    return cases(spark, d).cube("own", "half").agg(F.count("*").alias("n"), F.round(F.avg("length"), 6).alias("mean_length")).select(F.coalesce(F.col("own").cast("string"), F.lit("tous")).alias("camp"), F.coalesce("half", F.lit("tous")).alias("half"), "n", "mean_length")


@query(f"with {_C}, g as (select unnest([0.25::double, 0.5, 1, 2, 4]) as t) select t as threshold, count(*) filter (own and length >= t) as served, count(*) filter (not own and length >= t) as foreign_served, count(*) filter (own) as n_own from g cross join c group by t")
def lower_threshold_price(spark, d):
    grid = (0.25, 0.5, 1.0, 2.0, 4.0)
    own, v = F.col("own"), F.col("length")
    row = cases(spark, d).agg(F.count_if(own).alias("n_own"), *[x for i, t in enumerate(grid) for x in (F.count_if(own & (v >= t)).alias(f"s{i}"), F.count_if(~own & (v >= t)).alias(f"f{i}"))])
    return row.select(F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"s{i}").alias("served"), F.col(f"f{i}").alias("foreign_served"), F.col("n_own")) for i, t in enumerate(grid)])).alias("x")).select("x.*")
