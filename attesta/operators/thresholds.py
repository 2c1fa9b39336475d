"""Studies of decision thresholds over cases: ``own`` (in the corpus or not), one or more signals, recalls.

Sweeps use running totals over the distinct values of a signal. Those totals are made in buckets
cut at quantiles (each bucket in a task of its own, then the bucket's offset added), so no
window runs over all cases in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.operators.lexical import small

BUCKETS = 64
EPSILON = 1e-12


def running(values: DataFrame, value: str, *cols: str) -> DataFrame:
    """``values`` (distinct in ``value``) with ``upto_<col>``: the column's total over all smaller or equal values."""
    cuts = sorted(set(values.approxQuantile(value, [i / BUCKETS for i in range(1, BUCKETS)], 0.005))) or [0.0]
    cut_array = F.array(*[F.lit(float(c)) for c in cuts])
    rows = values.withColumn("__b", F.size(F.filter(cut_array, lambda c: c < F.col(value))))
    inner = Window.partitionBy("__b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("__b").agg(*[F.sum(c).alias(c) for c in cols])  # at most BUCKETS rows
    offsets = totals.select("__b", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__o_{c}") for c in cols])
    out = rows.join(F.broadcast(offsets), "__b")
    return out.select(*values.columns, *[(F.sum(c).over(inner) + F.col(f"__o_{c}")).alias(f"upto_{c}") for c in cols])


def counts(cases: DataFrame, signal: str) -> DataFrame:
    """``v``, ``pos``, ``neg`` for each distinct value of the signal."""
    return cases.where(F.col(signal).isNotNull()).groupBy(F.col(signal).cast("double").alias("v")).agg(F.count_if("own").alias("pos"), F.count_if(~F.col("own")).alias("neg"))


def auc(cases: DataFrame, signal: str) -> DataFrame:
    """One row ``n_pos``, ``n_neg``, ``auc``: chance that an own case stands above a foreign one, ties a half; null without both."""
    run = running(counts(cases, signal), "v", "neg")
    below = F.col("pos") * (F.col("upto_neg") - F.col("neg") + F.col("neg") / 2)
    return run.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.round(F.try_divide(F.sum(below), F.sum("pos") * F.sum("neg")), 9).alias("auc"))


def leaderboard(cases: DataFrame, signals: tuple[str, ...]) -> DataFrame:
    """AUC of each signal, marked when it points the other way."""
    out = None
    for s in signals:
        one = auc(cases, s).select(F.lit(s).alias("signal"), "n_pos", "n_neg", "auc", (F.col("auc") < 0.5).alias("inverted"))
        out = one if out is None else out.unionByName(one)
    return out


def sweep(cases: DataFrame, signal: str) -> DataFrame:
    """``threshold``, ``false_accepts``, ``false_refusals`` at minus infinity and just above each value."""
    c = counts(cases, signal)
    run = running(c, "v", "pos", "neg")
    total = c.agg(F.coalesce(F.sum("neg"), F.lit(0)).alias("neg"))
    above = run.select((F.col("v") + EPSILON).alias("threshold"), (total.select("neg").scalar() - F.col("upto_neg")).alias("false_accepts"), F.col("upto_pos").alias("false_refusals"))
    return above.unionByName(total.select(F.lit(float("-inf")).alias("threshold"), F.col("neg").alias("false_accepts"), F.lit(0).cast("long").alias("false_refusals")))


def frontier(swept: DataFrame) -> DataFrame:
    """For each number of false accepts the fewest false refusals, at the lowest threshold that gives them."""
    best = swept.groupBy("false_accepts").agg(F.min(F.struct("false_refusals", "threshold")).alias("b"))
    return best.select("false_accepts", F.col("b.false_refusals").alias("false_refusals"), F.col("b.threshold").alias("threshold"))


def frontier_of_two(cases: DataFrame, left: str, right: str) -> DataFrame:
    """Frontier of the rule left >= a and right >= b over all pairs of observed values.

    Cases are first counted by their pair of values; the grid is then met by those cells, not by cases.
    """
    cells = cases.groupBy(F.col(left).alias("l"), F.col(right).alias("r")).agg(F.count_if("own").alias("pos"), F.count_if(~F.col("own")).alias("neg"))
    a, b = cells.select(F.col("l").alias("a")).distinct(), cells.select(F.col("r").alias("b")).distinct()
    total = cells.agg(F.sum("pos")).scalar()
    met = cells.join(small(a), F.col("l") >= F.col("a")).groupBy("a", "r").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).join(small(b), F.col("r") >= F.col("b"))
    grid = met.groupBy("a", "b").agg(F.sum("neg").alias("false_accepts"), F.sum("pos").alias("kept")).withColumn("false_refusals", total - F.col("kept"))
    best = grid.groupBy("false_accepts").agg(F.min(F.struct("false_refusals", "a", "b")).alias("m"))
    return best.select("false_accepts", "m.false_refusals", "m.a", "m.b")


def few_false_accepts(cases: DataFrame, left: str, right: str, most: int = 4) -> DataFrame:
    """The points of the two-signal frontier with at most ``most`` false accepts."""
    return frontier_of_two(cases, left, right).where(F.col("false_accepts") <= most)


def panel(cases: DataFrame, ids: list, signals: tuple[str, ...], signal: str, threshold: float) -> DataFrame:
    """Named cases with their signals and what the threshold decides for them."""
    return cases.where(F.col("id").isin(*ids)).select("id", "own", *signals, F.when(F.col(signal) >= threshold, "repond").otherwise("se tait").alias("verdict"))


def signal_sweep(rows: DataFrame, signals: tuple[str, ...], grid: tuple[float, ...]) -> DataFrame:
    """``signal``, ``threshold``, ``returned``, ``right``, ``wrong``, ``precision``, ``avoided`` (wrong ones kept silent) over a fixed grid (``rows``: the signals and ``correct``); one pass."""
    cells = [(s, t) for s in signals for t in grid]
    ok = F.col("correct")
    row = rows.agg(F.count_if(~ok).alias("wrong_all"), *[x for i, (s, t) in enumerate(cells) for x in (F.count_if((F.col(s) >= t) & ok).alias(f"r{i}"), F.count_if((F.col(s) >= t) & ~ok).alias(f"w{i}"))])
    parts = [F.struct(F.lit(s).alias("signal"), F.lit(t).alias("threshold"), (F.col(f"r{i}") + F.col(f"w{i}")).alias("returned"), F.col(f"r{i}").alias("right"), F.col(f"w{i}").alias("wrong"), F.round(F.try_divide(F.col(f"r{i}"), F.col(f"r{i}") + F.col(f"w{i}")), 6).alias("precision"), (F.col("wrong_all") - F.col(f"w{i}")).alias("avoided")) for i, (s, t) in enumerate(cells)]
    return row.select(F.explode(F.array(*parts)).alias("x")).select("x.*")


def recall_under(cases: DataFrame, accept: Column, *recalls: str) -> list[Column]:
    """Macro recalls of own cases when refusing scores 0."""
    return [F.round(F.avg(F.when(F.col("own"), F.when(accept, F.col(r)).otherwise(0.0))), 6).alias(r) for r in recalls]


def correlation(cases: DataFrame, left: str, right: str) -> DataFrame:
    """Pearson correlation with its band; null when a signal does not vary."""
    ok = (F.var_pop(left) > 0) & (F.var_pop(right) > 0)
    n, mx, my = F.count("*"), F.avg(left), F.avg(right)
    cov = F.avg(F.col(left) * F.col(right)) - mx * my
    agg = cases.agg(n.alias("n"), F.when(ok, F.try_divide(cov, F.sqrt(F.var_pop(left) * F.var_pop(right)))).alias("c"))
    band = F.when(F.col("c").isNull(), "indefinie").when(F.col("c") > 0.3, "positive").when(F.col("c") < -0.3, "negative").otherwise("nulle")
    return agg.select("n", F.round("c", 6).alias("correlation"), band.alias("band"))


def quantiles(cases: DataFrame, value: str, by: str) -> DataFrame:
    """Minimum, linear median and p95, upper median ``v[n // 2]``, index p95 ``v[int(.95 n)]`` and maximum by group.

    Linear ones come from counted values (``percentile`` keeps one count a value); the index forms from
    running counts, so that no group's values are gathered.
    """
    rows = cases.where(F.col(value).isNotNull()).select(F.col(by).alias("g"), F.col(value).cast("double").alias("v"))
    linear = rows.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.percentile("v", F.lit(0.5)).alias("median"), F.percentile("v", F.lit(0.95)).alias("p95"), F.max("v").alias("hi"))
    each = rows.groupBy("g", "v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col("v")))
    places = each.withColumn("upto", upto).join(F.broadcast(linear.select("g", "n")), "g").groupBy("g").agg(at(F.floor(F.col("n") / 2)).alias("upper_median"), at(F.floor(F.col("n") * 0.95)).alias("p95_index"))
    r = lambda c: F.round(c, 6).alias(c)
    return linear.join(places, "g").select("g", "n", *map(r, ("lo", "median", "upper_median", "p95", "p95_index", "hi")))


def exclusive_quantiles(cases: DataFrame, value: str, by: str, ps: tuple[float, ...]) -> DataFrame:
    """``g``, ``p``, ``value`` by the exclusive method, for groups of at least two: position p (n + 1), clamped, linear between; from counted values."""
    each = cases.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("g"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    sizes = each.groupBy("g").agg(F.sum("c").alias("n")).where("n > 1")
    rows = each.withColumn("upto", upto).join(small(sizes), "g")
    n = F.col("n")
    places = [F.least(F.greatest(F.lit(p) * (n + 1), F.lit(1.0)), n.cast("double")) for p in ps]
    at = lambda i: F.min(F.when(F.col("upto") >= i, F.col("v")))
    found = rows.groupBy("g", "n").agg(*[x for i, pos in enumerate(places) for x in (at(F.floor(pos)).alias(f"a{i}"), at(F.least(F.floor(pos) + 1, n)).alias(f"b{i}"))])
    between = lambda i: F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * (places[i] - F.floor(places[i]))
    parts = F.array(*[F.struct(F.lit(p).alias("p"), F.round(between(i), 6).alias("value")) for i, p in enumerate(ps)])
    return found.select("g", F.explode(parts).alias("x")).select("g", "x.*")


def histogram(cases: DataFrame, value: str, edges: tuple[float, ...], by: str) -> DataFrame:
    """Counts in classes [lo, hi) between ``edges``; values outside are left out."""
    v = F.col(value)
    lo = F.when(F.lit(False), F.lit(0.0))
    for a, b in zip(edges, edges[1:], strict=False):
        lo = lo.when((v >= a) & (v < b), F.lit(float(a)))
    return cases.select(F.col(by).alias("g"), lo.alias("lo")).where("lo is not null").groupBy("g", "lo").agg(F.count("*").alias("n"))


def rule_table(cases: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rule``, ``answered``, ``false_accepts``, ``false_refusals``, ``service`` of each rule; all rules in one pass."""
    aggs = []
    for i, accept in enumerate(rules.values()):
        own = F.col("own")
        aggs += [F.count_if(accept).alias(f"a{i}"), F.count_if(accept & ~own).alias(f"f{i}"), F.count_if(~accept & own).alias(f"r{i}"), F.avg(F.when(own, accept.cast("int"))).alias(f"s{i}")]
    row = cases.agg(*aggs)
    parts = [F.struct(F.lit(name).alias("rule"), F.col(f"a{i}").alias("answered"), F.col(f"f{i}").alias("false_accepts"), F.col(f"r{i}").alias("false_refusals"), F.round(f"s{i}", 6).alias("service")) for i, name in enumerate(rules)]
    return row.select(F.explode(F.array(*parts)).alias("x")).select("x.*")


def nearest(cases: DataFrame, signal: str, threshold: float) -> DataFrame:
    """The case nearest to the threshold on each side (ties: smallest id)."""
    v = F.col(signal)
    side = F.when(v >= threshold, "au-dessus").otherwise("en dessous")
    return cases.where(v.isNotNull()).groupBy(side.alias("side")).agg(F.min(F.struct(F.abs(v - threshold).alias("gap"), F.col("id"), v.alias("v"))).alias("m")).select("side", F.col("m.id").alias("id"), F.round("m.v", 6).alias("v"))


def flips(cases: DataFrame, left: str, right: str, threshold: float) -> DataFrame:
    """Cases that two signals decide differently, and whether the right one gains or loses."""
    a, b = F.col(left) >= threshold, F.col(right) >= threshold
    label = F.when(F.col("own") == b, "gagne").otherwise("perdu")
    return cases.where(a != b).select("id", "own", label.alias("effect"))


def worst(cases: DataFrame, left: str, right: str, n: int = 8) -> DataFrame:
    """The ``n`` largest drops from one signal to the other."""
    return cases.select("id", F.round(F.col(left) - F.col(right), 6).alias("drop")).orderBy(F.desc("drop"), "id").limit(n)
