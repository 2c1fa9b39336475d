import random

import numpy as np
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.operators import accents as A
from attesta.operators import answer as W
from attesta.operators import dense as D
from attesta.operators import extract as X
from attesta.operators import lexical as L
from attesta.operators import thresholds as P
from attesta.sources import vectors as V
from attesta.streaming import rate_limit


def test_light_stemmer_stops_at_the_first_suffix(spark):
    words = {"licenciement": "licenci", "conges": "cong", "paye": "paye", "231": "231", "les": "les", "nationaux": "nation", "elle": "elle", "salaires": "sal"}
    got = {r.w: r.s for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", T.stem(F.col("w")).alias("s")).collect()}
    assert got == words


def test_folding_of_combining_marks(spark):
    df = spark.createDataFrame([("Congé É Œ",)], "t string")
    assert df.select(T.fold(F.col("t")).alias("x"), T.nfd_fold(F.col("t")).alias("y")).first() == ("conge e œ", "conge e œ")


def test_article_id_and_case(spark):
    df = spark.createDataFrame([("Premier", "premier"), (" 012", "12"), ("1er", "premier"), ("01", "premier"), ("231", "231")], "a string, b string")
    assert df.where(T.article_id(F.col("a")) != F.col("b")).isEmpty()
    df = spark.createDataFrame([("CONGE", "CONGÉ"), ("Conge", "Congé"), ("conge", "congé")], "a string, b string")
    assert df.where(T.case_like(F.col("a"), F.lit("congé")) != F.col("b")).isEmpty()


def greedy(text, limit):
    out, cur = [], ""
    for p in (x for x in text.split("\n") if x.strip()):
        if cur and len(cur) + len(p) + 1 > limit:
            out.append(cur)
            cur = p
        else:
            cur = f"{cur}\n{p}" if cur else p
    return [*out, cur] if cur else out or [text]


def test_chunks_against_a_loop(spark):
    rng = random.Random(3)
    texts = ["", "\n\n", "a" * 50, *("\n".join("x" * rng.randrange(0, 30) for _ in range(rng.randrange(1, 12))) for _ in range(60))]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.chunks(F.col("t"), 40).alias("c")).collect()
    assert {r.i: r.c for r in got} == {i: greedy(t, 40) for i, t in enumerate(texts)}


def test_rate_limit_against_a_loop(spark):
    rng = random.Random(5)
    events = [(str(rng.randrange(4)), i, float(rng.randrange(300))) for i in range(400)]
    logs, want = {}, {}
    for k, i, t in sorted(events, key=lambda e: (e[0], e[2], e[1])):
        log = [x for x in logs.get(k, []) if t - x < 60]
        want[i] = len(log) < 3
        logs[k] = [*log, t] if want[i] else log
    got = {r.event_id: r.allowed for r in rate_limit.batch(spark.createDataFrame(events, "key string, event_id long, t double"), 3, 60.0).collect()}
    assert got == want and not all(want.values())


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    events = [("a", i, 1.7e9 + i * 10.0) for i in range(12)] + [("b", 100 + i, 1.7e9 + i * 40.0) for i in range(4)]
    df = spark.createDataFrame(events, "key string, event_id long, s double").select("key", "event_id", F.timestamp_seconds("s").alias("ts"))
    df.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).withWatermark("ts", "1 hour")
    q = rate_limit.stream(source, 3, 60.0).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.event_id: r.allowed for r in spark.table("limited").collect()}
    want = {r.event_id: r.allowed for r in rate_limit.batch(df.select("key", "event_id", F.unix_seconds("ts").cast("double").alias("t")), 3, 60.0).collect()}
    assert got == want


def test_auc_laws(spark):
    case = lambda rows: P.auc(spark.createDataFrame(rows, "own boolean, s double"), "s").first().auc
    assert case([(True, 2.0), (False, 1.0)]) == 1.0
    assert case([(True, 1.0), (False, 2.0)]) == 0.0
    assert case([(True, 1.0), (False, 1.0)]) == 0.5
    assert case([(True, 1.0)]) is None


def test_frontier_is_monotone_and_reaches_zero(spark):
    rng = random.Random(1)
    rows = [(rng.random() < 0.6, round(rng.random(), 2)) for _ in range(300)]
    out = sorted(P.frontier(P.sweep(spark.createDataFrame(rows, "own boolean, s double"), "s")).collect(), key=lambda r: r.false_accepts)
    refusals = [r.false_refusals for r in out]
    assert refusals[-1] == 0 and out[-1].false_accepts == sum(not o for o, _ in rows)
    assert refusals == sorted(refusals, reverse=True)


def test_cosine_is_exact(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc_id long, v array<double>").repartition(7)
    q = spark.createDataFrame([(i, v[i].tolist()) for i in range(3)], "query_id long, v array<double>")
    from attesta.operators.lexical import top

    got = {(r.query_id, r.rank): r.doc_id for r in top(D.cosine(df, q, 5), 5).collect()}
    want = {(i, r + 1): int(d) for i in range(3) for r, d in enumerate(np.argsort(-(v @ v[i]), kind="stable")[:5])}
    assert got == want


def test_reaccenting_keeps_case_and_ambiguous_words(spark):
    corpus = spark.createDataFrame([("Le congé annuel payé du salarié. Le salarie des",)], "text string")
    lex = A.lexicon(A.forms(corpus))
    out = A.reaccented(spark.createDataFrame([("Conge PAYE du salarie, congé",), (None,)], "text string"), lex).collect()
    assert [r.reaccented for r in out] == ["Congé PAYÉ du salarie, congé", None]


def test_paragraphs_join_hyphens(spark):
    rows = [("d", 0, "Article", True, True, 0, 70.0, 200.0), ("d", 1, "un non-", False, False, 0, 70.0, 530.0), ("d", 2, "respect est", False, False, 0, 70.0, 530.0), ("d", 3, "grave.", False, False, 0, 70.0, 100.0), ("d", 4, "Autre.", False, False, 0, 70.0, 90.0)]
    df = spark.createDataFrame(rows, "doc string, n int, text string, bold boolean, heading boolean, article int, x0 double, x1 double")
    assert [r.text for r in X.paragraphs(df).orderBy("paragraph").collect()] == ["un non-respect est grave.", "Autre."]


def test_index_refuses_another_corpus(spark, tmp_path):
    import pytest

    v = spark.createDataFrame([("1", [1.0, 0.0])], "numero string, v array<double>")
    V.write_index(v, "seal", str(tmp_path / "i"), "m")
    assert V.read_index(spark, str(tmp_path / "i"), "seal", "m").count() == 1
    for seal, model in (("other", "m"), ("seal", "n")):
        with pytest.raises(V.IndexRefused):
            V.read_index(spark, str(tmp_path / "i"), seal, model)
    with pytest.raises(V.IndexRefused):
        V.adopt(v.select("numero", F.expr("array(2.0D, 0.0D)").alias("v")))


def test_question_set_validation(spark):
    from attesta.sources import corpus as C

    rows = [
        ("a", "x", ["usager"], ["1"], [], None, None, ["b"]),
        ("b", "y", ["usager"], ["1"], ["1"], None, None, []),
        ("c", " ", ["sans_reponse"], [], [], "f", "reglage", None),
        ("d", "z", ["sans_reponse"], [], [], "f", "reglage", None),
        ("e", "w", ["usager"], ["9"], [], "f", None, None),
    ]
    got = {(r.id, r.anomaly) for r in C.validate_questions(spark.createDataFrame(rows, C.QUESTION), spark.createDataFrame([("1",)], "numero string")).collect()}
    assert got == {("b", "attendu_et_tolere"), ("a", "paire_non_reciproque"), ("c", "question_vide"), ("f", "volets_desequilibres"), ("e", "article_inconnu"), ("e", "famille_sur_repondable")}


def test_headed_chunks_equal_a_loop(spark):
    texts = ["un\n deux \n\ntrois " + "x" * 30, "", "   ", "a" * 50 + "\n" + "b" * 5, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.headed_chunks(F.col("t"), F.lit("T. "), 20).alias("c"))
    got = {r.i: r.c for r in df.collect()}
    for i, t in enumerate(texts[:4]):
        done, cur, n = [], "", 0
        for p in filter(None, (x.strip(" ") for x in t.split("\n"))):
            if cur and n + len(p) > 20:
                done, cur, n = [*done, cur], "", 0
            cur, n = (f"{cur} {p}" if cur else p), n + len(p)
        assert got[i] == (["T. " + c for c in [*done, *([cur] if cur else [])]] or ["T."])


def test_footnotes_open_in_sequence_only(spark):
    lines = ["Avant", "1 - Première note", "suite de 1999", "3 - trompeuse", "2 – Deuxième", "2 répétée", "3. non", "3 Troisième"]
    df = spark.createDataFrame([("d", n, t) for n, t in enumerate(lines)] + [("e", 0, "rien")], "doc string, n int, text string")
    got = [tuple(r) for r in X.footnotes(df).orderBy("doc", "note").collect()]
    assert got == [("d", 1, "Première note suite de 1999 3 - trompeuse"), ("d", 2, "Deuxième 2 répétée 3. non"), ("d", 3, "Troisième")]


def test_digest_is_blake2b_of_eight_bytes(spark):
    import hashlib

    texts = ["", "Quelle est la durée du congé ?", "漢字" * 100, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    got = [None if r[0] is None else int(r[0]) for r in df.select(W.digest(F.col("t"))).collect()]
    assert got[:3] == [int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big") for t in texts[:3]]


def test_stored_index_gives_the_same_scores(spark, tmp_path):
    rows = [(1, ["a", "b", "a"]), (2, ["b", "c"]), (3, []), (4, ["d"])]
    bags, q = spark.createDataFrame(rows, "doc_id long, toks array<string>"), spark.createDataFrame([(0, ["a", "b", "z", "b"]), (1, [])], "query_id long, toks array<string>")
    L.build_index(bags, str(tmp_path / "i"))
    ix = L.open_index(spark, str(tmp_path / "i"))
    assert L.statistics(ix).first() == L.statistics(bags).first() and ix.lengths.count() == 4
    for f in (L.bm25, L.overlap, L.idf_overlap, L.coverage, L.saturation):
        assert sorted(map(tuple, f(ix, q).collect())) == sorted(map(tuple, f(bags, q).collect())), f


def test_dense_blocks_give_the_same_ranking(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 8))
    rows = spark.createDataFrame([(i, v[i].tolist()) for i in range(60)], "doc_id long, v array<double>").repartition(4)
    q = rows.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    whole = sorted(map(tuple, L.top(D.cosine(rows, q, 5), 5).collect()))
    monkeypatch.setattr(D, "MAX_QUERY_VALUES", 8)
    assert sorted(map(tuple, L.top(D.cosine(rows, q, 5), 5).collect())) == whole
    pooled = {(r.query_id, r.doc_id): r.score for r in L.top(D.pooled_cosine(rows.withColumn("numero", F.col("doc_id") % 7), q, 2), 2).collect()}
    for i in (0, 20, 40):
        best = sorted(((-round(float(max(v[j] @ v[i] for j in range(n, 60, 7))), 6), n) for n in range(7)))[:2]
        assert {n: -s for s, n in best} == {n: s for (k, n), s in pooled.items() if k == i}


def test_sql_functions_and_settings(spark):
    import pytest

    from attesta.plans import registry as R

    R.register(spark)
    row = spark.sql("select strip_accents('Été À la'), text_tokens('Le congé, payé'), dot_product(array(1D, 2D), array(3D, 4D))").first()
    assert tuple(row) == ("ete a la", ["le", "conge", "paye"], 11.0)
    assert [r[0] for r in spark.sql("select * from article_range(1, 3)").collect()] == ["premier", "2", "3"]
    assert [tuple(r) for r in spark.sql("select * from text_chunks('abcde', 2) order by place").collect()] == [(0, "ab"), (1, "cd"), (2, "e")]
    assert V.index_path(spark, "/a/b/") == "/a/b"
    spark.conf.set(V.PATH_SETTING, "/elsewhere/")
    assert V.index_path(spark, "/a") == "/elsewhere"
    spark.conf.unset(V.PATH_SETTING)
    assert spark.range(1).select(V.prefixed(F.lit("x"), "intfloat/multilingual-e5-large", True)).first()[0] == "query: x"
    with pytest.raises(KeyError):
        V.prefixed(F.lit("x"), "unknown", False)
    assert R.adapted(lambda q: q + "!")("a", []) == "a!" and R.adapted(lambda q, r: q + r[0])("a", ["b"]) == "ab"
    with pytest.raises(TypeError):
        R.adapted(lambda: "")
    assert R.timed(lambda: spark.range(1), 3) > 0


def test_text_report(spark, tmp_path):
    from attesta.sources import corpus as C

    df = spark.createDataFrame([("rappel", 0.5), ("x", None)], "mesure string, valeur double")
    C.write_text_report(df, "Bilan", str(tmp_path / "r"))
    assert [r.value for r in spark.read.text(str(tmp_path / "r")).collect()] == ["Bilan", "mesure  valeur", "rappel  0.5", "x       –"]
