from pyspark.sql import functions as F

from attesta.operators import guard as K

READ = [
    ("articles 27, 28 et 29", ["27", "28", "29"], []),
    ("art 45", ["45"], []),
    ("L'article 2 renvoie à ce que fixe l'article 500.", ["2", "500"], []),
    ("l'article 32 a 2 alinéas", ["32"], []),
    ("l'article 5 - 10 jours de congé", ["5"], []),
    ("le 1er alinéa de ce texte", [], []),
    ("l'article 238, 18 jours ouvrables", ["238"], []),
    ("l'article 9, 30 % et 4 heures", ["9"], []),
    ("les articles 145 à 148", ["145", "146", "147", "148"], []),
    ("les articles 145 jusqu’à l’article n° 147 et 3", ["145", "146", "147", "3"], []),
    ("de l'article 231 à l'article 234", ["231", "232", "233", "234"], []),
    ("article premier, article 01, article 1er, ART. N° 1ᵉʳ", ["premier"], []),
    ("les articles premier à 3", ["premier", "2", "3"], []),
    ("l'article 12 ; 13", ["12"], []),
    ("l'article _512_ et **article** 7", ["512", "7"], []),
    ("articles 3 & 4 ou 5 et 5", ["3", "4", "5"], []),
    ("", [], []),
    (None, [], []),
    ("article 12345", [], ["article 12345"]),
    ("l'article 231-1", [], ["article 231-1"]),
    ("article 12bis puis article 12 ter", ["12"], ["article 12bis"]),
    ("Article L. 3", [], ["Article L. 3"]),
    ("article deux cent douze", [], ["article deux cent douze"]),
    ("articles 10 à 5 et 7", ["10"], ["articles 10 à 5"]),
    ("articles 1 à 900", ["premier"], ["articles premier à 900"]),
    ("l'article 10 à l'article 5", ["10", "5"], ["articles 10 à 5"]),
    ("articles 4 et 231-1, 8", ["4"], ["article 231-1"]),
    ("articles 4 et 231-1; article 231-1", ["4"], ["article 231-1"]),
]


def test_citations(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(READ)], "i int, t string")
    got = {r.i: (r.r.citations, r.r.unreadable) for r in df.select("i", K.citations(F.col("t")).alias("r")).collect()}
    assert got == {i: (c, u) for i, (_, c, u) in enumerate(READ)}


def test_bench_reader_disagrees_where_it_should(spark):
    rows = [("les articles 1 à 589",), ("la loi et l'article 65-99",), ("articles 3 à 5",), ("Article Premier, 30 jours",), ("articles 7 et 8, 9 heures",), (None,)]
    df = spark.createDataFrame(rows, "t string").coalesce(1)
    assert [r[0] for r in df.select(K.bench_citations(F.col("t"))).collect()] == [["1", "589"], [], ["3", "4", "5"], ["premier"], ["7", "8"], []]
    assert [r[0] for r in df.select(K.bench_citations(F.col("t"), F.array(F.lit("3"), F.lit("5"))).alias("x")).collect()][2] == ["3", "5"]


def test_verdict_order(spark):
    rows = [("", [], [], ["1"]), ("x", ["2"], ["L. 3"], ["1"]), ("x", [], [], ["1"]), ("x", ["2"], [], ["1"]), ("x", ["1"], [], ["1"])]
    df = spark.createDataFrame(rows, "t string, c array<string>, u array<string>, a array<string>")
    out = [r.v for r in df.select(K.verdict(F.col("t"), F.col("c"), F.col("u"), F.col("a")).alias("v")).collect()]
    assert [v.motive for v in out] == [K.EMPTY, K.UNREAD, K.UNCITED, K.INVENTED, None]
    assert [v.accepted for v in out] == [False] * 4 + [True]
    assert "l'article 2, qui ne figure pas parmi le seul article retrouvé" in out[3].reason


def test_numbers_as_long_as_the_corpus_has_them(spark):
    rows = [("L'article 123456 du Code",), ("Les articles 99999 et 3000000000 du Code",), ("articles 12345 à 12347",), ("article 1234567890123456789",)]
    df = spark.createDataFrame(rows, "t string").coalesce(1)
    got = [(r.r.citations, r.r.unreadable) for r in df.select(K.citations(F.col("t"), 18).alias("r")).collect()]
    assert got == [(["123456"], []), (["99999", "3000000000"], []), (["12345", "12346", "12347"], []), ([], ["article 1234567890123456789"])]
