import pytest
from pyspark.sql import functions as F

from attesta.plans import registry as R


def test_resolve():
    assert R.resolve("attesta.operators.lexical:mute").__name__ == "mute"
    with pytest.raises(ValueError):
        R.resolve("nothing")


def test_compare_and_gate(spark):
    wanted = spark.createDataFrame([(1, [10]), (2, [])], "query_id long, want array<long>")
    right = lambda: spark.createDataFrame([(1, 10, 1.0, 1), (1, 10, 1.0, 2)], "query_id long, doc_id long, score double, rank int")
    wrong = lambda: spark.createDataFrame([(1, 11, 1.0, 1), (2, 11, 1.0, 1)], "query_id long, doc_id long, score double, rank int")
    rows = {r.retriever: r for r in R.compare({"right": right, "wrong": wrong}, wanted).collect()}
    assert (rows["right"].recall1, rows["right"].abstention, rows["wrong"].recall1, rows["wrong"].abstention) == (1.0, 1.0, 0.0, 0.0)
    report = spark.createDataFrame([(0.5, None)], "recall double, other double")
    assert R.gate(report, recall=0.5) == R.OK and R.gate(report, recall=0.6) == R.gate(report, other=0.1) == R.BROKEN
    assert R.gate(report, anomalies=report) == R.gate(report.where("false")) == R.UNMEASURED


def test_writer_failures_are_kept(spark):
    def writer(question, retrieved):
        if not retrieved:
            raise R.WriterError("nothing to read")
        return f"L'article {retrieved[0]} répond."

    rows = spark.createDataFrame([("q", ["12"]), ("q", [])], "text string, retrieved array<string>")
    out = R.written(rows, writer).select("draft", "failure", F.size("retrieved").alias("n")).orderBy("n").collect()
    assert [tuple(r)[:2] for r in out] == [(None, "nothing to read"), ("L'article 12 répond.", None)]
