"""Vectors as rows: named in Spark, without a second pass through Python."""

import math

from logweir.operators import classify


def test_vector_rows_are_named_by_a_join(spark):
    lines = spark.createDataFrame([(1, "abc abc"), (2, "abd"), (3, None), (4, "zz ab")], "weight long, line string")
    terms = spark.createDataFrame([("abc", 2.0), ("qq", 9.0), ("abd", 1.0), (" ab", 1.0)], "term string, idf double")
    rows = classify.tfidf_vectors(lines.withColumnRenamed("weight", "id"), "id", "line", terms)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "BroadcastHashJoin" in plan
    got = {(r.id, r.term): r.weight for r in rows.collect()}
    two = {"abc": (1 + math.log(2)) * 2, " ab": 1 + math.log(2)}
    size = math.sqrt(sum(x * x for x in two.values()))
    want = {(1, t): x / size for t, x in two.items()} | {(2, "abd"): 1 / math.sqrt(2), (2, " ab"): 1 / math.sqrt(2), (4, " ab"): 1.0}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_no_terms_give_no_rows(spark):
    lines = spark.createDataFrame([(1, "abc")], "id long, line string")
    terms = spark.createDataFrame([], "term string, idf double")
    assert classify.tfidf_vectors(lines, "id", "line", terms).count() == 0
