"""Hand-calculated fixtures for the ranking engine."""

import math

import pytest
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import evaluation as E
from gleaner.operators import ranking as R
from gleaner.operators import tables as V

GRADES = {"Exact": 2, "Partial": 1, "Irrelevant": 0}


def test_product_text(spark):
    df = spark.createDataFrame([("  Modern   Lamp ", "Lighting", None, None, "Color: Black\nStyle: Modern")], "a string, b string, c string, d string, e string")
    assert df.select(T.product_text(*map(F.col, "abcde"))).first()[0] == "Modern Lamp Lighting Color: Black Style: Modern"


def test_canonical_judgments_and_order(spark):
    rows = [("q1", "p1", "Exact")] * 2 + [("q1", "p2", "Partial"), ("q2", "p3", "Partial"), ("q2", "p3", "Irrelevant"), ("q3", "p4", "Exact")] + [("q3", "p4", "Partial")] * 2
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "query_id string, product_id string, label string")
        got = {r.product_id: (r.label, r.resolution, r.observed_labels, r.judgment_count, r.selected_label_count) for r in E.canonical_judgments(df, GRADES).collect()}
        assert got == {"p1": ("Exact", "identical_duplicate_collapse", "Exact", 2, 2), "p2": ("Partial", "single", "Partial", 1, 1), "p3": ("Partial", "tie_highest_relevance", "Partial|Irrelevant", 2, 1), "p4": ("Partial", "majority_vote", "Exact|Partial", 3, 2)}
    q = E.judgment_quality(df, GRADES).first()
    assert (q.original, q.canonical, q.repeated, q.identical_duplicates, q.conflicts) == (8, 4, 4, 2, 2)


@pytest.mark.parametrize(("n", "sizes"), [(20, (14, 3, 3)), (10, (7, 2, 1))])
def test_splits(spark, n, sizes):
    ids = [(str(i),) for i in range(n)]
    a, b = ({r.query_id: r.split for r in V.split_queries(spark.createDataFrame(x, "query_id string"), 42).collect()} for x in (ids, ids[::-1]))
    assert a == b and len(a) == n
    assert tuple(list(a.values()).count(s) for s in ("train", "validation", "test")) == sizes


def _evaluated(spark, ranked, k, judged=None):
    judged = ranked if judged is None else judged
    j = spark.createDataFrame([("q", f"p{i}", g) for i, g in enumerate(judged)], "query_id string, product_id string, relevance_grade int")
    r = spark.createDataFrame([("q", f"p{i}", i + 1, 1.0 - i / 10) for i in range(len(ranked))], "query_id string, product_id string, rank int, score double")
    return E.judged_evaluation(j.select("query_id").distinct(), r, j, k).first()


def test_metrics(spark):
    r = _evaluated(spark, [2, 1, 0], 3)
    assert r.dcg == pytest.approx(3 + 1 / math.log2(3), abs=1e-6) and (r.ndcg, r.recall, r.rr) == (1, 1, 1) and r.precision == pytest.approx(2 / 3, abs=1e-6)
    r = _evaluated(spark, [0, 1, 2], 3)
    assert r.dcg == pytest.approx(1 / math.log2(3) + 3 / math.log2(4), abs=1e-6) and r.rr == 0.5
    r = _evaluated(spark, [0, 0], 2)
    assert (r.dcg, r.ndcg, r.precision, r.recall, r.rr) == (0, 0, 0, 0, 0)
    assert _evaluated(spark, [1], 3).precision == pytest.approx(1 / 3, abs=1e-6)
    assert _evaluated(spark, [0, 1], 1).rr == 0


def test_lexical_search_and_candidates(spark):
    c = spark.createDataFrame([("p3", "blue outdoor rug"), ("p1", "round coffee table wood"), ("p2", "rectangular dining table"), ("p0", "round accent mirror")], "product_id string, t string")
    index = R.LexicalIndex(c, F.col("t"), min_df=1)
    q = spark.createDataFrame([("a", "round coffee table"), ("b", ""), ("c", "unseenquuxword")], "query_id string, query string")
    assert [(r.query_id, r.product_id) for r in index.search(q).orderBy("rank").collect()] == [("a", "p1"), ("a", "p0"), ("a", "p2")]
    pairs = spark.createDataFrame([("a", "p1"), ("a", "p3"), ("b", "p1"), ("c", "p1")], _pairs := "query_id string, product_id string")
    got = index.candidates(q, pairs).orderBy("rank").collect()
    assert [(r.query_id, r.product_id) for r in got] == [("a", "p1"), ("a", "p3")] and got[1].score == 0
    v = index.vocabulary_analysis(spark.createDataFrame([("a", "round quux")], "query_id string, query string")).first()
    assert (v.indexed, v.unknown, v.oov_fraction) == ("round", "quux|round quux", 0.5)


def test_semantic_ties_and_blank_query(spark):
    c = spark.createDataFrame([("p3", [0.0, 1.0, 0.0]), ("p1", [1.0, 0.0, 0.0]), ("p2", [0.5, 0.5, 0.0]), ("p0", [1.0, 0.0, 0.0])], "product_id string, vector array<double>")
    q = spark.createDataFrame([("q", "x", [2.0, 0.0, 0.0]), ("r", " ", [1.0, 0.0, 0.0])], "query_id string, query string, vector array<double>")
    assert [r.product_id for r in R.semantic_search(q, c, 99).orderBy("rank").collect()] == ["p0", "p1", "p2", "p3"]


def test_fusion(spark):
    s = "query_id string, product_id string, rank int, score double"
    lex = spark.createDataFrame([("q", "p1", 1, 10.0), ("q", "p2", 2, 0.0)], s)
    sem = spark.createDataFrame([("q", "p2", 1, 1.0), ("q", "p1", 2, 0.0)], s)
    got = {r.product_id: r.score for r in R.fuse(R.fused(lex, sem), R.weighted(0.75)).collect()}
    assert got == {"p2": 0.75, "p1": 0.25}
    sem = spark.createDataFrame([("q", "p2", 1, 1.0)], s)
    pairs = spark.createDataFrame([("q", "p1"), ("q", "p2"), ("q", "p3")], "query_id string, product_id string")
    got = {r.product_id: r.score for r in R.fuse(R.fused(lex, sem, pairs), R.reciprocal(60)).collect()}
    assert got == pytest.approx({"p2": 0.5 / 62 + 0.5 / 61, "p1": 0.5 / 61, "p3": 0})


def test_feature_schema_is_guarded():
    R.check_features(list(R.FEATURES))
    with pytest.raises(ValueError):
        R.check_features([*R.FEATURES[:-1], "relevance_grade"])


def test_feedback_reasons(spark):
    searches = spark.createDataFrame([(1, ["a", "b"])], "search_id long, returned_product_ids array<string>")
    fb = spark.createDataFrame([(1, 1, "a", "clicked"), (2, 1, "z", "clicked"), (3, 9, "a", "relevant"), (4, 1, "a", "liked")], "feedback_id long, search_id long, product_id string, feedback_type string")
    assert {r.feedback_id: r.reason for r in V.validated_feedback(fb, searches).collect()} == {1: "", 2: "not_returned", 3: "unknown_search", 4: "invalid_type"}


def test_latency_percentiles(spark):
    rows = [("a", float(i)) for i in range(1, 100)] + [("b", float(i)) for i in range(1, 101)]
    got = {r.k: r for r in E.latency_summary(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    assert (got["a"].p50, got["a"].p95, got["a"].p99) == (50, 94.1, None) and (got["b"].mean, got["b"].p99) == (50.5, 99.01)


def test_feedback_stream(spark, tmp_path):
    from gleaner.streaming.feedback import append_feedback, feedback_stream

    schema = "feedback_id long, search_id long, product_id string, feedback_type string"
    searches = spark.createDataFrame([(1, ["a"])], "search_id long, returned_product_ids array<string>")
    spark.createDataFrame([(1, 1, "a", "clicked"), (2, 2, "a", "clicked")], schema).write.parquet(f"{tmp_path}/in")
    append_feedback(feedback_stream(spark, f"{tmp_path}/in", schema, searches), f"{tmp_path}/ok", f"{tmp_path}/bad", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/ok").count() == 1 and spark.read.parquet(f"{tmp_path}/bad").first().reason == "unknown_search"


def test_raw_tables_and_write_once(spark, tmp_path):
    from gleaner.sources.tables import read_raw, write_once

    (tmp_path / "label.csv").write_text("id\tquery_id\tproduct_id\tlabel\n1\t2001\t1001\tExact\n2\t2001\t0012\tNaN\n")
    df = read_raw(spark, str(tmp_path / "label.csv"), "label")
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("1", "2001", "1001", "Exact"), ("2", "2001", "0012", None)]
    write_once(df, f"{tmp_path}/out")
    with pytest.raises(Exception, match="already exists"):
        write_once(df, f"{tmp_path}/out")
