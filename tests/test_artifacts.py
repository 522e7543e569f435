"""Kept models and indexes, the linear Transformer, the contracts' corners, keyed logs and replayed batches."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import contracts as C
from gleaner.operators import dense as N
from gleaner.operators import evaluation as E
from gleaner.operators import ranking as R
from gleaner.operators import serving as S
from gleaner.operators import tables as V
from gleaner.operators.relevance import LinearRelevance
from gleaner.sources import artifacts as A

ROWS = "query_id string, product_id string, hybrid_rank int, relevance_grade int, " + ", ".join(f"{n} double" for n in R.FEATURES)


@pytest.fixture(scope="module")
def training(spark):
    r = random.Random(8)
    rows = []
    for i in range(240):
        g = min(2, i % 4)
        rows.append((f"q{i % 12}", f"p{i}", i % 20 + 1, g, *[r.gauss(0.4 * g * (k % 3), 1 + k / 5) for k in range(len(R.FEATURES) - 1)], 7.0))  # the last never varies
    return spark.createDataFrame(rows, ROWS)


def plain_fit(rows, c, balanced):
    """Multinomial regression by Newton's method: sum of weighted losses plus 1 / (2 C) of the weights' squares."""
    x = np.array([[r[f] for f in R.FEATURES] for r in rows])
    y = np.array([r.relevance_grade for r in rows])
    std = x.std(0, ddof=1)
    x = np.where(std > 0, (x - x.mean(0)) / np.where(std > 0, std, 1), 0)
    n, k = len(x), 3
    weight = n / (k * np.bincount(y)[y]) if balanced else np.ones(n)
    x1 = np.hstack([x, np.ones((n, 1))])
    theta, d = np.zeros((k, x1.shape[1])), x1.shape[1]
    ridge = np.tile(np.append(np.full(d - 1, 1 / c), 1e-9), k)
    for _ in range(60):
        z = x1 @ theta.T
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        grad = ((weight[:, None] * (p - np.eye(k)[y])).T @ x1).ravel() + ridge * theta.ravel()
        hess = np.zeros((k * d, k * d))
        for a in range(k):
            for b in range(k):
                hess[a * d : (a + 1) * d, b * d : (b + 1) * d] = (x1 * (weight * p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ x1
        theta -= np.linalg.solve(hess + np.diag(ridge + 1e-9), grad).reshape(k, d)
    return p


@pytest.mark.parametrize(("c", "balanced"), [(1.0, True), (0.1, False)])
def test_fit_is_that_of_a_plain_solver(spark, training, c, balanced):
    rows = training.orderBy("product_id").collect()
    fitted = R.train_reranker(training, c, balanced, 500)
    linear = LinearRelevance.of(fitted, R.FEATURES)
    got = np.array([r.probability for r in linear.transform(training).orderBy("product_id").collect()])
    from pyspark.ml.functions import vector_to_array

    own = fitted.transform(training).withColumn("p", vector_to_array("probability")).orderBy("product_id").collect()
    assert np.allclose(got, np.array([r.p for r in own]), atol=1e-9)
    assert np.abs(got - plain_fit(rows, c, balanced)).max() < 2e-3


def test_kept_model_is_refused_when_changed(spark, training, tmp_path):
    said = {"c_value": 1.0, "class_weight": "balanced"}
    model = LinearRelevance.of(R.train_reranker(training), R.FEATURES)
    folder = f"{tmp_path}/model"
    A.write_relevance(model, training, folder, said)
    again = A.load_relevance(spark.newSession(), folder, training, said)
    pool = training.withColumn("rank", F.col("hybrid_rank"))
    want, got = (sorted(map(tuple, R.rerank(pool, m.probability()).collect())) for m in (model, again))
    assert want == got and len(got) == 12 * 10
    with pytest.raises(Exception, match="already exists"):
        A.write_relevance(model, training, folder, said)
    with pytest.raises(ValueError, match="training_digest"):
        A.load_relevance(spark, folder, training.withColumn("lexical_rank", F.col("lexical_rank") + 1))
    with pytest.raises(ValueError, match="training_rows"):
        A.load_relevance(spark, folder, training.unionByName(training))
    with pytest.raises(ValueError, match="parameters"):
        A.load_relevance(spark, folder, parameters={"c_value": 2.0})
    other = LinearRelevance(features=list(R.FEATURES), weights=[0.5] * 39, biases=[0.0] * 3)
    other.write().overwrite().save(f"{folder}/model")
    with pytest.raises(ValueError, match="model_hash"):
        A.load_relevance(spark, folder)
    LinearRelevance(features=list(R.FEATURES[::-1]), weights=[0.5] * 39, biases=[0.0] * 3).write().overwrite().save(f"{folder}/model")
    with pytest.raises(ValueError, match="order"):
        A.load_relevance(spark, folder)
    A.write_relevance(model, training, folder, said, force=True)
    assert A.load_relevance(spark, folder).digest() == model.digest()


def test_transformer_in_a_pipeline(spark, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel

    t = LinearRelevance(features=["a", "b"], weights=[1.0, 0.0, 0.0, 2.0, -1.0, 0.5], biases=[0.0, 0.1, 0.2], outputCol="p")
    df = spark.createDataFrame([(1.0, 2.0), (900.0, -900.0)], "a double, b double")
    Pipeline(stages=[t]).fit(df).write().save(f"{tmp_path}/p")
    got = [r.p for r in PipelineModel.load(f"{tmp_path}/p").transform(df).collect()]
    z = np.array([1.0, 4.1, 0.2])
    assert got[0] == pytest.approx((np.exp(z) / np.exp(z).sum()).tolist()) and got[1] == pytest.approx([1, 0, 0])
    with pytest.raises(ValueError, match="weight for each"):
        LinearRelevance(features=["a"], weights=[1.0], biases=[0.0, 1.0]).transform(df)


def test_kept_dense_index(spark, tmp_path):
    c = spark.createDataFrame([("a", "one"), ("b", "two")], "product_id string, product_text string")
    index = N.dense_index(spark.createDataFrame([("a", [3.0, 4.0]), ("b", [0.0, 2.0])], "product_id string, vector array<double>"), 2)
    folder = f"{tmp_path}/dense"
    A.write_dense(index, c, "m", folder)
    again = A.load_dense(spark.newSession(), folder, "m", 2, c)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, index.collect()))
    for said in ({"model": "other"}, {"dimension": 3}, {"catalog": c.withColumn("product_text", F.lit("x"))}):
        with pytest.raises(ValueError, match=next(iter(said))):
            A.load_dense(spark, folder, **said)
    index.limit(1).write.mode("append").parquet(f"{folder}/vectors")
    with pytest.raises(ValueError, match="index_rows"):
        A.load_dense(spark, folder)


def test_ranking_faults(spark):
    rows = {
        "fine": [("a", 1, 0.5), ("b", 2, 0.4)], "repeated": [("a", 1, 0.5), ("b", 1, 0.4), ("c", 3, 0.3)], "gap": [("a", 1, 0.5), ("b", 3, 0.4)],
        "null": [("a", 1, 0.5), ("b", None, 0.4)], "infinite": [("a", 1, float("inf"))], "nan": [("a", 1, float("nan"))], "twice": [("a", 1, 0.5), ("a", 2, 0.5)], "all_null": [("a", None, 0.5)],
    }
    r = spark.createDataFrame([(q, *x) for q, xs in rows.items() for x in xs], "query_id string, product_id string, rank int, score double")
    got = {x.query_id: x.fault for x in E.ranking_faults(r, 10).collect()}
    n = "ranks_not_contiguous"
    assert got == {"repeated": n, "gap": n, "null": n, "all_null": n, "infinite": "score_not_finite", "nan": "score_not_finite", "twice": "repeated_product"}


def test_white_space_is_blank(spark):
    c = spark.createDataFrame([("\t", "x"), ("1", "\n\t"), ("2", " "), ("3", "x")], "product_id string, product_text string")
    got = {r.check_name: r.n for r in C.catalog_contract(c).collect()}
    assert (got["blank_id"], got["blank_text"]) == (1, 2)
    assert {r.column_name: r.missing for r in V.missing_counts(c, blank=True).collect()} == {"product_id": 1, "product_text": 2}
    q = spark.createDataFrame([("a", "\t\n", 5, "lexical"), ("b", "\tlamp\n", 5, "lexical")], "request_id string, query string, top_k int, mode string")
    assert {r.request_id: r.reason for r in V.validated_requests(q, ("lexical",)).collect()} == {"a": "blank_query", "b": ""}
    assert {r.request_id: r.reason for r in S.resolved_requests(q, "lexical").collect()} == {"a": "blank_query", "b": ""}


def test_unknown_products_and_parameters(spark):
    h = spark.createDataFrame([("q", "p", 1, 0.8, 0.6, 0.7, 2, 4)], "query_id string, product_id string, rank int, lexical_score double, semantic_score double, score double, lexical_rank int, semantic_rank int")
    q = spark.createDataFrame([("q", "x")], "query_id string, query string")
    c = spark.createDataFrame([("z", "t", "d", "x")], "product_id string, product_name string, product_description string, product_text string")
    with pytest.raises(Exception, match="unknown product_id: p"):
        R.rerank_features(h, q, c).collect()
    with pytest.raises(Exception, match="unknown query_id: q"):
        R.rerank_features(h, q.limit(0), c.withColumn("product_id", F.lit("p"))).collect()
    for call in (lambda: R.top_k(h, 0), lambda: R.weighted(1.5), lambda: R.reciprocal(True), lambda: R.fused(h, h, rrf_k=0), lambda: V.split_queries(q, 1, (0.5, 0.4, 0.2)), lambda: R.rerank_features(h, q, c, -1), lambda: R.train_reranker(h, 0.0)):
        with pytest.raises(ValueError):
            call()


def test_engines_run_for_what_is_asked(spark):
    requests = spark.createDataFrame([("r1", "q1", "x", 2, "lexical"), ("r2", "q2", "x", 3, "lexical"), ("r3", "q1", "x", 1, "semantic")], "request_id string, query_id string, query string, top_k int, mode string")
    resolved, calls = S.resolved_requests(requests, "lexical"), []

    def engine(name):
        def run(queries, k):
            calls.append((name, sorted(r.query_id for r in queries.collect()), k))
            return queries.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank")).select("query_id", F.concat(F.lit(name), F.col("rank")).alias("product_id"), F.col("rank").cast("int").alias("rank"), (1 / F.col("rank")).alias("score"))

        return run

    found = S.batch_search(resolved, {m: engine(m) for m in S.MODES})
    assert sorted((r.request_id, r.product_id) for r in found.collect()) == [("r1", "lexical1"), ("r1", "lexical2"), ("r2", "lexical1"), ("r2", "lexical2"), ("r2", "lexical3"), ("r3", "semantic1")]
    assert sorted(calls) == [("lexical", ["q1", "q2"], 3), ("semantic", ["q1"], 1)]
    short = engine("x")(requests.select("query_id").distinct(), 2)
    with pytest.raises(Exception, match="too short for request r2"):
        S.batch_search(resolved, {"lexical": short, "semantic": short}, 2).collect()
    with pytest.raises(Exception, match="no engine for the mode of request r3"):
        S.batch_search(resolved, {"lexical": short}, 3).collect()


def test_order_statistics(spark):
    r = random.Random(1)
    rows = [(g, float(r.randrange(40))) for g in ("a", "b", None) for _ in range(r.randrange(30, 200))] + [("one", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {x.g: x for x in E.order_statistics(df, "g", "v", {"low": 0.0, "p37": 0.37, "top": 1.0}).collect()}
    for g in {g for g, _ in rows}:
        v = [x for k, x in rows if k == g]
        assert (got[g].n, got[g].mean) == (len(v), pytest.approx(np.mean(v)))
        assert [got[g].low, got[g].p37, got[g].top] == pytest.approx(np.quantile(v, [0, 0.37, 1]).tolist())


def test_log_has_a_primary_key(spark, tmp_path):
    schema = "search_id string, query string, reason string"
    a = spark.createDataFrame([("1", "x", ""), ("1", "y", ""), ("2", "x", ""), ("3", "x", "bad_latency")], schema)
    path = f"{tmp_path}/log"
    S.append_events(a, path)
    S.append_events(a, path)
    S.append_events(spark.createDataFrame([("2", "other", ""), ("4", "x", "")], schema), path)
    assert sorted((r.search_id, r.query) for r in spark.read.parquet(path).where("search_id <> '1'").collect()) == [("2", "x"), ("4", "x")]
    assert spark.read.parquet(path).where("search_id = '1'").count() == 1


def test_batch_that_failed_half_way(spark, tmp_path):
    from gleaner.streaming.feedback import append_feedback, feedback_stream, write_batch

    schema = "feedback_id long, search_id long, product_id string, feedback_type string"
    searches = spark.createDataFrame([(1, ["a"])], "search_id long, returned_product_ids array<string>")
    rows = spark.createDataFrame([(1, 1, "a", "clicked"), (2, 2, "a", "clicked")], schema)
    rows.write.parquet(f"{tmp_path}/in")
    ok, bad = f"{tmp_path}/ok", f"{tmp_path}/bad"
    (tmp_path / "file").write_text("in the way")
    with pytest.raises(Exception):  # noqa: B017, PT011
        write_batch(V.validated_feedback(rows, searches), 0, ok, f"{tmp_path}/file/x")
    assert spark.read.parquet(ok).count() == 1
    for _ in range(2):
        append_feedback(feedback_stream(spark, f"{tmp_path}/in", schema, searches), ok, bad, f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(ok).count() == 1 and spark.read.parquet(bad).first().reason == "unknown_search"


def test_manifest_of_any_ids(spark):
    s = spark.createDataFrame([("q1", "train"), ("x-2", "train"), ("q3", "test")], "query_id string, split string")
    src = spark.createDataFrame([("q1", "a"), ("x-2", None)], "id string, t string")
    a, b = (sorted(map(tuple, V.split_manifest(x, 1, {"train": 0.7, "test": 0.3}, y).collect())) for x, y in ((s, src), (s.orderBy(F.desc("query_id")), src.orderBy(F.desc("id")))))
    assert a == b and len({r[5] for r in a}) == 2
    assert V.source_digest(src).first() != V.source_digest(src.fillna("x")).first()
