"""What search and features hold for each pair."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.operators import lexical as L
from gleaner.operators import ranking as R


def test_scores_of_a_batch_hold_their_table_only():
    n, terms, products = 400, 400, 32  # 5 million entries
    rng = np.random.default_rng(2)
    q = L.Queries(pa.array([f"q{i}" for i in range(n)]), np.repeat(np.arange(n), terms), np.tile(np.arange(terms), n), rng.random(n * terms))
    row, own, weight = np.repeat(np.arange(products), terms), np.tile(np.arange(terms), products), rng.random(products * terms)
    tracemalloc.start()
    table = q.table(row, own, weight, products)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20
    assert table.reshape(products, n) == pytest.approx(weight.reshape(products, terms) @ q.weight.reshape(n, terms).T, abs=2e-9)


def test_features_carry_no_text_that_is_not_asked_for(spark):
    hybrid = spark.createDataFrame([("q", "p", 1, 0.8, 0.6, 0.7, 2, 4)], "query_id string, product_id string, rank int, lexical_score double, semantic_score double, score double, lexical_rank int, semantic_rank int")
    catalog = spark.createDataFrame([("p", "a b", "long text", "long text too")], "product_id string, product_name string, product_description string, product_text string")
    queries = spark.createDataFrame([("q", "a")], "query_id string, query string")
    few = R.rerank_features(hybrid, queries, catalog).select("query_id", F.col("query_title_token_coverage").alias("c"))
    lines = few._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [x for x in lines if "product_text" in x and "LogicalRDD" not in x] and few.first().c == 1
    with pytest.raises(Exception, match="unknown product_id: gone"):
        R.rerank_features(hybrid.withColumn("product_id", F.lit("gone")), queries, catalog).select("product_id").collect()


def test_common_terms_are_one_product_and_rare_ones_are_added_up(monkeypatch):
    n, terms, products = 300, 2000, 48
    rng = np.random.default_rng(5)
    have = rng.random((n, terms)) < np.where(np.arange(terms) < 40, 0.5, 0.01)
    query, term = np.nonzero(have)
    q = L.Queries(pa.array([f"q{i}" for i in range(n)]), query, term * 3, rng.random(len(query)))
    row, own = np.nonzero(rng.random((products, terms + 50)) < 0.05)
    weight = rng.random(len(row))
    w, x = np.zeros((terms + 50, n)), np.zeros((products, terms + 50))
    w[q.term // 3, q.query], x[row, own] = q.weight, weight
    monkeypatch.setattr(L, "_ADDS", 50)
    assert q.table(*q.own(row, own * 3, weight), products).reshape(products, n) == pytest.approx(x @ w, abs=2e-9)
    assert len(q._common()[1]) == 40 and (q.own(row, own * 3 + 1, weight)[0].size == 0)
    none = L.Queries(pa.array(["a"]), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    assert (none.table(*none.own(row, own, weight), products) == 0).all()
