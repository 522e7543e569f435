"""Queries over the whole job: all terms, whole query texts, all searches."""

from pyspark.sql import functions as F

from gleaner import bindings as D
from gleaner.operators import ranking as R
from gleaner.plans import registry


def test_all_terms(spark):
    f = R.term_blocks(spark.createDataFrame([("a", "xx zz yy"), ("b", "xx qq yy")], "product_id string, t string"), "product_id", F.col("t"))
    assert {r.term for r in R.term_stats(f, max_features=None).collect()} == {"xx", "yy"}
    assert R.term_stats(f, max_features=1).count() == 1
    assert registry.DEEP == 100 and {"term_stats_all", "hybrid_weighted_deep"} <= registry.QUERIES.keys() & registry.ORACLE.keys()


def test_whole_query_texts(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(30))
    spark.createDataFrame([(1, text)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert D.text_queries(spark, str(tmp_path), short=False).first()["query"] == text
    spark.createDataFrame([(7, "word20 word21 other", "en", "web"), (8, "word20 word21 again", "en", "web"), (9, "none of it", "en", "web")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.product_id for r in registry.QUERIES["lexical_search_all"](spark, str(tmp_path)).collect()} == {"7", "8"}


def test_all_documents_and_requested_searches(spark, tmp_path):
    spark.createDataFrame([(i, f"same words {i % 2}x", "en", "web") for i in range(5)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert registry.QUERIES["index_metadata_all"](spark, str(tmp_path)).first().products == 5  # no vectors needed
    events = [(1, "view"), (2, "click"), (3, "view"), (4, "purchase"), (5, "view"), (103, "view")]
    spark.createDataFrame([(i, k, "t", 1.0, '{"k": 1}', 9) for i, k in events], "event_id long, event_type string, ts string, value double, props string, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    assert {r.search_id for r in registry.QUERIES["event_lookup_all"](spark, str(tmp_path)).collect()} == {1, 3}
