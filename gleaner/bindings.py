"""The roles of the ranking engine bound to the given tables, in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import feature_tokens, product_text
from gleaner.functions.vectors import doubles
from gleaner.operators.evaluation import ClassJudgments

GRADES = {"Exact": 2, "Partial": 1, "Irrelevant": 0}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _catalog(documents: DataFrame, *more: str) -> DataFrame:
    d = documents.select(F.col("doc_id").cast("string").alias("product_id"), F.substring_index("text", "\n", 1).alias("product_name"), F.col("lang").alias("product_class"), F.col("source").alias("category_hierarchy"), F.col("text").alias("product_description"), *more)
    return d.withColumn("product_text", product_text(*[F.col(c) for c in ("product_name", "product_class", "category_hierarchy", "product_description")]))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts: product_id, product_name (first line), product_class, category_hierarchy, product_description."""
    return _catalog(table(spark, sf_dir, "documents"))


def _query(text: str, short: bool) -> Column:
    return (F.array_join(F.slice(feature_tokens(F.col(text)), 1, 8), " ") if short else F.col(text)).alias("query")


def text_queries(spark: SparkSession, sf_dir: str, short: bool = False) -> DataFrame:
    """Queries from the benchmark: the item's whole text or, if short, its first eight feature tokens."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").cast("string").alias("query_id"), _query("text", short))


def vector_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a vector and a class label. What is made of a text is made after the join, whose shuffle has it once."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), doubles(F.col("embedding")).alias("vector"), "label")
    return _catalog(table(spark, sf_dir, "documents").join(e, "doc_id"), "vector", "label")


def vector_queries(spark: SparkSession, sf_dir: str, short: bool = False) -> DataFrame:
    """Every 50th text of the vector catalog as a query: its text as in text_queries, its vector and label."""
    c = vector_catalog(spark, sf_dir).where("cast(product_id AS bigint) % 50 = 0")
    return c.select(F.col("product_id").alias("query_id"), _query("product_description", short), "vector", "label")


def judged(spark: SparkSession, sf_dir: str) -> ClassJudgments:
    """Grades by label: 2 for one label, 1 for the next label, 0 for the one after."""
    e = table(spark, sf_dir, "embeddings").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id")), "vec_id").select(F.col("vec_id").cast("string").alias("product_id"), "label")
    q = vector_queries(spark, sf_dir).select("query_id", F.explode(F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda d: F.struct((F.col("label") + d).alias("label"), (2 - F.abs(d)).cast("int").alias("relevance_grade")))).alias("near"))
    return ClassJudgments(q.select("query_id", "near.*"), e)


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, product_id, relevance_grade): all pairs of judged()."""
    return judged(spark, sf_dir).pairs()


def raw_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human-label stand-ins with repeats and conflicts, from line items."""
    li = table(spark, sf_dir, "lineitem")
    label = F.when(F.col("l_returnflag") == "A", "Exact").when(F.col("l_returnflag") == "N", "Partial").otherwise("Irrelevant")
    return li.select(F.col("l_suppkey").cast("string").alias("query_id"), F.col("l_partkey").cast("string").alias("product_id"), label.alias("label"))


def search_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as searches: ten product ids each, from the k of their properties."""
    e = table(spark, sf_dir, "events").where("event_type = 'view'")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    mode = F.element_at(F.array(*map(F.lit, ("lexical", "semantic", "hybrid", "rerank"))), (F.col("event_id") % 4 + 1).cast("int"))
    returned = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: ((k + 7 * i) % 100).cast("string"))
    return e.select(F.col("event_id").alias("search_id"), "ts", mode.alias("mode"), F.lit(10).alias("top_k"), F.col("value").alias("latency_ms"), returned.alias("returned_product_ids"), F.col("user_id").cast("string").alias("session_id"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type <> 'view'")
    kind = F.when(F.col("event_type") == "click", "clicked").when(F.col("event_type") == "purchase", "relevant").when(F.col("event_type") == "signup", "not_relevant").otherwise(F.col("event_type"))
    return e.select(F.col("event_id").alias("feedback_id"), (F.col("event_id") - 1).alias("search_id"), "ts", F.get_json_object("props", "$.k").alias("product_id"), kind.alias("feedback_type"))
