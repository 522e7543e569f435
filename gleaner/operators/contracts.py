"""Contracts of the engine's tables: each returns its violations as (check_name, n), in one pass where it can."""

from __future__ import annotations

import math
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators.tables import require_columns

if TYPE_CHECKING:
    from gleaner.operators.evaluation import ClassJudgments

PAIR = ["query_id", "product_id"]


def _counts(row: DataFrame) -> DataFrame:
    """(check_name, n) from one row of counts."""
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("check_name"), F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias("n")) for c in row.columns])))


def _blank(c: str) -> Column:
    return F.col(c).isNotNull() & T.blank(F.col(c))


def judgment_contract(judgments: DataFrame, grades: tuple[int, ...] | None = None) -> DataFrame:
    """Canonical judgments: keys and grades present, one row a pair, grades finite and not negative (or among grades)."""
    require_columns(judgments, [*PAIR, "relevance_grade"], "judgments")
    g = F.col("relevance_grade").cast("double")
    bad = F.isnan(g) | (F.abs(g) == float("inf")) | (g < 0) if grades is None else ~g.isin(*map(float, grades))
    pairs = judgments.groupBy(*PAIR).agg(F.count("*").alias("n"), F.count_if(g.isNull()).alias("lost"), F.count_if(F.coalesce(bad, F.lit(False))).alias("bad"))
    lost = F.col("query_id").isNull() | F.col("product_id").isNull()
    return _counts(pairs.agg(F.sum(F.when(lost, F.col("n")).otherwise(F.col("lost"))).alias("missing"), F.sum(F.when(~lost, F.col("n") - 1)).alias("repeated_pairs"), F.sum("bad").alias("bad_grade")))


def catalog_contract(catalog: DataFrame, id_col: str = "product_id", text_col: str = "product_text") -> DataFrame:
    """What an index is built on: ids and texts present and not blank, ids unique, at least one row."""
    require_columns(catalog, [id_col, text_col], "catalog")
    ids = catalog.groupBy(id_col).agg(F.count("*").alias("n"), F.count_if(F.col(text_col).isNull()).alias("no_text"), F.count_if(_blank(text_col)).alias("blank_text"))
    lost = F.col(id_col).isNull()
    sums = ids.agg(F.sum(F.when(lost, F.col("n"))).alias("missing_id"), F.sum(F.when(_blank(id_col), F.col("n"))).alias("blank_id"), F.sum("no_text").alias("missing_text"), F.sum("blank_text").alias("blank_text"), F.sum(F.when(~lost, F.col("n") - 1)).alias("repeated_id"), (F.coalesce(F.sum("n"), F.lit(0)) == 0).cast("int").alias("no_rows"))
    return _counts(sums)


def _class_candidates(judged: ClassJudgments, catalog: DataFrame) -> DataFrame:
    """candidate_contract() of judgments by class: products of the same classes, so often each, are one row with their number."""
    known = catalog.select("product_id").distinct().withColumn("known", F.lit(1))
    labels = judged.products.where("product_id IS NOT NULL AND label IS NOT NULL").groupBy("product_id", "label").agg(F.count("*").alias("n"))
    products = labels.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("label", "n"))).alias("classes"))
    products = products.join(known, "product_id", "left").withColumn("known", F.coalesce("known", F.lit(0)))
    kinds = products.groupBy("classes", "known").agg(F.count("*").alias("products"))
    asked = judged.near.where("query_id IS NOT NULL AND label IS NOT NULL").groupBy("query_id", "label").agg(F.count("*").alias("m"))
    met = kinds.select("classes", "known", "products", F.inline("classes")).join(asked, "label")
    met = met.groupBy("query_id", "classes", "known", "products").agg(F.sum(F.col("m") * F.col("n")).alias("n"))
    itself = products.select(F.col("product_id").alias("query_id"), "classes", "known", F.lit(1).alias("own"))
    met = met.join(itself, ["query_id", "classes", "known"], "left").withColumn("pairs", F.col("products") - F.coalesce("own", F.lit(0)))
    return _counts(met.agg(F.sum((F.col("n") - 1) * F.col("pairs")).alias("repeated_candidates"), F.sum((1 - F.col("known")) * F.col("pairs")).alias("unknown_candidates")))


def candidate_contract(pairs: DataFrame | ClassJudgments, catalog: DataFrame) -> DataFrame:
    """Candidate lists: a product once for a query, and each of them in the catalog."""
    if not isinstance(pairs, DataFrame):
        return _class_candidates(pairs, catalog)
    once = pairs.groupBy(*PAIR).agg(F.count("*").alias("n"))
    known = catalog.select("product_id").distinct().withColumn("known", F.lit(1))
    return _counts(once.join(known, "product_id", "left").agg(F.sum(F.col("n") - 1).alias("repeated_candidates"), F.count_if(F.col("known").isNull()).alias("unknown_candidates")))


def split_contract(splits: DataFrame, queries: DataFrame, names: tuple[str, ...] = ("train", "validation", "test")) -> DataFrame:
    """Splits share no query, cover all queries and no others, and none is empty."""
    by = splits.groupBy("query_id").agg(F.count_distinct("split").alias("splits"))
    both = by.join(queries.select("query_id").distinct().withColumn("known", F.lit(1)), "query_id", "full")
    found = both.agg(F.count_if(F.col("splits") > 1).alias("in_two_splits"), F.count_if(F.col("splits").isNull()).alias("in_no_split"), F.count_if(F.col("known").isNull()).alias("unknown_query"))
    filled = splits.agg(*[F.count_if(F.col("split") == n).alias(n) for n in names])
    empty = reduce(lambda a, b: a + b, [(F.col(n) == 0).cast("long") for n in names])
    return _counts(found.crossJoin(F.broadcast(filled.select(empty.alias("empty_splits")))))


def split_overlaps(splits: DataFrame) -> DataFrame:
    """(first, second, n): queries that two splits share, for each pair of splits that shares any."""
    both = splits.distinct().groupBy("query_id").agg(F.sort_array(F.collect_set("split")).alias("s")).where(F.size("s") > 1)
    pairs = F.flatten(F.transform("s", lambda a, i: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("first"), b.alias("second")))))
    return both.select(F.inline(pairs)).groupBy("first", "second").agg(F.count("*").alias("n"))


def split_filter(rows: DataFrame, splits: DataFrame, name: str) -> DataFrame:
    """The rows whose query is in a split."""
    return rows.join(splits.where(F.col("split") == name).select("query_id").distinct(), "query_id", "left_semi")


def norm_contract(vectors: DataFrame, column: str, tolerance: float = 1e-5) -> DataFrame:
    """Stored vectors: present, finite, of one dimension and of unit length within the tolerance."""
    v = F.col(column).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return _counts(vectors.agg(F.count_if(F.col(column).isNull()).alias("missing"), F.count_if(odd).alias("not_finite"), F.greatest(F.count_distinct(F.size(v)) - 1, F.lit(0)).alias("other_dimensions"), F.count_if(~odd & (F.abs(norm - 1) > tolerance)).alias("not_unit")))


def required_columns(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(table_name, column_name) of required columns that tables lack; no job is run."""
    spark = next(iter(tables.values()))[0].sparkSession
    lost = [(t, c) for t, (df, names) in sorted(tables.items()) for c in sorted(set(names) - set(df.columns))]
    return spark.createDataFrame(lost, "table_name string, column_name string")


def check_parameters(*, k: int | None = None, depth: int | None = None, rrf_k: int | None = None, weight: float | None = None, weights: tuple[float, ...] | None = None, strategy: str | None = None, proportions: tuple[float, ...] | None = None, c_grid: tuple[float, ...] | None = None, class_weights: tuple[str, ...] | None = None) -> None:
    """Raises ValueError for a parameter out of its range, before a plan is built; True and False are no numbers."""

    def number(x: object, low: float, high: float = math.inf) -> bool:
        return isinstance(x, int | float) and not isinstance(x, bool) and math.isfinite(x) and low <= x <= high

    for name, x in (("k", k), ("depth", depth), ("rrf_k", rrf_k)):
        if x is not None and (isinstance(x, bool) or not isinstance(x, int) or x <= 0):
            raise ValueError(f"{name} must be a positive whole number")
    if strategy is not None and strategy not in ("weighted_normalized", "rrf"):
        raise ValueError("strategy must be weighted_normalized or rrf")
    if weight is not None and not number(weight, 0, 1):
        raise ValueError("weight must lie between 0 and 1")
    if weights is not None and (not weights or len(set(weights)) != len(weights) or not all(number(w, 0, 1) for w in weights)):
        raise ValueError("weights must be distinct numbers between 0 and 1")
    if proportions is not None and (not all(number(p, 0, 1) for p in proportions) or abs(sum(proportions) - 1) > 1e-9):
        raise ValueError("proportions must not be negative and sum to 1")
    if c_grid is not None and (not c_grid or not all(number(c, 1e-300) for c in c_grid)):
        raise ValueError("the grid of C must hold positive numbers")
    if class_weights is not None and (not class_weights or not set(class_weights) <= {"none", "balanced"}):
        raise ValueError("class weights must be none or balanced")
