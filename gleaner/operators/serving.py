"""Batch search by mode, its log, and the breakdown of scores."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators.contracts import check_parameters
from gleaner.sources.scratch import written

MODES = ("lexical", "semantic", "hybrid", "rerank")


def resolved_requests(requests: DataFrame, default: str, loaded: tuple[str, ...] = MODES, most: int = 100) -> DataFrame:
    """Requests with the mode that answers them and a reason, empty for those that can be run: default stands for the
    selected mode; a mode that is none, and one that is not loaded, are refused."""
    mode = F.when(F.col("mode") == "default", F.lit(default)).otherwise(F.col("mode"))
    q = T.stripped(F.col("query"))
    reason = (
        F.when(q == "", "blank_query")
        .when(F.col("top_k").isNull() | (F.col("top_k") < 1) | (F.col("top_k") > most), "bad_top_k")
        .when(~F.coalesce(mode, F.lit("")).isin(*MODES), "unknown_mode")
        .when(~mode.isin(*loaded), "mode_not_loaded")
        .otherwise("")
    )
    return requests.withColumns({"resolved_mode": mode, "reason": reason})


def batch_search(requests: DataFrame, engines: dict[str, DataFrame | Callable[[DataFrame, int], DataFrame]], depth: int | None = None) -> DataFrame:
    """(request_id, resolved_mode, product_id, rank, score): the requests' top_k of their mode's ranking.

    requests are resolved ones (request_id, query_id, top_k, resolved_mode, reason). engines has, for each mode, a ranking
    (query_id, product_id, rank, score) of its first `depth` products, made once however many requests ask for it, or a
    function that makes one of a table (query_id) and a depth: it is called for the mode's own queries and the greatest
    top_k that they ask for, and not at all if none does. A request that asks for more than `depth` results, or for a mode
    without an engine, is an error when it runs.
    """
    good = requests.where("reason = ''").select("request_id", "query_id", "top_k", "resolved_mode", "reason")
    made = any(callable(e) for e in engines.values())
    asked = {r.resolved_mode: r.most for r in good.groupBy("resolved_mode").agg(F.max("top_k").alias("most")).collect()} if made else {}  # a row a mode
    parts, depths = [], {}
    for mode, engine in engines.items():
        if callable(engine):
            if mode not in asked:
                continue
            engine, depths[mode] = engine(good.where(F.col("resolved_mode") == mode).select("query_id").distinct(), asked[mode]), asked[mode]
        else:
            check_parameters(depth=depth)
            depths[mode] = depth
        parts.append(engine.select("query_id", "product_id", "rank", "score", F.lit(mode).alias("resolved_mode")))
    known = F.create_map(*[F.lit(x) for m in depths.items() if m[1] is not None for x in m]) if any(d is not None for d in depths.values()) else F.create_map().cast("map<string,int>")
    missing = ~F.col("resolved_mode").isin(*depths) if depths else F.lit(True)
    runs = F.col("reason") == ""  # said again: filters are evaluated in any order
    told = F.when(runs & missing, F.raise_error(F.concat(F.lit("no engine for the mode of request "), F.col("request_id")))).when(
        runs & (F.col("top_k") > F.element_at(known, F.col("resolved_mode"))), F.raise_error(F.concat(F.lit("the ranking is too short for request "), F.col("request_id")))
    )
    good = good.where(told.isNull())  # before the join, so that no request goes unread
    rows = reduce(DataFrame.unionByName, parts) if parts else good.sparkSession.createDataFrame([], "query_id string, product_id string, rank int, score double, resolved_mode string")
    found = good.join(rows, ["query_id", "resolved_mode"]).where("rank <= top_k")
    return found.select("request_id", "resolved_mode", "product_id", "rank", "score")


def enriched(results: DataFrame, catalog: DataFrame, query: str = "query") -> DataFrame:
    """Results (..., query, product_id) with the catalog's display fields, the short description and the matched terms.
    A product that the catalog lacks is an error, when it runs."""
    known = catalog.select("product_id", "product_name", "product_class", T.short_description(F.col("product_description")).alias("short"), F.lit(True).alias("known"))
    rows = results.join(known, "product_id", "left")
    rows = rows.withColumn("product_id", F.when(F.col("known"), F.col("product_id")).otherwise(F.raise_error(F.concat(F.lit("result is not in the catalog: "), F.coalesce("product_id", F.lit("null"))))))
    matched = T.matched_terms(T.feature_tokens(F.col(query)), T.feature_tokens(F.col("product_name")))
    return rows.withColumn("matched", F.array_join(matched, " ")).drop("known")


def score_breakdown(results: DataFrame, mode: Column, strategy: str = "weighted_normalized", weight: float = 0.9) -> DataFrame:
    """Results with components, by mode: the engines' scores and what each adds to the ranking's score, null where the mode
    has none."""
    both = mode.isin("hybrid", "rerank")
    if strategy == "rrf":
        parts = [0.5 * F.col("lexical_rrf"), 0.5 * F.col("semantic_rrf")]
    else:
        parts = [(1 - F.lit(weight)) * F.col("lexical_norm"), F.lit(weight) * F.col("semantic_norm")]
    out = {}
    for name, part in zip(("lexical", "semantic"), parts, strict=True):
        own = F.col(f"{name}_score")
        out[f"{name}_value"] = F.when((mode == name) | both, own)
        out[f"{name}_part"] = F.when(mode == name, own).when(both, part)
    return results.withColumns(out)


def search_events(requests: DataFrame, results: DataFrame, enabled: bool = True) -> DataFrame:
    """(search_id, query, mode, top_k, latency_ms, returned_product_ids, session_id, reason): an event for each request that
    was run, its products by rank; reason is empty for those that may be logged. No rows where logging is off."""
    returned = results.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("rank", "product_id"))).alias("r"))
    rows = requests.where("reason = ''").join(returned, "request_id", "left").where(F.lit(enabled))
    ids = F.coalesce(F.transform("r", lambda x: x["product_id"]), F.array().cast("array<string>"))
    rows = rows.select(F.col("request_id").alias("search_id"), T.stripped(F.col("query")).alias("query"), F.col("resolved_mode").alias("mode"), "top_k", "latency_ms", ids.alias("returned_product_ids"), "session_id")
    blank = F.exists("returned_product_ids", lambda x: T.blank(x))
    reason = (
        F.when(F.col("search_id").isNull(), "missing_search_id")
        .when(F.coalesce(F.col("query"), F.lit("")) == "", "blank_query")
        .when(F.col("top_k").isNull() | (F.col("top_k") <= 0), "bad_top_k")
        .when(F.col("latency_ms").isNull() | F.isnan("latency_ms") | (F.col("latency_ms") < 0) | (F.col("latency_ms") == float("inf")), "bad_latency")
        .when(blank, "blank_product_id")
        .when(F.size(F.array_distinct("returned_product_ids")) < F.size("returned_product_ids"), "repeated_product")
        .otherwise("")
    )
    return rows.withColumn("reason", reason)


def logged(spark: SparkSession, path: str) -> DataFrame | None:
    """The log at path, or None where there is none yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at) else None


def append_events(events: DataFrame, path: str, key: str = "search_id") -> None:
    """Adds the events that may be logged to the log at path: key is its primary key. An event whose key the log has is left
    out, so that logging a batch again changes nothing; of events of one batch that share a key that with the least hash is
    logged. One writer at a time: the log is read before it is added to."""
    good = events.where("reason = ''").drop("reason")
    first = Window.partitionBy(key).orderBy(F.xxhash64(*good.columns), *[F.to_json(F.struct(*good.columns))])
    good = good.withColumn("place", F.row_number().over(first)).where("place = 1").drop("place")
    known = logged(events.sparkSession, path)
    if known is not None:
        good = written(good.join(known.select(key).distinct(), key, "left_anti").select(*good.columns), "events")
    good.write.mode("append").parquet(path)
