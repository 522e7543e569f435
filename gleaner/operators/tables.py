"""Validation, splits, sampling, serving log: relational checks that return violations as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.sources.scratch import written

#: Rows of a task where a table is dealt by its rows' number.
_TASK_ROWS = 2_000_000


def missing_counts(df: DataFrame, blank: bool = False) -> DataFrame:
    """(column_name, missing): nulls of each column (with blank, strings of white space too), in one pass."""
    kinds = dict(df.dtypes)

    def gone(c: str) -> Column:
        return T.blank(F.col(c)) if blank and kinds[c] == "string" else F.col(c).isNull()

    one = df.agg(*[F.count_if(gone(c)).alias(c) for c in df.columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing")) for c in df.columns])).alias("x")).select("x.*")


def require_columns(df: DataFrame, names: list[str], table: str) -> None:
    lost = [n for n in names if n not in df.columns]
    if lost:
        raise ValueError(f"{table} is missing required columns: {', '.join(sorted(lost))}")


def assert_empty(violations: DataFrame, what: str) -> None:
    rows = violations.limit(5).collect()
    if rows:
        raise ValueError(f"{what}: {[r.asDict() for r in rows]}")


def key_duplicates(table: DataFrame, key: str, name: str) -> DataFrame:
    """(table_name, key_name, n): rows beyond the first of each key."""
    by = table.groupBy(key).agg(F.count("*").alias("n"))
    return by.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n")).select(F.lit(name).alias("table_name"), F.lit(key).alias("key_name"), "n")


def missing_values(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """(table_name, column_name, n): required columns with values that are null or only white space; none where all are
    there."""
    counts = df.agg(*[F.count_if(T.normalize(F.col(c)) == "").alias(c) for c in columns])
    rows = counts.select(F.inline(F.array(*[F.struct(F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), F.col(c).alias("n")) for c in columns])))
    return rows.where("n > 0")


def _dealt(rows: DataFrame, *key: str) -> tuple[DataFrame, int]:
    """Rows with a deal, by their place, in tasks of some _TASK_ROWS at most by key and deal, and the number of tasks: those of a
    hot key are in many tasks."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), rows.count() // _TASK_ROWS + 1)
    return rows.withColumn("deal", F.monotonically_increasing_id() % n).repartition(n, *key, "deal"), n


def duplicate_counts(labels: DataFrame) -> DataFrame:
    """Repeated rows and conflicting pairs of (query_id, product_id, label).

    Pairs are nearly as many as rows, so a task that counts a file's pairs, or one of a fixed number of tasks, would hold a
    share of the table. Rows are dealt first; what a task counted is dealt by pair, a row of a task for each.
    """
    key = ("query_id", "product_id")
    dealt, n = _dealt(labels, *key)
    counted = dealt.groupBy(*key, "deal").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    pairs = counted.repartition(n, *key).groupBy(*key).agg(F.sum("n").alias("n"), (F.min("low") != F.max("high")).alias("conflict"))
    return pairs.agg(F.sum("n").alias("label_rows"), F.sum(F.col("n") - 1).alias("repeated_pairs"), F.count_if("conflict").alias("conflicting_pairs"))


def invalid_labels(rows: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """(column, n): the values that are not allowed; a null is none of them."""
    return rows.where(~F.col(column).isin(*allowed)).groupBy(column).agg(F.count("*").alias("n"))


def foreign_key_violations(child: DataFrame, key: str, parent: DataFrame, parent_key: str, name: str) -> DataFrame:
    """(check_name, n, examples): distinct keys without a parent, with the five least."""
    lost = child.select(F.col(key).cast("string").alias("k")).dropna().distinct().join(parent.select(F.col(parent_key).cast("string").alias("k")).distinct(), "k", "left_anti")
    few = lost.orderBy("k").limit(5).agg(F.array_join(F.sort_array(F.collect_list("k")), ",").alias("examples"))
    return lost.agg(F.count("*").alias("n")).crossJoin(F.broadcast(few)).select(F.lit(name).alias("check_name"), "n", "examples")


def global_place(rows: DataFrame, *order: str | Column, name: str = "place") -> DataFrame:
    """Rows with their place, from 1 on, in the order: ranges of it are numbered by tasks of their own, and the number of
    rows before each range is added. No task holds more than a range."""
    ranged = written(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged")
    own = ranged.withColumn("own", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    parts = ranged.groupBy("part").agg(F.count("*").alias("n"))  # a row for each task
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("before"))
    return own.join(F.broadcast(parts), "part").select(*rows.columns, (F.col("own") + F.col("before")).alias(name))


def split_queries(queries: DataFrame, seed: int, proportions: tuple[float, float, float] = (0.7, 0.15, 0.15)) -> DataFrame:
    """(query_id, split): a seeded order by hash, cut by largest remainders (ties in the order of the splits). Ids decide,
    so input order does not matter."""
    from gleaner.operators.contracts import check_parameters

    check_parameters(proportions=proportions)
    ids = queries.select("query_id").distinct()
    n = ids.count()
    exact = [p * n for p in proportions]
    counts = [int(x + 1e-9) for x in exact]
    for i in sorted(range(3), key=lambda i: (-(exact[i] - counts[i]), i))[: n - sum(counts)]:
        counts[i] += 1
    keyed = ids.withColumn("key", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("query_id")), 256))
    place = F.col("place")
    return global_place(keyed, "key", "query_id").select("query_id", F.when(place <= counts[0], "train").when(place <= counts[0] + counts[1], "validation").otherwise("test").alias("split"))


def ordered_digest(rows: DataFrame, by: str, number: Column, block: int = 1000) -> DataFrame:
    """(by, n, ids_sha256): a digest of each group's whole numbers in order: that of the digests of blocks of numbers, so no
    task holds a group's numbers, only its blocks' digests."""
    x = rows.select(by, number.cast("long").alias("number")).withColumn("block", F.expr(f"number div {int(block)}"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list("number")), lambda v: v.cast("string")), ",")
    x = x.groupBy(by, "block").agg(F.sha2(listed, 256).alias("digest"), F.count("*").alias("n"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "digest"))), lambda v: v["digest"]), ",")
    return x.groupBy(by).agg(F.sum("n").alias("n"), F.sha2(whole, 256).alias("ids_sha256"))


def keyed_digest(rows: DataFrame, key: Column, *by: str) -> DataFrame:
    """(by, n, sha256) of text keys of any form, whatever their order: keys are dealt by the first three hex digits of their
    SHA-256, each deal's keys are joined in order and digested, and the digests are digested."""
    x = rows.select(*by, key.cast("string").alias("key")).withColumn("deal", F.substring(F.sha2("key", 256), 1, 3))
    x = x.groupBy(*by, "deal").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("key")), ","), 256).alias("digest"), F.count("*").alias("n"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("deal", "digest"))), lambda v: v["digest"]), ",")
    return x.groupBy(*by).agg(F.sum("n").alias("n"), F.sha2(whole, 256).alias("sha256"))


def source_digest(source: DataFrame) -> DataFrame:
    """One row (source_rows, source_sha256): a table's rows, each as the digest of its columns' texts."""
    texts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x1e")) for c in source.columns]
    return keyed_digest(source, F.sha2(F.concat_ws("\x1f", *texts), 256)).select(F.coalesce("n", F.lit(0).cast("long")).alias("source_rows"), F.col("sha256").alias("source_sha256"))


def split_manifest(splits: DataFrame, seed: int, proportions: dict[str, float], source: DataFrame) -> DataFrame:
    """(split, n, requested, actual, seed, ids_sha256, source_rows, source_sha256): what a split was made of."""
    total = splits.agg(F.count("*").alias("total"))
    ids = keyed_digest(splits, F.col("query_id"), "split").withColumnRenamed("sha256", "ids_sha256")
    x = ids.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(source_digest(source)))
    asked = F.element_at(F.create_map(*[F.lit(v) for p in proportions.items() for v in p]), F.col("split"))
    return x.select("split", "n", asked.alias("requested"), F.round(F.col("n") / F.col("total"), 6).alias("actual"), F.lit(seed).alias("seed"), "ids_sha256", "source_rows", "source_sha256")


def stratified_sample(queries: DataFrame, size: int, seed: int) -> DataFrame:
    """(query_id, bucket): a sample with the buckets' shares: floors, then largest remainders, ties by bucket.

    No bucket's quota is above size, so each task passes on the size least hashes of a bucket at most.
    """
    q = queries.select("query_id", T.length_bucket(F.col("query")).alias("bucket"))
    counts = q.groupBy("bucket").count().withColumn("total", F.sum("count").over(Window.partitionBy(F.lit(1))))  # four rows at most
    take = F.least(F.lit(size), F.col("total"))
    counts = counts.withColumns({"floor": F.floor(take * F.col("count") / F.col("total")), "rest": take * F.col("count") % F.col("total"), "take": take})
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("rest"), "bucket")
    counts = counts.withColumn("extra", (F.row_number().over(w) <= F.col("take") - F.sum("floor").over(Window.partitionBy(F.lit(1)))).cast("int"))
    quota = counts.select("bucket", (F.col("floor") + F.col("extra")).alias("quota"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("query_id")), 256), "query_id"))
    first = q.withColumn("place", place).where(F.col("place") <= size)  # a number, so that Spark limits each task
    return first.join(F.broadcast(quota), "bucket").where("place <= quota").select("query_id", "bucket")


def label_distribution(labels: DataFrame, domain: tuple[str, ...], column: str = "label") -> DataFrame:
    """(label, n): how often each label of the domain occurs, zeros too."""
    found = labels.groupBy(column).agg(F.count("*").alias("n"))
    known = labels.sparkSession.createDataFrame([(x,) for x in domain], f"{column} string")
    return F.broadcast(known).join(found, column, "left").select(column, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def provenance_mismatches(recorded: DataFrame, actual: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """(owner, key, recorded, actual) where two tables (owner, key, value) differ or lack a row; values that are floating
    point numbers may differ by the tolerance."""
    a, b = recorded.withColumnRenamed("value", "recorded"), actual.withColumnRenamed("value", "actual")
    same = F.col("recorded").eqNullSafe(F.col("actual"))
    if {dict(a.dtypes)["recorded"], dict(b.dtypes)["actual"]} & {"double", "float"}:
        same = same | F.coalesce(F.abs(F.col("recorded") - F.col("actual")) <= tolerance, F.lit(False))
    return a.join(b, ["owner", "key"], "full").where(~same).select("owner", "key", "recorded", "actual")


def validated_requests(requests: DataFrame, modes: tuple[str, ...], most: int = 100, longest: int = 500) -> DataFrame:
    """Requests with a reason: empty for those that can be run."""
    q = T.stripped(F.col("query"))
    reason = F.when(q == "", "blank_query").when(F.length(q) > longest, "query_too_long").when(F.col("top_k").isNull() | (F.col("top_k") < 1) | (F.col("top_k") > most), "bad_top_k").when(~F.coalesce("mode", F.lit("")).isin(*modes), "unknown_mode").otherwise("")
    return requests.withColumn("reason", reason)


FEEDBACK = ("relevant", "not_relevant", "clicked")


def validated_feedback(feedback: DataFrame, searches: DataFrame) -> DataFrame:
    """Feedback with a reason: type not known, search not known, product not returned by it, or empty."""
    known = searches.select("search_id", "returned_product_ids", F.lit(True).alias("known"))
    x = feedback.join(known, "search_id", "left")
    reason = F.when(~F.col("feedback_type").isin(*FEEDBACK), "invalid_type").when(F.col("known").isNull(), "unknown_search").when(~F.coalesce(F.array_contains("returned_product_ids", F.col("product_id")), F.lit(False)), "not_returned").otherwise("")
    return x.select(*feedback.columns, reason.alias("reason"))


def analytics_summary(searches: DataFrame, accepted: DataFrame) -> DataFrame:
    """(measure, name, value): counts and mean latency in aggregate only, no query text and no ids."""
    zero = F.lit(0.0)
    total = searches.agg(F.count("*").cast("double").alias("searches"), F.round(F.coalesce(F.avg("latency_ms"), zero), 6).alias("mean_latency_ms"))
    total = total.select(F.explode(F.array(*[F.struct(F.lit("total").alias("measure"), F.lit(c).alias("name"), F.col(c).alias("value")) for c in ("searches", "mean_latency_ms")])).alias("x")).select("x.*")
    mode = searches.groupBy(F.col("mode").alias("name")).agg(F.count("*").cast("double").alias("value")).select(F.lit("mode").alias("measure"), "name", "value")
    kind = accepted.groupBy(F.col("feedback_type").alias("name")).agg(F.count("*").cast("double").alias("value")).select(F.lit("feedback").alias("measure"), "name", "value")
    return total.unionByName(mode).unionByName(kind)
