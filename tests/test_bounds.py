"""What tasks hold does not grow with the rows of a block, a batch or a group."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gleaner.operators import lexical as L
from gleaner.operators import tables as V
from gleaner.sources.scratch import written


def test_long_rows_are_read_in_small_groups(spark):
    rows = spark.range(0, 400, 1, 1).select(F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda i: F.xxhash64("id", i)).alias("x"))
    t = written(rows, "long", long_rows=True)
    (file,) = [f.removeprefix("file://") for f in t.inputFiles()]
    groups = pq.ParquetFile(file).metadata
    assert max(groups.row_group(i).total_byte_size for i in range(groups.num_row_groups)) < 8 << 20 and groups.num_rows == 400
    digest = F.expr("bit_xor(xxhash64(x))")
    assert t.select(digest).first() == rows.select(digest).first()


def test_pairs_of_long_products_and_many_queries_are_made_in_pieces(monkeypatch):
    n, terms, products = 400, 400, 32  # each product shares all terms with each query: 5 million entries
    rng = np.random.default_rng(1)
    query, term = np.repeat(np.arange(n), terms), np.tile(np.arange(terms), n)
    q = L.Queries(pa.array([f"q{i}" for i in range(n)]), query, term, rng.random(len(term)))
    row, own, weight = np.repeat(np.arange(products), terms), np.tile(np.arange(terms), products), rng.random(products * terms)
    tracemalloc.start()
    r, met = q.pairs(row, own, weight, np.full(n, -np.inf))
    table = q.table(row, own, weight, products)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(r) == n * products and peak < 80 << 20
    want = weight.reshape(products, terms) @ q.weight.reshape(n, terms).T
    assert table.reshape(products, n) == pytest.approx(want, abs=2e-9)
    monkeypatch.setattr(L, "_ENTRIES", 7_001)
    r2, met2 = q.pairs(row, own, weight, np.full(n, -np.inf))
    assert (r2 == r).all() and (met2 == met).all() and (q.table(row, own, weight, products) == table).all()


def test_tasks_that_count_pairs_are_bounded(spark, monkeypatch):
    rows = [("q", "hot", "Exact")] * 1500 + [(f"q{i}", f"p{i}", ("Exact", None)[i % 2]) for i in range(1500)]
    rows += [("q1", "p1", "Exact"), ("q2", "p2", "Partial"), ("q3", "p3", None), (None, "p", "Exact"), (None, "p", "Partial"), ("q", None, "Exact")]
    labels = spark.createDataFrame(rows, "query_id string, product_id string, label string")
    monkeypatch.setattr(V, "_TASK_ROWS", 100)
    dealt, n = V._dealt(labels, "query_id", "product_id")
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert n == 31 and sum(sizes) == len(rows) and max(sizes) < 500  # the hot pair was one task's before
    found = V.duplicate_counts(labels)
    assert f", {n})" in found._jdf.queryExecution().executedPlan().toString()
    assert tuple(found.first()) == (3006, 1499 + 4, 2)
    assert tuple(V.duplicate_counts(labels.limit(0)).first()) == (None, None, 0)
