"""The block tokeniser, the forward index and pruned search against the plain forms."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner import bindings as D
from gleaner.functions import text as T
from gleaner.operators import lexical as L
from gleaner.operators import ranking as R
from gleaner.operators.best import Best

SF = "/root/testdata/sf0.01"
ODD = ["", None, "a", "ab", "a b c", "Ab aB AB", "éa É İstanbul straße", "日本語 日本語 x_y __ 1_000", "tab\tnl\nab cd", "naïve—café naïve", "x" * 50, "éa é", "½ Ⅷ ٣٤ ab", "end of one"]


class Box:
    def __init__(self, value):
        self.value = value


def test_terms_are_those_of_the_pattern(spark):
    """The block tokeniser against the regular expression and the n-grams of functions.text, row by row."""
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(ODD * 3)], "product_id string, t string").repartition(2)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").cast("string").alias("product_id"), F.col("text").alias("t"))
    for table in (rows, docs):
        got = {(r.product_id, r.term): r.tf for r in L.term_frequencies(table, "product_id", F.col("t")).collect()}
        plain = table.select("product_id", F.explode(T.ngrams(T.index_tokens(F.col("t")))).alias("term")).groupBy("product_id", "term").count()
        assert got == {(r.product_id, r.term): r["count"] for r in plain.collect()}


def test_stats_of_blocks(spark):
    rows = spark.createDataFrame([(f"{b}{i}", f"only{b} word all") for b in "abc" for i in range(4)] + [("z", "once")], "product_id string, t string").repartition(3)
    blocks = L.term_blocks(rows, "product_id", F.col("t"))
    assert {(r.term, r.df, r.total_tf) for r in L.term_stats(blocks, 5, None).collect()} == {("word", 12, 12), ("all", 12, 12), ("word all", 12, 12)}
    assert [r.term for r in L.term_stats(blocks, 2, 2).collect()] == ["all", "word"]
    assert L.term_stats(blocks.limit(0)).count() == 0


def weights(text, idf):
    words = text.split()
    tf = Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)])
    raw = {t: (1 + math.log(n)) * idf[t] for t, n in tf.items() if t in idf}
    norm = math.sqrt(sum(x * x for x in raw.values()))
    return {t: x / norm for t, x in raw.items()}


@pytest.mark.parametrize(("bound", "blocks", "k"), [(100_000, 20_000, 10), (None, 20_000, 3), (40, 7, 4)])
def test_search_and_candidates_by_brute_force(spark, monkeypatch, bound, blocks, k):
    monkeypatch.setattr(L, "QUERY_BLOCK", blocks)
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    weight = [1 / (i + 1) for i in range(60)]
    texts = {f"p{i}": " ".join(r.choices(vocabulary, weight, k=r.randint(0, 40))) for i in range(150)}
    texts |= {f"copy{i}": texts["p1"] for i in range(20)}  # ties, more than k
    queries = {f"q{i}": " ".join(r.choices(vocabulary, weight, k=r.randint(1, 6))) for i in range(25)} | {"p1": texts["p1"], "none": "unheard of", "blank": ""}
    c = spark.createDataFrame(list(texts.items()), "product_id string, t string").repartition(4)
    q = spark.createDataFrame(list(queries.items()), "query_id string, query string")
    index = R.LexicalIndex(c, F.col("t"), 2, bound)
    df, total = Counter(), Counter()
    for t in texts.values():
        words = t.split()
        grams = words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
        df.update(set(grams))
        total.update(grams)
    chosen = sorted((t for t in df if df[t] >= 2), key=lambda t: (-total[t], t))[:bound]
    idf = {t: math.log((1 + len(texts)) / (1 + df[t])) + 1 for t in chosen}
    assert {x.term for x in index.terms.collect()} == set(chosen)
    own = {p: weights(t, idf) for p, t in texts.items()}
    want, every = set(), {}
    for name, t in queries.items():
        v = weights(t, idf)
        scored = {p: round(sum(x * w[g] for g, x in v.items() if g in w), 9) for p, w in own.items()}
        every[name] = scored if v else {}
        best = sorted((-s, p) for p, s in scored.items() if s > 0 and p != name)[:k]
        want |= {(name, p, i + 1, -s) for i, (s, p) in enumerate(best)}
    got = {(x.query_id, x.product_id, x.rank): x.score for x in index.search(q, k, but_itself=True).collect()}
    assert got == pytest.approx({(a, b, n): s for a, b, n, s in want}, abs=2e-9)
    pairs = [(a, b) for a in queries for b in r.sample(sorted(texts), 9)] + [("q1", "not there"), ("stranger", "p1")]
    listed = {(x.query_id, x.product_id): x.score for x in index.candidates(q, spark.createDataFrame(pairs, "query_id string, product_id string")).collect()}
    assert listed == pytest.approx({(a, b): every[a].get(b, 0.0) for a, b in pairs if every.get(a)}, abs=2e-9)


def test_products_that_cannot_reach_the_best_are_not_paired(spark):
    """On the documents and the benchmark's items: pairs made, against pairs that share a term. These texts share a small
    vocabulary: seven in ten of all pairs share a term."""
    index = R.LexicalIndex(D.catalog(spark, SF), F.col("product_description"))
    q = D.text_queries(spark, SF)
    block = next(index._blocks(q)).value
    batches = index.forward.select("product_id", "term_ids", "weights").toArrow().to_batches(max_chunksize=100)
    every, pruned, none = [], [], Box(np.full(len(block.ids), -np.inf))
    one = list(L.best_of(Box(block), none, 10, False)(iter(batches)))[0].to_pydict()
    list(L.best_of(Box(block), none, 1001, False, every)(iter(batches)))  # no floor is ever reached
    tenth = {}
    for name, s in zip(one["query_id"], one["score"], strict=True):
        tenth[name] = min(tenth.get(name, math.inf), s)
    floors = Box(np.array([tenth[x] for x in block.ids.to_pylist()]))
    assert list(L.best_of(Box(block), floors, 10, False, pruned)(iter(batches)))[0].to_pydict() == one
    assert sum(every) == index.postings.select("product_id", "term").join(index.query_vectors(q).select("query_id", "term"), "term").select("query_id", "product_id").distinct().count()
    assert sum(pruned) < 0.6 * sum(every)


def test_candidates_plan_holds_listed_pairs_only(spark):
    index = R.LexicalIndex(D.catalog(spark, SF), F.col("product_description"))
    q = D.text_queries(spark, SF)
    pairs = q.select("query_id", F.lit("3").alias("product_id"))
    plan = index.candidates(q, pairs)._jdf.queryExecution().toString()
    assert "term_ids" in plan and "Generate" not in plan.split("== Physical Plan ==")[1]


def test_best_is_what_a_sort_gives():
    rng = np.random.default_rng(0)
    best, offered = Best(5, 4), {q: [] for q in range(5)}
    for b in range(12):
        names = np.array([f"n{b}-{i}" for i in rng.permutation(30)], object)
        scores = rng.integers(-3, 4, (5, 30)).astype(float)
        scores[rng.random((5, 30)) < 0.3] = -np.inf
        best.offer_all(0, names, scores)
        for q in range(5):
            offered[q] += [(-s, n) for s, n in zip(scores[q].tolist(), names, strict=True) if s > -math.inf]
    for q in range(5):
        assert list(zip((-best.score[q]).tolist(), best.name[q], strict=True)) == sorted(offered[q])[:4]


def test_blocks_of_queries_are_searched_one_after_another(spark, monkeypatch):
    words = "oak table chair lamp sofa round red blue".split()
    c = spark.createDataFrame([(f"p{i}", " ".join(words[(i * j + j) % 8] for j in range(1, 2 + i % 5))) for i in range(40)], "product_id string, text string")
    q = spark.createDataFrame([(f"q{i}", f"{words[i]} {words[i - 3]}") for i in range(8)], "query_id string, query string")
    index = L.LexicalIndex(c, F.col("text"), max_features=None)
    want = index.search(q, 3)
    assert "MapInArrow" in want._jdf.queryExecution().toString()
    monkeypatch.setattr(L, "QUERY_BLOCK", 2)
    found = index.search(q, 3)
    assert "MapInArrow" not in found._jdf.queryExecution().toString()  # nothing is left that holds a block
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and want.count() == 24


def test_all_postings_are_those_of_the_index_without_its_tables(spark, monkeypatch):
    c = spark.createDataFrame([("1", "Oak table oak"), ("2", "oak chair table"), ("3", None), ("4", "alone"), ("5", "oak table " * 50)], "product_id string, text string").repartition(2)
    want = L.LexicalIndex(c, F.col("text"), max_features=None).postings
    made, old = [], L.written
    monkeypatch.setattr(L, "written", lambda df, label, **k: made.append(label) or old(df, label, **k))
    monkeypatch.setattr(L, "_POSTINGS", 2)
    rows = lambda df: sorted((r.product_id, r.term, r.tf, round(r.weight, 9)) for r in df.collect())
    found = L.all_postings(c, "product_id", F.col("text"))
    assert rows(found) == rows(want) and len(rows(want)) == 10 and made == ["term-blocks"]
    assert rows(L.all_postings(c.limit(0), "product_id", F.col("text"))) == []
