"""Features, categories, contracts, serving, dense vectors and persisted indexes on hand-made tables."""

import pytest
from pyspark.sql import functions as F

from gleaner.operators import analysis as A
from gleaner.operators import contracts as C
from gleaner.operators import dense as N
from gleaner.operators import evaluation as E
from gleaner.operators import ranking as R
from gleaner.operators import serving as S
from gleaner.operators import tables as V


def counts(df):
    return {r.check_name: r.n for r in df.collect()}


def test_features(spark):
    hybrid = spark.createDataFrame([("q", "p", 1, 0.8, 0.6, 0.7, 2, 4), ("r", "p2", 3, 0.1, 0.0, 0.2, 1, 0)], "query_id string, product_id string, rank int, lexical_score double, semantic_score double, score double, lexical_rank int, semantic_rank int")
    queries = spark.createDataFrame([("q", "round coffee table"), ("r", "coffee table")], "query_id string, query string")
    catalog = spark.createDataFrame(
        [("p", "Round Oak Coffee Table", "A circular solid wood living room table", "name round oak coffee table description circular solid wood"), ("p2", "Coffee Table", None, None)],
        "product_id string, product_name string, product_description string, product_text string",
    )
    got = {r.product_id: r for r in R.rerank_features(hybrid, queries, catalog, 50).collect()}
    p, p2 = got["p"], got["p2"]
    assert (p.query_title_token_overlap, p.query_title_token_coverage, p.query_product_text_token_coverage, p.exact_phrase_in_title, p.query_length, p.title_length, p.product_text_length) == (0.75, 1, 1, 0, 3, 4, 9)
    assert (p.lexical_similarity, p.semantic_similarity, p.hybrid_score, p.lexical_rank, p.semantic_rank, p.hybrid_rank) == (0.8, 0.6, 0.7, 2, 4, 1)
    assert (p2.semantic_rank, p2.query_description_token_overlap, p2.exact_phrase_in_title, p2.product_text_length) == (51, 0, 1, 0)
    R.check_features(list(R.FEATURES))
    for name in R.FORBIDDEN:
        with pytest.raises(ValueError, match="tell"):
            R.check_features([*R.FEATURES[:-1], name])
    with pytest.raises(ValueError, match="order"):
        R.check_features(list(R.FEATURES[::-1]))


def test_error_categories_and_win_loss(spark):
    rows = [("lexical", 0.9, 0.3, 0.8, 0.85, 2), ("semantic", 0.2, 0.9, 0.8, 0.7, 2), ("hybrid", 0.4, 0.5, 0.9, 0.95, 2), ("partial", 0.5, 0.5, 0.6, 0.4, 1), ("tie", 0.5, 0.5, 0.5, 0.5, 2)]
    rec = spark.createDataFrame([(*r, 1, None if r[0] == "partial" else 1) for r in rows], "query_id string, lexical_ndcg double, semantic_ndcg double, hybrid_ndcg double, rerank_ndcg double, rerank_top_grade int, exact_count int, first_exact_rank int")
    got = E.error_categories(rec, 2, 2).collect()
    assert {r.category: r.n for r in got} == {"lexical_better_than_semantic": 1, "semantic_better_than_lexical": 2, "hybrid_better_than_both": 2, "failed_tail_queries": 2, "partial_vs_exact_confusion": 1, "reranking_helps": 2, "reranking_hurts": 2}
    assert [r.query_id for r in sorted(got, key=lambda r: r.place) if r.category == "failed_tail_queries"] == ["partial", "tie"]
    assert [r.query_id for r in sorted(got, key=lambda r: r.place) if r.category == "semantic_better_than_lexical"] == ["semantic", "hybrid"]
    wins = {(r.query_id, r.category): r.margin for r in E.fusion_win_loss(rec).collect()}
    assert wins == {("lexical", "lexical_wins"): 0.1, ("semantic", "semantic_wins"): 0.1, ("hybrid", "hybrid_improves_both"): 0.4, ("partial", "hybrid_improves_both"): 0.1}
    below = rec.where("query_id = 'tie'").withColumn("hybrid_ndcg", F.lit(0.2))
    assert [(r.category, r.margin) for r in E.fusion_win_loss(below).collect()] == [("fusion_hurts", 0.3)]


def test_components(spark):
    s = "query_id string, product_id string, rank int, score double"
    lex = spark.createDataFrame([("q", "p1", 1, 0.9), ("q", "p2", 2, 0.4)], s)
    sem = spark.createDataFrame([("q", "p2", 1, 0.8)], s)
    pairs = spark.createDataFrame([("q", p) for p in ("p3", "p2", "p1")], "query_id string, product_id string")
    got = R.fuse(R.fused(lex, sem, pairs), R.weighted(0.6)).orderBy("rank").collect()
    assert [r.product_id for r in got] == ["p2", "p1", "p3"] and got[2].score == 0
    p2 = got[0]
    assert (p2.lexical_present, p2.semantic_present, p2.lexical_norm, p2.semantic_norm) == (1, 1, 0, 1)
    assert (p2.lexical_rrf, p2.semantic_rrf) == (pytest.approx(1 / 62), pytest.approx(1 / 61)) and got[1].semantic_rrf == 0 == got[2].lexical_rank


def test_contracts(spark):
    j = "query_id string, product_id string, relevance_grade double"
    rows = [("a", "p", 1.0), ("a", "p", 2.0), ("a", None, 1.0), ("b", "p", None), ("b", "q", -1.0), ("b", "r", float("nan"))]
    assert counts(C.judgment_contract(spark.createDataFrame(rows, j))) == {"missing": 2, "repeated_pairs": 1, "bad_grade": 2}
    assert counts(C.judgment_contract(spark.createDataFrame([("a", "p", 3.0)], j), (0, 1, 2)))["bad_grade"] == 1
    with pytest.raises(ValueError, match="missing required columns"):
        C.judgment_contract(spark.createDataFrame([("a",)], "query_id string"))
    c = spark.createDataFrame([("1", "x"), ("1", "y"), (" ", "z"), ("2", None), ("3", " ")], "product_id string, product_text string")
    assert counts(C.catalog_contract(c)) == {"missing_id": 0, "blank_id": 1, "missing_text": 1, "blank_text": 1, "repeated_id": 1, "no_rows": 0}
    assert counts(C.catalog_contract(c.limit(0)))["no_rows"] == 1
    pairs = spark.createDataFrame([("a", "1"), ("a", "1"), ("a", "9")], "query_id string, product_id string")
    assert counts(C.candidate_contract(pairs, c)) == {"repeated_candidates": 1, "unknown_candidates": 1}
    splits = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "train"), ("z", "test")], "query_id string, split string")
    q = spark.createDataFrame([("a",), ("b",), ("c",)], "query_id string")
    assert counts(C.split_contract(splits, q)) == {"in_two_splits": 1, "in_no_split": 1, "unknown_query": 1, "empty_splits": 1}
    assert [tuple(r) for r in C.split_overlaps(splits).collect()] == [("test", "train", 1)]
    v = spark.createDataFrame([([1.0, 0.0],), ([0.5, 0.5],), (None,), ([1.0],)], "v array<double>")
    assert counts(C.norm_contract(v, "v")) == {"missing": 1, "not_finite": 0, "other_dimensions": 1, "not_unit": 1}
    assert [tuple(r) for r in C.required_columns({"c": (c, ["product_id", "name"])}).collect()] == [("c", "name")]
    C.check_parameters(k=5, depth=100, weight=0.9, weights=(0.0, 0.5), strategy="rrf", proportions=(0.7, 0.15, 0.15), c_grid=(0.1,), class_weights=("none",))
    for bad in ({"k": True}, {"k": 0}, {"depth": 1.5}, {"weight": 1.1}, {"weight": True}, {"weights": (0.1, 0.1)}, {"strategy": "sum"}, {"proportions": (0.5, 0.4)}, {"c_grid": (0,)}, {"class_weights": ("some",)}, {"rrf_k": -1}):
        with pytest.raises(ValueError):
            C.check_parameters(**bad)


def test_serving(spark, tmp_path):
    requests = spark.createDataFrame(
        [("r1", "q1", "lamp", 2, "default", 1.0), ("r2", "q1", " ", 2, "lexical", 1.0), ("r3", "q1", "lamp", 0, "lexical", 1.0), ("r4", "q1", "lamp", 1, "fuzzy", 1.0), ("r5", "q1", "lamp", 1, "rerank", 1.0), ("r6", "q2", "x", 5, "lexical", float("nan"))],
        "request_id string, query_id string, query string, top_k int, mode string, latency_ms double",
    ).withColumn("session_id", F.lit("s"))
    resolved = S.resolved_requests(requests, "lexical", ("lexical", "hybrid"))
    assert {r.request_id: (r.resolved_mode, r.reason) for r in resolved.collect()} == {"r1": ("lexical", ""), "r2": ("lexical", "blank_query"), "r3": ("lexical", "bad_top_k"), "r4": ("fuzzy", "unknown_mode"), "r5": ("rerank", "mode_not_loaded"), "r6": ("lexical", "")}
    ranking = spark.createDataFrame([("q1", p, i + 1, 1.0 - i / 10) for i, p in enumerate("abc")], "query_id string, product_id string, rank int, score double")
    found = S.batch_search(resolved, {"lexical": ranking, "hybrid": ranking.limit(0)}, 100)
    assert sorted((r.request_id, r.product_id, r.rank) for r in found.collect()) == [("r1", "a", 1), ("r1", "b", 2)]
    events = S.search_events(resolved, found)
    assert {r.search_id: (list(r.returned_product_ids), r.reason) for r in events.collect()} == {"r1": (["a", "b"], ""), "r6": ([], "bad_latency")}
    assert S.search_events(resolved, found, enabled=False).count() == 0
    for _ in range(2):
        S.append_events(events, f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 1  # logged twice, held once
    catalog = spark.createDataFrame([("a", "Lamp", "Lighting", "x " * 200)], "product_id string, product_name string, product_class string, product_description string")
    rows = found.withColumn("query", F.lit("lamp"))
    one = S.enriched(rows.where("rank = 1"), catalog).first()
    assert one.matched == "lamp" and one.short.endswith("...") and len(one.short) <= 240
    with pytest.raises(Exception, match="not in the catalog: b"):
        S.enriched(rows, catalog).collect()


def test_dense(spark):
    class Provider:
        def embed_documents(self, texts):
            return [[float(len(t)), 1.0] for t in texts]

        def embed_queries(self, texts):
            return [[0.0, float(len(t))] for t in texts]

    class Short(Provider):
        def embed_documents(self, texts):
            return [[1.0, 1.0]] * (len(texts) + 1)

    c = spark.createDataFrame([("a", "xxx"), ("b", " "), ("c", None)], "product_id string, product_text string")
    made = N.embedded(c, Provider)
    assert {r.product_id: r.vector for r in made.collect()} == {"a": [3.0, 1.0], "b": None, "c": None}
    assert N.embedded(c, Provider, queries=True).where("product_id = 'a'").first().vector == [0.0, 3.0]
    with pytest.raises(Exception, match="more vectors than texts"):
        N.embedded(c, Short).collect()
    index = N.dense_index(made.where("product_id = 'a'"), 2)
    assert index.first().vector == pytest.approx([3 / 10**0.5, 1 / 10**0.5])
    assert tuple(N.dense_metadata(index, "m").first()) == ("m", 1, 2, "double", "l2")
    with pytest.raises(Exception, match="vector of b: missing"):
        N.dense_index(made.where("product_id = 'b'"), 2).collect()
    h = c.select(N.hashed_vector(F.col("product_text"), 8).alias("v")).collect()
    assert sum(h[0].v) == 1 and sum(h[1].v) == 0


def test_index_round_trip(spark, tmp_path):
    c = spark.createDataFrame([("p3", "blue outdoor rug"), ("p1", "round coffee table wood table"), ("p2", "rectangular dining table"), ("p0", "round accent mirror")], "product_id string, t string")
    assert {(r.term, r.tf) for r in R.term_frequencies(c.where("product_id = 'p1'"), "product_id", F.col("t")).collect()} == {("round", 1), ("coffee", 1), ("table", 2), ("wood", 1), ("round coffee", 1), ("coffee table", 1), ("table wood", 1), ("wood table", 1)}
    index = R.LexicalIndex(c, F.col("t"), min_df=1, max_features=None)
    folder = f"{tmp_path}/index"
    index.write(folder)
    q = spark.createDataFrame([("a", "round coffee table")], "query_id string, query string")
    assert sorted(map(tuple, R.LexicalIndex.load(spark, folder).search(q).collect())) == sorted(map(tuple, index.search(q).collect()))
    with pytest.raises(Exception, match="already exists"):
        index.write(folder)
    index.write(folder, force=True)
    index.forward.limit(2).write.mode("append").parquet(f"{folder}/forward")
    with pytest.raises(ValueError, match="metadata"):
        R.LexicalIndex.load(spark, folder)


def test_summaries(spark):
    s = spark.createDataFrame([("lexical", 0.5, 2.0), ("semantic", 0.7, 3.0), ("hybrid", 0.7, 3.0), ("rerank", 0.7, 4.0)], "system string, ndcg double, latency double")
    assert E.select_default(s, ("lexical", "hybrid", "semantic", "rerank")).first().system == "hybrid"
    assert {(r.system, r.delta) for r in E.metric_deltas(s, "lexical", ("ndcg",)).collect()} == {("semantic", 0.2), ("hybrid", 0.2), ("rerank", 0.2)}
    d = R.reranker_decision(s).first()
    assert (d.improved, d.mode) == (False, "hybrid")
    rows = spark.createDataFrame([("a", float(x)) for x in (4, 1, 2, 3, 10)], "k string, v double")
    assert tuple(E.five_number_summary(rows, "k", "v").first()) == ("a", 1.0, 2.0, 3.0, 4.0, 10.0)
    labels = spark.createDataFrame([("Exact",), ("Exact",)], "label string")
    assert {r.label: r.n for r in V.label_distribution(labels, ("Exact", "Partial")).collect()} == {"Exact": 2, "Partial": 0}
    said = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "label int, predicted int")
    one = E.classification_summary(said, spark.createDataFrame([(0,), (1,), (2,)], "class int")).first()
    assert one.accuracy == 0.75 and one.macro_f1 == pytest.approx((2 / 3 + 0.8 + 0) / 3, abs=1e-6)
    a = spark.createDataFrame([("m", "w", 0.1 + 0.2), ("m", "x", 1.0)], "owner string, key string, value double")
    b = spark.createDataFrame([("m", "w", 0.3), ("m", "x", 2.0), ("m", "y", 1.0)], "owner string, key string, value double")
    assert sorted(r.key for r in V.provenance_mismatches(a, b).collect()) == ["x", "y"]
    placed = V.global_place(spark.range(1000).select((999 - F.col("id")).alias("n")), "n")
    assert placed.where("place <> n + 1").count() == 0


def test_lexical_categories(spark):
    cols = "query_id string, relevant long, ndcg double, oov_fraction double, top_grade int, phrase_on_top boolean, title_overlap double"
    rec = spark.createDataFrame([("a", 1, 0.9, 0.0, 2, True, 1.0), ("b", 1, 0.2, 0.5, 0, False, 0.0), ("c", 0, 1.0, 1.0, 2, True, 0.0), ("d", 2, 0.4, 0.5, 0, False, 0.5)], cols)
    got = {}
    for r in A.lexical_error_categories(rec, 1).collect():
        got[r.category] = r.query_id
    assert got == {"high_performing": "a", "poorly_performing": "b", "vocabulary_mismatch": "b", "exact_keyword_success": "a", "synonym_failure": "b"}


def test_reranker_grid_keeps_splits_apart(spark):
    q = [f"q{i}" for i in range(6)]
    feats = [(x, f"p{g}{k}", 1 + g * 2 + k, *[g + 0.05 * k + i / 100 for _ in R.FEATURES]) for i, x in enumerate(q) for g in (0, 1, 2) for k in (0, 1)]
    f = spark.createDataFrame(feats, "query_id string, product_id string, hybrid_rank int, " + ", ".join(f"{n} double" for n in R.FEATURES))
    j = spark.createDataFrame([(r[0], r[1], int(r[1][1])) for r in feats], "query_id string, product_id string, relevance_grade int")
    splits = spark.createDataFrame([(x, "train" if i < 4 else "validation") for i, x in enumerate(q)], "query_id string, split string")
    queries = spark.createDataFrame([(x, "text") for x in q], "query_id string, query string")
    grid, model = R.reranker_grid(f, queries, j, splits)
    rows = grid.collect()
    assert len(rows) == 6 and sum(r.chosen for r in rows) == 1 and all(r.ndcg == 1 for r in rows)
    assert R.coefficients(model, spark).count() == 3 * len(R.FEATURES)
    assert {r.query_id for r in R.training_rows(f, queries, j, splits, "train").select("query_id").distinct().collect()} == set(q[:4])
    with pytest.raises(Exception, match="no judgments: q0"):
        R.training_rows(f, queries, j.where("query_id <> 'q0'"), splits, "train").collect()
