"""SQL with the same rows as the registered queries, where SQL can express them; written apart from the plans."""

from __future__ import annotations

_NORM = "trim(regexp_replace(coalesce({}, ''), '[\\t-\\r\\x1c-\\x20\\x{{85}}\\p{{Z}}]+', ' ', 'g'))"
_TOK = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+')"
_IDX = "regexp_extract_all(lower(coalesce({}, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}')"
_GRAMS = "list_concat({0}, list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
_BUCKET = "CASE WHEN len(string_split({0}, ' ')) <= 1 THEN '1' WHEN len(string_split({0}, ' ')) = 2 THEN '2' WHEN len(string_split({0}, ' ')) <= 4 THEN '3-4' ELSE '5+' END"

_LABELS = """labels_ AS (SELECT l_suppkey::VARCHAR AS query_id, l_partkey::VARCHAR AS product_id,
    CASE l_returnflag WHEN 'A' THEN 'Exact' WHEN 'N' THEN 'Partial' ELSE 'Irrelevant' END AS label FROM lineitem)"""
_CANON = _LABELS + """,
    counted AS (SELECT query_id, product_id, label, CASE label WHEN 'Exact' THEN 2 WHEN 'Partial' THEN 1 ELSE 0 END AS g, count(*) AS n FROM labels_ GROUP BY ALL),
    ordered AS (SELECT *, row_number() OVER w AS rn, max(n) OVER p AS top FROM counted WINDOW w AS (PARTITION BY query_id, product_id ORDER BY n DESC, g DESC, label), p AS (PARTITION BY query_id, product_id)),
    canon AS (SELECT query_id, product_id, max(CASE WHEN rn = 1 THEN label END) AS label, max(CASE WHEN rn = 1 THEN g END) AS relevance_grade, max(CASE WHEN rn = 1 THEN n END) AS selected_label_count,
        sum(n)::BIGINT AS judgment_count, count(*) AS distinct_label_count, string_agg(label, '|' ORDER BY g DESC, label) AS observed_labels,
        CASE WHEN sum(n) = 1 THEN 'single' WHEN count(*) = 1 THEN 'identical_duplicate_collapse' WHEN sum(CASE WHEN n = top THEN 1 ELSE 0 END) > 1 THEN 'tie_highest_relevance' ELSE 'majority_vote' END AS resolution
        FROM ordered GROUP BY query_id, product_id)"""

_PAIRS = f"""pairs AS (SELECT doc_id, {_TOK.format('b.text')} AS q, {_TOK.format('d.text')} AS t FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT max(item_id) + 1 FROM benchmark))"""

_PRODUCT_TEXT = "concat_ws(' ', " + ", ".join(f"nullif({_NORM.format(c)}, '')" for c in ("string_split(text, chr(10))[1]", "lang", "source", "text")) + ")"

_CAT = f"""cat AS (SELECT doc_id::VARCHAR AS product_id, string_split(text, chr(10))[1] AS product_name, lang AS product_class, text AS body, {_PRODUCT_TEXT} AS product_text, embedding::DOUBLE[] AS v, label FROM documents JOIN embeddings ON doc_id = vec_id),
    qs AS (SELECT product_id AS query_id, body AS query, v AS qv, label FROM cat WHERE product_id::BIGINT % 50 = 0),
    judged AS (SELECT query_id, product_id, 2 - abs(q.label - c.label) AS grade FROM qs q JOIN cat c ON abs(q.label - c.label) <= 2 AND query_id <> product_id)"""


def _index(catalog: str, text: str, queries: str) -> str:
    """Postings and query vectors over a catalog's terms."""
    return f""",
    ptok AS (SELECT product_id, {_IDX.format(text)} AS w FROM {catalog}), ptf AS (SELECT product_id, term, count(*) AS tf FROM (SELECT product_id, unnest({_GRAMS.format('w')}) AS term FROM ptok) GROUP BY ALL),
    stats AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS total_tf FROM ptf GROUP BY term HAVING count(*) >= 2 ORDER BY total_tf DESC, term LIMIT 100000),
    terms AS (SELECT *, ln((1.0 + (SELECT count(*) FROM {catalog})) / (1.0 + df)) + 1 AS idf FROM stats),
    praw AS (SELECT product_id, term, tf, (1 + ln(tf)) * idf AS raw FROM ptf JOIN terms USING (term)), post AS (SELECT product_id, term, tf, raw / sqrt(sum(raw * raw) OVER (PARTITION BY product_id)) AS weight FROM praw),
    qtok AS (SELECT query_id, {_IDX.format('query')} AS w FROM {queries}), qtf AS (SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest({_GRAMS.format('w')}) AS term FROM qtok) GROUP BY ALL),
    qraw AS (SELECT query_id, term, tf, (1 + ln(tf)) * idf AS raw FROM qtf JOIN terms USING (term)), qvec AS (SELECT query_id, term, tf, raw / sqrt(sum(raw * raw) OVER (PARTITION BY query_id)) AS weight FROM qraw),
    lscore AS (SELECT query_id, product_id, sum(q.weight * p.weight) AS score FROM qvec q JOIN post p USING (term) GROUP BY ALL)"""


def _ranked(name: str, source: str, k: int) -> str:
    return f""",
    {name} AS (SELECT query_id, product_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, product_id) AS rank FROM {source} QUALIFY rank <= {k})"""


#: All documents as the catalog, the benchmark's items as queries.
_TEXT = "cat AS (SELECT doc_id::VARCHAR AS product_id, text AS body FROM documents), qs AS (SELECT item_id::VARCHAR AS query_id, text AS query FROM benchmark)" + _index("cat", "body", "qs")
_LEX = _CAT + _index("cat", "body", "qs") + ", lown AS (SELECT * FROM lscore WHERE query_id <> product_id AND score > 0)"
_SEM = """,
    sscore AS (SELECT query_id, product_id, list_inner_product(qv, v) / sqrt(list_inner_product(qv, qv)) / sqrt(list_inner_product(v, v)) AS score FROM qs, cat WHERE query_id <> product_id AND trim(query) <> '')"""
_FUSED = (
    _LEX
    + _SEM
    + _ranked("lex", "lown", 100)
    + _ranked("sem", "sscore", 100)
    + """,
    sides AS (SELECT query_id, product_id, round(l.score, 9) AS ls, l.score AS lraw, l.rank AS lr, round(s.score, 9) AS ss, s.score AS sraw, s.rank AS sr FROM lex l FULL JOIN sem s USING (query_id, product_id)),
    spans AS (SELECT *, min(ls) OVER w AS l0, max(ls) OVER w AS l1, min(ss) OVER w AS s0, max(ss) OVER w AS s1 FROM sides WINDOW w AS (PARTITION BY query_id)),
    comp AS (SELECT query_id, product_id, coalesce(lraw, 0) AS lexical_score, coalesce(sraw, 0) AS semantic_score, coalesce(lr, 0) AS lexical_rank, coalesce(sr, 0) AS semantic_rank,
        CASE WHEN ls IS NULL THEN 0 WHEN l1 - l0 <= 1e-12 THEN 1 ELSE (ls - l0) / (l1 - l0) END AS lexical_norm, CASE WHEN ss IS NULL THEN 0 WHEN s1 - s0 <= 1e-12 THEN 1 ELSE (ss - s0) / (s1 - s0) END AS semantic_norm FROM spans),
    wscore AS (SELECT *, (1 - 0.9::DOUBLE) * lexical_norm + 0.9::DOUBLE * semantic_norm AS score FROM comp),
    hyb AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, product_id) AS rank FROM wscore QUALIFY rank <= 100)"""
)
#: The reranker's features, in order, and the fixed model's logits over them.
FEATURE_NAMES = "lexical_similarity semantic_similarity hybrid_score lexical_rank semantic_rank query_title_token_overlap query_description_token_overlap exact_phrase_in_title query_title_token_coverage query_product_text_token_coverage query_length title_length product_text_length".split()


def _features(source: str, depth: int, rer: str = "rer") -> str:
    """feat: the features of the pairs of a fused ranking up to a depth; rer: their order by the fixed model."""
    return f""",
    ftok AS (SELECT h.*, {_TOK.format('q.query')} AS q, {_TOK.format('c.product_name')} AS t, {_TOK.format('c.body')} AS d, {_TOK.format('c.product_text')} AS x
        FROM {source} h JOIN qs q USING (query_id) JOIN cat c USING (product_id) WHERE rank <= {depth}),
    fset AS (SELECT *, list_distinct(q) AS uq, len(list_distinct(list_concat(q, t))) AS qt, len(list_distinct(list_concat(q, d))) AS qd,
        len(list_intersect(list_distinct(q), list_distinct(t))) AS it, len(list_intersect(list_distinct(q), list_distinct(d))) AS idd, len(list_intersect(list_distinct(q), list_distinct(x))) AS ix FROM ftok),
    feat AS (SELECT query_id, product_id, rank AS hybrid_rank, lexical_score AS lexical_similarity, semantic_score AS semantic_similarity, score AS hybrid_score,
        CASE WHEN lexical_rank > 0 THEN lexical_rank ELSE {depth + 1} END::DOUBLE AS lexical_rank, CASE WHEN semantic_rank > 0 THEN semantic_rank ELSE {depth + 1} END::DOUBLE AS semantic_rank,
        CASE WHEN qt > 0 THEN it / qt ELSE 0 END AS query_title_token_overlap, CASE WHEN qd > 0 THEN idd / qd ELSE 0 END AS query_description_token_overlap,
        CASE WHEN len(q) > 0 AND contains(' ' || array_to_string(t, ' ') || ' ', ' ' || array_to_string(q, ' ') || ' ') THEN 1.0 ELSE 0.0 END::DOUBLE AS exact_phrase_in_title,
        CASE WHEN len(uq) > 0 THEN it / len(uq) ELSE 0 END AS query_title_token_coverage, CASE WHEN len(uq) > 0 THEN ix / len(uq) ELSE 0 END AS query_product_text_token_coverage,
        len(q)::DOUBLE AS query_length, len(t)::DOUBLE AS title_length, len(x)::DOUBLE AS product_text_length FROM fset),
    logit AS (SELECT *, 0.3 - lexical_similarity - 0.5 * semantic_similarity - 0.2 * query_title_token_coverage AS z0, 0.1 + 0.2 * lexical_similarity + 0.4 * semantic_similarity + 0.1 * query_title_token_coverage AS z1,
        -0.4 + 1.5 * lexical_similarity + semantic_similarity + 0.6 * query_title_token_coverage AS z2 FROM feat),
    {rer} AS (SELECT query_id, product_id, hybrid_rank, (exp(z1) + 2 * exp(z2)) / (exp(z0) + exp(z1) + exp(z2)) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, hybrid_rank, product_id) AS rank FROM logit QUALIFY rank <= 10)"""


_FEATURES = _FUSED + _features("hyb", 100)
_POOL = (
    _LEX
    + _SEM
    + """,
    lc AS (SELECT query_id, product_id, coalesce(score, 0) AS score FROM judged LEFT JOIN lscore USING (query_id, product_id) WHERE query_id IN (SELECT query_id FROM qvec)),
    lcr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, product_id) AS rank FROM lc),
    scd AS (SELECT s.* FROM sscore s JOIN judged USING (query_id, product_id)),
    scr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, product_id) AS rank FROM scd),
    psides AS (SELECT j.query_id, j.product_id, l.score AS lraw, round(l.score, 9) AS ls, l.rank AS lr, s.score AS sraw, round(s.score, 9) AS ss, s.rank AS sr FROM judged j LEFT JOIN lcr l USING (query_id, product_id) LEFT JOIN scr s USING (query_id, product_id)),
    pspans AS (SELECT *, min(ls) OVER w AS l0, max(ls) OVER w AS l1, min(ss) OVER w AS s0, max(ss) OVER w AS s1 FROM psides WINDOW w AS (PARTITION BY query_id)),
    pcomp AS (SELECT query_id, product_id, coalesce(lraw, 0) AS lexical_score, coalesce(sraw, 0) AS semantic_score, coalesce(lr, 0) AS lexical_rank, coalesce(sr, 0) AS semantic_rank,
        CASE WHEN ls IS NULL THEN 0 WHEN l1 - l0 <= 1e-12 THEN 1 ELSE (ls - l0) / (l1 - l0) END AS lexical_norm, CASE WHEN ss IS NULL THEN 0 WHEN s1 - s0 <= 1e-12 THEN 1 ELSE (ss - s0) / (s1 - s0) END AS semantic_norm,
        coalesce(1::DOUBLE / (60 + lr), 0) AS lexical_rrf, coalesce(1::DOUBLE / (60 + sr), 0) AS semantic_rrf, (lr IS NOT NULL)::INT::DOUBLE AS lexical_present, (sr IS NOT NULL)::INT::DOUBLE AS semantic_present FROM pspans),
    pscore AS (SELECT *, (1 - 0.9::DOUBLE) * lexical_norm + 0.9::DOUBLE * semantic_norm AS score FROM pcomp),
    pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, product_id) AS rank FROM pscore)"""
)
#: The four systems on judged candidates: jl, js, jh, jr.
_JUDGED = (
    _POOL
    + _features("pool", 100, "jr")
    + """,
    jl AS (SELECT query_id, product_id, lexical_rank AS rank FROM pool WHERE lexical_rank BETWEEN 1 AND 10), js AS (SELECT query_id, product_id, semantic_rank AS rank FROM pool WHERE semantic_rank BETWEEN 1 AND 10),
    jh AS (SELECT query_id, product_id, rank FROM pool WHERE rank <= 10)"""
)
_RANKED = {"lexical": "jl", "semantic": "js", "hybrid": "jh", "rerank": "jr"}


def _evaluated(name: str, ranking: str, k: int = 10) -> str:
    """Per-query metrics of a ranking against judged."""
    return f""",
    {name}_i AS (SELECT query_id, count(*) AS candidates, sum(CASE WHEN grade >= 1 THEN 1 ELSE 0 END) AS relevant, sum(CASE WHEN rn <= {k} THEN (pow(2.0, grade) - 1) / log2(rn + 1) END) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, product_id) AS rn FROM judged) GROUP BY query_id),
    {name}_f AS (SELECT query_id, count(*) AS retrieved, sum((pow(2.0, coalesce(grade, 0)) - 1) / log2(rank + 1)) AS gain, sum(CASE WHEN grade >= 1 THEN 1 ELSE 0 END) AS hits, min(CASE WHEN grade >= 1 THEN rank END) AS first FROM {ranking} LEFT JOIN judged USING (query_id, product_id) WHERE rank <= {k} GROUP BY query_id),
    {name} AS (SELECT query_id, coalesce(candidates, 0)::BIGINT AS candidates, coalesce(retrieved, 0)::BIGINT AS retrieved, coalesce(relevant, 0)::BIGINT AS relevant, round(coalesce(gain, 0), 6) AS dcg, round(CASE WHEN ideal > 0 THEN coalesce(gain, 0) / ideal ELSE 0 END, 6) AS ndcg,
        round(coalesce(hits, 0) / {k}, 6) AS precision, round(CASE WHEN relevant > 0 THEN coalesce(hits, 0) / relevant ELSE 0 END, 6) AS recall, round(coalesce(1 / first, 0), 6) AS rr FROM qs LEFT JOIN {name}_i USING (query_id) LEFT JOIN {name}_f USING (query_id))"""


_RUNS = _JUDGED + "".join(_evaluated(f"e_{x}", r) for x, r in _RANKED.items())
_TOPS = ", ".join(f"coalesce((SELECT max(grade) FROM {r} r JOIN judged j USING (query_id, product_id) WHERE r.query_id = x.query_id AND rank = 1), 0)::INT AS {x}_top_grade" for x, r in _RANKED.items())
_RECORDS = (
    _RUNS
    + ", exact AS (SELECT query_id, count(*) FILTER (WHERE grade = 2) AS exact_count FROM judged GROUP BY query_id)"
    + ", rec AS (SELECT x.query_id, exact_count, "
    + ", ".join(f"e_{x}.ndcg AS {x}_ndcg" for x in _RANKED)
    + f", {_TOPS}, (SELECT max(product_id) FROM jr WHERE jr.query_id = x.query_id AND rank = 1) AS top_product_id, (SELECT min(rank) FROM jr JOIN judged j USING (query_id, product_id) WHERE jr.query_id = x.query_id AND grade = 2)::INT AS first_exact_rank FROM exact x "
    + " ".join(f"JOIN e_{x} USING (query_id)" for x in _RANKED)
    + ")"
)
_CASES = (
    ("lexical_better_than_semantic", "lexical_ndcg > semantic_ndcg", "semantic_ndcg - lexical_ndcg", "lexical_ndcg - semantic_ndcg", 3),
    ("semantic_better_than_lexical", "semantic_ndcg > lexical_ndcg", "lexical_ndcg - semantic_ndcg", "semantic_ndcg - lexical_ndcg", 3),
    ("hybrid_better_than_both", "hybrid_ndcg > greatest(lexical_ndcg, semantic_ndcg)", "greatest(lexical_ndcg, semantic_ndcg) - hybrid_ndcg", "hybrid_ndcg - greatest(lexical_ndcg, semantic_ndcg)", 3),
    ("reranking_helps", "rerank_ndcg > hybrid_ndcg", "hybrid_ndcg - rerank_ndcg", "rerank_ndcg - hybrid_ndcg", 3),
    ("reranking_hurts", "rerank_ndcg < hybrid_ndcg", "rerank_ndcg - hybrid_ndcg", "hybrid_ndcg - rerank_ndcg", 3),
    ("partial_vs_exact_confusion", "exact_count > 0 AND rerank_top_grade = 1", "(first_exact_rank IS NULL)::INT", "0.0", 3),
)
_CATEGORIES = " UNION ALL ".join(f"(SELECT '{n}' AS category, count(*) OVER () AS n, row_number() OVER (ORDER BY {k}, query_id)::INT AS place, query_id, round({m}, 6) AS margin FROM rec WHERE {c} QUALIFY place <= {most})" for n, c, k, m, most in _CASES)
_TAIL = "(SELECT 'failed_tail_queries' AS category, least(5, count(*) OVER ()) AS n, row_number() OVER (ORDER BY rerank_ndcg, query_id)::INT AS place, query_id, 0.0 AS margin FROM rec QUALIFY place <= 5)"
_MARGINS = (("lexical_wins", "l - greatest(s, h)"), ("semantic_wins", "s - greatest(l, h)"), ("hybrid_improves_both", "h - greatest(l, s)"), ("fusion_hurts", "least(l, s) - h"))
_CONFIGS = ", ".join(f"('w{i:02d}', {i / 10}::DOUBLE)" for i in range(11))
_GRID = (
    _FUSED
    + f""",
    conf AS (SELECT * FROM (VALUES {_CONFIGS}, ('rrf', NULL)) c(config, w)),
    gs AS (SELECT config, query_id, product_id, CASE WHEN w IS NULL THEN CASE WHEN lexical_rank > 0 THEN 0.5::DOUBLE / (60 + lexical_rank) ELSE 0 END + CASE WHEN semantic_rank > 0 THEN 0.5::DOUBLE / (60 + semantic_rank) ELSE 0 END ELSE (1 - w) * lexical_norm + w * semantic_norm END AS score FROM comp, conf),
    gr AS (SELECT *, row_number() OVER (PARTITION BY config, query_id ORDER BY round(score, 9) DESC, product_id) AS rank FROM gs QUALIFY rank <= 10),
    gi AS (SELECT query_id, sum(CASE WHEN grade >= 1 THEN 1 ELSE 0 END) AS relevant, sum(CASE WHEN rn <= 10 THEN (pow(2.0, grade) - 1) / log2(rn + 1) END) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, product_id) AS rn FROM judged) GROUP BY query_id),
    gf AS (SELECT config, query_id, sum((pow(2.0, coalesce(grade, 0)) - 1) / log2(rank + 1)) AS gain, sum(CASE WHEN grade >= 1 THEN 1 ELSE 0 END) AS hits, min(CASE WHEN grade >= 1 THEN rank END) AS first FROM gr LEFT JOIN judged USING (query_id, product_id) GROUP BY ALL),
    ge AS (SELECT c.config, round(CASE WHEN ideal > 0 THEN coalesce(gain, 0) / ideal ELSE 0 END, 6) AS ndcg, round(CASE WHEN relevant > 0 THEN coalesce(hits, 0) / relevant ELSE 0 END, 6) AS recall, round(coalesce(1 / first, 0), 6) AS rr FROM qs CROSS JOIN conf c LEFT JOIN gi USING (query_id) LEFT JOIN gf ON gf.query_id = qs.query_id AND gf.config = c.config),
    grid AS (SELECT config, round(avg(ndcg), 4) AS ndcg, round(avg(recall), 4) AS recall, round(avg(rr), 4) AS rr FROM ge GROUP BY config)"""
)
_SEARCHES = """ev AS (SELECT event_id AS search_id, value AS latency_ms, ['lexical', 'semantic', 'hybrid', 'rerank'][event_id % 4 + 1] AS mode, list_transform(range(10), lambda i: ((coalesce((props->>'$.k')::INT, 0) + 7 * i) % 100)::VARCHAR) AS returned FROM events WHERE event_type = 'view'),
    fb AS (SELECT event_id AS feedback_id, event_id - 1 AS search_id, props->>'$.k' AS product_id, CASE event_type WHEN 'click' THEN 'clicked' WHEN 'purchase' THEN 'relevant' WHEN 'signup' THEN 'not_relevant' ELSE event_type END AS kind FROM events WHERE event_type <> 'view'),
    fv AS (SELECT feedback_id, kind, CASE WHEN kind NOT IN ('clicked', 'relevant', 'not_relevant') THEN 'invalid_type' WHEN ev.search_id IS NULL THEN 'unknown_search' WHEN NOT coalesce(list_contains(returned, product_id), FALSE) THEN 'not_returned' ELSE '' END AS reason FROM fb LEFT JOIN ev USING (search_id))"""
_SPLITS = """sp AS (SELECT item_id::VARCHAR AS query_id, row_number() OVER (ORDER BY sha256('42:' || item_id::VARCHAR), item_id::VARCHAR) AS rn, count(*) OVER () AS n FROM benchmark),
    ex AS (SELECT *, floor(0.7 * n + 1e-9) AS a, floor(0.15 * n + 1e-9) AS b, 0.7 * n - floor(0.7 * n + 1e-9) AS ra, 0.15 * n - floor(0.15 * n + 1e-9) AS rb FROM sp),
    sz AS (SELECT *, n - a - 2 * b AS extra FROM ex),
    sw AS (SELECT *, a + CASE WHEN extra >= 1 AND ra >= rb OR extra >= 3 THEN 1 ELSE 0 END AS na, b + CASE WHEN extra >= 1 AND ra < rb OR extra >= 2 THEN 1 ELSE 0 END AS nb FROM sz),
    split AS (SELECT query_id, CASE WHEN rn <= na THEN 'train' WHEN rn <= na + nb THEN 'validation' ELSE 'test' END AS split FROM sw)"""
_SCORE = "SELECT query_id, product_id, rank, round(score, 6) AS score FROM "
_MEANS = ", ".join(f"round(avg({m}), 4) AS mean_{m}" for m in ("ndcg", "precision", "recall", "rr")) + ", " + ", ".join(f"round(coalesce(avg(CASE WHEN relevant > 0 THEN {m} END), 0), 4) AS eligible_{m}" for m in ("ndcg", "precision", "recall", "rr"))

_META = """SELECT (SELECT count(*) FROM cat) AS documents, count(DISTINCT product_id) AS products, count(DISTINCT term) AS terms, count(*) AS postings, (SELECT count(*) FROM terms) AS vocabulary,
        2::BIGINT AS min_df, {}::BIGINT AS max_features, '1-2' AS ngrams, 'sublinear' AS tf, 'l2' AS norm FROM post"""

ORACLE = {
    "normalize_text": f"SELECT doc_id, sha256({_NORM.format('text')}) AS text_sha256 FROM documents",
    "product_text": f"SELECT p_partkey, concat_ws(' ', nullif({_NORM.format('p_name')}, ''), nullif({_NORM.format('p_type')}, ''), nullif({_NORM.format('p_brand')}, '')) AS product_text FROM part",
    "label_grade": f"WITH {_LABELS} SELECT label, CASE label WHEN 'Exact' THEN 2 WHEN 'Partial' THEN 1 ELSE 0 END AS grade, count(*) AS n FROM labels_ GROUP BY ALL",
    "feature_tokens": f"SELECT doc_id, len({_TOK.format('text')})::INT AS n_tokens, sha256(array_to_string({_TOK.format('text')}, ' ')) AS tokens_sha256 FROM documents",
    "word_ngrams": f"WITH t AS (SELECT doc_id, {_IDX.format('text')} AS w FROM documents), g AS (SELECT doc_id, {_GRAMS.format('w')} AS g FROM t) SELECT doc_id, len(g)::INT AS n_grams, sha256(array_to_string(g, '|')) AS grams_sha256 FROM g",
    "token_measures": f"""WITH {_PAIRS} SELECT doc_id, round(CASE WHEN len(list_distinct(list_concat(q, t))) > 0 THEN len(list_intersect(list_distinct(q), list_distinct(t))) / len(list_distinct(list_concat(q, t))) ELSE 0 END, 6) AS jaccard,
        round(CASE WHEN len(q) > 0 THEN len(list_intersect(list_distinct(q), list_distinct(t))) / len(list_distinct(q)) ELSE 0 END, 6) AS coverage,
        CASE WHEN len(q) > 0 AND contains(' ' || array_to_string(t, ' ') || ' ', ' ' || array_to_string(q, ' ') || ' ') THEN 1.0 ELSE 0.0 END::DOUBLE AS phrase FROM pairs""",
    "matched_terms": f"WITH {_PAIRS} SELECT doc_id, array_to_string(list_filter(q, lambda x, i: list_contains(t, x) AND list_position(q, x) = i), ' ') AS matched FROM pairs",
    "short_description": f"WITH n AS (SELECT doc_id, {_NORM.format('text')} AS t FROM documents) SELECT doc_id, CASE WHEN t = '' THEN NULL WHEN length(t) <= 240 THEN t ELSE rtrim(t[1:237]) || '...' END AS short FROM n",
    "length_buckets": f"WITH n AS (SELECT {_NORM.format('text')} AS t FROM documents) SELECT {_BUCKET.format('t')} AS bucket, count(*) AS n FROM n GROUP BY ALL",
    "l2_normalize": "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), u AS (SELECT vec_id, unnest(list_transform(v, lambda x: x / sqrt(list_inner_product(v, v)))) AS x, unnest(range(len(v)))::INT AS place FROM e) SELECT vec_id, place, round(x, 6) AS x FROM u",
    "sample_hash": """WITH b AS (SELECT source, doc_id // 1000 AS block, sha256(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS digest, count(*) AS n FROM documents GROUP BY ALL)
        SELECT source, sum(n)::BIGINT AS n, sha256(string_agg(digest, ',' ORDER BY block)) AS ids_sha256 FROM b GROUP BY source""",
    "missing_counts": " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL" + (f" OR {_NORM.format(c)} = ''" if c in ("text", "lang", "source") else "") + (" OR doc_id % 25 = 0" if c == "text" else "") + ") AS missing FROM documents" for c in ("doc_id", "text", "lang", "source", "n_chars")),
    "duplicate_counts": f"WITH {_LABELS}, p AS (SELECT query_id, product_id, count(*) AS n, count(DISTINCT label) AS d FROM labels_ GROUP BY ALL) SELECT sum(n)::BIGINT AS label_rows, sum(n - 1)::BIGINT AS repeated_pairs, count(*) FILTER (WHERE d > 1) AS conflicting_pairs FROM p",
    "invalid_labels": "SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view', 'purchase') GROUP BY event_type",
    "fk_violations": """WITH a AS (SELECT DISTINCT doc_id::VARCHAR AS k FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)), b AS (SELECT DISTINCT l_partkey::VARCHAR AS k FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part))
        SELECT 'label_vector' AS check_name, count(*) AS n, coalesce((SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT k FROM a ORDER BY k LIMIT 5)), '') AS examples FROM a
        UNION ALL SELECT 'item_part', count(*), coalesce((SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT k FROM b ORDER BY k LIMIT 5)), '') FROM b""",
    "vector_contract": "SELECT CASE WHEN embedding IS NULL THEN 'missing' WHEN len(embedding) <> 64 THEN 'dimension' WHEN len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 THEN 'not_finite' WHEN list_inner_product(embedding, embedding) = 0 THEN 'zero' ELSE 'ok' END AS flaw, count(*) AS n FROM embeddings GROUP BY ALL",
    "request_validation": """SELECT item_id::VARCHAR AS request_id, CASE WHEN item_id % 7 = 0 OR trim(text, chr(32) || chr(9) || chr(10) || chr(13)) = '' THEN 'blank_query' WHEN length(trim(text, chr(32) || chr(9) || chr(10) || chr(13))) > 500 THEN 'query_too_long' WHEN item_id * 9 < 1 OR item_id * 9 > 100 THEN 'bad_top_k' WHEN item_id % 4 = 3 THEN 'unknown_mode' ELSE '' END AS reason FROM benchmark""",
    "provenance_audit": """WITH a AS (SELECT lang AS owner, source AS key, count(*) AS recorded FROM documents GROUP BY ALL), b AS (SELECT lang AS owner, source AS key, count(*) AS actual FROM documents WHERE doc_id % 10 <> 0 GROUP BY ALL)
        SELECT owner, key, recorded, actual FROM a FULL JOIN b USING (owner, key) WHERE recorded IS DISTINCT FROM actual""",
    "source_manifest": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows, (SELECT string_agg(column_name, ',' ORDER BY ordinal_position) FROM information_schema.columns WHERE table_name = '{t}') AS columns FROM {t}" for t in "benchmark conversations customer documents embeddings events labels lineitem nation orders pages part region supplier".split()),
    "canonical_judgments": f"WITH {_CANON} SELECT * FROM canon",
    "judgment_quality": f"WITH {_CANON} SELECT sum(judgment_count)::BIGINT AS original, count(*) AS canonical, (sum(judgment_count) - count(*))::BIGINT AS repeated, (sum(judgment_count) - sum(distinct_label_count))::BIGINT AS identical_duplicates, count(*) FILTER (WHERE distinct_label_count > 1) AS conflicts, "
    + ", ".join(f"count(*) FILTER (WHERE resolution = '{r}') AS {r}" for r in ("single", "identical_duplicate_collapse", "tie_highest_relevance", "majority_vote"))
    + " FROM canon",
    "conflict_combinations": f"WITH {_CANON} SELECT observed_labels, count(*) AS n FROM canon WHERE distinct_label_count > 1 GROUP BY ALL",
    "class_distribution": f"WITH {_CAT} SELECT " + ", ".join(f"count(*) FILTER (WHERE grade = {g}) AS grade_{g}" for g in (0, 1, 2)) + " FROM judged",
    "latency_summary": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, CASE WHEN count(*) >= 100 THEN round(quantile_cont(value, 0.99), 6) END AS p99 FROM events WHERE value IS NOT NULL AND NOT isnan(value) AND value >= 0 GROUP BY event_type",
    "query_splits": f"WITH {_SPLITS} SELECT * FROM split",
    "split_manifest": f"""WITH {_SPLITS}, b AS (SELECT split, substr(sha256(query_id), 1, 3) AS block, sha256(string_agg(query_id, ',' ORDER BY query_id)) AS digest, count(*) AS n FROM split GROUP BY ALL),
        h AS (SELECT sha256(concat_ws(chr(31), coalesce(item_id::VARCHAR, chr(30)), coalesce(text, chr(30)))) AS key FROM benchmark), hb AS (SELECT substr(sha256(key), 1, 3) AS block, sha256(string_agg(key, ',' ORDER BY key)) AS digest FROM h GROUP BY ALL)
        SELECT split, sum(n)::BIGINT AS n, CASE split WHEN 'train' THEN 0.7 ELSE 0.15 END::DOUBLE AS requested, round(sum(n) / (SELECT count(*) FROM split), 6) AS actual, 42 AS seed, sha256(string_agg(digest, ',' ORDER BY block)) AS ids_sha256, (SELECT count(*) FROM benchmark) AS source_rows,
               (SELECT sha256(string_agg(digest, ',' ORDER BY block)) FROM hb) AS source_sha256 FROM b GROUP BY split""",
    "stratified_sample": f"""WITH q AS (SELECT p_partkey::VARCHAR AS query_id, {_BUCKET.format(_NORM.format('p_name'))} AS bucket FROM part), c AS (SELECT bucket, count(*) AS n, sum(count(*)) OVER () AS total FROM q GROUP BY bucket),
        f AS (SELECT *, least(100, total) AS take, (least(100, total) * n // total)::BIGINT AS lo, least(100, total) * n % total AS rest FROM c), g AS (SELECT *, row_number() OVER (ORDER BY rest DESC, bucket) AS place, take - sum(lo) OVER () AS more FROM f),
        h AS (SELECT bucket, lo + CASE WHEN place <= more THEN 1 ELSE 0 END AS quota FROM g)
        SELECT query_id, bucket FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY sha256('42:' || query_id), query_id) AS rn FROM q) JOIN h USING (bucket) WHERE rn <= quota""",
    "term_stats": f"WITH cat AS (SELECT doc_id AS product_id, text AS body FROM documents), qs AS (SELECT '' AS query_id, '' AS query){_index('cat', 'body', 'qs')} SELECT * FROM stats",
    "tfidf_index": f"WITH {_TEXT} SELECT product_id, term, tf, round(weight, 6) AS weight FROM post",
    "query_vectors": f"WITH {_TEXT} SELECT query_id, term, tf, round(weight, 6) AS weight FROM qvec",
    "index_metadata": f"WITH {_TEXT} {_META.format('100000')}",
    "vocabulary_analysis": f"""WITH {_TEXT}, bq AS (SELECT query_id, {_IDX.format('query')} AS w FROM qs), bg AS (SELECT query_id, unnest({_GRAMS.format('w')}) AS term, unnest(range(len({_GRAMS.format('w')}))) AS place FROM bq),
        bk AS (SELECT bg.*, terms.term IS NOT NULL AS known FROM bg LEFT JOIN terms USING (term))
        SELECT query_id, coalesce(string_agg(term, '|' ORDER BY place) FILTER (WHERE known), '') AS indexed, coalesce(string_agg(term, '|' ORDER BY place) FILTER (WHERE NOT known), '') AS unknown, round(count(*) FILTER (WHERE NOT known AND NOT contains(term, ' ')) / count(*) FILTER (WHERE NOT contains(term, ' ')), 6) AS oov_fraction FROM bk GROUP BY query_id""",
    "lexical_search": f"WITH {_TEXT}{_ranked('lex', 'lscore', 10)} {_SCORE} lex",
    "lexical_candidates": f"WITH {_LEX}, cs AS (SELECT query_id, product_id, coalesce(score, 0) AS score FROM judged LEFT JOIN lscore USING (query_id, product_id) WHERE query_id IN (SELECT query_id FROM qvec)){_ranked('r', 'cs', 10)} {_SCORE} r",
    "semantic_search": f"WITH {_CAT}{_SEM}{_ranked('r', 'sscore', 10)} {_SCORE} r",
    "semantic_candidates": f"WITH {_CAT}{_SEM}, cs AS (SELECT s.* FROM sscore s JOIN judged USING (query_id, product_id)){_ranked('r', 'cs', 10)} {_SCORE} r",
    "minmax_normalize": f"WITH {_LEX}{_ranked('lex', 'lown', 100)}, m AS (SELECT *, min(round(score, 9)) OVER w AS a, max(round(score, 9)) OVER w AS b FROM lex WINDOW w AS (PARTITION BY query_id)) SELECT query_id, product_id, round(CASE WHEN b - a <= 1e-12 THEN 1 ELSE (round(score, 9) - a) / (b - a) END, 6) AS scaled FROM m",
    "hybrid_weighted": f"WITH {_FUSED} {_SCORE} hyb WHERE rank <= 10",
    "hybrid_rrf": f"WITH {_FUSED}, rs AS (SELECT *, CASE WHEN lexical_rank > 0 THEN 0.5::DOUBLE / (60 + lexical_rank) ELSE 0 END + CASE WHEN semantic_rank > 0 THEN 0.5::DOUBLE / (60 + semantic_rank) ELSE 0 END AS score FROM comp){_ranked('r', 'rs', 10)} {_SCORE} r",
    "fusion_grid": f"WITH {_GRID} SELECT * FROM grid",
    "fusion_best": f"WITH {_GRID} SELECT * FROM grid ORDER BY ndcg DESC, recall DESC, rr DESC, config LIMIT 1",
    "rerank_features": f"WITH {_FEATURES} SELECT query_id, product_id, hybrid_rank, " + ", ".join(f"round({f}, 6) AS {f}" for f in FEATURE_NAMES) + " FROM feat",
    "rerank_fixed_model": f"WITH {_FEATURES} SELECT query_id, product_id, rank, round(score, 6) AS expected_relevance FROM rer",
    "judged_eval": f"WITH {_FUSED}{_evaluated('e', 'hyb')} SELECT * FROM e",
    "known_relevant_eval": f"WITH {_LEX}{_ranked('lex', 'lown', 10)}{_evaluated('e', 'lex')} SELECT query_id, relevant, round(recall * relevant)::BIGINT AS recovered, recall, rr FROM e",
    "eval_aggregate": f"WITH {_LEX}{_ranked('lex', 'lown', 10)}{_evaluated('e', 'lex')} SELECT count(*) AS queries, count(*) FILTER (WHERE relevant > 0) AS eligible, {_MEANS} FROM e",
    "eval_diagnostics": f"""WITH {_LEX}{_ranked('lex', 'lown', 3)}{_evaluated('e', 'lex')} SELECT query_id, 'no_relevant_judgments' AS code FROM e WHERE relevant = 0
        UNION ALL SELECT query_id, CASE WHEN retrieved = 0 THEN 'no_results' ELSE 'fewer_results_than_requested' END FROM e WHERE retrieved = 0 OR retrieved < least(10, candidates)""",
    "eval_errors": f"""WITH {_LEX}{_ranked('lex', 'lown', 10)}, bad AS (SELECT DISTINCT query_id FROM lex WHERE query_id::BIGINT % 100 = 0), ok AS (SELECT * FROM lex WHERE query_id NOT IN (SELECT query_id FROM bad)){_evaluated('e', 'ok')}
        SELECT query_id, relevant, ndcg, precision, recall, rr, CASE WHEN b.query_id IS NULL THEN 'ok' ELSE 'error' END AS status, CASE WHEN b.query_id IS NULL THEN '' ELSE 'ranks_not_contiguous' END AS fault FROM e LEFT JOIN bad b USING (query_id)""",
    "system_comparison": f"WITH {_FEATURES}" + "".join(_evaluated(f"e{k}_{s}", r, k) for k in (5, 10) for s, r in (("lexical", "lex"), ("semantic", "sem"), ("hybrid", "hyb"), ("rerank", "rer"))) + " " + " UNION ALL ".join(f"SELECT '{s}' AS system, {k} AS k, {_MEANS} FROM e{k}_{s}" for k in (5, 10) for s in ("lexical", "semantic", "hybrid", "rerank")),
    "quality_records": f"WITH {_RECORDS} SELECT * FROM rec",
    "error_categories": f"WITH {_RECORDS} {_CATEGORIES} UNION ALL {_TAIL}",
    "fusion_win_loss": f"WITH {_RECORDS}, m AS (SELECT *, lexical_ndcg AS l, semantic_ndcg AS s, hybrid_ndcg AS h FROM rec) " + " UNION ALL ".join(f"SELECT query_id, '{n}' AS category, round({m}, 6) AS margin FROM m WHERE {m} > 0" for n, m in _MARGINS),
    "confusion_matrix": "SELECT lang AS label, CASE WHEN strlen(text) > length(text) THEN 'de' ELSE 'en' END AS predicted, count(*) AS n FROM documents GROUP BY ALL",
    "classification_report": """WITH r AS (SELECT lang AS label, CASE WHEN strlen(text) > length(text) THEN 'de' ELSE 'en' END AS predicted FROM documents), c AS (SELECT DISTINCT lang AS class FROM documents),
        x AS (SELECT class, (SELECT count(*) FROM r WHERE label = class) AS support, (SELECT count(*) FROM r WHERE predicted = class) AS said, (SELECT count(*) FROM r WHERE label = class AND predicted = class) AS hit FROM c),
        y AS (SELECT *, CASE WHEN said > 0 THEN hit / said ELSE 0 END AS p, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS q FROM x) SELECT class, round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 6) AS f1, support FROM y""",
    "feedback_validation": f"WITH {_SEARCHES} SELECT feedback_id, reason FROM fv",
    "analytics_summary": f"WITH {_SEARCHES} SELECT 'total' AS measure, 'searches' AS name, count(*)::DOUBLE AS value FROM ev UNION ALL SELECT 'total', 'mean_latency_ms', round(avg(latency_ms), 6) FROM ev UNION ALL SELECT 'mode', mode, count(*) FROM ev GROUP BY mode UNION ALL SELECT 'feedback', kind, count(*) FROM fv WHERE reason = '' GROUP BY kind",
    "event_lookup": f"WITH {_SEARCHES} SELECT search_id, mode, array_to_string(returned, ',') AS returned FROM ev WHERE search_id IN (SELECT search_id FROM fb)",
    "top_known_relevant": f"WITH {_CAT}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, product_id) AS place FROM judged WHERE grade >= 1) SELECT query_id, product_id, place, grade AS relevance_grade, product_class FROM r JOIN cat USING (product_id) WHERE place <= 3",
    "enriched_results": f"""WITH {_FUSED}, x AS (SELECT h.query_id, product_id, rank, {_NORM.format('body')} AS t, {_TOK.format('query')} AS q, {_TOK.format('product_name')} AS n FROM hyb h JOIN cat USING (product_id) JOIN qs ON qs.query_id = h.query_id WHERE rank <= 10)
        SELECT query_id, product_id, rank, CASE WHEN t = '' THEN NULL WHEN length(t) <= 240 THEN t ELSE rtrim(t[1:237]) || '...' END AS short, array_to_string(list_filter(q, lambda w, i: list_contains(n, w) AND list_position(q, w) = i), ' ') AS matched FROM x""",
    "score_breakdown": f"WITH {_FUSED} SELECT query_id, product_id, round(0.1::DOUBLE * lexical_norm, 6) AS lexical_part, round(0.9::DOUBLE * semantic_norm, 6) AS semantic_part, lexical_rank, semantic_rank FROM hyb WHERE rank <= 10",
}


_JUDGED_10 = " UNION ALL ".join(f"SELECT '{x}' AS system, * FROM e_{x}" for x in _RANKED)
_FLAWED = """, flawed AS (SELECT * FROM (SELECT query_id, split FROM split UNION ALL SELECT query_id, 'test' FROM split WHERE split = 'train' AND query_id::BIGINT % 10 = 0) WHERE query_id <> '1')"""
#: The same split of the vector queries.
_QSPLITS = _SPLITS.replace("item_id::VARCHAR", "query_id").replace("FROM benchmark", "FROM qs")
_REQUESTS = """, req AS (SELECT 'r' || query_id AS request_id, query_id, query, (query_id::BIGINT / 50)::INT % 9 AS top_k, ['default', 'lexical', 'semantic', 'hybrid', 'rerank', 'fuzzy'][(query_id::BIGINT / 50)::INT % 6 + 1] AS mode FROM qs),
    res AS (SELECT *, CASE mode WHEN 'default' THEN 'hybrid' ELSE mode END AS resolved_mode, CASE WHEN trim(query) = '' THEN 'blank_query' WHEN top_k < 1 THEN 'bad_top_k' WHEN mode = 'fuzzy' THEN 'unknown_mode' ELSE '' END AS reason FROM req)"""
_SYSTEMS = """, systems AS (SELECT 'lexical' AS system, query_id, product_id, rank, score FROM lex WHERE rank <= 10 UNION ALL SELECT 'semantic', query_id, product_id, rank, score FROM sem WHERE rank <= 10
    UNION ALL SELECT 'hybrid', query_id, product_id, rank, score FROM hyb WHERE rank <= 10 UNION ALL SELECT 'rerank', query_id, product_id, rank, score FROM rer)"""
_FOUND = f"{_FEATURES}{_SYSTEMS}{_REQUESTS}, found AS (SELECT request_id, resolved_mode, product_id, rank, score FROM res JOIN systems s ON s.query_id = res.query_id AND s.system = res.resolved_mode WHERE reason = '' AND rank <= top_k)"
_CHECK = "SELECT '{0}' AS check_name, ({1})::BIGINT AS n"


def _checks(source: str, **checks: str) -> str:
    return f"WITH {source} " + " UNION ALL ".join(_CHECK.format(n, q) for n, q in checks.items())


ORACLE |= {
    "hybrid_candidates": f"WITH {_POOL} SELECT query_id, product_id, rank, lexical_rank, semantic_rank, " + ", ".join(f"round({c}, 6) AS {c}" for c in "lexical_score semantic_score lexical_norm semantic_norm lexical_rrf semantic_rrf lexical_present semantic_present score".split()) + " FROM pool",
    "lexical_error_categories": f"""WITH {_RUNS}, qg AS (SELECT query_id, unnest({_IDX.format('query')}) AS term FROM qs),
        oov AS (SELECT query_id, count(*) FILTER (WHERE terms.term IS NULL) / count(*) AS oov FROM qg LEFT JOIN terms USING (term) GROUP BY query_id),
        top AS (SELECT jl.query_id, grade AS top_grade, lower(product_text) AS body_ FROM jl JOIN judged USING (query_id, product_id) JOIN cat USING (product_id) WHERE rank = 1),
        qw AS (SELECT query_id, lower(query) AS low, list_distinct({_IDX.format('query')}) AS w FROM qs),
        ov AS (SELECT query_id, max(CASE WHEN len(w) > 0 THEN len(list_intersect(w, list_distinct(string_split({_NORM.format('lower(product_name)')}, ' ')))) / len(w) ELSE 0 END) AS ov FROM judged JOIN cat USING (product_id) JOIN qw USING (query_id) WHERE grade >= 1 GROUP BY query_id),
        r AS (SELECT query_id, ndcg, round(coalesce(oov, 0), 6) AS oov, coalesce(top_grade, -1) AS g, coalesce(contains(body_, low), FALSE) AS phrase, coalesce(ov, 0) AS ov FROM e_lexical JOIN qw USING (query_id) LEFT JOIN oov USING (query_id) LEFT JOIN top USING (query_id) LEFT JOIN ov USING (query_id) WHERE relevant > 0) """
    + " UNION ALL ".join(
        f"(SELECT '{n}' AS category, row_number() OVER (ORDER BY {k}, query_id)::INT AS place, query_id, ndcg FROM r WHERE {c} QUALIFY place <= 3)"
        for n, c, k in (("high_performing", "TRUE", "-ndcg"), ("poorly_performing", "TRUE", "ndcg"), ("vocabulary_mismatch", "oov > 0", "-oov, ndcg"), ("exact_keyword_success", "g >= 1 AND phrase", "-ndcg"), ("synonym_failure", "ndcg < 0.5 AND g < 1 AND ov = 0", "ndcg"))
    ),
    "low_overlap_successes": f"""WITH {_RECORDS}, d AS (SELECT query_id, semantic_ndcg - lexical_ndcg AS delta FROM rec WHERE semantic_ndcg > lexical_ndcg), many AS (SELECT query_id, count(*) AS m FROM judged GROUP BY query_id),
        c AS (SELECT p.query_id, product_id, semantic_rank, CASE WHEN lexical_rank > 0 THEN lexical_rank ELSE m + 1 END AS lexical_rank, delta, {_TOK.format('query')} AS q, {_TOK.format('product_name')} AS t FROM pool p JOIN judged USING (query_id, product_id) JOIN d ON d.query_id = p.query_id JOIN many ON many.query_id = p.query_id JOIN qs ON qs.query_id = p.query_id JOIN cat USING (product_id) WHERE grade >= 1 AND semantic_rank BETWEEN 1 AND 10),
        o AS (SELECT *, CASE WHEN len(q) > 0 THEN len(list_intersect(list_distinct(q), list_distinct(t))) / len(list_distinct(q)) ELSE 0 END AS overlap FROM c),
        f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY semantic_rank) AS k FROM o WHERE overlap <= 0.25 AND semantic_rank < lexical_rank QUALIFY k = 1)
        SELECT row_number() OVER (ORDER BY round(delta, 9) DESC, query_id)::INT AS place, query_id, product_id, semantic_rank, lexical_rank, round(overlap, 6) AS overlap, round(delta, 6) AS delta FROM f QUALIFY place <= 5""",
    "top_judged_results": f"WITH {_JUDGED} SELECT query_id, product_id, rank, grade AS relevance_grade, product_class FROM jl JOIN judged USING (query_id, product_id) JOIN cat USING (product_id) WHERE rank <= 3",
    "judged_comparison": f"WITH {_JUDGED}" + "".join(_evaluated(f"e{k}_{x}", r, k) for k in (5, 10) for x, r in _RANKED.items()) + " " + " UNION ALL ".join(f"SELECT '{x}' AS system, {k} AS k, {_MEANS} FROM e{k}_{x}" for k in (5, 10) for x in _RANKED),
    "aligned_runs": f"WITH {_FEATURES}".replace(", ftok AS", ", ftok AS")
    + _POOL[len(_LEX + _SEM) :]
    + _features("pool", 100, "jr").replace("ftok", "pftok").replace("fset", "pfset").replace("feat ", "pfeat ").replace("logit", "plogit").replace("FROM feat)", "FROM pfeat)")
    + _JUDGED[_JUDGED.index(",\n    jl AS") :]
    + ", known AS (SELECT * FROM judged WHERE grade >= 1)"
    + "".join(_evaluated(f"e{k}_{x}", r, k) for k in (5, 10) for x, r in _RANKED.items())
    + "".join(_evaluated(f"k_{x}", r).replace("judged", "known") for x, r in (("lexical", "lex"), ("semantic", "sem"), ("hybrid", "hyb"), ("rerank", "rer")))
    + " "
    + " UNION ALL ".join(f"SELECT '{x}' AS system, query_id, a.ndcg AS ndcg_5, b.ndcg AS ndcg_10, a.precision AS precision_5, b.precision AS precision_10, a.recall AS recall_5, b.recall AS recall_10, b.rr AS rr_10, c.recall AS known_recall_10, c.rr AS known_rr_10 FROM e5_{x} a JOIN e10_{x} b USING (query_id) JOIN k_{x} c USING (query_id)" for x in _RANKED),
    "select_default": f"WITH {_SEARCHES}, lat AS (SELECT mode AS system, round(quantile_cont(latency_ms, 0.5), 6) AS latency FROM ev WHERE latency_ms IS NOT NULL AND NOT isnan(latency_ms) AND latency_ms >= 0 GROUP BY mode), {_RUNS}, m AS (SELECT system, round(avg(ndcg), 4) AS ndcg FROM ({_JUDGED_10}) GROUP BY system) SELECT system, ndcg, latency FROM m JOIN lat USING (system) ORDER BY ndcg DESC, latency, list_position(['lexical', 'semantic', 'hybrid', 'rerank'], system) LIMIT 1",
    "metric_deltas": f"WITH {_RUNS}, m AS (SELECT system, round(avg(ndcg), 4) AS ndcg, round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall, round(avg(rr), 4) AS rr FROM ({_JUDGED_10}) GROUP BY system), "
    + "long AS ("
    + " UNION ALL ".join(f"SELECT system, '{m}' AS metric, {m} AS value FROM m" for m in ("ndcg", "precision", "recall", "rr"))
    + ") SELECT a.system, metric, b.value AS base_value, a.value, round(a.value - b.value, 6) AS delta FROM long a JOIN long b USING (metric) WHERE a.system <> 'lexical' AND b.system = 'lexical'",
    "five_number_summary": f"WITH {_RUNS} SELECT system, " + ", ".join(f"round(quantile_cont(ndcg, {x}), 4) AS {n}" for n, x in (("least", 0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("greatest", 1))) + f" FROM ({_JUDGED_10}) GROUP BY system",
    "search_errors": f"""WITH {_LEX}{_ranked('lex', 'lown', 10)} SELECT DISTINCT query_id, 'search_error' AS code, CASE WHEN query_id::BIGINT % 100 = 0 OR query_id::BIGINT % 250 = 0 AND max(rank) OVER (PARTITION BY query_id) >= 2 THEN 'ranks_not_contiguous' ELSE 'score_not_finite' END AS message FROM lex
        QUALIFY query_id::BIGINT % 100 = 0 OR query_id::BIGINT % 350 = 0 OR query_id::BIGINT % 250 = 0 AND max(rank) OVER (PARTITION BY query_id) >= 2""",
    "ranking_contract": f"WITH {_CAT}{_SEM}{_ranked('r', 'sscore', 10)} SELECT DISTINCT query_id, 'not_a_candidate' AS fault FROM r WHERE (query_id, product_id) NOT IN (SELECT (query_id, product_id) FROM judged WHERE grade >= 1)",
    "label_distribution": f"WITH {_LABELS}, d AS (SELECT unnest(['Exact', 'Partial', 'Irrelevant', 'Unknown']) AS label) SELECT label, (SELECT count(*) FROM labels_ l WHERE l.label = d.label) AS n FROM d",
    "classification_summary": ORACLE["classification_report"].replace("SELECT class, round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 6) AS f1, support FROM y", "SELECT (SELECT count(*) FROM r) AS n, (SELECT round(avg((label = predicted)::INT), 6) FROM r) AS accuracy, round(avg(round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 6)), 6) AS macro_f1 FROM y"),
    "judgment_contract": _checks(_LABELS, missing="SELECT count(*) FROM labels_ WHERE query_id IS NULL OR product_id IS NULL", repeated_pairs="SELECT count(*) - count(DISTINCT (query_id, product_id)) FROM labels_", bad_grade="0"),
    "catalog_contract": _checks(
        f"c AS (SELECT doc_id::VARCHAR AS id, {_PRODUCT_TEXT} AS t FROM documents), a AS (SELECT * FROM c UNION ALL SELECT id, chr(9) FROM c WHERE id::BIGINT % 40 = 0 UNION ALL SELECT chr(9), chr(9) FROM c WHERE id::BIGINT % 40 = 0)",
        missing_id="SELECT count(*) FROM a WHERE id IS NULL", blank_id="SELECT count(*) FROM a WHERE trim(id, chr(9)) = ''", missing_text="SELECT count(*) FROM a WHERE t IS NULL",
        blank_text="SELECT count(*) FROM a WHERE trim(t, chr(9)) = ''", repeated_id="SELECT count(*) - count(DISTINCT id) FROM a", no_rows="SELECT (count(*) = 0)::INT FROM a",
    ),
    "candidate_contract": _checks(_CAT, repeated_candidates="SELECT count(*) FROM judged WHERE grade = 2", unknown_candidates="SELECT count(*) FROM judged WHERE product_id NOT IN (SELECT product_id FROM cat WHERE label <> 3)"),
    "split_contract": _checks(
        _SPLITS + _FLAWED,
        in_two_splits="SELECT count(*) FROM (SELECT query_id FROM flawed GROUP BY query_id HAVING count(DISTINCT split) > 1)", in_no_split="SELECT count(*) FROM split WHERE query_id NOT IN (SELECT query_id FROM flawed)",
        unknown_query="SELECT count(DISTINCT query_id) FROM flawed WHERE query_id NOT IN (SELECT query_id FROM split)", empty_splits="SELECT 3 - count(DISTINCT split) FROM flawed",
    ),
    "split_overlaps": f"WITH {_SPLITS}{_FLAWED} SELECT a.split AS first, b.split AS second, count(*) AS n FROM flawed a JOIN flawed b USING (query_id) WHERE a.split < b.split GROUP BY ALL",
    "split_filter": f"WITH {_SPLITS} SELECT query_id, length(text)::INT AS n_chars FROM split JOIN benchmark ON item_id::VARCHAR = query_id WHERE split = 'validation'",
    "norm_contract": _checks(
        "e AS (SELECT embedding::DOUBLE[] AS v FROM embeddings)",
        missing="SELECT count(*) FROM e WHERE v IS NULL", not_finite="SELECT count(*) FROM e WHERE len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0",
        other_dimensions="SELECT count(DISTINCT len(v)) - 1 FROM e", not_unit="SELECT count(*) FROM e WHERE abs(sqrt(list_inner_product(v, v)) - 1) > 1e-5",
    ),
    "missing_values": "SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) FILTER (WHERE {_NORM.format(f'{c}::VARCHAR')} = '') AS n FROM {t}" for t, cs in (("documents", ("doc_id", "text", "lang", "source")), ("conversations", ("conv_id", "role", "text"))) for c in cs)
    + ") WHERE n > 0",
    "key_duplicates": " UNION ALL ".join(f"SELECT '{n}' AS table_name, '{k}' AS key_name, count(*) - count(DISTINCT {k}) AS n FROM {t}" for t, k, n in (("part", "p_partkey", "product"), ("benchmark", "item_id", "query"), ("lineitem", "l_orderkey", "label"))),
    "dense_index": f"WITH {_CAT}, u AS (SELECT product_id, unnest(list_transform(v, lambda x: x / sqrt(list_inner_product(v, v)))) AS x, unnest(range(len(v)))::INT AS place FROM cat) SELECT product_id, place, round(x, 6) AS x FROM u",
    "dense_index_hashed": f"""WITH c AS (SELECT doc_id::VARCHAR AS product_id, {_TOK.format(_PRODUCT_TEXT)} AS t FROM documents), p AS (SELECT product_id, list_transform(t, lambda x: ('0x' || md5(x)[1:8])::BIGINT % 32) AS p FROM c WHERE len(t) > 0),
        n AS (SELECT product_id, place, count(*) AS n FROM (SELECT product_id, unnest(p) AS place FROM p) GROUP BY ALL), l AS (SELECT product_id, sqrt(sum(n * n)) AS len FROM n GROUP BY product_id)
        SELECT product_id, r.place::INT AS place, round(coalesce(n, 0) / len, 6) AS x FROM l CROSS JOIN range(32) r(place) LEFT JOIN n USING (product_id, place)""",
    "dense_metadata": f"WITH {_CAT} SELECT 'given' AS model, count(*) AS vectors, max(len(v))::INT AS dimension, 'double' AS dtype, 'l2' AS normalization FROM cat",
    "training_rows": f"WITH {_JUDGED}, {_QSPLITS} SELECT query_id, product_id, hybrid_rank, grade AS relevance_grade, " + ", ".join(f"round({f}, 6) AS {f}" for f in FEATURE_NAMES) + " FROM feat JOIN judged USING (query_id, product_id) WHERE query_id IN (SELECT query_id FROM split WHERE split = 'train')",
    "precomputed_ranking": f"WITH {_JUDGED}, sc AS (SELECT query_id, product_id, hybrid_rank, round(lexical_similarity + 2 * query_title_token_coverage, 4) AS expected_relevance FROM feat) SELECT query_id, product_id, row_number() OVER (PARTITION BY query_id ORDER BY round(expected_relevance, 9) DESC, hybrid_rank, product_id) AS rank, expected_relevance, hybrid_rank FROM sc QUALIFY rank <= 10",
    "reranker_decision": f"WITH {_RUNS}, m AS (SELECT (SELECT round(avg(ndcg), 4) FROM e_hybrid) AS hybrid_ndcg, (SELECT round(avg(ndcg), 4) FROM e_rerank) AS rerank_ndcg) SELECT *, rerank_ndcg > hybrid_ndcg AS improved, CASE WHEN rerank_ndcg > hybrid_ndcg THEN 'rerank' ELSE 'hybrid' END AS mode FROM m",
    "batch_search": f"WITH {_FOUND} SELECT request_id, resolved_mode, product_id, rank, round(score, 6) AS score FROM found",
    "rejected_requests": f"WITH {_CAT}{_REQUESTS} SELECT request_id, mode, reason FROM res WHERE reason <> ''",
    "search_events": f"WITH {_FOUND} SELECT request_id AS search_id, resolved_mode AS mode, top_k, coalesce((SELECT string_agg(product_id, ',' ORDER BY rank) FROM found f WHERE f.request_id = res.request_id), '') AS returned, '' AS reason FROM res WHERE reason = ''",
    "score_breakdown_by_mode": f"""WITH {_FEATURES}{_SYSTEMS} SELECT system, query_id, product_id, s.rank, CASE WHEN system <> 'semantic' THEN round(lexical_score, 6) END AS lexical_value, CASE WHEN system <> 'lexical' THEN round(semantic_score, 6) END AS semantic_value,
        round(CASE system WHEN 'lexical' THEN lexical_score WHEN 'semantic' THEN NULL ELSE (1 - 0.9::DOUBLE) * lexical_norm END, 6) AS lexical_part, round(CASE system WHEN 'semantic' THEN semantic_score WHEN 'lexical' THEN NULL ELSE 0.9::DOUBLE * semantic_norm END, 6) AS semantic_part FROM systems s JOIN comp USING (query_id, product_id)""",
    "score_breakdown_rrf": f"""WITH {_FUSED}, rs AS (SELECT *, CASE WHEN lexical_rank > 0 THEN 0.5::DOUBLE / (60 + lexical_rank) ELSE 0 END AS lp, CASE WHEN semantic_rank > 0 THEN 0.5::DOUBLE / (60 + semantic_rank) ELSE 0 END AS sp FROM comp), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(lp + sp, 9) DESC, product_id) AS rank FROM rs QUALIFY rank <= 10)
        SELECT query_id, product_id, rank, round(lexical_score, 6) AS lexical_value, round(semantic_score, 6) AS semantic_value, round(lp, 6) AS lexical_part, round(sp, 6) AS semantic_part FROM r""",
}


def _all(sql: str) -> str:
    """The same over all terms of two documents or more."""
    return sql.replace(" ORDER BY total_tf DESC, term LIMIT 100000", "")


_ALL = _all(_TEXT)

ORACLE |= {
    "tfidf_index_all": f"WITH {_ALL} SELECT product_id, term, tf, round(weight, 6) AS weight FROM post",
    "index_metadata_all": f"WITH {_ALL} {_META.format('NULL')}",
    "event_lookup_all": ORACLE["event_lookup"],
    "term_stats_all": _all(ORACLE["term_stats"]),
    "hybrid_weighted_deep": _all(ORACLE["hybrid_weighted"]),
    "lexical_search_all": _all(ORACLE["lexical_search"]),
}
ORACLE["dense_embedded"] = ORACLE["dense_index_hashed"]
