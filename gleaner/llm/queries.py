"""The registered queries of this subpackage, op1 to op13, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm._shared import table
from gleaner.llm.chat_format import chat_digests
from gleaner.llm.contamination import contained_items
from gleaner.llm.hard_negatives import hard_negatives
from gleaner.llm.knn_quality import knn_scores
from gleaner.llm.ngram_join import ngram_jaccard_components
from gleaner.llm.passage_index import without_earlier_passages
from gleaner.llm.quality_rules import judged
from gleaner.llm.suffix_dedup import remove_repeats
from gleaner.llm.token_counts import count_tokens
from gleaner.llm.vector_codes import compressed, with_label_errors
from gleaner.llm.viterbi import encode_documents
from gleaner.llm.warc import read_archives, record_digests, write_archives
from gleaner.llm.wrapper import main_text

_SAID = "\\### Assistant: </turn> ok"


def tokenizer(name: str) -> str:
    """The place of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WARC record for every page, read back from the archives: sizes, digests, responses and revisits.

    Null html is an empty payload; repeated rows of a page are all the response or all revisits; an empty table gives no rows.
    """
    archives, folder = write_archives(table(spark, sf_dir, "pages"))
    return record_digests(read_archives(archives, folder, payload=False))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits of every document, made from its own columns: a passage replaced, a line put in, the end cut off."""
    n, lang = F.coalesce(F.length("text"), F.lit(0)), F.coalesce("lang", F.lit(""))

    def edit(start, stop, new):
        return F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"), new.alias("new"))

    edits = F.array(
        edit(F.floor(n / 3), F.floor(n / 3) + 9, F.concat(F.lit(" "), lang, F.lit(" "))),
        edit(F.floor(n / 2), F.floor(n / 2), F.concat(F.lit("\n"), F.coalesce("source", F.lit("")), F.lit("\n"))),
        edit(n - 5, n + 100, F.lit("")),
    )
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), edits)


def op3_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by votes of labelled neighbours; rows whose crc32(doc_id) mod 3 is 1 are never learnt from.

    Empty and null texts, and texts that share nothing with the sample, get the sample's share of good labels; without labels
    all scores are 0.5; repeated rows are each scored.
    """
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    scored = knn_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation through the role machine and the template, read back; conversation -7 holds control strings.

    Null roles and texts are empty; turns of one number are ordered by role and text; valid tells whether roles take turns.
    """
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_SAID).alias("text"))
    return chat_digests(said.unionByName(added))


def op5_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page by its host's wrapper; null html gives the empty text, repeated rows are pages each."""
    return main_text(table(spark, sf_dir, "pages"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to strings of 400 bytes that come again, in it or elsewhere, and what is left of it.

    A null text is empty; repeated rows are copies of each other; an empty table gives no rows.
    """
    return remove_repeats(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the installed model and decoded again: ids, digests, and whether the text came back.

    Null and empty texts have no ids; repeated rows are each encoded.
    """
    return encode_documents(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures of every document, the verdict of the base rules and that of weak supervision.

    A null text has no words and fails the base; EM is over the whole table; an empty table gives no rows.
    """
    return judged(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item of which it holds four fifths of the shingles.

    Null and empty texts hold nothing; items without words are in no document; repeated rows are each judged.
    """
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its set of 4-word shingles and the smallest id that links of 0.85 reach.

    A document without words is linked with nothing; rows that share an id are one node.
    """
    return ngram_jaccard_components(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every vector: 16 parts, 64 entries a part, two rounds; errors by row and by label, the codebooks' digest.

    Rows without a whole vector are left out; rows without a label share one label error; an empty table gives no rows.
    """
    return with_label_errors(*compressed(table(spark, sf_dir, "embeddings")))


def op12_fm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to passages of 13 words that start in a document of smaller id, too, and what is left.

    A null text has no words; rows that share an id aren't copies of each other; an empty table gives no rows.
    """
    left = without_earlier_passages(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives for each of five positives of every 50th vector, against all rows.

    A row without an id, a label or a whole vector takes no part; of rows that share an id the least one does.
    """
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


QUERIES = {f.__name__: f for f in (op1_warc, op2_token_counts, op3_knn_quality, op4_chat_format, op5_wrapper, op6_suffix_dedup, op7_sentencepiece, op8_quality_rules, op9_decontamination, op10_ngram_join, op11_vector_codes, op12_fm_dedup, op13_hard_negatives)}

_WORDS = "list_filter(regexp_split_to_array(lower({}), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
_ESCAPED = "replace(replace(replace({}, chr(92), chr(92) || '0'), '</turn>', chr(92) || '1'), '###', chr(92) || '2')"
#: Nearest entries, then means rounded down: DuckDB's // cuts towards zero, so the remainder is taken off first.
_SQUARE = "list_sum(list_transform(list_zip(x, e), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"
_ROUND = f"""a{{now}} AS (SELECT row, part, min({{{{'d': {_SQUARE}, 'entry': entry}}}}) AS m FROM p JOIN b{{now}} USING (part) GROUP BY row, part),
        s{{next}} AS (SELECT part, (m).entry AS entry, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{{now}} JOIN p USING (row, part), LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY ALL),
        m{{next}} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS e FROM s{{next}} GROUP BY part, entry),
        b{{next}} AS (SELECT part, entry, coalesce(m{{next}}.e, b{{now}}.e) AS e FROM b{{now}} LEFT JOIN m{{next}} USING (part, entry))"""

ORACLE = {
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> least THEN least END AS refers_to FROM f""",
    "op4_chat_format": f"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, chr(92) || '### Assistant: </turn> ok' FROM range(2) t(i)),
        s AS (SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS learnt, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
                     14 + length(replace({_ESCAPED.format('role')}, ':' || chr(10), chr(92) || '3')) + length({_ESCAPED.format('text')}) AS n FROM c)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               sum(length(learnt))::BIGINT AS loss_chars, sha256(string_agg(learnt, '' ORDER BY turn, role, text)) AS loss_sha256, sum(n)::BIGINT AS formatted_chars,
               bool_and(CASE role WHEN 'system' THEN before IS NULL WHEN 'user' THEN before IS NULL OR before <> 'user' WHEN 'assistant' THEN before IS NOT NULL AND before = 'user' ELSE FALSE END) AS valid
        FROM s GROUP BY conv_id""",
    "op9_decontamination": f"""
        WITH tw AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL),
        iw AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark WHERE text IS NOT NULL),
        i AS (SELECT DISTINCT item_id, least(5, len(w)) AS k, unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda p: array_to_string(w[p : p + least(5, len(w)) - 1], ' '))) AS g FROM iw WHERE len(w) > 0),
        d AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p : p + k - 1], ' '))) AS g FROM tw, (SELECT DISTINCT k FROM i) WHERE len(w) >= k),
        n AS (SELECT item_id, count(*) AS n_shingles FROM i GROUP BY item_id)
        SELECT doc_id, item_id, n_shingles, count(*) AS n_shared, round(count(*) / n_shingles, 6) AS containment
        FROM i JOIN d USING (k, g) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_shingles HAVING 5 * count(*) >= 4 * n_shingles""",
    "op11_vector_codes": f"""
        WITH r AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v, len(embedding) // 16 AS w, row_number() OVER (ORDER BY vec_id, embedding) AS row
                   FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS MATERIALIZED (SELECT row, vec_id, label, k AS part, v[k * w + 1 : (k + 1) * w] AS x FROM r, range(16) t(k)),
        b0 AS (SELECT part, row - 1 AS entry, x AS e FROM p WHERE row <= 64),
        {_ROUND.format(now=0, next=1)}, {_ROUND.format(now=1, next=2)},
        a2 AS (SELECT row, part, min({{'d': {_SQUARE}, 'entry': entry}}) AS m FROM p JOIN b2 USING (part) GROUP BY row, part),
        c AS (SELECT row, string_agg(printf('%02x', (m).entry), '' ORDER BY part) AS code, sum((m).d)::BIGINT AS error FROM a2 GROUP BY row),
        h AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2)
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM c JOIN r USING (row), h""",
    "op12_fm_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
        p AS (SELECT row, doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
        s AS (SELECT row, doc_id, i, sha256(array_to_string(w[i : i + 12], ' ')) AS s FROM p),
        e AS (SELECT row, i FROM s QUALIFY min(doc_id) OVER (PARTITION BY s) < doc_id),
        g AS (SELECT DISTINCT row, unnest(range(i, i + 13)) AS i FROM e),
        r AS (SELECT row, list(i) AS gone FROM g GROUP BY row),
        k AS (SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, w, list_transform(range(1, len(w) + 1), lambda i: NOT coalesce(list_contains(gone, i), FALSE)) AS stays FROM d LEFT JOIN r USING (row))
        SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(coalesce(array_to_string(list_where(w, stays), ' '), '')) AS kept_sha256 FROM k""",
    "op13_hard_negatives": """
        WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
                   FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
              FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
        p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
        SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        QUALIFY rank <= 3""",
}
