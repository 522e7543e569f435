"""The corpus pipeline: from documents to token ids, in five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Rows
without a doc_id do not pass the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm._shared import one_row_per_id, rows_by_id, table, written
from gleaner.llm.contamination import decontaminated
from gleaner.llm.ngram_join import ngram_jaccard_components
from gleaner.llm.quality_rules import filtered
from gleaner.llm.queries import tokenizer
from gleaner.llm.suffix_dedup import without_repeated_passages
from gleaner.llm.viterbi import encode_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that weak supervision keeps. A null text is no good; of rows that share an id all stay if one is kept; an
    empty table gives no rows."""
    return filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that n-gram similarity (five words, 0.8) links: that with the smallest id; of rows that
    share this id, that with the least text. Rows without an id go; documents without words stay."""
    groups = ngram_jaccard_components(docs, words=5, num=80, den=100)
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    return one_row_per_id(rows_by_id(docs, "doc_id", first))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages of over 50 words, or of 400 bytes, that come again; n_chars is that of what is left.
    Every row stays, if with an empty text; a null text stays null."""
    cut = without_repeated_passages(docs, words=51)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark; null and empty texts hold none."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, with digests and the round trip's verdict; null and empty texts have none."""
    return encode_documents(docs, tokenizer("piece_bpe_32k.model"), ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("token_ids", token_ids),
]

#: EM, connected components and a search for the best path are beyond SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
