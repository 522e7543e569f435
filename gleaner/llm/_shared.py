"""Small plan helpers used by the operators of this subpackage, and the scratch tables of the library."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.sources.scratch import cleared, scratch_root, written

__all__ = ["cleared", "documents_of", "one_row_per_id", "rows_by_id", "scratch_root", "shuffle_partitions", "table", "unique", "written"]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def documents_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) of the rows with an id; a null text is the empty text."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("doc_id IS NOT NULL")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unique(label: str) -> str:
    """A column name that no table has."""
    return f"{label}_{uuid.uuid4().hex}"


def rows_by_id(documents: DataFrame, id_col: str, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of documents whose id is in the one column of ids (left_semi) or not in it (left_anti, null ids stay).

    A merge join, so that texts are never broadcast and plans are alike at every size.
    """
    other = unique("id")
    return documents.join(ids.toDF(other).hint("merge"), F.col(f"`{id_col}`").cast("long") == F.col(other), how)


def one_row_per_id(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of rows that share an id the one with the least text, of these that with the least hash; null ids are left out."""
    key, place = unique("key"), unique("place")
    first = Window.partitionBy(key).orderBy(F.col(f"`{text_col}`"), F.xxhash64(*[F.col(f"`{c}`") for c in documents.columns]))
    rows = documents.withColumn(key, F.col(f"`{id_col}`").cast("long")).where(F.col(key).isNotNull())
    return rows.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).drop(key, place)
