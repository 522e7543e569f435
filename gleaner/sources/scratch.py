"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_ROOT: dict[str, str] = {}
#: Row groups of tables with long rows. Parquet's reader decodes a few thousand rows at once but never more than a row group,
#: so these bound what a task holds, and a file is read by several tasks. Sizes are looked at every few rows.
_SMALL_GROUPS = {"parquet.block.size": 4 << 20, "parquet.page.size.row.check.min": 4, "parquet.page.size.row.check.max": 64}


def scratch_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only a local master (tests) may leave it unset and gets its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"spark.checkpoint.dir is unset: on {master} it has to name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_ROOT:
        _OWN_ROOT[app] = tempfile.mkdtemp(prefix="spark-gleaner-")
    return _OWN_ROOT[app]


def written(df: DataFrame, label: str, long_rows: bool = False) -> DataFrame:
    """Writes df as a Parquet table of its own and reads it again: each use reads what was made once, lineage is cut, and
    the table outlives executors. long_rows: rows hold lists of thousands of places."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**(_SMALL_GROUPS if long_rows else {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def cleared(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more: all that was made of them is written itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
