"""Feedback as a stream of files against the static table of searches: no state, no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.operators.tables import validated_feedback


def feedback_stream(spark: SparkSession, folder: str, schema, searches: DataFrame) -> DataFrame:
    """A streaming table of feedback with reasons; a row that comes before its search is rejected."""
    return validated_feedback(spark.readStream.schema(schema).parquet(folder), searches)


def write_batch(rows: DataFrame, batch: int, accepted: str, rejected: str) -> None:
    """Writes one batch's accepted and rejected rows to its own partition of two tables (batch_id). A batch that comes
    again, as after a failure between the two writes, takes the place of what it left before."""
    rows = rows.persist()
    try:
        rows.where("reason = ''").drop("reason").write.mode("overwrite").parquet(f"{accepted}/batch_id={batch}")
        rows.where("reason <> ''").write.mode("overwrite").parquet(f"{rejected}/batch_id={batch}")
    finally:
        rows.unpersist()


def append_feedback(stream: DataFrame, accepted: str, rejected: str, checkpoint: str):
    """Adds accepted and rejected rows to two tables partitioned by batch_id, until the folder is read. Batches are numbered
    by the checkpoint, so that a restart writes the batch it failed in over itself."""
    sink = stream.writeStream.foreachBatch(lambda df, batch: write_batch(df, batch, accepted, rejected))
    return sink.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
