"""Models and dense indexes kept between jobs, each with what it was made of; refused where that does not hold any more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.dense import dense_metadata
from gleaner.operators.ranking import FEATURES, check_features
from gleaner.operators.relevance import LinearRelevance
from gleaner.sources.tables import config_hash, schema_hash


def _digest(df: DataFrame, prefix: str) -> DataFrame:
    """One row (rows, sum): a count and two sums over all rows and columns, whatever their order; a row that comes twice
    counts twice."""
    every = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    sums = df.select(F.xxhash64(every).alias("a"), F.hash(every).cast("long").alias("b")).agg(F.count("*").alias("n"), F.bit_xor("a").alias("a"), F.sum("b").alias("b"))
    return sums.select(F.col("n").alias(f"{prefix}_rows"), F.concat_ws(":", "a", "b").alias(f"{prefix}_digest"))


def _refuse(folder: str, meta: dict, now: dict) -> None:
    other = sorted(k for k, v in now.items() if meta.get(k) != v)
    if other:
        raise ValueError(f"{folder} is not what its metadata tells of: {', '.join(other)}")


def _features_hash() -> str:
    return config_hash({"features": list(FEATURES)})


def write_relevance(model: LinearRelevance, training: DataFrame, folder: str, parameters: dict, force: bool = False) -> None:
    """Keeps a model, its parameters, and the count and digest of the rows that it was trained on."""
    check_features(model.getFeatures())
    mode = "overwrite" if force else "errorifexists"
    said = {"features_hash": _features_hash(), "model_hash": model.digest(), "parameters": config_hash(parameters)}
    meta = _digest(training.select("query_id", "product_id", "relevance_grade", *FEATURES), "training")
    meta = meta.select("*", *[F.lit(v).alias(k) for k, v in said.items()], F.to_json(F.create_map(*[F.lit(str(x)) for kv in sorted(parameters.items()) for x in kv])).alias("said"))
    meta.write.mode(mode).json(f"{folder}/metadata")  # first: it refuses a folder that is in use
    writer = model.write()
    (writer.overwrite() if force else writer).save(f"{folder}/model")


def load_relevance(spark: SparkSession, folder: str, training: DataFrame | None = None, parameters: dict | None = None) -> LinearRelevance:
    """The model as it was written. Raises where its numbers or features are not those that the metadata tells of, and, if
    they are given, where the training rows or the parameters aren't."""
    meta = spark.read.json(f"{folder}/metadata").first().asDict()
    model = LinearRelevance.load(f"{folder}/model")
    check_features(model.getFeatures())
    now = {"features_hash": _features_hash(), "model_hash": model.digest()}
    if parameters is not None:
        now["parameters"] = config_hash(parameters)
    if training is not None:
        now |= _digest(training.select("query_id", "product_id", "relevance_grade", *FEATURES), "training").first().asDict()
    _refuse(folder, meta, now)
    return model


def write_dense(index: DataFrame, catalog: DataFrame, model: str, folder: str, force: bool = False, id_col: str = "product_id", text_col: str = "product_text") -> None:
    """Keeps a dense index (id, vector) with its metadata, digest and schema, and the digest of the texts it was made of."""
    mode = "overwrite" if force else "errorifexists"
    index.write.mode(mode).parquet(f"{folder}/vectors")
    kept = index.sparkSession.read.parquet(f"{folder}/vectors")
    meta = dense_metadata(kept, model).crossJoin(F.broadcast(_digest(kept, "index"))).crossJoin(F.broadcast(_digest(catalog.select(id_col, text_col), "catalog")))
    meta.withColumn("schema_hash", F.lit(schema_hash(kept))).write.mode(mode).json(f"{folder}/metadata")


def load_dense(spark: SparkSession, folder: str, model: str | None = None, dimension: int | None = None, catalog: DataFrame | None = None, id_col: str = "product_id", text_col: str = "product_text") -> DataFrame:
    """The dense index as it was written. Raises where its rows are not those that the metadata tells of, and, if they are
    given, where the model, the dimension or the catalog's texts aren't."""
    kept = spark.read.parquet(f"{folder}/vectors")
    meta = spark.read.json(f"{folder}/metadata").first().asDict()
    now = _digest(kept, "index").first().asDict() | {"schema_hash": schema_hash(kept)}
    now |= {k: v for k, v in (("model", model), ("dimension", dimension)) if v is not None}
    if catalog is not None:
        now |= _digest(catalog.select(id_col, text_col), "catalog").first().asDict()
    _refuse(folder, meta, now)
    return kept
