"""The dense index: texts embedded in batches by a plug-in, or vectors that are there, checked and of unit length."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.functions.vectors import flaws, l2_normalize


class EmbeddingProvider(Protocol):
    """What embeds texts. A factory of it is sent to the tasks, and each task makes its own."""

    def embed_documents(self, texts: list[str]) -> list[list[float]]: ...

    def embed_queries(self, texts: list[str]) -> list[list[float]]: ...


def embedded(rows: DataFrame, factory: Callable[[], EmbeddingProvider], id_col: str = "product_id", text_col: str = "product_text", queries: bool = False, batch: int = 64) -> DataFrame:
    """(id, vector) of every row: null and blank texts have none. A provider that returns another number of vectors than it
    was given texts fails the job."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = factory()
        embed = provider.embed_queries if queries else provider.embed_documents
        for frame in frames:
            for k in range(0, len(frame), batch):
                part = frame.iloc[k : k + batch]
                said = [t is not None and bool(t.strip()) for t in part[text_col]]
                texts = [t for t, s in zip(part[text_col], said, strict=True) if s]
                vectors = iter(embed(texts) if texts else [])
                found = [[float(x) for x in next(vectors)] if s else None for s in said]
                if next(vectors, None) is not None:
                    raise ValueError("the provider returned more vectors than texts")
                yield pd.DataFrame({id_col: part[id_col], "vector": found})

    return rows.select(F.col(id_col).cast("string").alias(id_col), text_col).mapInPandas(run, f"{id_col} string, vector array<double>")


def hashed_vector(text: Column, dimension: int) -> Column:
    """A vector without a model, in the JVM: each token adds 1 at the place that its MD5 names."""
    places = F.transform(T.feature_tokens(text), lambda t: F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % dimension)
    every = F.sequence(F.lit(0), F.lit(dimension - 1))

    def counted(held: Column) -> Column:
        return F.transform(every, lambda i: F.size(F.filter(held, lambda p: p == i)).cast("double"))

    # the places as the one element of an array: named in the lambda itself, they would be taken anew for each number
    return F.aggregate(F.array(places), F.array_repeat(F.lit(0.0), dimension), lambda _, held: counted(held))


class HashedTokens:
    """A provider without a model: each token of a-z and 0-9 adds 1 at the place that its MD5 names."""

    def __init__(self, dimension: int = 32):
        self.dimension = dimension

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            vector = [0.0] * self.dimension
            for token in re.findall("[a-z0-9]+", text.lower()):
                vector[int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % self.dimension] += 1
            out.append(vector)
        return out

    embed_queries = embed_documents


def dense_index(vectors: DataFrame, dimension: int, id_col: str = "product_id", column: str = "vector") -> DataFrame:
    """(id, vector) of unit length. A vector that is missing, of another dimension, not finite or zero is an error, when it
    runs, that names the row."""
    flaw = flaws(F.col(column), dimension)
    told = F.raise_error(F.concat(F.lit("vector of "), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(": "), flaw))
    return vectors.select(id_col, F.when(flaw.isNotNull(), told).otherwise(l2_normalize(F.col(column))).alias("vector"))


def dense_metadata(index: DataFrame, model: str) -> DataFrame:
    """One row: model, vectors, dimension, type of numbers, and how vectors are scaled."""
    kind = dict(index.dtypes)["vector"].removeprefix("array<").removesuffix(">")
    sizes = index.agg(F.count("*").alias("vectors"), F.max(F.size("vector")).alias("dimension"))
    return sizes.select(F.lit(model).alias("model"), "vectors", "dimension", F.lit(kind).alias("dtype"), F.lit("l2").alias("normalization"))
