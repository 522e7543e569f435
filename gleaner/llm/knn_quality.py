"""Quality by nearest-neighbour voting in a latent-semantic space.

A text becomes counts of word shapes (classes of the first and last character, length, capitals), of repetitions (a word
that equals the one before it, a line that equals an earlier one) and of hashed words. A bounded sample of labelled rows
(`sample` of them, those with the least hash of their id, so not by their order) gives the document frequencies and the
latent space: the leading `rank` directions of its tf-idf vectors. The labelled vectors (sample x rank floats) and the
projection are sent to all tasks; there each block of documents is multiplied with all labelled vectors, exactly, and
the `neighbours` most similar ones vote, weighted by exp(similarity / temperature). The score is the weighted share of
label 1.

Cases: a null or empty text, or one that shares nothing with the sample, has no neighbours: its score is the sample's
share of label 1; without any label all scores are 0.5; labels of null count not, of several labels of an id the largest
does; rows of documents without an id are left out, repeated rows are each scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm import _blocks as B
from gleaner.llm._shared import documents_of

_HASHED, _FIRST, _LAST, _LENGTH, _CAPS = 512, 5, 7, 6, 3
_SHAPES = _FIRST * _LAST * _LENGTH * _CAPS
WIDTH = _SHAPES + _HASHED + 4
_ROWS = 1000


def _classes(groups: list[bytes], other: int) -> np.ndarray:
    out = np.full(256, other, np.int64)
    for k, g in enumerate(groups):
        out[list(g)] = k
    return out


_LETTERS = bytes(range(97, 123)) + bytes(range(128, 256))
_FIRST_OF = _classes([_LETTERS, bytes(range(65, 91)), b"0123456789", b"#*$%&|<>"], 4)
_LAST_OF = _classes([_LETTERS, bytes(range(65, 91)), b"0123456789", b"#*$%&|<>", b".,;:", b"!?"], 6)
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of WIDTH counts for each text."""
    n = len(offsets) - 1
    starts, ends, rows = B.words(data, offsets)
    out = np.zeros((n, WIDTH), np.float32)
    if not len(starts):
        return out
    hashes = B.word_hashes(data, starts, ends)
    size = np.searchsorted([2, 4, 7, 11, 16], ends - starts, "right")
    caps = np.concatenate(([0], np.cumsum(_UPPER[data])))
    caps = np.minimum(caps[ends] - caps[starts], 2)
    shape = ((_FIRST_OF[data[starts]] * _LAST + _LAST_OF[data[ends - 1]]) * _LENGTH + size) * _CAPS + caps
    hashed = _SHAPES + (hashes >> np.uint64(55)).astype(np.int64)
    twice = np.zeros(len(starts), bool)
    twice[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    flags = _SHAPES + _HASHED + twice.astype(np.int64)
    for column in (shape, hashed, flags):
        out += np.bincount(rows * WIDTH + column, minlength=n * WIDTH).reshape(n, WIDTH).astype(np.float32)
    line_of, line = _lines(data, offsets)
    order = np.lexsort((line, line_of))
    again = np.zeros(len(line), np.int64)
    again[order[1:]] = (line[order[1:]] == line[order[:-1]]) & (line_of[order[1:]] == line_of[order[:-1]])
    np.add.at(out, (line_of, _SHAPES + _HASHED + 2 + again), 1)
    return out


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each line."""
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate((offsets[:-1][np.diff(offsets) > 0], breaks + 1)))
    starts = starts[starts < len(data)]
    ends = np.concatenate((starts[1:], [len(data)]))
    return np.searchsorted(offsets, starts, "right") - 1, B.word_hashes(data, starts, ends)


def _weighed(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Row-wise unit vectors of sublinear tf by idf."""
    x = np.log1p(counts) * idf
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


class Space:
    """The latent space of labelled counts, with their vectors."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, rank: int):
        df = (counts > 0).sum(0)
        self.idf = np.where(df > 0, np.log((1 + len(counts)) / (1 + df)) + 0.1, 0).astype(np.float32)
        x = _weighed(counts, self.idf)
        values, directions = np.linalg.eigh((x.T @ x).astype(np.float64))
        self.project = directions[:, np.argsort(-values)[:rank]].astype(np.float32)
        self.labels = labels.astype(np.float32)
        self.prior = float(self.labels.mean()) if len(labels) else 0.5
        self.vectors = self.place(counts)

    def place(self, counts: np.ndarray) -> np.ndarray:
        y = _weighed(counts, self.idf) @ self.project
        norm = np.sqrt((y * y).sum(1, keepdims=True))
        return (y / np.where(norm > 0, norm, 1)).astype(np.float32)

    def score(self, counts: np.ndarray, neighbours: int, temperature: float) -> np.ndarray:
        out = np.full(len(counts), self.prior)
        k = min(neighbours, len(self.labels))
        if not k:
            return out
        y = self.place(counts)
        placed = np.flatnonzero((y != 0).any(1))
        for i in range(0, len(placed), 256):
            rows = placed[i : i + 256]
            similar = y[rows] @ self.vectors.T
            best = np.argpartition(-similar, k - 1, 1)[:, :k]
            weight = np.exp((np.take_along_axis(similar, best, 1) - 1) / temperature)
            out[rows] = (weight * self.labels[best]).sum(1) / weight.sum(1)
        return np.clip(out, 0, 1)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        for i, j, data, offsets in B.blocks(*B.utf8(rb.column("text")), rows=_ROWS):
            x = features(data, offsets)
            yield pa.RecordBatch.from_arrays([*(rb.column(c).slice(i, j - i) for c in ("doc_id", "label")), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "label", "counts"])


def _scored(space, neighbours: int, temperature: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for i, j, data, offsets in B.blocks(*B.utf8(rb.column("text")), rows=_ROWS):
                score = space.value.score(features(data, offsets), neighbours, temperature)
                yield pa.RecordBatch.from_arrays([rb.column("doc_id").slice(i, j - i), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return run


def knn_scores(documents: DataFrame, labels: DataFrame, label: str, usable: Column | None = None, sample: int = 4096, rank: int = 48, neighbours: int = 25, temperature: float = 0.08, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row with an id; learns from at most `sample` rows of labels where usable holds."""
    spark = documents.sparkSession
    docs = documents_of(documents, id_col, text_col)
    rows = labels.where(F.lit(True) if usable is None else usable).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).dropna()
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = docs.join(F.broadcast(rows), "doc_id").select("doc_id", "label", "text").mapInArrow(_counts, "doc_id long, label int, counts binary")
    held = known.orderBy(F.xxhash64("doc_id"), "counts").limit(sample).select("label", "counts").collect()  # of WIDTH floats each, however long the texts
    counts = np.stack([np.frombuffer(r["counts"], np.float32) for r in held]) if held else np.zeros((0, WIDTH), np.float32)
    space = spark.sparkContext.broadcast(Space(counts, np.array([r["label"] for r in held]), rank))
    return docs.mapInArrow(_scored(space, neighbours, temperature), "doc_id long, score double")
