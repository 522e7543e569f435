"""Hard-negative mining: for each anchor and each of its positives the best rows of other labels within a band of scores.

Slot-decomposed selection. The band of a positive of score p is [low * p, high * p]; an anchor's bands overlap. Their upper
limits, in falling order, cut the scores into disjoint slots, so that each row has one slot of an anchor at most. Tasks
combine: a partition keeps the k best rows of each slot, partitions are merged slot by slot, and one merge from the lowest
slot upwards gives the k best of every suffix of slots - which are the answers for all bands, once what lies below a
band's lower limit is dropped.

The anchors are the stated side: blocks of ANCHORS of them go to all tasks, and each block is run against all rows, once
for the positives and once for the slots. Scores are inner products of whole numbers in doubles, which are exact below
2 ** 53; a vector that could reach that is an error that says so.

Cases: rows without an id, a label, a vector, or with a component that is null or not finite take no part; of rows that
share an id that with the least label, then the least vector, takes part; ties go to the smaller id; an anchor without
positives, and a positive without a row in its band, give no rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm._shared import shuffle_partitions, written

#: Anchors whose vectors are sent to all tasks at once.
ANCHORS = 8192
#: Rows and anchors whose products a task holds at once.
_ROWS, _COLUMNS = 2048, 512
_LAST = np.iinfo(np.int64).max


class Best:
    """The k best (higher score, then smaller id) of each group, in tables of one size however many rows come."""

    def __init__(self, groups: int, k: int):
        self.score, self.id = np.full((groups, k), -np.inf), np.full((groups, k), _LAST)

    def offer(self, groups: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores[r, c] of row ids[r] for the group groups[c]; minus infinity is no offer."""
        k = self.score.shape[1]
        floor, last = self.score[groups, -1], self.id[groups, -1]
        fits = (scores > floor) | ((scores == floor) & (ids[:, None] < last))
        fits &= scores > -np.inf
        if len(ids) > k and np.count_nonzero(fits) > 4 * k * len(groups):
            held = np.where(fits, scores, -np.inf)
            fits &= held >= np.partition(held, len(ids) - k, 0)[len(ids) - k]
        r, c = np.nonzero(fits)
        if not len(r):
            return
        own = np.unique(groups[c])
        g = np.concatenate([np.repeat(own, k), groups[c]])
        s, i = np.concatenate([self.score[own].ravel(), scores[r, c]]), np.concatenate([self.id[own].ravel(), ids[r]])
        order = np.lexsort((i, -s, g))
        g, s, i = g[order], s[order], i[order]
        top = np.arange(len(g)) - np.searchsorted(g, g) < k
        self.score[own], self.id[own] = s[top].reshape(-1, k), i[top].reshape(-1, k)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, id, score) of all that is held."""
        g, place = np.nonzero(self.score > -np.inf)
        return g, self.id[g, place], self.score[g, place].astype(np.int64)


def _parts(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for whole in batches:
        for at in range(0, whole.num_rows, _ROWS):
            rb = whole.slice(at, _ROWS)
            values = rb.column("vector").flatten().to_numpy().astype(np.float64)
            if len(values) != rb.num_rows * dimension:
                raise ValueError("vectors of more than one length have no inner product")
            yield rb.column("vec_id").to_numpy(), rb.column("label").to_numpy(), values.reshape(-1, dimension)


def _positives(block, k: int):
    """(anchor_id, vec_id, score): a partition's k best other rows of each anchor's own label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, labels, vectors = block.value
        best = Best(len(anchors), k)
        own = {label: np.flatnonzero(labels == label) for label in np.unique(labels).tolist()}
        for ids, row_labels, rows in _parts(batches, vectors.shape[1]):
            for label in np.unique(row_labels).tolist():
                same = np.flatnonzero(row_labels == label)
                every = own.get(label, same[:0])
                for at in range(0, len(every), _COLUMNS):
                    columns = every[at : at + _COLUMNS]
                    scores = rows[same] @ vectors[columns].T
                    scores[ids[same][:, None] == anchors[columns]] = -np.inf
                    best.offer(columns, scores, ids[same])
        g, i, s = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(anchors[g]), pa.array(i), pa.array(s)], names=["anchor_id", "vec_id", "score"])

    return run


def slots(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last): the scores of each slot of each anchor, from the bands' limits by falling upper limit.

    A slot ends where the next one begins, or where it falls below all bands that reach down to it."""
    after = np.concatenate([high[:, 1:] + 1, np.full((len(high), 1), -np.inf)], 1)
    return np.maximum(after, np.minimum.accumulate(low, 1)), high


def _negatives(block, k: int):
    """(anchor_id, slot, vec_id, score): a partition's k best rows of other labels in each slot of each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, labels, vectors, low, high = block.value
        first, last = slots(low, high)
        many = first.shape[1]
        best = Best(len(anchors) * many, k)
        for ids, row_labels, rows in _parts(batches, vectors.shape[1]):
            for at in range(0, len(anchors), _COLUMNS):
                columns = np.arange(at, min(len(anchors), at + _COLUMNS))
                scores = rows @ vectors[columns].T
                scores[row_labels[:, None] == labels[columns]] = -np.inf
                for slot in range(many):
                    inside = (scores >= first[columns, slot]) & (scores <= last[columns, slot])
                    some = inside.any(0)
                    if some.any():
                        best.offer(columns[some] * many + slot, np.where(inside[:, some], scores[:, some], -np.inf), ids)
        g, i, s = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(anchors[g // many]), pa.array((g % many).astype(np.int32)), pa.array(i), pa.array(s)], names=["anchor_id", "slot", "vec_id", "score"])

    return run


def whole_vectors(rows: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int, label: Column | None = None) -> DataFrame:
    """(vec_id, label, vector array<int>): floor(scale * x) of each component x, one row an id."""
    v, id_, own = F.col(f"`{vector_col}`"), F.col(f"`{id_col}`").cast("long"), F.col(f"`{label_col}`").cast("long")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = rows.where(id_.isNotNull() & own.isNotNull() & v.isNotNull() & ~odd)
    most = F.sqrt(F.lit(float(1 << 53)) / F.greatest(F.size(v), F.lit(1)))
    high = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double") * scale))) + 1
    told = F.raise_error(F.concat(F.lit("components too large for exact products in the vector of "), id_.cast("string")))
    numbers = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("int"))
    kept = kept.select(id_.alias("vec_id"), (own if label is None else label).cast("long").alias("label"), F.when(high >= most, told).otherwise(numbers).alias("vector"))
    one = kept.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("first"))
    return one.select("vec_id", "first.label", "first.vector")


def _blocks(anchors: DataFrame) -> Iterator[list]:
    """The anchors in order, ANCHORS at a time."""
    after = None
    while True:
        rest = anchors if after is None else anchors.where(F.col("vec_id") > after)
        block = rest.orderBy("vec_id").limit(ANCHORS).collect()
        if block:
            yield block
        if len(block) < ANCHORS:
            return
        after = block[-1].vec_id


def hard_negatives(
    rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, den: int = 100, scale: int = 256,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", label: Column | None = None,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    anchor is a condition on vec_id. An anchor's positives are its `positives` best other rows of its label; for each, the
    `negatives` best rows of other labels with low * positive_score <= den * score <= high * positive_score.
    """
    spark = rows.sparkSession
    vectors = whole_vectors(rows, id_col, label_col, vector_col, scale, label).repartition(shuffle_partitions(spark))
    vectors = written(vectors, "vectors")  # spread evenly: the products of a row cost far more than its transport
    anchors = written(vectors.where(anchor), "anchors")
    near, answers = [], []

    def block_of(part: list, *more: np.ndarray):
        head = (np.array([r.vec_id for r in part]), np.array([r.label for r in part]), np.array([r.vector for r in part], np.float64))
        return spark.sparkContext.broadcast((*head, *more))

    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    in_slot = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    for part in _blocks(anchors):
        found = vectors.mapInArrow(_positives(block_of(part), positives), "anchor_id long, vec_id long, score long")
        found = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
        listed = found.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("positives"))
        listed = written(listed, "positives")
        score_of = {r.anchor_id: [p.score for p in r.positives] for r in listed.collect()}  # of one block
        part = [r for r in part if r.vec_id in score_of]
        if not part:
            continue
        p = [score_of[r.vec_id] for r in part]
        none = [-np.inf] * positives  # an anchor of fewer positives has slots that nothing lies in
        lows = np.array([([-(-low * s // den) for s in x] + none)[:positives] for x in p], np.float64)
        highs = np.array([([high * s // den for s in x] + none)[:positives] for x in p], np.float64)
        held = vectors.mapInArrow(_negatives(block_of(part, lows, highs), negatives), "anchor_id long, slot int, vec_id long, score long")
        held = held.withColumn("place", F.row_number().over(in_slot)).where(F.col("place") <= negatives)
        near.append(listed)
        answers.append(written(held.groupBy("anchor_id").agg(F.collect_list(F.struct(F.col("slot"), (-F.col("score")).alias("below"), F.col("vec_id"))).alias("held")), "slots"))
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not answers:
        return spark.createDataFrame([], out)

    def of_slot(slot: int) -> Column:
        return F.transform(F.filter("held", lambda x: x["slot"] == slot), lambda x: F.struct(x["below"].alias("below"), x["vec_id"].alias("vec_id")))

    merged, best_of = F.array().cast("array<struct<below:bigint,vec_id:bigint>>"), []
    for slot in reversed(range(positives)):  # from the lowest slot upwards
        merged = F.slice(F.array_sort(F.concat(merged, of_slot(slot))), 1, negatives)
        best_of.insert(0, merged)
    every = reduce(DataFrame.unionByName, near).join(reduce(DataFrame.unionByName, answers), "anchor_id").select("anchor_id", "positives", F.array(*best_of).alias("suffixes"))
    every = every.select("anchor_id", F.explode("positives").alias("p"), "suffixes").withColumn("best", F.get("suffixes", F.col("p.place") - 1))
    every = every.select("anchor_id", "p", F.posexplode(F.filter("best", lambda x: -x["below"] * den >= low * F.col("p.score"))).alias("at", "n"))
    return every.select("anchor_id", F.col("p.vec_id").alias("positive_id"), (F.col("at") + 1).alias("rank"), F.col("n.vec_id").alias("negative_id"), F.col("p.score").alias("positive_score"), (-F.col("n.below")).alias("negative_score"))
