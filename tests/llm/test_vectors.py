"""Operators on vectors against brute force: ties, repeated rows, nulls, odd components, clashing columns, empty tables."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "vec_id long, label int, embedding array<float>, slot int, place int, score long, rank int, part int, held string"


def rows_of(n, dimension=16, seed=3, hot=0):
    """Rows of small components (so that scores tie), with hot copies of one vector, nulls and odd components."""
    r = random.Random(seed)
    one = [r.uniform(-1, 1) for _ in range(dimension)]
    out = []
    for i in range(n):
        v = one if i < hot else [r.choice([-0.5, -0.25, 0.0, 0.3, 0.5, 0.75]) for _ in range(dimension)]
        out.append((i, r.randrange(3), list(v)))
    out += [(n, None, one), (n + 1, 1, None), (None, 1, one), (n + 2, 2, [None] * dimension), (n + 3, 0, [math.nan] + one[1:]), (n + 4, 0, [math.inf] + one[1:])]
    return [(*x, 1, 2, 3, 4, 5, "x") for x in out]


def whole(v):
    return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(256 * float(np.float32(x))) for x in v]


def mined(rows, step, positives, negatives, low, high):
    kept = {}
    for i, label, v, *_ in rows:
        q = whole(v)
        if i is not None and label is not None and q is not None:
            kept[i] = min(kept.get(i, (label, q)), (label, q))
    out = set()
    for a, (label, v) in kept.items():
        if a % step:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, (other, w) in kept.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            band = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s]
            out |= {(a, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(band[:negatives])}
    return out


@pytest.mark.parametrize(("hot", "anchors"), [(0, 8192), (90, 8192), (20, 7)])
def test_hard_negatives(spark, monkeypatch, hot, anchors):
    from gleaner.llm import hard_negatives as H

    monkeypatch.setattr(H, "ANCHORS", anchors)
    rows = rows_of(260, hot=hot)
    rows += rows[:5] + [(3, 0, *rows[7][2:]), (8, 2, *rows[7][2:])]  # repeated rows, and ids with two rows
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for low, high in ((50, 95), (-100, 99)):
        got = {tuple(r) for r in H.hard_negatives(df, F.col("vec_id") % 10 == 0, 5, 3, low, high).collect()}
        assert got == mined(rows, 10, 5, 3, low, high)
    assert got


def test_hard_negatives_without_rows(spark):
    from gleaner.llm.hard_negatives import hard_negatives

    df = spark.createDataFrame(rows_of(3), SCHEMA)
    assert hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives(df, F.col("vec_id") > 900).count() == 0
    big = spark.createDataFrame([(1, 0, [3e6] * 16), (2, 0, [1.0] * 16)], "vec_id long, label int, embedding array<double>")
    with pytest.raises(Exception, match="too large for exact products"):
        hard_negatives(big, F.col("vec_id") == 2).collect()


def quantised(rows, parts, entries, rounds):
    """Lloyd rounds in plain Python: {place of row: (code, error)}, codebooks."""
    kept = [(k, i, whole(v)) for k, (i, _, v, *_) in enumerate(rows) if whole(v) is not None]
    kept.sort(key=lambda x: (x[1] is None, x[1] or 0, x[2]))
    width = len(kept[0][2]) // parts
    cut = {k: [tuple(q[p * width : (p + 1) * width]) for p in range(parts)] for k, _, q in kept}
    books = [[cut[k][p] for k, _, _ in kept[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for x in cut.values():
                own.setdefault(nearest(p, x[p])[1], []).append(x[p])
            books[p] = [tuple(sum(c) // len(c) for c in zip(*own[j], strict=True)) if j in own else e for j, e in enumerate(books[p])]
    out = {k: [nearest(p, x[p]) for p in range(parts)] for k, x in cut.items()}
    return {k: ("".join(f"{j:02x}" for _, j in x), sum(d for d, _ in x)) for k, x in out.items()}, books


@pytest.mark.parametrize(("hot", "entries"), [(0, 64), (80, 20), (0, 200)])
def test_vector_codes(spark, hot, entries):
    from gleaner.llm import vector_codes as V

    r = random.Random(9)
    rows = rows_of(300, hot=hot) + rows_of(5)[:3]
    rows += [(1000 + i, None if i % 9 == 0 else i % 4, [r.gauss(0, 0.2) for _ in range(16)], *rows[0][3:]) for i in range(500)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    coded, books = V.compressed(df, 4, entries, 2)
    want, want_books = quantised(rows, 4, entries, 2)
    assert books.tolist() == [[list(e) for e in b] for b in want_books]
    got = [(x.vec_id, x.code, x.error) for x in coded.collect()]
    assert sorted(got, key=repr) == sorted(((rows[k][0], *x) for k, x in want.items()), key=repr)
    by = {}
    for k, (_, error) in want.items():
        by[rows[k][1]] = by.get(rows[k][1], 0) + error
    label = {rows[k][0]: rows[k][1] for k in want if rows[k][0] is not None and rows[k][0] >= 1000}
    found = V.with_label_errors(coded, books).collect()
    assert len(found) == len(want) and all(x.label_error == by[label[x.vec_id]] for x in found if x.vec_id in label)


def test_vector_codes_cases(spark):
    from gleaner.llm.vector_codes import compressed, with_label_errors

    df = spark.createDataFrame(rows_of(3), SCHEMA)
    coded, books = compressed(df.limit(0), 4)
    assert with_label_errors(coded, books).count() == 0
    assert with_label_errors(*compressed(df.where("vec_id = 1 AND embedding IS NULL"), 4)).count() == 0
    with pytest.raises(ValueError, match="divides"):
        compressed(df, 5)
    for v, said in (([1.0] * 8, "not a vector of 16"), ([1e9] * 16, "within")):
        odd = spark.createDataFrame([(1, 1, [1.0] * 16), (9, 1, v)], "vec_id long, label int, embedding array<double>")
        with pytest.raises(Exception, match=said):
            compressed(odd, 4, 1)


def test_balls_own_points_without_distances():
    """In points that lie in clumps most balls are owned wholly, and every assignment is the nearest entry."""
    from gleaner.llm.vector_codes import owners, tree

    rng = np.random.default_rng(1)
    centres = rng.integers(-2000, 2000, (40, 4))
    points = (centres[rng.integers(0, 40, 4000)] + rng.integers(-20, 20, (4000, 4))).astype(np.int64)
    order, low, up, sums, away = tree(points)
    assert sorted(order.tolist()) == list(range(4000)) and low[0].tolist() == [0, 4000]
    entries = np.concatenate([centres[:30], centres[:3], rng.integers(-2000, 2000, (20, 4))]).astype(np.int64)
    now = points[order]
    assert all((now[a:b].sum(0) == s).all() for (a, b), s in zip(low.tolist(), sums, strict=True))
    balls, owner, places, nearest, taken = owners(now, low, up, sums, away, entries)
    got = np.full(4000, -1)
    for b, o in zip(balls.tolist(), owner.tolist(), strict=True):
        assert (got[low[b, 0] : low[b, 1]] == -1).all()
        got[low[b, 0] : low[b, 1]] = o
    assert (got[places] == -1).all()
    got[places] = nearest
    assert (got == ((now[:, None] - entries[None]) ** 2).sum(2).argmin(1)).all()
    assert taken < 4000 * len(entries) / 8


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_blocks_of_any_size_give_the_same_codes(monkeypatch, block):
    import pyarrow as pa

    from gleaner.llm import vector_codes as V

    monkeypatch.setattr(V, "BLOCK_ROWS", block)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 0.3, (120, 8)), np.repeat(rng.normal(0, 0.3, (1, 8)), 80, 0)])
    books = np.floor(256 * x[:40]).astype(np.int64).reshape(40, 2, 4).transpose(1, 0, 2)
    rb = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array([1] * 200), pa.array(x.tolist())], names=["vec_id", "label", "vector"])
    found = [r for out in V._coded(books)(V._built(2, 256)(iter([rb]))) for r in out.to_pylist()]
    q = np.floor(256 * x).astype(np.int64).reshape(200, 2, 4)
    d = ((q[:, :, None] - books[None]) ** 2).sum(3)
    assert [r["vec_id"] for r in found] == list(range(200))
    assert [r["code"] for r in found] == ["".join(f"{k:02x}" for k in row) for row in d.argmin(2).tolist()]
    assert [r["error"] for r in found] == d.min(2).sum(1).tolist()
    moved = [r for out in V._moved(books)(V._built(2, 256)(iter([rb]))) for r in out.to_pylist()]
    for r in moved:
        own = q[d[:, r["part"]].argmin(1) == r["entry"], r["part"]]
        assert (r["n"], r["sums"]) == (len(own), own.sum(0).tolist())
