"""Vector code compression: product quantisation whose rounds run over anchors-hierarchy metric trees.

A vector of whole numbers is cut into parts; every part position has a codebook of entries that Lloyd rounds move. The
rows are put into blocks, and each block gets one tree a part position, built once and written as a table:

* Middle-out: the anchors hierarchy picks about sqrt(n) anchors, each new one the point farthest from the anchor of the
  widest ball; it takes the points that are nearer to it, and asks only those that can be (twice their distance from
  their own anchor exceeds that between the anchors). The same is done once more inside every anchor's ball.
* The balls are then joined upwards, always the two whose common ball is smallest, and a ball caches the sum and the
  number of its points.

A round walks each tree from its root, one level at a time. A ball inherits its parent's list of candidate entries. Of
these the one nearest to the ball's centre drives out every entry that the whole ball lies nearer to than the
perpendicular bisector between the two; a ball whose list shrinks to one entry is wholly owned and gives it its cached
sum and count at once. What is left at the leaves is compared point by point with the entries still listed there.

Sums, counts and distances are whole numbers, so codes and codebooks are exact; the bounds that drive entries out are
computed in floating point with a margin that only leaves an entry in. A task sends one row for each part position and
entry; the codebooks, whose size is a parameter, are all that the driver holds.

Cases: rows whose vector is null or holds a null or a component that is not finite are left out; rows that share an id
are each coded; a null id is coded, but comes after all others where the first codebook is filled (ties there: the lesser
vector); fewer rows than entries make smaller codebooks; an empty table gives no rows; vectors whose length the parts do
not divide, of more than one length, or with components beyond 2 ** 26 after scaling, are errors that say so.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm._shared import cleared, written

#: Rows of a block, so points of a tree.
BLOCK_ROWS = 4096
#: Points up to which a ball is a leaf, and balls whose points are looked at at once.
LEAF, _BALLS = 24, 256
MOST = 1 << 26


def _anchors(points: np.ndarray, group: np.ndarray, starts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The anchor of each point, numbered from 0 over all groups: group g (its points from starts[g]) gets up to wanted[g].

    All groups choose their next anchor at once; a point changes to it if it is strictly nearer."""
    n, groups = len(points), len(wanted)
    anchor, own = np.zeros(n, np.int64), np.arange(n)
    seat = starts[:-1].copy()  # the point that an anchor is
    diff = points - points[seat][group]
    distance = np.einsum("ij,ij->i", diff, diff).astype(np.float64)
    where = seat[group]
    live = np.ones(groups, bool)
    for k in range(1, int(wanted.max(initial=1))):
        top = np.maximum.reduceat(distance, starts[:-1])
        live &= (wanted > k) & (top > 0)  # a group of equal points needs no more anchors
        if not live.any():
            break
        first = np.minimum.reduceat(np.where(distance == top[group], own, n), starts[:-1])
        gap = points[where] - points[first[group]]
        near = np.einsum("ij,ij->i", gap, gap)
        ask = np.flatnonzero(live[group] & (4 * distance > near))  # others are nearer to their own anchor for sure
        diff = points[ask] - points[first[group[ask]]]
        new = np.einsum("ij,ij->i", diff, diff).astype(np.float64)
        moves = new < distance[ask]
        ask, new = ask[moves], new[moves]
        distance[ask], anchor[ask], where[ask] = new, k, first[group[ask]]
    return anchor


def _joined(centre: np.ndarray, radius: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (child, child) of balls, each pair making the next ball: always the two whose common ball is smallest."""
    n = len(radius)
    c, r = np.zeros((2 * n - 1, centre.shape[1])), np.zeros(2 * n - 1)
    c[:n], r[:n] = centre, radius
    cost = np.full((2 * n - 1, 2 * n - 1), np.inf)

    def against(k: int, others: np.ndarray) -> None:
        d = np.sqrt(((c[others] - c[k]) ** 2).sum(1))
        both = np.maximum(np.maximum(r[others], r[k]), (d + r[others] + r[k]) / 2)
        cost[np.minimum(others, k), np.maximum(others, k)] = both

    for k in range(1, n):
        against(k, np.arange(k))
    alive, out = np.ones(2 * n - 1, bool), []
    for k in range(n, 2 * n - 1):
        a, b = divmod(int(cost[:k, :k].argmin()), k)
        out.append((a, b))
        size = cost[a, b]
        d = np.sqrt(((c[a] - c[b]) ** 2).sum())
        if d + min(r[a], r[b]) <= max(r[a], r[b]) or d == 0:
            c[k], r[k] = c[a if r[a] >= r[b] else b], max(r[a], r[b])
        else:
            c[k], r[k] = c[a] + (c[b] - c[a]) * ((size - r[a]) / d), size
        alive[[a, b]] = False
        cost[[a, b]], cost[:, [a, b]] = np.inf, np.inf
        against(k, np.flatnonzero(alive[:k]))
    return out


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run, place) of all places of runs of count[r] from first[r]."""
    of = np.repeat(np.arange(len(count)), count)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + first[of]


def _groups(key: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    return np.append(np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))), len(key))


def tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, low, up, sums, away) of a block's points of one part: ball k holds the points order[low[k, 0] : low[k, 1]],
    whose sum is sums[k] and of which none is farther than away[k] from their mean, and lies in the ball up[k], which
    comes before it; ball 0 is the root."""
    n = len(points)
    root = int(np.ceil(np.sqrt(n)))
    anchor = _anchors(points, np.zeros(n, np.int64), np.array([0, n]), np.array([root]))
    order = np.argsort(anchor, kind="stable")
    starts = _groups(anchor[order])
    group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    inner = _anchors(points[order], group, starts, np.where(np.diff(starts) > LEAF, np.ceil(np.sqrt(np.diff(starts))), 1).astype(np.int64))
    rank = np.lexsort((inner, group))
    order = order[rank]
    leaves = _groups(group * (n + 1) + inner[rank])
    # the anchors' balls, joined upwards
    sizes = np.diff(starts)
    now = points[order].astype(np.float64)
    centre = np.add.reduceat(now, starts[:-1]) / sizes[:, None]
    radius = np.sqrt(np.maximum.reduceat(((now - centre[group]) ** 2).sum(1), starts[:-1]))
    many = len(sizes)
    pairs = _joined(centre, radius) if many > 1 else []
    # numbered from the root down: 2 * many - 2 is the root of the joins
    kids = {many + k: ab for k, ab in enumerate(pairs)}
    place, low, up, at, pieces = {}, [], [], 0, []
    todo = [(many + len(pairs) - 1, -1)]
    while todo:
        ball, parent = todo.pop()
        place[ball] = len(low)
        low.append([at, at])
        up.append(parent)
        if ball in kids:
            todo += [(kids[ball][1], place[ball]), (kids[ball][0], place[ball])]
            continue
        a, b = starts[ball], starts[ball + 1]
        pieces.append(order[a:b])
        inside = leaves[np.searchsorted(leaves, a) : np.searchsorted(leaves, b) + 1]
        if len(inside) > 2:
            for x, y in zip(inside[:-1].tolist(), inside[1:].tolist(), strict=True):
                low.append([at + x - a, at + y - a])
                up.append(place[ball])
        at += int(b - a)
        low[place[ball]][1] = at
    low, up = np.array(low, np.int64), np.array(up, np.int64)
    for k in range(len(up) - 1, 0, -1):  # a joined ball ends where its last child does
        low[up[k], 1] = max(low[up[k], 1], low[k, 1])
    order = np.concatenate(pieces)
    now, first, count = points[order], low[:, 0], low[:, 1] - low[:, 0]
    total = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(now, 0)])
    sums, away = total[low[:, 1]] - total[first], np.empty(len(up))
    centre = sums / count[:, None]
    for k in range(0, len(up), _BALLS):
        of, at = _spread(first[k : k + _BALLS], count[k : k + _BALLS])
        c = count[k : k + _BALLS]
        away[k : k + _BALLS] = np.sqrt(np.maximum.reduceat(((now[at] - centre[k : k + _BALLS][of]) ** 2).sum(1), np.cumsum(c) - c))
    return order, low, up, sums, away


def _built(parts: int, scale: int):
    """Blocks of rows as one row each: ids, labels, numbers, and for each part position its tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                rb = whole.slice(at, BLOCK_ROWS)
                values = np.floor(rb.column("vector").flatten().to_numpy().astype(np.float64) * scale)
                if np.abs(values).max() > MOST:
                    raise ValueError(f"components must lie within {MOST // scale} of 0, so that errors are exact")
                values = values.astype(np.int64).reshape(rb.num_rows, parts, -1)
                trees = [tree(values[:, p]) for p in range(parts)]
                held = [values.astype(np.int32), *(np.concatenate(x).astype(t) for x, t in zip(zip(*trees, strict=True), _KINDS, strict=True))]
                held.append(np.cumsum([0, *(len(x[2]) for x in trees)]).astype(np.int32))
                lists = [pa.array([rb.column(c).to_pylist()], pa.list_(pa.int64())) for c in ("vec_id", "label")]
                yield pa.RecordBatch.from_arrays([*lists, *(pa.array([x.tobytes()], pa.binary()) for x in held)], names=_BLOCK)

    return run


_KINDS = (np.int16, np.int32, np.int32, np.int64, np.float64)
_BLOCK = ["ids", "labels", "numbers", "orders", "lows", "ups", "sums", "aways", "cuts"]
_BLOCK_SCHEMA = "ids array<long>, labels array<long>, " + ", ".join(f"{c} binary" for c in _BLOCK[2:])


def owners(points: np.ndarray, low: np.ndarray, up: np.ndarray, sums: np.ndarray, away: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(balls, entry of each, places, entry of each, distances taken): the balls that one entry owns wholly, and the places
    in the tree's order of the points of all other balls.

    Ties go to the lower entry: an entry is driven out only by one that is strictly nearer to the whole ball.
    """
    first, count = low[:, 0], low[:, 1] - low[:, 0]
    centre = sums / count[:, None]
    e = entries.astype(np.float64)
    between = np.sqrt(((e[:, None] - e[None]) ** 2).sum(2))
    norm = (e**2).sum(1)
    slack = 1e-9 * (1 + np.abs(e).max() ** 2 + float(np.abs(points).max()) ** 2)
    children = np.argsort(up[1:], kind="stable") + 1
    begin = np.searchsorted(up[children], np.arange(len(up) + 1))
    owned, singles, taken = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)], 0
    balls, lists = np.zeros(1, np.int64), np.zeros((1, len(e)), bool)
    lists[0, np.unique(entries, axis=0, return_index=True)[1]] = True  # of equal entries the lowest
    while len(balls):
        d = norm - 2 * (centre[balls] @ e.T)  # squared distances, but for the centre's own term
        taken += int(lists.sum())
        d[~lists] = np.inf
        best = d.argmin(1)
        ahead = d - d[np.arange(len(balls)), best][:, None]
        lists &= ~(ahead > 2 * between[best] * away[balls][:, None] + slack)  # the bisector lies ahead / (2 * between) off
        alone = lists.sum(1) == 1
        owned.append(np.stack([balls[alone], lists[alone].argmax(1)], 1))
        balls, lists = balls[~alone], lists[~alone]
        many = begin[balls + 1] - begin[balls]
        leaf, listed = balls[many == 0], lists[many == 0]
        for k in range(0, len(leaf), _BALLS):
            of, at = _spread(first[leaf[k : k + _BALLS]], count[leaf[k : k + _BALLS]])
            own, entry = np.nonzero(listed[k : k + _BALLS][of])
            taken += len(own)
            diff = points[at[own]] - entries[entry]
            square = np.einsum("ij,ij->i", diff, diff)
            least = np.minimum.reduceat(square, np.searchsorted(own, np.arange(len(at))))
            hit = np.flatnonzero(square == least[own])  # in order of entries: the first of equals is the lowest
            singles.append(np.stack([at, entry[hit[np.searchsorted(own[hit], np.arange(len(at)))]]], 1))
        of, at = _spread(begin[balls], many)  # children take over their parent's list
        balls, lists = children[at], lists[of]
    owned, singles = np.concatenate(owned), np.concatenate(singles)
    return owned[:, 0], owned[:, 1], singles[:, 0], singles[:, 1], taken


def _each(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[tuple]:
    """Of each block its ids, labels, numbers (rows, parts, width) and the tree of each part position."""
    for rb in batches:
        for r in range(rb.num_rows):
            ids, labels = rb.column("ids")[r].values, rb.column("labels")[r].values
            numbers, orders, lows, ups, sums, aways, cuts = (np.frombuffer(rb.column(c)[r].as_py(), t) for c, t in zip(_BLOCK[2:], (np.int32, *_KINDS, np.int32), strict=True))
            n = len(ids)
            numbers, lows = numbers.reshape(n, parts, -1).astype(np.int64), lows.reshape(-1, 2)
            sums = sums.reshape(len(ups), -1)
            trees = [(orders[p * n : (p + 1) * n], *(x[cuts[p] : cuts[p + 1]] for x in (lows, ups, sums, aways))) for p in range(parts)]
            yield ids, labels, numbers, trees


def _moved(books: np.ndarray):
    """(part, entry, n, sums): what the entries own, added up over a task's blocks; books[part, entry]."""
    parts, many, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros((parts, many, width), np.int64), np.zeros((parts, many), np.int64)
        for _, _, numbers, trees in _each(batches, parts):
            for p, (order, low, up, sums, away) in enumerate(trees):
                points = numbers[order, p]
                balls, owner, places, nearest, _ = owners(points, low, up, sums, away, books[p])
                entry = np.concatenate([owner, nearest])
                counts[p] += np.bincount(entry, np.concatenate([(low[balls, 1] - low[balls, 0]), np.ones(len(places), np.int64)]), many).astype(np.int64)
                moved = np.concatenate([sums[balls], points[places]])
                for k in range(width):  # whole numbers below 2 ** 53 all along
                    totals[p, :, k] += np.bincount(entry, moved[:, k], many).astype(np.int64)
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(counts[p, e]), pa.array(totals[p, e].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    return run


def _coded(books: np.ndarray):
    """(vec_id, label, code, error) of every row."""
    parts = len(books)
    hexes = np.array([f"{k:02x}" for k in range(books.shape[1])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, numbers, trees in _each(batches, parts):
            codes, error = np.empty((len(ids), parts), np.int64), np.zeros(len(ids), np.int64)
            for p, (order, low, up, sums, away) in enumerate(trees):
                balls, owner, places, nearest, _ = owners(numbers[order, p], low, up, sums, away, books[p])
                of, at = _spread(low[balls, 0], low[balls, 1] - low[balls, 0])
                codes[order[at], p], codes[order[places], p] = owner[of], nearest
                diff = numbers[:, p] - books[p][codes[:, p]]
                error += np.einsum("ij,ij->i", diff, diff)
            text = ["".join(x) for x in hexes[codes].tolist()]
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array(text, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def compressed(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error) of every row with a whole vector, codebooks[part, entry]).

    Each component x counts as floor(scale * x). A codebook starts as the parts of the `entries` rows of least id; a round
    assigns every part to its nearest entry (squared Euclidean distance, ties to the lower one) and moves each entry that
    owns parts to their mean, rounded down. A code has two hex digits a part.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries must be from 1 to 256: a code has two hex digits a part")
    spark = rows.sparkSession
    v = F.col(f"`{vector_col}`")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = rows.where(v.isNotNull() & ~odd).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("long").alias("label"), v.cast("array<double>").alias("vector"), F.size(v).alias("size"))
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()
    schema = "vec_id long, label long, code string, error long"
    if not first:
        return spark.createDataFrame([], schema), np.zeros((parts, 0, 0), np.int64)
    dimension = first[0].size
    if not dimension or any(r.size != dimension for r in first) or dimension % parts:
        raise ValueError(f"vectors must be of one length that {parts} divides")
    start = np.floor(np.array([r.vector for r in first]) * scale)
    books = np.where(np.abs(start) <= MOST, start, MOST).astype(np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    told = F.raise_error(F.concat(F.lit(f"not a vector of {dimension} components: that of "), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))))
    kept = kept.withColumn("vector", F.when(F.col("size") == dimension, F.col("vector")).otherwise(told))
    blocks = written(kept.select("vec_id", "label", "vector").mapInArrow(_built(parts, scale), _BLOCK_SCHEMA), "vector-blocks")
    for _ in range(rounds):
        found = blocks.mapInArrow(_moved(books), "part int, entry int, n long, sums array<long>")
        width = books.shape[2]
        sums = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(width)])
        for r in sums.collect():  # a row for each part position and entry
            books[r.part, r.entry] = [r[f"s{k}"] // r.n for k in range(width)]
    coded = written(blocks.mapInArrow(_coded(books), schema), "codes")
    cleared(blocks)
    return coded, books


def with_label_errors(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): label_error is the error of all rows of the label."""
    by = written(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    rows = coded.join(by, F.col("label").eqNullSafe(F.col("of")))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
