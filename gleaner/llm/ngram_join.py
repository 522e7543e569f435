"""N-gram Jaccard join: documents whose sets of word n-grams have a Jaccard similarity of at least num/den.

Prefix-tree join. A document is the sorted sequence of its distinct n-gram hashes (the global order is that of the
64-bit hashes). Sets that can be similar are brought together without a count of n-grams and without pairs: sizes are
put into classes of ratio 5/4, a class allows a symmetric difference of at most d, the hash range is cut into
d + 1 + e segments, and two similar sets agree in at least e + 1 of them. Each set is entered under all segments but the
e with the fewest n-grams: the largest segment in which two sets agree is left in both. (Small segments would bring sets
together by a common line.) Sets that agree in a segment are chained in stars, the stars' components are the clusters. Inside a cluster the distinct sets are stored in a trie and the other
sets of the block traverse it together: every node keeps the partial overlaps of all of them with the path so far, a
subtree ends where no overlap can reach its bound with what remains, and a path without branches is intersected as one
array. Large clusters are cut in blocks by size and hash, and each pair of blocks
that can hold similar sets is a task of its own; tasks emit spanning links only.

Common lines chain sets that are not similar, and such a cluster grows with the table, so a large cluster is parted before
its n-grams are sent to pairs of blocks: of each set only a bit for every n-gram goes there, the parities of the n-grams in
as many buckets. In how many bits two sets differ is at most in how many n-grams they do, so that similar sets stay together.

Cases: a null text is empty; a document without n-grams is linked with nothing; rows without an id are left out; rows
that share an id are one node (their links add up, each row is returned); equal sets that are not empty are linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import _blocks as B
from gleaner.llm._graph import components
from gleaner.llm._shared import documents_of, shuffle_partitions, written

#: Distinct sets of a cluster, and n-grams of them all, that one task holds on either side (one set may have more).
BLOCK_SETS, BLOCK_GRAMS = 2000, 4_000_000
#: Sets of a block whose sketches meet, bits of a sketch at most (8 for a byte: 16 MB of one side), words compared at once.
SKETCH_SETS, SKETCH_BITS, _WORDS = 4000, 1 << 15, 1 << 20
#: Parts of the signatures for each shuffle partition: a task holds one of its parts at a time.
PARTS = 8
#: Signatures that a task holds before it sorts and passes them on.
_FLUSH = 1_000_000


def _bounds() -> np.ndarray:
    """Lower ends of the size classes."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 5 // 4))
    return np.array(out, np.int64)


def _signatures(sets: list[np.ndarray], num: int, den: int, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of the set) for every segment that a set enters, in its own size class and, where a similar set
    can be in the next one, there."""
    size = np.array([len(s) for s in sets], np.int64)
    tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    of = np.repeat(np.arange(len(sets)), size)
    salted = B.mix(tokens, 7)
    own = np.searchsorted(bounds, np.maximum(size, 1), "right") - 1
    out = []
    for step in (0, 1):
        kind = own + step
        enters = (size > 0) & ((step == 0) | (den * size >= num * bounds[kind]))
        d = (den - num) * 2 * (bounds[kind + 1] - 1) // (den + num)
        spare = (d + 1) // 3
        k = d + 1 + spare
        if not enters.any():
            continue
        use = enters[of]
        t, o = tokens[use], of[use]
        segment = ((t >> np.uint64(32)) * k[o].astype(np.uint64)) >> np.uint64(32)
        new = np.flatnonzero(np.concatenate(([True], (o[1:] != o[:-1]) | (segment[1:] != segment[:-1]))))
        sums, count, o, segment = np.add.reduceat(salted[use], new), np.diff(np.append(new, len(t))), o[new], segment[new]
        sig = B.mix(sums + B.mix(segment * np.uint64(512) + kind[o].astype(np.uint64), 3), 5)
        filled = np.bincount(o, minlength=len(sets))
        few = np.flatnonzero(enters & (k - filled > spare))
        rank = np.lexsort((sig, count, o))  # of each set the spare least segments go, the empty ones first
        place = np.arange(len(rank)) - np.repeat(np.cumsum(filled) - filled, filled)
        stays = rank[place >= (spare - (k - filled))[o[rank]]]
        out.append((sig[stays], o[stays]))
        for i in few:  # more empty segments than may go: some of them must be entered, so all are
            empty = np.setdiff1d(np.arange(k[i], dtype=np.uint64), segment[o == i])
            out.append((B.mix(B.mix(empty * np.uint64(512) + np.uint64(kind[i]), 3), 11), np.full(len(empty), i)))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def _stars(sigs: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of equal signatures: one each with its smallest id, and the distinct (id, smallest id) of the others."""
    order = np.lexsort((ids, sigs))
    sigs, ids = sigs[order], ids[order]
    first = np.concatenate(([True], sigs[1:] != sigs[:-1]))
    lead = ids[first][np.cumsum(first) - 1]
    other = lead != ids
    a, b = ids[other], lead[other]
    rank = np.lexsort((b, a))
    a, b = a[rank], b[rank]
    once = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(a)]
    return sigs[first], ids[first], a[once], b[once]


_MID = "part int, sigs binary, ids binary"
_OUT = "kind int, a long, b long, c long"


def _entered(words: int, num: int, den: int, parts: int):
    """Per batch: the sizes of the sets (part below 0), edges within the batch (part below 0), and signatures by part."""
    bounds = _bounds()

    def flush(sigs: list, ids: list) -> Iterator[tuple]:
        s, i, a, b = _stars(np.concatenate(sigs), np.concatenate(ids))
        if len(a):
            yield -2, a.tobytes(), b.tobytes()
        part = ((s >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)  # in the order of s
        cut = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
        for p in range(parts):
            if cut[p + 1] > cut[p]:
                yield p, s[cut[p] : cut[p + 1]].tobytes(), i[cut[p] : cut[p + 1]].tobytes()

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["part", "sigs", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, ids, held = [], [], 0
        for rb in batches:
            doc = rb.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j, data, offsets in B.blocks(*B.utf8(rb.column("text"))):
                sets = B.shingle_sets(data, offsets, words)
                digest = [int(B.mix(B.mix(s, 9).sum(keepdims=True), len(s)).view(np.int64)[0]) for s in sets]
                yield batch([(-1, doc[i:j].tobytes(), np.array([[len(s) for s in sets], digest], np.int64).tobytes())])
                s, o = _signatures(sets, num, den, bounds)
                sigs.append(s)
                ids.append(doc[i:j][o])
                held += len(s)
                if held >= _FLUSH:
                    yield batch(list(flush(sigs, ids)))
                    sigs, ids, held = [], [], 0
        if held:
            yield batch(list(flush(sigs, ids)))

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each part's signatures together: stars of those that met. Rows come sorted by part, so one part is held at a time.
    Sizes, digests and earlier edges pass through."""

    def out(kind: int, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(c)], names=["kind", "a", "b", "c"])

    def done() -> pa.RecordBatch:
        _, _, a, b = _stars(np.concatenate(sigs), np.concatenate(ids))
        return out(0, a, b, np.zeros(len(a), np.int64))

    sigs, ids, now = [], [], None
    for rb in batches:
        for part, x, y in zip(*(c.to_pylist() for c in rb.columns), strict=True):
            if part != now and sigs:
                yield done()
                sigs, ids = [], []
            now = part
            if part == -1:
                yield out(1, np.frombuffer(x, np.int64), *np.frombuffer(y, np.int64).reshape(2, -1))
            elif part < 0:
                yield out(0, np.frombuffer(x, np.int64), b := np.frombuffer(y, np.int64), np.zeros(len(b), np.int64))
            else:
                sigs.append(np.frombuffer(x, np.uint64))
                ids.append(np.frombuffer(y, np.int64))
    if sigs:
        yield done()


def _sets_of(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for i, j, data, offsets in B.blocks(*B.utf8(rb.column("text"))):
                sets = [s.tobytes() for s in B.shingle_sets(data, offsets, words)]
                yield pa.RecordBatch.from_arrays([*(rb.column(c).slice(i, j - i) for c in ("doc_id", "cluster", "i", "j", "side")), pa.array(sets, pa.binary())], names=["doc_id", "cluster", "i", "j", "side", "grams"])

    return run


def trie_links(stored: list[np.ndarray], probes: list[np.ndarray], num: int, den: int, same: bool) -> list[tuple[int, int]]:
    """Spanning links (index of a probe, index of a stored set) among similar sets; same: both lists are one.

    The stored sets are sorted; a run of them that shares its first tokens is a subtree of the trie. While a path is
    shared, over holds the overlaps of the probes alive with it. Pairs that links have joined already are not compared: a
    subtree drops the probes that its sets are all joined with, and a set tries one probe before it turns to all others.
    """
    n = len(stored)
    order = np.array(sorted(range(n), key=lambda i: stored[i].astype(">u8").tobytes()))  # bytes of this order compare as the numbers do
    sets = [stored[i] for i in order]
    sizes, psize = np.array([len(s) for s in sets]), np.array([len(p) for p in probes])
    tokens = np.concatenate(probes)
    of = np.repeat(np.arange(len(probes)), psize)
    rank = np.argsort(tokens, kind="stable")
    tokens, of = tokens[rank], of[rank]
    shift = 0 if same else n
    label = np.arange(n + (0 if same else len(probes)))  # of stored sets, then of probes: equal where links join them
    links: list[tuple[int, int]] = []

    def link(p: int, k: int) -> None:
        if label[p + shift] != label[k]:
            label[label == label[p + shift]] = label[k]
            links.append((p, k))

    shared = [0] * (n + 1)  # tokens that neighbours share from the start
    for i in range(1, n):
        m = min(len(sets[i - 1]), len(sets[i]))
        differs = np.flatnonzero(sets[i - 1][:m] != sets[i][:m])
        shared[i] = int(differs[0]) if len(differs) else m
    todo = [(0, n, 0, np.zeros(len(probes), np.int64), np.arange(len(probes)))]  # run, depth, overlaps, probes alive
    while todo:
        lo, hi, depth, over, alive = todo.pop()
        held = label[order[lo:hi]]
        if (held == held[0]).all():
            apart = label[alive + shift] != held[0]
            over, alive = over[apart], alive[apart]
        if not len(alive):
            continue
        if hi - lo == 1:
            tail, k = sets[lo][depth:], int(order[lo])
            one = int(alive[0])
            met = np.intersect1d(sets[lo], probes[one], assume_unique=True)
            if len(met) * (den + num) >= num * (sizes[lo] + psize[one]):
                link(one, k)
                apart = label[alive + shift] != label[k]
                over, alive = over[apart], alive[apart]
                if not len(alive):
                    continue
            total = np.zeros(len(probes), np.int64)
            if len(tail):
                first, count = np.searchsorted(tokens, tail, "left"), np.searchsorted(tokens, tail, "right")
                count -= first
                total += np.bincount(of[np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())], minlength=len(probes))
            similar = (total[alive] + over) * (den + num) >= num * (sizes[lo] + psize[alive])
            for p in alive[similar].tolist():
                link(p, k)
            continue
        deep = min(shared[lo + 1 : hi])
        for token in sets[lo][depth:deep]:
            a, b = np.searchsorted(tokens, token, "left"), np.searchsorted(tokens, token, "right")
            if b > a:
                where = np.searchsorted(alive, of[a:b])
                where[where == len(alive)] = 0
                over = over.copy()
                over[where[alive[where] == of[a:b]]] += 1
        longest, shortest = sizes[lo:hi].max(), sizes[lo:hi].min()
        ahead = np.minimum(longest - deep, psize[alive] - over)
        fits = (over + ahead) * (den + num) >= num * (shortest + psize[alive])
        over, alive = over[fits], alive[fits]
        if not len(alive):
            continue
        i = lo
        while i < hi:
            j = i + 1
            while j < hi and shared[j] > deep:
                j += 1
            todo.append((i, j, deep, over, alive))
            i = j
    return links


def _joined(num: int, den: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        side = rows.column("side").to_numpy()
        doc = rows.column("doc_id").to_numpy()
        grams = [np.frombuffer(x, np.uint64) for x in rows.column("grams").to_pylist()]
        left = [i for i in range(len(doc)) if side[i] == 0]
        right = [i for i in range(len(doc)) if side[i] == 1]
        same = not right
        links = trie_links([grams[i] for i in left], [grams[i] for i in (left if same else right)], num, den, same) if left else []
        a = [int(doc[(left if same else right)[p]]) for p, _ in links]
        b = [int(doc[left[s]]) for _, s in links]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _placed(same: DataFrame, block_sets: int, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """(doc_id, cluster, i, j, side): the pairs of blocks (i, j), and the side there, that each distinct set goes to.

    A cluster of at most block_sets sets and block_grams n-grams is one block. A larger one has blocks by size class (of ratio 1.26, so similar
    sets are in one class or in neighbours) and, where a class is larger, by hash; only those pairs of blocks are made
    whose classes can hold similar sets.
    """
    # tables of clusters are written before they are joined, so that adaptive execution can split a large cluster's sets
    sets = written(same.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("grams")).where("n > 1"), "large").join(same, "cluster")
    one = (F.col("n") <= block_sets) & (F.col("grams") <= block_grams)
    sets = sets.withColumn("class", F.when(one, F.lit(0)).otherwise(F.floor(F.log("n_shingles") / F.log(F.lit(1.26))) + 1).cast("long"))
    parts = sets.groupBy("cluster", "class").agg(F.ceil(F.greatest(F.count("*") / block_sets, F.sum("n_shingles") / block_grams)).cast("long").alias("parts"))
    parts = written(parts, "parts")
    sets = sets.join(parts, ["cluster", "class"])
    for name, step in (("above", 1), ("below", -1)):
        sets = sets.join(parts.select("cluster", (F.col("class") - step).alias("class"), F.col("parts").alias(name)), ["cluster", "class"], "left")
    wide = 1 << 32
    own = F.col("class") * wide + F.pmod(F.xxhash64("rep"), F.col("parts"))
    sets = sets.select(F.col("rep").alias("doc_id"), "cluster", "class", "parts", "above", "below", own.alias("own"))

    def of(step: int, parts: str, place) -> object:
        first = (F.col("class") + step) * wide
        return F.when(F.col(parts).isNull(), F.array()).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1), lambda k: place(first + k)))

    def struct(i, j, side) -> object:
        return F.struct(i.alias("i"), j.alias("j"), side.alias("side"))

    me = F.col("own")
    pairs = F.concat(of(0, "parts", lambda x: struct(F.least(me, x), F.greatest(me, x), F.when(me <= x, 0).otherwise(1))), of(1, "above", lambda x: struct(me, x, F.lit(0))), of(-1, "below", lambda x: struct(x, me, F.lit(1))))
    return sets.select("doc_id", "cluster", pairs.alias("x")).select("doc_id", "cluster", "x.i", "x.j", "x.side")


def _sketch(grams: np.ndarray) -> np.ndarray:
    """The parity of the n-grams in each bucket, a bit each; as many buckets as n-grams, up to a power of two. The sketch of
    half the buckets is one half of it xor the other."""
    bits = min(SKETCH_BITS, max(64, 1 << int(len(grams) - 1).bit_length())) if len(grams) else 64
    counts = np.bincount((B.mix(grams, 13) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for i, j, data, offsets in B.blocks(*B.utf8(rb.column("text"))):
                sets = B.shingle_sets(data, offsets, words)
                yield pa.RecordBatch.from_arrays([rb.column("doc_id").slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array([_sketch(s).tobytes() for s in sets], pa.binary())], names=["doc_id", "size", "sketch"])

    return run


def sketch_links(left: list[np.ndarray], left_size: np.ndarray, right: list[np.ndarray], right_size: np.ndarray, num: int, den: int, same: bool) -> list[tuple[int, int]]:
    """Spanning links (index on the left, index on the right) of the pairs whose sketches can be those of similar sets; same:
    both sides are one."""
    shift = 0 if same else len(left)
    label = np.arange(shift + len(right))
    links: list[tuple[int, int]] = []

    def levels(side: list[np.ndarray]) -> dict[int, np.ndarray]:
        many = np.array([len(x) for x in side])
        return {int(m): np.flatnonzero(many == m) for m in np.unique(many)}

    def folded(rows: np.ndarray, to: int) -> np.ndarray:
        while rows.shape[1] > to:
            rows = rows[:, : rows.shape[1] // 2] ^ rows[:, rows.shape[1] // 2 :]
        return rows

    for wide_l, at_l in levels(left).items():
        for wide_r, at_r in levels(right).items():
            wide = min(wide_l, wide_r)
            a, b = folded(np.array([left[i] for i in at_l]), wide), folded(np.array([right[i] for i in at_r]), wide)
            step = max(1, _WORDS // b.size)
            for low in range(0, len(a), step):
                own = at_l[low : low + step]
                differ = np.bitwise_count(a[low : low + step, None, :] ^ b[None]).sum(2, dtype=np.int64)
                x, y = left_size[own][:, None], right_size[at_r][None]
                fits = (differ * (den + num) <= (den - num) * (x + y)) & (den * np.minimum(x, y) >= num * np.maximum(x, y))
                for k in np.flatnonzero(fits.any(1)):
                    met = at_r[np.flatnonzero(fits[k])]
                    names, first = np.unique(label[met + shift], return_index=True)
                    mine = label[own[k]]
                    new = names != mine
                    if new.any():
                        links += [(int(own[k]), int(r)) for r in met[first[new]]]
                        label[np.isin(label, names[new])] = mine
    return links


def _near(num: int, den: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        side, doc, size = (rows.column(c).to_numpy() for c in ("side", "doc_id", "size"))
        sketch = [np.frombuffer(x, np.uint64) for x in rows.column("sketch").to_pylist()]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = not len(right)
        right = left if same else right
        links = sketch_links([sketch[i] for i in left], size[left], [sketch[i] for i in right], size[right], num, den, same) if len(left) else []
        return pa.table({"a": pa.array([int(doc[left[x]]) for x, _ in links], pa.int64()), "b": pa.array([int(doc[right[y]]) for _, y in links], pa.int64())})

    return run


def _parted(docs: DataFrame, same: DataFrame, words: int, num: int, den: int, block_sets: int) -> DataFrame:
    """The distinct sets with the clusters of more than one block cut into those that sketches leave; sets that are like no
    other are gone."""
    sizes = written(same.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("grams")), "cluster-sizes")
    large = sizes.where((F.col("n") > block_sets) | (F.col("grams") > BLOCK_GRAMS)).select("cluster")
    if not large.limit(1).count():
        return same
    sets = written(same.join(large, "cluster"), "large-sets")
    placed = written(_placed(sets, SKETCH_SETS, 1 << 60), "sketched")
    # all texts are sketched where they lie, as sketches are a small part of what a shuffle of texts would carry
    rows = docs.mapInArrow(_sketches(words), "doc_id long, size long, sketch binary").join(placed.hint("merge"), "doc_id")
    pairs = rows.select("cluster", "doc_id", "size", "sketch", F.explode(F.arrays_zip("i", "j", "side")).alias("x")).select("cluster", "doc_id", "size", "sketch", "x.*")
    found = components(pairs.groupBy("cluster", "i", "j").applyInArrow(_near(num, den), "a long, b long"))
    parted = sets.drop("cluster").join(found.select(F.col("node").alias("rep"), F.col("component").alias("cluster")), "rep")
    return same.join(large, "cluster", "left_anti").unionByName(parted.select(*same.columns))


def ngram_jaccard_components(documents: DataFrame, words: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text", block_sets: int = BLOCK_SETS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: size of its n-gram set, smallest id that links reach."""
    if not 4 * den <= 5 * num <= 5 * den:
        raise ValueError("num / den is from 0.8 to 1: similar sets are in one size class or in neighbours")
    spark = documents.sparkSession
    docs = documents_of(documents, id_col, text_col)
    n = shuffle_partitions(spark)
    entered = docs.mapInArrow(_entered(words, num, den, PARTS * n), _MID)
    spread = F.when(F.col("part") < 0, F.xxhash64("ids")).otherwise(F.col("part").cast("long"))
    met = written(entered.repartition(n, spread).sortWithinPartitions("part").mapInArrow(_met, _OUT), "met")
    sizes, edges = met.where("kind = 1").select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"), F.col("c").alias("digest")), met.where("kind = 0").select("a", "b")
    clusters = written(components(edges).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")), "clusters")

    # equal sets: of one cluster, size and digest; only the first of them is compared any further
    kind = ["cluster", "n_shingles", "digest"]
    members = sizes.join(clusters, "doc_id")
    same = members.groupBy(*kind).agg(F.min("doc_id").alias("rep"))
    equal = members.join(same, kind).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    placed = written(_placed(_parted(docs, same, words, num, den, block_sets), block_sets), "placed")
    grams = docs.join(placed.hint("merge"), "doc_id").mapInArrow(_sets_of(words), "doc_id long, cluster long, i array<long>, j array<long>, side array<int>, grams binary")
    pairs = grams.select("cluster", "doc_id", "grams", F.explode(F.arrays_zip("i", "j", "side")).alias("x")).select("cluster", "doc_id", "grams", "x.*")
    links = pairs.groupBy("cluster", "i", "j").applyInArrow(_joined(num, den), "a long, b long")
    found = components(equal.unionByName(links))
    return sizes.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
