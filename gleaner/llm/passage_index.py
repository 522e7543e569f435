"""Substring dedup: removes each word that a passage of `words` words covers which also starts in a text of smaller id.

Compressed FM-index per shard. A passage is looked up in one shard only, that of its anchor: of the runs of `gram` words in
it, that with the least hash, so that equal passages have equal anchors at equal places.

1. A text's passages fall into stretches that share an anchor. A stretch is known by its anchor (a name) and by the hash of
   all its words (a key). Names that come in one id only end here.
2. Of equal stretches that of the smallest id stays to be searched; all passages of the others are repeats.
3. Where a name has stretches of more than one kind, their words are gathered in shards by name. A shard's words become
   symbols, its stretches one text, and its Burrows-Wheeler transform a wavelet tree of packed bits with counts for every
   64. The stretches are streamed against it: backward search from each end of a passage, one word at a time for all
   passages at once, gives the matching statistic - how many words back another stretch agrees - and the passages that
   reach `words` have the interval of their copies, whose smallest id decides.
4. A name with more than HOT stretches has its passages counted by their hashes instead, which no single task holds.

Words are told apart by their bytes inside a shard. Names and keys are hashes: two of 64 bits together decide in step 2,
and for hot names. Texts are told apart by id and hash.

Cases: a null text has no words; texts of fewer words than `words` lose none; rows without an id are left out; rows that
share an id are separate texts of that id, and neither is the other's copy; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import _blocks as B
from gleaner.llm._shared import cleared, documents_of, shuffle_partitions, written
from gleaner.llm.suffix_dedup import _least

_PLACE = np.uint64((1 << 31) - 1)
#: Bytes of stretches of a shard; whole names, so that a shard may be larger by what its last name has.
SHARD_BYTES = 2 << 20
#: Stretches of one name beyond which they are not gathered in one task.
HOT = 20_000
_STEP_ROWS = 1000


class WaveletTree:
    """Ranks in a sequence of symbols below 2 ** bits: by level, from the highest bit, packed bits and counts of ones."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.n, self.bits, self.levels = len(symbols), bits, []
        now = symbols
        for shift in range(bits - 1, -1, -1):
            bit = (now >> shift) & 1
            packed = np.zeros((self.n // 64 + 1) * 8, np.uint8)
            packed[: (self.n + 7) // 8] = np.packbits(bit.astype(np.uint8), bitorder="little")
            word = packed.view(np.uint64)
            before = np.cumsum(np.bitwise_count(word), dtype=np.int64) - np.bitwise_count(word)
            self.levels.append((shift, word, before, self.n - int(bit.sum())))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        self.start = self._down(np.arange(1 << bits), np.zeros(1 << bits, np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, word, before, zeros in self.levels:
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = before[at >> 6] + np.bitwise_count(word[at >> 6] & mask)
            at = np.where((symbols >> shift) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol comes before each place."""
        return self._down(symbols, at) - self.start[symbols]


class FMIndex:
    """Backward search in a text of symbols from 1; the text ends with a symbol that comes once."""

    def __init__(self, text: np.ndarray):
        self.suffixes = suffix_array(text)
        self.tree = WaveletTree(text[self.suffixes - 1], int(text.max()).bit_length())
        counts = np.bincount(text, minlength=1 << self.tree.bits)
        self.below = np.concatenate(([0], np.cumsum(counts)))

    def matching(self, text: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(length, low, high): of the words of text up to each end, how many (most at best) come at least twice in the
        indexed text, and the interval of suffixes that begin with them."""
        c = text[ends]
        low, high = self.below[c], self.below[c + 1]
        length = (high - low > 1).astype(np.int64)
        live = np.flatnonzero(length)
        for k in range(1, most):
            if not len(live):
                break
            c = text[ends[live] - k]
            a = self.below[c] + self.tree.rank(c, low[live])
            b = self.below[c] + self.tree.rank(c, high[live])
            met = b - a > 1
            live = live[met]
            low[live], high[live], length[live] = a[met], b[met], k + 1
        return length, low, high


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The places of the suffixes in order, by ranks of doubled lengths; the last symbol comes once."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: n - width] = rank[width:] + 1 if width < n else 0
        key = rank * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        if rank[order[-1]] == n - 1:
            return order
        width *= 2


def _anchored(words: int, gram: int):
    """(doc_id, t, place, name, key) of each stretch; place holds its anchor's word and how far before it the first and
    the last of its passages start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            ids, t = rb.column("doc_id").to_numpy(), rb.column("t").to_numpy()
            for i, j, data, offsets in B.blocks(*B.utf8(rb.column("text"))):
                starts, ends, rows = B.words(data, offsets)
                n = len(starts)
                if n < words:
                    continue
                h = B.word_hashes(data, starts, ends)
                grams = np.zeros(n - gram + 1, np.uint64)
                for k in range(gram):
                    grams += h[k : k + len(grams)] * B._TURN[k]
                grams = B.mix(grams, 31)
                least = _least((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), words - gram + 1)
                at = np.flatnonzero(rows[: len(least)] == rows[words - 1 :])
                if not len(at):
                    continue
                anchor = (least[at] & _PLACE).astype(np.int64)
                new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1))))
                first, last, anchor = at[new], at[np.append(new[1:], len(at)) - 1], anchor[new]
                power, unpower = B._powers(n + 1)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[:n])])
                key = (sums[last + words] - sums[first]) * unpower[first]
                key = B.mix(key + B.mix(((anchor - first) * 64 + anchor - last).astype(np.uint64), 33), 32)
                row = rows[first]
                place = (anchor - np.searchsorted(rows, row)) * 4096 + (anchor - first) * 64 + anchor - last
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][row]), pa.array(t[i:j][row]), pa.array(place), pa.array(grams[anchor].view(np.int64)), pa.array(key.view(np.int64))], names=["doc_id", "t", "place", "name", "key"])

    return run


def _lists(rb: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """(row, text bytes, values of each list column) of the rows."""
    columns = [(rb.column(c).offsets.to_numpy(), rb.column(c).values.to_numpy(zero_copy_only=False)) for c in names]
    for r, text in enumerate(rb.column("text").to_pylist()):
        yield r, text.encode(), [v[o[r] : o[r + 1]] for o, v in columns]


def _stretches(words: int):
    """(name, key, low, hot, before, stretch) of the stretches that stay to be searched."""
    names = ["name", "key", "low", "hot", "before", "stretch"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in names]
        for rb in batches:
            ids = rb.column("doc_id").to_pylist()
            for r, raw, (place, name, key, hot) in _lists(rb, "places", "names", "keys", "hots"):
                said = raw.split()  # at ASCII white space
                anchor, before, after = place // 4096, place // 64 % 64, place % 64
                for store, x in zip(held, (name.tolist(), key.tolist(), [ids[r]] * len(name), hot.tolist(), before.tolist()), strict=False):
                    store += x
                held[-1] += [b" ".join(said[a:b]) for a, b in zip((anchor - before).tolist(), (anchor - after + words).tolist(), strict=True)]
                if len(held[0]) >= 8000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(held, kinds, strict=True)], names=names)
                    held = [[] for _ in names]
        if held[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(held, kinds, strict=True)], names=names)

    return run


def searched(stretches: list[bytes], low: np.ndarray, before: np.ndarray, words: int) -> np.ndarray:
    """Of each stretch the passages that come in a stretch of smaller id: bit d for that which starts d words before the
    anchor, which is before[i] words after the stretch's start."""
    data, offsets = np.frombuffer(b"".join(stretches), np.uint8), np.cumsum([0, *map(len, stretches)])
    starts, ends, rows = B.words(data, offsets)
    many = len(stretches)
    letters = data[~B._SPACE[data]]
    cut = np.cumsum(np.concatenate(([0], ends - starts))).astype(np.int32)
    symbols = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(cut.tobytes()), pa.py_buffer(letters.tobytes())]).dictionary_encode().indices.to_numpy()
    # one text: every stretch, then a symbol of its own
    text = np.empty(len(starts) + many, np.int64)
    at = np.arange(len(starts)) + rows
    text[at] = symbols + many + 1
    size = np.bincount(rows, minlength=many)
    stop = np.cumsum(size + 1) - 1
    text[stop] = np.arange(1, many + 1)
    of = np.repeat(np.arange(many), size + 1)
    index = FMIndex(text)
    begin = stop - size
    passages = np.maximum(size - words + 1, 0)
    stretch = np.repeat(np.arange(many), passages)
    start = np.arange(len(stretch)) - np.repeat(np.cumsum(passages) - passages, passages)
    length, a, b = index.matching(text, begin[stretch] + start + words - 1, words)
    whole = np.flatnonzero(length == words)
    out = np.zeros(many, np.int64)
    if len(whole):
        intervals, which = np.unique(a[whole] * (len(text) + 1) + b[whole], return_inverse=True)
        pairs = np.stack([intervals // (len(text) + 1), intervals % (len(text) + 1)], 1).ravel()  # apart from each other
        ids = np.append(low[of[index.suffixes]], np.iinfo(np.int64).max)
        least = np.minimum.reduceat(ids, pairs)[::2][which]
        again = whole[least < low[stretch[whole]]]
        np.bitwise_or.at(out, stretch[again], np.int64(1) << (before[stretch[again]] - start[again]))
    return out


def _by_shard(words: int):
    """(name, key, passages) of stretches sorted by name, a shard at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def done() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            found = searched(t.column("stretch").to_pylist(), t.column("low").to_numpy(), t.column("before").to_numpy(), words)
            some = np.flatnonzero(found)
            return pa.RecordBatch.from_arrays([pa.array(t.column(c).to_numpy()[some]) for c in ("name", "key")] + [pa.array(found[some])], names=["name", "key", "passages"])

        for rb in (whole.slice(k, _STEP_ROWS) for whole in batches for k in range(0, whole.num_rows, _STEP_ROWS)):
            if size >= SHARD_BYTES:  # a shard ends between two names
                names = rb.column("name").to_numpy()
                other = np.flatnonzero(names != held[-1].column("name")[-1].as_py())
                cut = int(other[0]) if len(other) else len(names)
                held.append(rb.slice(0, cut))
                if cut == len(names):
                    continue
                yield done()
                held, size, rb = [], 0, rb.slice(cut)
            held.append(rb)
            size += rb.nbytes
        if held:
            yield done()

    return run


def _hashed(words: int):
    """(name, key, low, d, one): the passages of stretches by their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, _STEP_ROWS):
                rb = whole.slice(k, _STEP_ROWS)
                data, offsets = B.utf8(rb.column("stretch").cast(pa.string()))
                starts, ends, rows = B.words(data, offsets)
                h = B.word_hashes(data, starts, ends)
                total = np.zeros(len(h) - words + 1, np.uint64)
                for w in range(words):
                    total += h[w : w + len(total)] * B._TURN[w]
                at = np.flatnonzero(rows[: len(total)] == rows[words - 1 :])
                row = rows[at]
                d = rb.column("before").to_numpy()[row] - (at - np.searchsorted(rows, row))
                name, key, low = (rb.column(c).to_numpy()[row] for c in ("name", "key", "low"))
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(key), pa.array(low), pa.array(d), pa.array(B.mix(total[at], 35).view(np.int64))], names=["name", "key", "low", "d", "one"])

    return run


def _kept(words: int):
    """(doc_id, n_words, n_removed, text) of the texts with the passages that go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, _STEP_ROWS):
                rb = whole.slice(k, _STEP_ROWS)
                counts, removed, texts = [], [], []
                for _, raw, (place, passages) in _lists(rb, "places", "passages"):
                    said = raw.split()
                    counts.append(len(said))
                    if len(place):
                        anchor, before, after = place // 4096, place // 64 % 64, place % 64
                        d = np.arange(words)
                        gone = np.where(passages[:, None] < 0, (d <= before[:, None]) & (d >= after[:, None]), (passages[:, None] >> d) & 1)
                        at = (anchor[:, None] - d)[gone.astype(bool)]
                        change = np.bincount(at, minlength=len(said) + 1) - np.bincount(at + words, minlength=len(said) + 1)
                        stays = np.cumsum(change)[:-1] == 0
                        said = list(compress(said, stays.tolist()))
                    removed.append(counts[-1] - len(said))
                    texts.append(b" ".join(said).decode())
                yield pa.RecordBatch.from_arrays([rb.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "n_words", "n_removed", "text"])

    return run


def _listed(df: DataFrame, *columns: str) -> DataFrame:
    rows = df.groupBy("doc_id", "t").agg(F.collect_list(F.struct(*columns)).alias("rows"))
    return rows.select(F.col("doc_id").alias("of_id"), F.col("t").alias("of_t"), *[F.col(f"rows.{c}").alias(c if c == "passages" else f"{c}s") for c in columns])


def without_earlier_passages(documents: DataFrame, words: int = 13, gram: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, text) of every row with an id: its words, how many go, and those that stay, joined by
    one space. Words are runs of bytes outside ASCII white space."""
    if not 0 < gram <= words <= 60:
        raise ValueError("0 < gram <= words <= 60")
    docs = documents_of(documents, id_col, text_col).withColumn("t", F.xxhash64("text"))
    n = shuffle_partitions(docs.sparkSession)
    stretches = written(docs.mapInArrow(_anchored(words, gram), "doc_id long, t long, place long, name long, key long"), "stretches")
    names = stretches.groupBy("name").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("name")
    names = written(names, "names")  # plain tables in joins: adaptive execution splits a hot name's stretches
    shared = written(stretches.join(names, "name", "left_semi"), "shared")
    cleared(stretches)
    kinds = shared.groupBy("name", "key").agg(F.min(F.struct("doc_id", "t", "place")).alias("rep"), F.max("doc_id").alias("high"))
    kinds = written(kinds.select("name", "key", F.col("rep.doc_id").alias("low"), "high", F.col("rep.t").alias("t"), F.col("rep.place").alias("place")), "kinds")
    several = kinds.groupBy("name").agg(F.count("*").alias("n"), F.min("low").alias("least"), F.max("low").alias("most")).where("n > 1 AND least < most")
    several = written(several.select("name", F.when(F.col("n") > HOT, 1).otherwise(0).cast("long").alias("hot")), "several")
    reps = _listed(kinds.join(several, "name").select(F.col("low").alias("doc_id"), "t", "place", "name", "key", "hot"), "place", "name", "key", "hot")
    held = docs.join(reps.hint("merge"), (F.col("doc_id") == F.col("of_id")) & (F.col("t") == F.col("of_t"))).select("doc_id", "text", "places", "names", "keys", "hots")
    # a repeated row brings its stretches twice: they are equal and of one id, so no matter
    held = written(held.mapInArrow(_stretches(words), "name long, key long, low long, hot long, before long, stretch binary"), "held")
    cold = held.where("hot = 0").repartition(n, "name").sortWithinPartitions("name").mapInArrow(_by_shard(words), "name long, key long, passages long")
    windows = held.where("hot = 1").mapInArrow(_hashed(words), "name long, key long, low long, d long, one long")
    first = written(windows.groupBy("name", "d", "one").agg(F.min("low").alias("least")), "first")
    hot = windows.join(first, ["name", "d", "one"]).where("least < low").select("name", "key", F.expr("shiftleft(1L, cast(d AS int))").alias("passages"))
    met = cold.unionByName(hot).groupBy("name", "key").agg(F.bit_or("passages").alias("passages"))
    marks = kinds.select("name", "key", "low", "high").join(met, ["name", "key"], "left").where("low < high OR passages IS NOT NULL")
    marks = written(marks.select("name", "key", "low", "passages"), "marks")
    gone = shared.join(marks, ["name", "key"]).where("doc_id > low OR passages IS NOT NULL")
    gone = gone.select("doc_id", "t", "place", F.when(F.col("doc_id") > F.col("low"), F.lit(-1).cast("long")).otherwise(F.col("passages")).alias("passages"))
    gone = written(_listed(gone, "place", "passages"), "gone")
    cleared(names, shared, kinds, several, held, first, marks)
    rows = docs.join(gone.hint("merge"), (F.col("doc_id") == F.col("of_id")) & (F.col("t") == F.col("of_t")), "left")
    none = F.array().cast("array<bigint>")
    rows = rows.select("doc_id", "text", *[F.coalesce(c, none).alias(c) for c in ("places", "passages")])
    return rows.mapInArrow(_kept(words), "doc_id long, n_words long, n_removed long, text string")
