"""Suffix-array dedup: removes every byte that a string of `length` bytes covers which starts anywhere else, too.

The difference-cover scheme, cut off at `length` bytes. A periodic cover of v residues samples some sqrt(v) of every v
positions (12 of 133, so 9 % of all bytes as rows); here the sample is a cover that the content sets: of the
`length - width + 1` windows of `width` bytes inside any string of `length` bytes, that with the least hash. It has the
property that the scheme rests on - two equal strings hold a sampled position at one and the same offset - with under
1 % of the positions.

1. Sample: the positions of the cover in every text, named by a hash of their window that is built by doubling.
2. Names met once end there: no string around them starts elsewhere. The others are named again, by triples: the windows
   at the start, in the middle and at the end of their context, the bytes of all strings of `length` that hold the
   sampled window. A triple spans all that a string can reach, so the recursion ends at this level; a triple met twice
   settles all its strings at once.
3. The contexts that are left are gathered by the name they share and their sampled suffixes sorted and ranked. The other
   suffixes are merged in by (rank of the bytes before the sampled place, rank of the sampled suffix), to `length` bytes,
   and neighbours compared: equal ranks are repeats. The strings of a name with more than HOT_CONTEXTS contexts are
   counted by a grouping of their hashes instead, which no single task holds.
4. Runs of repeated starts become byte spans of their texts.

Names across the cluster are hashes in place of ranks, so no level waits for a sort of the whole table; a hash that names
two windows alike only brings their contexts together, as step 3 compares bytes. Two hashes of 64 bits (window and triple,
window and string) decide in step 2 and for hot names, one (id and text) tells rows apart.

Cases: a null text is empty; texts shorter than `length` keep all; matches never cross texts; rows without an id are left
out; rows that share an id are separate texts, and two whole copies of a row count as two texts, each a copy of the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import _blocks as B
from gleaner.llm._shared import cleared, documents_of, shuffle_partitions, unique, written

_PLACE = np.uint64((1 << 31) - 1)
_BYTES = B.mix(np.arange(256, dtype=np.uint64), 21)
_LEAF_BYTES, _STEP_ROWS = 2 << 20, 1000
#: Contexts of one name beyond which they are not gathered in one task: their strings are counted by a grouping.
HOT_CONTEXTS = 20_000
#: Bytes a word has where texts are compared by words: 49 bits of its hash as ASCII.
WORD_BYTES = 7


def _doubled(data: np.ndarray, wanted: int) -> dict[int, np.ndarray]:
    """Hashes of the m bytes from each position, for the powers of two m that add up to wanted; where fewer remain the
    array ends."""
    h, m, out = _BYTES[data], 1, {}
    while True:
        if wanted & m:
            out[m] = h
        if 2 * m > wanted:
            return out
        h = B.mix(h[: max(0, len(h) - m)] * np.uint64(0xC2B2AE3D27D4EB4F) + h[m:]) if len(h) > m else h[:0]
        m *= 2


def _window(data: np.ndarray, width: int) -> np.ndarray:
    """Hashes of width bytes from each position, from those of powers of two."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    part = _doubled(data, width)
    total, at = np.zeros(n, np.uint64), 0
    for m in sorted(part, reverse=True):
        total = B.mix(total * np.uint64(0x9FB21C651E98DF25) + part[m][at : at + n])
        at += m
    return total


def _least(keys: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours, by minima from both ends of stretches of w."""
    n = len(keys)
    full = -(-n // w) * w
    padded = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    grid = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def _cover(length: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            keys = rb.column("doc_key").to_numpy(zero_copy_only=False)
            for i, j, data, offsets in B.blocks(*B.utf8(rb.column("text"))):
                if len(data) < length:
                    continue
                h = _window(data, width)
                ranked = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
                least = _least(ranked, length - width + 1)
                row = np.searchsorted(offsets, np.arange(len(least)), "right") - 1
                inside = np.arange(len(least)) + length <= offsets[row + 1]
                at = np.unique((least[inside] & _PLACE).astype(np.int64))
                if len(at):
                    row = np.searchsorted(offsets, at, "right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(keys[i:j][row]), pa.array(at - offsets[row]), pa.array(h[at].view(np.int64))], names=["doc_key", "p", "name"])

    return run


def _reach(p: np.ndarray, n: int, length: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the context of a sampled position in a text of n bytes."""
    return np.maximum(0, p - (length - width)), np.minimum(n, p + length)


def _rows(batches: Iterator[pa.RecordBatch], *lists: str) -> Iterator[tuple]:
    for rb in batches:
        data, offsets = B.utf8(rb.column("text"))
        columns = [rb.column(c) for c in lists]
        keys = rb.column("doc_key").to_pylist()
        for r in range(rb.num_rows):
            yield keys[r], data[offsets[r] : offsets[r + 1]], [np.asarray(c[r].values) for c in columns]


def _batch(schema: pa.Schema, columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if f.type != pa.binary() else [x for y in c for x in y], f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _contexts(length: int, width: int, whole: bool):
    """Of each sampled position (ps, names) of a text its context's key, or, if whole, its bytes."""
    fields = [("doc_key", pa.int64()), ("p", pa.int64()), ("name", pa.int64()), ("a", pa.int64()), ("b", pa.int64())]
    more = ("m", "hot") if whole else ()
    schema = pa.schema([*fields, *((c, pa.int64()) for c in more), ("context", pa.binary()) if whole else ("key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in schema]
        count = 0
        for key, data, (ps, names, *rest) in _rows(batches, "ps", "names", *(f"{c}s" for c in more)):
            a, b = _reach(ps, len(data), length, width)
            if whole:
                raw = data.tobytes()
                last: object = [raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            else:
                part = _doubled(data, 256)
                size = b - a  # at least length: hashes of 256 bytes from both ends and between cover it
                if (size > 256 * 3).any():
                    last = np.array([int.from_bytes(hashlib.blake2b(data[x:y], digest_size=8).digest(), "little", signed=True) for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
                else:
                    h = part[256]
                    last = B.mix(h[a] * np.uint64(3) + h[(a + b - 256) // 2] * np.uint64(5) + h[b - 256] * np.uint64(7) + B.mix((size * 4096 + ps - a).astype(np.uint64))).view(np.int64)
            for store, x in zip(held, (np.full(len(ps), key), ps, names, a, b, *rest, last), strict=True):
                store.append(x)
            count += len(ps)
            if count >= (8_000 if whole else 200_000):
                yield _batch(schema, held)
                held, count = [[] for _ in schema], 0
        if count:
            yield _batch(schema, held)

    return run


def _starts(name: np.ndarray, p: np.ndarray, a: np.ndarray, raw: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each start of a string inside the contexts raw: its context, its place there, and the hash of the string with
    its name and offset."""
    size = np.array([len(x) for x in raw], np.int64)
    starts = size - length + 1
    cut = np.concatenate(([0], np.cumsum(starts)))
    of = np.repeat(np.arange(len(raw), dtype=np.int32), starts)
    at = (np.arange(len(of)) - np.repeat(cut[:-1], starts)).astype(np.int32)
    one = np.empty(len(of), np.uint64)
    for i, j, data, offsets in B.blocks(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum(size)))):
        o, x = of[cut[i] : cut[j]], at[cut[i] : cut[j]]
        delta = (p[o] - a[o] - x).astype(np.uint64)
        one[cut[i] : cut[j]] = B.mix(_window(data, length)[offsets[o - i] + x] + B.mix(name[o].view(np.uint64) + delta * np.uint64(0xD1B54A32D192ED03)))
    return of, at, one


def _hashed(length: int):
    """The starts (doc_key, first, name, one, m) in the contexts of names that too many contexts share for one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, _STEP_ROWS):
                rb = whole.slice(k, _STEP_ROWS)
                key, p, name, a, m = (rb.column(c).to_numpy() for c in ("doc_key", "p", "name", "a", "m"))
                of, at, one = _starts(name, p, a, rb.column("context").to_pylist(), length)
                yield pa.RecordBatch.from_arrays([pa.array(key[of]), pa.array(a[of] + at), pa.array(name[of]), pa.array(one.view(np.int64)), pa.array(m[of])], names=["doc_key", "first", "name", "one", "m"])

    return run


def _sorted(rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lexicographic order of byte rows (zeros beyond size), and the bytes that neighbours in it share."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    keys = wide.view(">u8").astype(np.uint64)
    order = np.lexsort((size, *keys.T[::-1]))
    now, n = rows[order], size[order]
    differs = now[1:] != now[:-1]
    shared = np.where(differs.any(1), differs.argmax(1), rows.shape[1])
    return order, np.minimum(shared, np.minimum(n[1:], n[:-1]))


def _ranks(order: np.ndarray, shared: np.ndarray, depth: int) -> np.ndarray:
    """The rank of each row by its first depth bytes: neighbours that share as many have one rank."""
    out = np.empty(len(order), np.int64)
    out[order] = np.concatenate(([0], np.cumsum(shared < depth)))
    return out


def merged(p: np.ndarray, a: np.ndarray, m: np.ndarray, raw: list[bytes], length: int, width: int) -> np.ndarray:
    """again[i, d]: whether the string of length bytes that starts d bytes before the sampled place of context i comes
    again among the contexts (each met m times).

    The sampled suffixes are sorted to that length, and so are the bytes before them, read backwards. The other suffixes
    are merged in by (rank of their first d bytes, rank of the sampled suffix that follows): neighbours with equal ranks
    agree in length bytes. Everything is compared by its bytes; a hash that names two windows alike does no harm.
    """
    data = np.frombuffer(b"".join(raw), np.uint8)
    size = np.array([len(x) for x in raw], np.int64)
    back, before = length - width, p - a
    after = np.minimum(size - before, length)
    place = (np.cumsum(size) - size + before)[:, None]

    def bytes_at(at: np.ndarray, held: np.ndarray) -> np.ndarray:
        return np.where(np.arange(at.shape[1]) < held[:, None], data[np.clip(at, 0, len(data) - 1)], 0).astype(np.uint8)

    right = _sorted(bytes_at(place + np.arange(length), after), after)
    left = _sorted(bytes_at(place - 1 - np.arange(max(1, back)), before), before)
    again = np.zeros((len(raw), back + 1), bool)
    for d in range(back + 1):
        inside = np.flatnonzero((before >= d) & (after >= length - d))
        if len(inside):
            pair = _ranks(*left, d)[inside] * len(raw) + _ranks(*right, length - d)[inside]
            _, same = np.unique(pair, return_inverse=True)
            again[inside, d] = np.bincount(same, weights=m[inside])[same] >= 2
    return again


def _repeated(length: int, width: int):
    """Runs of starts (doc_key, first, last) whose string comes again among the contexts that share its name."""

    def solve(key, p, a, m, raw) -> pa.RecordBatch:
        again = merged(p, a, m, raw, length, width) & (m == 1)[:, None]  # contexts met twice are settled
        of, start = np.nonzero(again)
        start = p[of] - start
        rank = np.lexsort((start, of))
        of, start = of[rank], start[rank]
        first = np.concatenate(([True], (of[1:] != of[:-1]) | (start[1:] != start[:-1] + 1)))[: len(of)]
        last = np.concatenate((first[1:], [True]))[: len(of)]
        return pa.RecordBatch.from_arrays([pa.array(key[of[first]]), pa.array(start[first]), pa.array(start[last])], names=["doc_key", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def done(rbs: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(rbs).combine_chunks()
            return solve(*(t.column(c).to_numpy() for c in ("doc_key", "p", "a", "m")), t.column("context").to_pylist())

        for rb in (whole.slice(k, _STEP_ROWS) for whole in batches for k in range(0, whole.num_rows, _STEP_ROWS)):
            # sorted by name: what is held may end only between two names
            names = rb.column("name").to_numpy(zero_copy_only=False)
            if size >= _LEAF_BYTES:
                before = held[-1].column("name")[-1].as_py()
                cut = int(np.argmax(names != before)) if (names != before).any() else len(names)
                if cut:
                    held.append(rb.slice(0, cut))
                if cut < len(names):
                    yield done(held)
                    held, size, rb = [], 0, rb.slice(cut)
                else:
                    continue
            held.append(rb)
            size += rb.nbytes
        if held:
            yield done(held)

    return run


def spans(first: np.ndarray, last: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal byte runs covered by strings of length that start in the runs first..last."""
    return joined(zip(first.tolist(), (last + length).tolist(), strict=True))


def joined(runs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte runs in order, those that touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def keep(raw: bytes, cut: list[tuple[int, int]], characters: bool = False) -> bytes:
    """What is left; characters: a character that a span only cuts stays, so that the rest is UTF-8."""
    out, at = [], 0
    for a, b in cut:
        if characters:
            while a < b and raw[a] & 0xC0 == 0x80:
                a += 1
            while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                b -= 1
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def _removed(length: int):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, _STEP_ROWS):
                rb = whole.slice(k, _STEP_ROWS)
                out: list[list] = [[] for _ in names[1:]]
                for _, data, (first, last) in _rows([rb], "firsts", "lasts"):
                    cut, raw = spans(first, last, length), data.tobytes()
                    kept = keep(raw, cut)
                    text = keep(raw, cut, True).decode() if cut else raw.decode()
                    for store, x in zip(out, (len(raw), sum(b - a for a, b in cut), len(cut), hashlib.sha256(kept).hexdigest(), text), strict=True):
                        store.append(x)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([rb.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], names=names)

    return run


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text as WORD_BYTES ASCII bytes a word, from the word's hash: equal words, and only those, have equal bytes."""
    for rb in batches:
        keys = rb.column("doc_key")
        for i, j, data, offsets in B.blocks(*B.utf8(rb.column("text"))):
            starts, ends, rows = B.words(data, offsets)
            h = B.word_hashes(data, starts, ends)
            code = ((h[:, None] >> np.arange(0, 7 * WORD_BYTES, 7, dtype=np.uint64)) & np.uint64(127)).astype(np.uint8)
            cut = (np.searchsorted(rows, np.arange(j - i + 1)) * WORD_BYTES).astype(np.int32)
            text = pa.StringArray.from_buffers(j - i, pa.py_buffer(cut.tobytes()), pa.py_buffer(code.tobytes()))
            yield pa.RecordBatch.from_arrays([keys.slice(i, j - i), text], names=["doc_key", "text"])


def word_spans(data: np.ndarray, first: np.ndarray, last: np.ndarray, words: int) -> list[tuple[int, int]]:
    """Byte runs of the passages of that many words of a text that start in the runs first..last of its coded form."""
    starts, ends, _ = B.words(data, np.array([0, len(data)]))
    i, j = -(-first // WORD_BYTES), last // WORD_BYTES  # a start inside a word's code is none
    whole = i <= j
    return list(zip(starts[i[whole]].tolist(), ends[j[whole] + words - 1].tolist(), strict=True))


def _without(length: int, words: int):
    """What is left of each text without the repeats of length bytes and those of that many words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            keys, kept = [], []
            for key, data, (first, last, word_first, word_last) in _rows([rb], "firsts", "lasts", "word_firsts", "word_lasts"):
                cut = joined([*spans(first, last, length), *word_spans(data, word_first, word_last, words)])
                keys.append(key)
                kept.append(keep(data.tobytes(), cut, True).decode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(kept, pa.string())], names=["doc_key", "kept"])

    return run


def _listed(df: DataFrame, *columns: str) -> DataFrame:
    rows = df.groupBy("doc_key").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("rows"))
    return rows.select("doc_key", *[F.col(f"rows.{c}").alias(f"{c}s") for c in columns])


def _runs(docs: DataFrame, length: int, width: int) -> DataFrame:
    """(doc_key, firsts, lasts) of docs (doc_key, text): runs of starts of repeats."""
    if not 0 < width <= length or length < 256:
        raise ValueError("0 < width <= length and length >= 256")
    n = shuffle_partitions(docs.sparkSession)
    sampled = written(docs.where(F.octet_length("text") >= length).select("doc_key", "text").mapInArrow(_cover(length, width), "doc_key long, p long, name long"), "cover")
    names = written(sampled.groupBy("name").count().where("count > 1").select("name"), "names")  # a plain table: adaptive execution splits the places of a hot name
    shared = sampled.join(names, "name", "left_semi")
    held = written(docs.select("doc_key", "text").join(_listed(shared, "p", "name").hint("merge"), "doc_key"), "held")
    named = written(held.mapInArrow(_contexts(length, width, False), "doc_key long, p long, name long, a long, b long, key long"), "named")
    kinds = named.groupBy("name", "key").agg(F.count("*").alias("m"), F.min(F.struct("doc_key", "p", "a", "b")).alias("rep"))
    kinds = written(kinds, "kinds")
    settled = named.join(kinds.where("m > 1"), ["name", "key"], "left_semi").select("doc_key", F.col("a").alias("first"), (F.col("b") - length).alias("last"))
    unsettled = kinds.groupBy("name").agg(F.count("*").alias("contexts"), F.min("m").alias("least")).where("contexts > 1 AND least = 1")
    unsettled = written(unsettled, "unsettled")  # joined as a plain table, so that a hot name's contexts are split
    left = kinds.join(unsettled, "name").select("rep.doc_key", "rep.p", "name", "m", F.when(F.col("contexts") > HOT_CONTEXTS, 1).otherwise(0).cast("long").alias("hot"))
    whole = held.select("doc_key", "text").join(_listed(left, "p", "name", "m", "hot").hint("merge"), "doc_key")
    whole = whole.mapInArrow(_contexts(length, width, True), "doc_key long, p long, name long, a long, b long, m long, hot long, context binary")
    whole = written(whole, "contexts")
    again = whole.where("hot = 0").repartition(n, "name").sortWithinPartitions("name").mapInArrow(_repeated(length, width), "doc_key long, first long, last long")
    strings = whole.where("hot = 1").mapInArrow(_hashed(length), "doc_key long, first long, name long, one long, m long")
    twice = strings.groupBy("name", "one").agg(F.sum("m").alias("met")).where("met > 1")
    again = again.unionByName(strings.where("m = 1").join(twice, ["name", "one"], "left_semi").select("doc_key", "first", F.col("first").alias("last")))
    runs = written(_listed(settled.unionByName(again), "first", "last"), "runs")
    cleared(sampled, names, held, named, kinds, unsettled, whole)
    return runs


def remove_repeats(documents: DataFrame, length: int = 400, width: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, text) of every row of documents with an id.

    kept_sha256 is of the bytes that are left; text is what is left of the text, where a character that a cut only splits
    stays whole.
    """
    docs = documents_of(documents, id_col, text_col).withColumn("doc_key", F.xxhash64("doc_id", "text"))
    runs = _runs(docs.select("doc_key", "text"), length, width)
    none = F.array().cast("array<bigint>")
    rows = docs.join(runs.hint("merge"), "doc_key", "left").select("doc_key", "doc_id", "text", *[F.coalesce(c, none).alias(c) for c in ("firsts", "lasts")])
    return rows.mapInArrow(_removed(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")


def _replaced(documents: DataFrame, cut: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of documents with kept of cut (doc_key, kept) as their texts, where it has them."""
    row_key, cut_key, kept = unique("key"), unique("key"), unique("kept")
    key = F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    cut = cut.select(F.col("doc_key").alias(cut_key), F.col("kept").alias(kept))
    rows = documents.withColumn(row_key, F.when(F.col(f"`{id_col}`").isNotNull(), key)).join(cut.hint("merge"), F.col(row_key) == F.col(cut_key), "left")
    return rows.select(*[F.coalesce(F.col(kept), F.col(f"`{c}`")).alias(c) if c == text_col else F.col(f"`{c}`") for c in documents.columns])


def without_repeated_passages(documents: DataFrame, words: int = 51, length: int = 400, width: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of documents without the passages of that many words, or of length bytes, that come again.

    Words are runs of bytes outside ASCII white space; what white space lies between them does not matter. They are
    compared by the same scheme, over texts in which each word has WORD_BYTES bytes. Both kinds are found in the whole
    texts, so that no cut of one kind hides a repeat of the other.
    """
    docs = documents_of(documents, id_col, text_col).select(F.xxhash64("doc_id", "text").alias("doc_key"), "text")
    strings = _runs(docs, length, width)
    passages = _runs(docs.mapInArrow(_coded, "doc_key long, text string"), words * WORD_BYTES, words // 3 * WORD_BYTES)
    runs = strings.join(passages.select("doc_key", F.col("firsts").alias("word_firsts"), F.col("lasts").alias("word_lasts")), "doc_key", "full")
    none = F.array().cast("array<bigint>")
    runs = runs.select("doc_key", *[F.coalesce(c, none).alias(c) for c in ("firsts", "lasts", "word_firsts", "word_lasts")])
    cut = docs.join(runs.hint("merge"), "doc_key").mapInArrow(_without(length, words), "doc_key long, kept string").dropDuplicates(["doc_key"])
    return _replaced(documents, cut, id_col, text_col)
