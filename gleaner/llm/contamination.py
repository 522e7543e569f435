"""Benchmark decontamination: short test items inside long documents, found by MinHash sketches sized by the item.

An item of q distinct word shingles is contained if a document has at least c * q of them. Items are put into partitions
by size; an item's sketch is its k = q - ceil(c * q) + 1 least shingle hashes. A document that contains the item misses
at most k - 1 of its shingles, so it holds one of the sketch: the search loses nothing, however long the document is,
where a sketch of the document's own minima would hold none of the item's. Documents with too few shingles for a
partition's smallest item pass it by. Each hit is verified by the exact shingles, word for word.

The items are the stated query set: they are taken in blocks of at most BLOCK_BYTES of text, each block is sent to the
tasks whole and run against all documents.

Words are runs of characters other than ASCII white space, marks and control characters, in lower case. Cases: null and
empty texts contain nothing, an item without words is in no document, an item of fewer words than a shingle is looked
for as one run of its words; rows without an id are left out; repeated rows are each judged.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import _blocks as B
from gleaner.llm._shared import documents_of, rows_by_id

BLOCK_BYTES = 16 << 20
_OUT = "doc_id long, item_id long, n_shingles long, n_shared long"


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return B.utf8(pc.utf8_lower(column))


def _runs(raw: bytes, starts: list[int], ends: list[int], w: int) -> set[bytes]:
    own = [raw[a:b] for a, b in zip(starts, ends, strict=True)]
    return {b" ".join(own[i : i + w]) for i in range(len(own) - w + 1)}


class _Items:
    """A block of items: their exact shingles, and the sketches as sorted (hash, item) by shingle width and size class."""

    def __init__(self, items: list[tuple[int, str]], words: int, num: int, den: int):
        self.exact: list[tuple[int, int, set[bytes], int]] = []  # item_id, width, shingles, least number to contain
        sketches: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        self.least: dict[tuple[int, int], int] = {}
        data, offsets = _tokens(pa.array([t for _, t in items], pa.string()))
        starts, ends, rows = B.words(data, offsets, punctuated=True)
        hashes, raw = B.word_hashes(data, starts, ends), data.tobytes()
        for i, (item, _) in enumerate(items):
            a, b = np.searchsorted(rows, [i, i + 1])
            w = min(words, int(b - a))
            if not w:
                continue
            shingles = np.unique(B.shingle_hashes(hashes[a:b], rows[a:b], w)[0])
            q = len(shingles)
            least = -(-num * q // den)
            at = (w, q.bit_length())
            self.least[at] = min(self.least.get(at, least), least)
            sketches[at] += [(h, len(self.exact)) for h in shingles[: q - least + 1].tolist()]
            self.exact.append((item, w, _runs(raw, starts[a:b].tolist(), ends[a:b].tolist(), w), least))
        self.sketches = {at: (np.array([h for h, _ in sorted(s)], np.uint64), np.array([i for _, i in sorted(s)])) for at, s in sketches.items()}


def _search(shared, words: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _Items(shared.value, words, num, den)
        widths = sorted({w for w, _ in items.sketches})
        for rb in batches:
            ids = rb.column("doc_id").to_pylist()
            out: list[tuple[int, int, int, int]] = []
            for i, j, data, offsets in B.blocks(*_tokens(rb.column("text"))):
                starts, ends, rows = B.words(data, offsets, punctuated=True)
                hashes = B.word_hashes(data, starts, ends)
                hits: list[np.ndarray] = []
                for w in widths:
                    shingles, of = B.shingle_hashes(hashes, rows, w)
                    held = np.bincount(of, minlength=j - i)
                    for (width, size), (sketch, item) in items.sketches.items():
                        if width != w:
                            continue
                        at = np.searchsorted(sketch, shingles)
                        at[at == len(sketch)] = 0
                        met = np.flatnonzero((sketch[at] == shingles) & (held[of] >= items.least[width, size]))
                        for m, first in zip(met.tolist(), at[met].tolist(), strict=True):
                            while first < len(sketch) and sketch[first] == shingles[m]:
                                hits.append(np.array([of[m], item[first]]))
                                first += 1
                if not hits:
                    continue
                raw, known = data.tobytes(), {}
                for row, k in np.unique(np.stack(hits), axis=0).tolist():
                    item_id, w, exact, least = items.exact[k]
                    if (row, w) not in known:
                        a, b = np.searchsorted(rows, [row, row + 1])
                        known[row, w] = _runs(raw, starts[a:b].tolist(), ends[a:b].tolist(), w)
                    both = len(exact & known[row, w])
                    if both >= least:
                        out.append((ids[i + row], item_id, len(exact), both))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(4)], names=["doc_id", "item_id", "n_shingles", "n_shared"])

    return run


def contained_items(documents: DataFrame, items: DataFrame, words: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment): each document that holds at least num/den of an item."""
    spark = documents.sparkSession
    docs = documents_of(documents, id_col, text_col)
    queries = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    size = queries.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    many = max(1, -(-int(size) // (BLOCK_BYTES // 2)))  # blocks by hash: half full on average
    found = []
    for k in range(many):
        block = [(r[0], r[1]) for r in queries.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(many)) == k).collect()]
        found.append(docs.mapInArrow(_search(spark.sparkContext.broadcast(block), words, num, den), _OUT))
    pairs = reduce(DataFrame.unionByName, found)
    return pairs.withColumn("containment", F.round(F.col("n_shared") / F.col("n_shingles"), 6))


def decontaminated(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """The rows of documents that hold no item; rows without an id stay."""
    bad = contained_items(documents, items, id_col=id_col, **settings).select("doc_id").distinct()
    return rows_by_id(documents, id_col, bad, "left_anti")
