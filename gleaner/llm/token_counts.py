"""Edit-aware token counts: a segment tree per document over leaves of a few pre-tokens, re-encoded only where edits touch.

A pre-token pattern cuts a text from left to right, and what follows a cut depends on nothing before it. So the tokens of
a text are the sum over its pre-tokens, and an edit changes none that end REACH characters or more before it (no match
looks further ahead), nor any after the first old cut behind the edit that the new text is cut at again. The tree keeps
characters and tokens of every subtree; an edit descends by characters to the leaf REACH before its start, cuts and counts
again from there to the first leaf whose start is a cut as before, and carries the changed sums up.

`token_trees` makes the trees as a table, a row a document, and `edited_trees` takes such a table and gives the next one: a
batch of edits starts from the sums that the batch before it left, written or not, and encodes nothing but its own regions.

A pre-token's tokens are kept by its text (up to KEPT of them in a worker), so each is encoded once, not once a mention.

Cases: a null or empty text has no tokens and one empty leaf; edits apply one after another, each to the text as the
ones before left it; bounds outside that text are moved to its ends, a null bound or text counts as 0 or empty; a long
pre-token is a leaf alone; rows without an id are left out, repeated rows are each counted. A tree is as long as its document: each is held by one task.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Pre-tokens of a leaf when a tree is built; leaves that an edit would make FULL times as long become more leaves.
LEAF, FULL = 4, 32
#: Characters of the rows that one Arrow batch of trees holds, if it isn't a single row.
BATCH = 1 << 22
REACH = 2
KEPT = 300_000
#: Fixed value: the published pre-token pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = regex.compile(PATTERN)
_LOADED: dict[str, Callable[[list[str]], int]] = {}


def counter(path: str) -> Callable[[list[str]], int]:
    """Number of tokens of a list of pre-tokens by the ranks file at path; loaded once a worker."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding(path.rsplit("/", 1)[-1], pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        class Kept(dict):
            def __missing__(self, word: str) -> int:
                if len(self) >= KEPT:
                    self.clear()
                n = len(encode(word))
                if len(word) <= 64:
                    self[word] = n
                return n

        kept = Kept()
        _LOADED[path] = lambda words: sum(map(kept.__getitem__, words))
    return _LOADED[path]


class CountedText:
    """A text as leaves under a binary tree of (characters, tokens)."""

    def __init__(self, text: str, count: Callable[[list[str]], int], size: int = LEAF):
        self.count, self.size, self.encoded = count, size, 0
        words = _CUT.findall(text)
        groups = [words[k : k + size] for k in range(0, len(words), size)] or [[]]
        self._build(["".join(g) for g in groups], [count(g) for g in groups])

    @classmethod
    def loaded(cls, text: str, chars: list[int], tokens: list[int], count: Callable[[list[str]], int], size: int = LEAF) -> CountedText:
        """The tree that `nodes` gave for this text; nothing is cut or counted."""
        t = cls.__new__(cls)
        t.count, t.size, t.encoded = count, size, 0
        t.tops = 1 << ((len(chars) - 1).bit_length() - 1)
        ends = np.cumsum(chars[t.tops :]).tolist()
        t.leaf = [text[a:b] for a, b in zip([0, *ends], ends)]
        rest = [0] * (2 * t.tops - len(chars))
        t.chars, t.tokens = [*chars, *rest], [*tokens, *rest]
        return t

    def nodes(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of the nodes: [1] is the whole text, [k] the sum of [2k] and [2k + 1], leaves are last."""
        end = self.tops + len(self.leaf)
        return self.chars[:end], self.tokens[:end]

    def _build(self, leaf: list[str], tokens: list[int]) -> None:
        self.leaf, self.tops = leaf, 1 << (len(leaf) - 1).bit_length()
        rest = [0] * (self.tops - len(leaf))
        self.chars, self.tokens = [0] * self.tops + [*map(len, leaf), *rest], [0] * self.tops + [*tokens, *rest]
        for k in range(self.tops - 1, 0, -1):
            self._sum(k)

    def _sum(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(self.leaf)

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf with character at (the last one that has any, at the end), and at's place in it."""
        k = 1
        while k < self.tops:
            k *= 2
            if at >= self.chars[k] and self.chars[k + 1]:
                at -= self.chars[k]
                k += 1
        return k - self.tops, at

    def edit(self, start: int, stop: int, new: str) -> None:
        """Puts new in place of the characters start..stop."""
        start = min(max(start, 0), self.chars[1])
        stop = min(max(stop, start), self.chars[1])
        back = min(REACH, start)
        low, a = self._find(start - back)
        a += back  # counted from the start of leaf low, maybe beyond it
        high, b = self._find(stop)
        head = "".join(self.leaf[low : high + 1])[:a]
        region, behind, words, at = head + new + self.leaf[high][b:], high, [], 0
        text = region
        while True:
            # words from the start of leaf low until the region's end is a cut; else the next leaf joins the region
            while behind < len(self.leaf) - 1 and len(text) < len(region) + REACH:
                behind += 1
                text += self.leaf[behind]
            last = behind == len(self.leaf) - 1
            while at < len(region):
                m = _CUT.match(text, at)
                if m.end() + REACH > len(text) and not last:
                    break  # more text may change this match
                words.append(m[0])
                at = m.end()
            if at == len(region):
                break
            if at > len(region):
                high += 1
                if high > behind:
                    behind, text = high, text + self.leaf[high]
                region += self.leaf[high]
            else:
                behind += 1
                text += self.leaf[behind]
        self.encoded += len(region)
        slots = high - low + 1
        step = max(1, -(-len(words) // slots))
        if step > FULL * self.size:
            self._grow(low, high, words)
            return
        dirty = set()
        for s in range(slots):
            own = words[s * step : (s + 1) * step]
            k = self.tops + low + s
            self.leaf[low + s] = "".join(own)
            self.chars[k], self.tokens[k] = len(self.leaf[low + s]), self.count(own)
            dirty.add(k // 2)
        while dirty := dirty - {0}:
            for k in dirty:
                self._sum(k)
            dirty = {k // 2 for k in dirty}

    def _grow(self, low: int, high: int, words: list[str]) -> None:
        """Leaves low to high become as many as their new pre-tokens need; the others keep their counts, sums are made anew."""
        groups = [words[k : k + self.size] for k in range(0, len(words), self.size)]
        tokens = self.tokens[self.tops : self.tops + len(self.leaf)]
        self._build(
            [*self.leaf[:low], *map("".join, groups), *self.leaf[high + 1 :]],
            [*tokens[:low], *map(self.count, groups), *tokens[high + 1 :]],
        )


_LISTS = pa.list_(pa.int32())
_EDITS = "array<struct<start:int,stop:int,new:string>>"
_TREE = "doc_id long, text string, chars array<int>, tokens array<int>"
_ARROW = [("doc_id", pa.int64()), ("text", pa.string()), ("chars", _LISTS), ("tokens", _LISTS)]
_EDITED = [*_ARROW, ("n_edits", pa.int64()), ("n_chars_encoded", pa.int64())]


def _mapped(make: Callable[[], Callable[..., tuple]], takes: tuple[str, ...], gives: list, carried: tuple[str, ...]):
    """A batch function that gives a row, its text second, for each row's `takes`; `carried` columns go along."""

    def batch(rows: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
        fields = [*gives, *zip(carried, types)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make()
        for rb in batches:
            types, held, n = [rb.schema.field(c).type for c in carried], [], 0
            for i in range(rb.num_rows):
                row = call(*(rb.column(c)[i] for c in takes))
                held.append((*row, *(rb.column(c)[i].as_py() for c in carried)))
                n += len(row[1])
                if n >= BATCH:
                    yield batch(held, types)
                    held, n = [], 0
            if held:
                yield batch(held, types)

    return run


def _build(path: str, size: int) -> Callable[..., tuple]:
    count = counter(path)

    def build(doc: pa.Scalar, text: pa.Scalar) -> tuple:
        return (doc.as_py(), text.as_py(), *CountedText(text.as_py(), count, size).nodes())

    return build


def _edit(path: str, size: int) -> Callable[..., tuple]:
    count = counter(path)

    def edit(doc: pa.Scalar, text: pa.Scalar, chars: pa.Scalar, tokens: pa.Scalar, edits: pa.Scalar) -> tuple:
        t = CountedText.loaded(text.as_py(), chars.values.to_numpy().tolist(), tokens.values.to_numpy().tolist(), count, size)
        edits = edits.as_py() or []
        for e in edits:
            if e is not None:
                t.edit(e["start"] or 0, e["stop"] or 0, e["new"] or "")
        return (doc.as_py(), t.text(), *t.nodes(), len(edits), t.encoded)

    return edit


def _with(schema: str, rows: DataFrame, carried: tuple[str, ...]) -> StructType:
    return StructType([*StructType.fromDDL(schema), *rows.select(*carried).schema])


def token_trees(documents: DataFrame, vocabulary: str, size: int = LEAF, id_col: str = "doc_id", text_col: str = "text", carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, chars, tokens) and the carried columns of each row with an id: its segment tree, arrays of the nodes.

    chars[1] and tokens[1] are those of the whole text, node k holds the sum of nodes 2k and 2k + 1, and the leaves, the last
    nodes, are of `size` pre-tokens each. Carried columns are named otherwise than these four.
    """
    own = (F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = documents.select(*own, *carried).where("doc_id IS NOT NULL")
    return rows.mapInArrow(_mapped(partial(_build, vocabulary, size), ("doc_id", "text"), _ARROW, carried), _with(_TREE, rows, carried))


def edited_trees(trees: DataFrame, vocabulary: str, edits: Column, size: int = LEAF, carried: tuple[str, ...] = ()) -> DataFrame:
    """The trees after their edits, with n_edits, n_chars_encoded (what the edits had encoded) and the carried columns.

    trees: of token_trees or of this function, as they are or written and read again, joined with whatever `edits` is made of:
    array<struct<start: int, stop: int, new: string>> in characters. Null edits change nothing.
    """
    rows = trees.select("doc_id", "text", "chars", "tokens", edits.cast(_EDITS).alias("edits"), *carried)
    takes, schema = ("doc_id", "text", "chars", "tokens", "edits"), f"{_TREE}, n_edits long, n_chars_encoded long"
    return rows.mapInArrow(_mapped(partial(_edit, vocabulary, size), takes, _EDITED, carried), _with(schema, rows, carried))


def count_tokens(documents: DataFrame, vocabulary: str, edits: Column | None = None, size: int = LEAF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_leaves, n_edits, n_tokens_edited, n_chars_edited, n_chars_encoded) of each row with an id.

    The documents' trees, then the same after the edits (as in edited_trees, made of the documents' columns).
    """
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (F.lit(None) if edits is None else edits).cast(_EDITS).alias("edits"))
    nodes = F.size("chars")
    # a tree of n leaves has as many inner places as the next power of two, and n more
    leaves = nodes - F.pow(2, F.length(F.bin((nodes - 1).cast("long"))) - 1).cast("int")
    before = token_trees(rows, vocabulary, size, carried=("edits",)).withColumns({"n_tokens": F.get("tokens", F.lit(1)).cast("long"), "n_leaves": leaves.cast("long")})
    after = edited_trees(before, vocabulary, F.col("edits"), size, ("n_tokens", "n_leaves"))
    return after.select("doc_id", "n_tokens", "n_leaves", "n_edits", F.get("tokens", F.lit(1)).cast("long").alias("n_tokens_edited"), F.get("chars", F.lit(1)).cast("long").alias("n_chars_edited"), "n_chars_encoded")
