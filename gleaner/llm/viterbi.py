"""SentencePiece encoding and decoding by a streaming Viterbi search over the pieces and scores of a model file.

The best path maximises the sum of piece scores; of equal paths into a boundary that with the longest last piece wins.
Spaces are as in SentencePiece (one is put before the text, and a piece's mark stands for a space), characters in no
piece become byte pieces, so that decoding gives the text back, to the byte.

Every text goes through one search (Stream). It keeps a window: a boundary is reached by pieces of at most `reach`
characters, so as soon as the paths into the last `reach` boundaries all run through one boundary, the ids up to it are
final, and what lies before it leaves memory; the window grows only while paths stay apart. Where paths are known to meet beforehand - no piece has a space behind
another character, or a line feed - the stream commits without looking, and a stretch between two such places that a
worker has met before (it keeps up to KEPT) is not searched again. Pieces are looked up by their characters.

A model made for byte-pair merges works as well, by its scores: the ids are then those of the best path, as the
library's unigram search gives for the same pieces and scores, and not those of the merges.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm._shared import documents_of

#: Stretches whose ids a worker keeps, and characters of the longest that it keeps: some 200 bytes each, 2 kB at most.
KEPT, LONGEST_KEPT = 300_000, 400
_STRETCH = re.compile(r" +[^ \n]*|[^ \n]+|\n")
_LOADED: dict[str, Pieces] = {}


class Stream:
    """Ids of a text that comes in parts. feed() returns the ids that are final, end() the rest; peak is the most
    characters that the window has held."""

    __slots__ = ("pieces", "text", "best", "back", "peak", "gone")

    def __init__(self, pieces: Pieces):
        self.pieces, self.text, self.best, self.back = pieces, "", [0.0], [(0, -1)]
        self.peak, self.gone = 0, False

    def feed(self, part: str) -> list[int]:
        reach, out = self.pieces.reach, []
        for k in range(0, len(part), reach):
            self._extend(part[k : k + reach])
            if len(self.text) >= 2 * reach:
                out += self._commit(self._meeting())
        return out

    def _extend(self, part: str) -> None:
        tails, scores, unknown = self.pieces.tails.get, self.pieces.scores, self.pieces.unknown
        text, best, back = self.text + part, self.best, self.back
        for e in range(len(self.text) + 1, len(text) + 1):
            start, top, found = e - 1, None, None
            k = tails(text[start])
            while k is not None:
                if k >= 0:
                    score = best[start] + scores[k]
                    if top is None or score >= top:
                        top, found = score, (start, k)
                if not start:
                    break
                start -= 1
                k = tails(text[start:e])
            best.append(best[e - 1] + unknown if top is None else top)
            back.append(found or (e - 1, -1))
        self.text = text
        self.peak = max(self.peak, len(text))

    def _meeting(self) -> int:
        """The last boundary that the paths into all boundaries still in reach run through."""
        alive = set(range(len(self.text) - self.pieces.reach + 1, len(self.text) + 1))
        while len(alive) > 1:
            last = max(alive)
            alive.remove(last)
            alive.add(self.back[last][0])
        return alive.pop()

    def _path(self, at: int) -> list[int]:
        """The ids of the best path to a boundary of the window."""
        path, text, back = [], self.text, self.back
        while at > 0:
            start, k = back[at]
            if k < 0:
                path += reversed(self.pieces.bytes_of(text[start:at]))
            else:
                path.append(k)
            at = start
        path.reverse()
        return path

    def _commit(self, at: int) -> list[int]:
        path = self._path(at)
        self.gone = True
        self.text, self.best = self.text[at:], [x - self.best[at] for x in self.best[at:]]
        self.back = [(0, -1), *((s - at, k) for s, k in self.back[at + 1 :])]
        return path

    def end(self) -> list[int]:
        return self._path(len(self.text))

    def begin(self, text: str) -> str:
        """Begins another text, and returns what of it is still to be fed: what it shares with the start of the window stays
        searched, if nothing of the text before has left the window."""
        same, now = 0, self.text
        if not self.gone:
            most = min(len(now), len(text))
            while same < most and now[same] == text[same]:
                same += 1
        self.text, self.gone = now[:same], False
        del self.best[same + 1 :], self.back[same + 1 :]
        self.best[0], self.back[0] = 0.0, (0, -1)
        return text[same:]


class Pieces:
    """The pieces of a model file by their text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        text = {i: sp.id_to_piece(i).replace("▁", " ") for i in plain}
        self.ids = {t: i for i, t in text.items()}
        self.scores = [sp.get_score(i) for i in range(n)]
        self.unknown = min(self.scores[i] for i in plain) - 10
        self.reach = max(map(len, self.ids))
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if len(self.bytes) < 256:
            raise ValueError("the model has no byte pieces: characters outside its pieces could not be decoded")
        if any(re.search(r"[^ ] |\n", t) for t in self.ids):
            raise ValueError("a piece holds a space behind another character, or a line feed")
        self.out = [b""] * n
        for i, t in text.items():
            self.out[i] = t.encode()
        for b, i in self.bytes.items():
            self.out[i] = bytes([b])
        # every end of a piece, with the piece that it is itself: what is no end can't be reached further back
        self.tails = {t[k:]: -1 for t in self.ids for k in range(1, len(t))} | self.ids
        self.kept: dict[str, bytes] = {}

    def bytes_of(self, ch: str) -> list[int]:
        return [self.bytes[b] for b in ch.encode()]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian int32."""
        if len(self.kept) > KEPT:
            self.kept.clear()
        cut = [_STRETCH.findall(" " + t) if t else [] for t in texts]
        found = self.search(set().union(*cut) - self.kept.keys())
        out = [b"".join([self.kept[s] if s in self.kept else found[s] for s in c]) for c in cut]
        self.kept.update((s, ids) for s, ids in found.items() if len(s) <= LONGEST_KEPT)
        return out

    def search(self, stretches: set[str]) -> dict[str, bytes]:
        """The ids of stretches. In order, so that a stream goes on from what each shares with the one before."""
        stream, out = Stream(self), {}
        for s in sorted(stretches):
            ids = stream.feed(stream.begin(s))
            out[s] = array("i", ids + stream.end()).tobytes()
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.out[k] for k in ids])[1:]


def pieces(path: str) -> Pieces:
    """Loaded once a worker."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def _encoded(path: str, ids: bool):
    names = ["doc_id", "n_ids", "ids_sha256", "decoded_sha256", "round_trip", *["ids"] * ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                rb = whole.slice(k, 500)
                texts = rb.column("text").to_pylist()
                raw = p.encode(texts)
                arrays = [np.frombuffer(r, "<i4") for r in raw]
                back = [p.decode(a.tolist()) for a in arrays]
                out = [
                    rb.column("doc_id"),
                    pa.array([len(a) for a in arrays], pa.int64()),
                    pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string()),
                    pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string()),
                    pa.array([b == t.encode() for b, t in zip(back, texts, strict=True)], pa.bool_()),
                ]
                if ids:
                    ends = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays))))
                yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def encode_documents(documents: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """(doc_id, n_ids, ids_sha256, decoded_sha256, round_trip and, if ids, ids) of every row with an id.

    A null or empty text has no ids. ids_sha256 is of the ids as little-endian int32, decoded_sha256 of the decoded text.
    """
    schema = "doc_id long, n_ids long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * ids
    return documents_of(documents, id_col, text_col).mapInArrow(_encoded(model, ids), schema)


def decode_ids(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for rb in batches:
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), pa.array([p.decode(x or []).decode() for x in rb.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
