"""Vectorised passes over the UTF-8 bytes of an Arrow string column: words, word hashes, shingle hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PUNCTUATED = _SPACE.copy()
_PUNCTUATED[[b for b in range(128) if not chr(b).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TURN = [np.uint64((0xD6E8FEB86659FD93 * (2 * i + 1) + 2 * i) % (1 << 64) | 1) for i in range(64)]
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values (multiply and shift), so that sums and ranges of them spread evenly."""
    x = x + np.uint64(salt * 0x632BE59BD9B4E019 % (1 << 64))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, BLOCK_BYTES + 1)
        _POWERS[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, b, np.uint64)))) for b in (_BASE, _UNBASE)]
    return _POWERS[0], _POWERS[1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(data: np.ndarray, offsets: np.ndarray, most: int = BLOCK_BYTES, rows: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows, of most bytes and rows; a longer row is a block alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = min(i + rows, max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray, punctuated: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of each word: runs of bytes outside ASCII white space (and, if punctuated, ASCII marks)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~(_PUNCTUATED if punctuated else _SPACE)[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial from prefix sums, scrambled."""
    power, unpower = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * unpower[starts])


def shingle_hashes(hashes: np.ndarray, rows: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each run of w words that lies in one row."""
    n = len(hashes) - w + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for j in range(w):
        total += hashes[j : j + n] * _TURN[j]
    whole = rows[:n] == rows[w - 1 :]
    return mix(total[whole], w), rows[:n][whole]


def sequence_hash(hashes: np.ndarray) -> int:
    """The hash of a whole sequence of fewer words than a shingle has."""
    total = np.zeros(1, np.uint64)
    for j in range(len(hashes)):
        total += hashes[j : j + 1] * _TURN[j]
    return int(mix(total, 1000 + len(hashes))[0])


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, w: int) -> list[np.ndarray]:
    """Each row's sorted distinct shingle hashes (A-Z lowered); the whole sequence is one shingle where words are fewer."""
    data = lowered(data)
    starts, ends, rows = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    shingles, of = shingle_hashes(hashes, rows, w)
    n = len(offsets) - 1
    cut, first = np.searchsorted(of, np.arange(n + 1)), np.searchsorted(rows, np.arange(n + 1))
    out = []
    for i in range(n):
        if cut[i + 1] > cut[i]:
            out.append(np.unique(shingles[cut[i] : cut[i + 1]]))
        elif first[i + 1] > first[i]:
            out.append(np.array([sequence_hash(hashes[first[i] : first[i + 1]])], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
