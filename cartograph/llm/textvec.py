"""Whole-batch tokenising over Arrow string buffers with numpy.

A batch of texts is one byte buffer with row offsets. Word bounds come from a byte
table, words are hashed all at once (polynomial prefix sums modulo 2**64, then mixed),
and nothing per word is built in Python. Rows are handled in slices of bounded bytes, so
memory follows the slice and not the batch; a longer single text makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once.
SLICE_BYTES = 500_000
#: Words hashed at once.
HASH_WORDS = 200_000

SPACES = np.zeros(256, bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True
#: White space and ASCII punctuation.
SPACES_PUNCT = SPACES.copy()
SPACES_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64


@dataclass
class Words:
    """Words of a slice: byte bounds in ``data``, row of each word, row bounds in words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    row_words: np.ndarray  # words before each row; len rows + 1
    row_bytes: np.ndarray  # byte bounds of rows; len rows + 1

    def hashes(self) -> np.ndarray:
        return word_hashes(self.data, self.start, self.end)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), new array."""
    h = h ^ (h >> _U(33))
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        for k, b in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), np.uint64)
    for i in range(0, len(start), HASH_WORDS):
        s, e = start[i : i + HASH_WORDS], end[i : i + HASH_WORDS]
        lo, hi = int(s[0]), int(e[-1])
        up, down = _power(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + _U(1)) * up[: hi - lo], out=sums[1:])
        out[i : i + HASH_WORDS] = (sums[e - lo] - sums[s - lo]) * down[s - lo] + (e - s).astype(np.uint64) * _U(0xD6E8FEB86659FD93)
    return mix(out)


def _array(col) -> pa.Array:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return pc.fill_null(col, "") if col.null_count else col


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, row bounds in them) of slices of a batch."""
    arr = _array(batch.column(batch.schema.get_field_index(text)))
    n = len(arr)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    bufs = arr.buffers()
    off = np.frombuffer(bufs[1], kind)[arr.offset : arr.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def split_words(data: np.ndarray, bounds: np.ndarray, gaps: np.ndarray = SPACES, lower: bool = True) -> Words:
    """Words of a slice; ``gaps`` says which bytes separate them; A-Z are lowered if asked."""
    data = _LOWER[data] if lower else data
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~gaps[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    start = np.flatnonzero(inside & (~before | cut))
    end = np.flatnonzero(before & (~inside | cut))
    row_words = np.searchsorted(start, bounds)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(row_words))
    return Words(data, start, end, row, row_words, bounds)


def row_sums(values: np.ndarray, row_words: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (per word; first axis) by row."""
    sums = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=sums[1:])
    return sums[row_words[1:]] - sums[row_words[:-1]]
