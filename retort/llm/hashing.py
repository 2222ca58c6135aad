"""Vectorised word and shingle hashes of Arrow string columns, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SHINGLE = 5
#: Texts are taken together up to so many bytes; a longer text is taken alone.
CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_POSITION = _RANDOM.integers(0, 2**64, SHINGLE, dtype=np.uint64) | np.uint64(1)
_FEWER = _RANDOM.integers(0, 2**64, SHINGLE, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    out = []
    for b in (_BASE, pow(_BASE, -1, 2**64)):
        p = np.full(n, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def text_chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Pieces of a string column: (first row, bytes, row offsets into the bytes); a null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1)
        yield at, data[offsets[at] : offsets[upto]], offsets[at : upto + 1] - offsets[at]
        at = upto


def word_bounds(data: np.ndarray, offsets: np.ndarray, solid_bytes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in the bytes, and the index of the first word of each text (one more at the end).

    Words are runs of what is not white space, or of the bytes marked in ``solid_bytes``.
    """
    solid = ~_SPACE[data] if solid_bytes is None else solid_bytes[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, offsets)


class RangeHasher:
    """64-bit hashes of byte ranges, A-Z read as a-z if ``folded``."""

    def __init__(self, data: np.ndarray, folded: bool = True):
        power, self.inverse = _powers(max(CHUNK_BYTES, 1 << int(len(data)).bit_length()))
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[_LOWER[data] if folded else data] * power[: len(data)], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stops] - self.sums[starts]) * self.inverse[starts])


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, A-Z read as a-z."""
    return RangeHasher(data).hashes(starts, stops) if len(starts) else np.empty(0, np.uint64)


def shingle_hashes(words: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all five-word windows of the texts and the bounds of each text's own; a text of fewer words has one over all of them."""
    n = np.diff(firsts)
    counts = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(bounds[-1], dtype=np.uint64)
    if len(words) >= SHINGLE:
        length = len(words) - SHINGLE + 1
        windows = np.zeros(length, dtype=np.uint64)
        for k in range(SHINGLE):
            windows += words[k : k + length] * _POSITION[k]
        text_of = np.repeat(np.arange(len(n)), n)
        whole = text_of[:length] == text_of[SHINGLE - 1 :]
        out[np.repeat(n >= SHINGLE, counts)] = mixed(windows[whole])
    for i in np.flatnonzero((n > 0) & (n < SHINGLE)):
        few = words[firsts[i] : firsts[i + 1]]
        out[bounds[i]] = mixed((few * _POSITION[: len(few)]).sum(dtype=np.uint64, keepdims=True) + _FEWER[len(few) : len(few) + 1])[0]
    return out, bounds


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingle hashes of each text of a string column."""
    for at, data, offsets in text_chunks(column):
        starts, stops, firsts = word_bounds(data, offsets)
        hashes, bounds = shingle_hashes(word_hashes(data, starts, stops), firsts)
        for i in range(len(offsets) - 1):
            yield at + i, np.unique(hashes[bounds[i] : bounds[i + 1]])
