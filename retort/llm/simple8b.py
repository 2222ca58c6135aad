"""Simple-8b word-aligned coding of ids, vectorised over blocks.

A 64-bit word holds a selector in its top four bits and, below, as many ids as fit at the selector's width, the first in the
lowest bits. Selector 15 is an escape: the next word is one id in full. Ids are coded in blocks of ``BLOCK``; every block
starts at a word boundary, and its last word may be padded, so that blocks decode alone and in parallel.
"""

from __future__ import annotations

import numpy as np

BLOCK = 512
#: Ids in a word and bits of an id, by selector; selector 0 is not used and 15 is the escape.
COUNTS = np.array([0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1], dtype=np.int64)
WIDTHS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 64], dtype=np.int64)
ESCAPE = 15
_PAD = 60


def _bit_lengths(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs, at least 1; 64 stands for more than 60."""
    bits = np.maximum((ids.astype(np.float64).view(np.int64) >> 52) - 1022, 1).astype(np.uint8)  # the exponent
    bits[bits >= 60] = 60
    bits[ids >> np.uint64(60) > 0] = 64
    return bits


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the ids and the word offset of each block, with one more at the end."""
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    if not n:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    rows = np.zeros((blocks, BLOCK + _PAD), dtype=np.uint64)
    flat = np.zeros(blocks * BLOCK, dtype=np.uint64)
    flat[:n] = ids
    rows[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    bits = np.zeros((blocks, BLOCK + 2 * _PAD), dtype=np.uint8)
    bits[:, :BLOCK] = _bit_lengths(flat).reshape(blocks, BLOCK)
    if n < blocks * BLOCK:
        bits[-1, n - (blocks - 1) * BLOCK : BLOCK] = 0
    choice = np.full((blocks, BLOCK), ESCAPE, dtype=np.uint8)
    most = bits[:, : BLOCK + _PAD].copy()  # greatest width among the next ``have`` ids
    by_count, have = {1: most}, 1
    for selector in range(ESCAPE - 1, 0, -1):
        count = int(COUNTS[selector])
        while have < count:
            step = next(c for c in sorted(by_count, reverse=True) if have + c <= count)
            grown = by_count[have].copy()
            np.maximum(grown[:, :-have], by_count[step][:, have:], out=grown[:, :-have])
            have += step
            by_count[have] = grown
        choice[by_count[count][:, :BLOCK] <= WIDTHS[selector]] = selector
    lengths = np.full(blocks, BLOCK, dtype=np.int64)
    lengths[-1] = n - (blocks - 1) * BLOCK
    at, every = np.zeros(blocks, dtype=np.int64), np.arange(blocks)
    columns, places = [], []
    while True:
        going = at < lengths
        if not going.any():
            break
        here = np.where(going, at, 0)
        selectors = np.where(going, choice[every, here], 0)
        columns.append(selectors)
        places.append(here)
        at = at + COUNTS[selectors]
    selectors, places = np.array(columns).T, np.array(places).T  # a row a block
    used = selectors > 0
    block_of = np.broadcast_to(every[:, None], selectors.shape)[used]
    selector_of = selectors[used]
    every_row, spots = rows.ravel(), block_of * rows.shape[1] + places[used]
    sizes = 1 + (selector_of == ESCAPE)
    word_at = np.concatenate([[0], np.cumsum(sizes)])
    words = np.zeros(word_at[-1], dtype=np.uint64)
    for selector in np.unique(selector_of):
        mine = np.flatnonzero(selector_of == selector)
        spot = spots[mine]
        if selector == ESCAPE:
            words[word_at[mine]] = np.uint64(ESCAPE) << np.uint64(60)
            words[word_at[mine] + 1] = every_row[spot]
            continue
        word = np.full(len(mine), np.uint64(selector) << np.uint64(60), dtype=np.uint64)
        for j in range(COUNTS[selector]):
            word |= every_row[spot + j] << np.uint64(j * WIDTHS[selector])
        words[word_at[mine]] = word
    per_block = np.bincount(block_of, weights=sizes, minlength=blocks).astype(np.int64)
    return words, np.concatenate([[0], np.cumsum(per_block)])


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of whole blocks from their words and the word offset of each block, with one more at the end."""
    if not n:
        return np.empty(0, np.uint64)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    heads = np.ones(len(words), dtype=bool)
    for at in np.flatnonzero(selectors == ESCAPE):  # rare: only ids of more than 60 bits
        if heads[at]:
            heads[at + 1] = False
    where = np.flatnonzero(heads)
    selectors = selectors[where]
    counts = COUNTS[selectors]
    ends = np.cumsum(counts)
    starts = ends - counts
    out = np.zeros(ends[-1], dtype=np.uint64)
    for selector in np.unique(selectors):
        mine = selectors == selector
        if selector == ESCAPE:
            out[starts[mine]] = words[where[mine] + 1]
            continue
        word, first, width = words[where[mine]], starts[mine], int(WIDTHS[selector])
        mask = np.uint64((1 << width) - 1)
        for j in range(COUNTS[selector]):
            out[first + j] = (word >> np.uint64(j * width)) & mask
    # drop what pads the last word of each block
    first_of_block = np.concatenate([starts, ends[-1:]])[np.searchsorted(where, offsets[:-1])]
    lengths = np.full(len(offsets) - 1, BLOCK, dtype=np.int64)
    lengths[-1] = n - BLOCK * (len(lengths) - 1)
    if np.array_equal(first_of_block, np.arange(len(lengths)) * BLOCK) and ends[-1] == n:
        return out
    keep = np.repeat(first_of_block - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(n)
    return out[keep]
