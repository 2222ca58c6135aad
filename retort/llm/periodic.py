"""Periodic runs of words by recursive frequency splitting.

A run of period q and of ``LEAST_PERIODS`` periods or more holds each of its words ``LEAST_PERIODS`` times at least. So a word
that occurs less often within a segment is in none of its runs and splits it; the parts are counted again, until no word splits a
segment any more (at most as many rounds as a segment has different words, and only segments that were split are counted again).

Surviving segments are scanned by lags. For lags from 2^k to 2^(k+1) - 1, windows of 2^(k+1) words get names, by pairs of
the names of half as wide windows, and each place the lag to the next window of its name. In a run of period q all lags are q
(a smaller one would be a smaller period of the whole run), and a longest stretch of places with lag q is a run that no
neighbouring word extends. So every run is found once, with its smallest period, in a sort of the open places for each k.

Defined cases: a null or empty text has no run and an empty collapsed text; a text of one word of any length is a text of
one word; repeated rows each get their own result; an empty table gives an empty result; names of further columns do not matter, as
the given row travels in a column of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.llm.hashing import RangeHasher, text_chunks, word_bounds

LEAST_PERIODS, LEAST_LENGTH = 4, 6
#: A batch is worked on in pieces of at most so many rows.
PIECE_ROWS = 2000


def surviving(words: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Places of the words that no rare word of their segment splits off; ``words`` are small numbers, ``texts`` the text of each."""
    at, segment, done = np.arange(len(words)), texts.astype(np.int64), []
    while len(at):
        _, which, counts = np.unique(segment * (int(words.max()) + 1) + words[at], return_inverse=True, return_counts=True)
        frequent = counts[which] >= LEAST_PERIODS
        split = np.zeros(int(segment.max()) + 1, dtype=bool)
        split[segment[~frequent]] = True
        again = split[segment]
        done.append(at[~again])
        at, segment = at[again & frequent], segment[again & frequent]
        if len(at):
            segment = np.cumsum(np.concatenate([[0], (np.diff(at) != 1) | (np.diff(segment) != 0)]))
            long_enough = np.bincount(segment)[segment] >= LEAST_LENGTH
            at, segment = at[long_enough], segment[long_enough]
    return np.sort(np.concatenate(done)) if done else at


def scanned(words: np.ndarray, texts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Runs in the surviving places ``at`` as rows of (first place, length, period)."""
    found = [np.empty((0, 3), dtype=np.int64)]
    if len(at) < LEAST_LENGTH:
        return found[0]
    segment = np.cumsum(np.concatenate([[0], (np.diff(at) != 1) | (np.diff(texts[at]) != 0)]))
    longest = int(np.bincount(segment).max())
    # names of windows by place among ``at``; -1 where a window is alone or does not fit. Names hold the segment, so windows never leave it.
    name = np.unique(segment * (int(words.max()) + 1) + words[at], return_inverse=True)[1].astype(np.int64)
    least = 1
    while least * LEAST_PERIODS <= longest:
        right = np.full(len(at), -1, dtype=np.int64)
        right[:-least] = np.where(segment[:-least] == segment[least:], name[least:], -1)
        open_places = np.flatnonzero((name >= 0) & (right >= 0))
        if not len(open_places):
            break
        key = name[open_places] * (int(name.max()) + 1) + right[open_places]
        order = np.argsort(key, kind="stable")
        key, place = key[order], open_places[order]
        same = key[1:] == key[:-1]
        lag = place[1:] - place[:-1]
        good = same & (lag >= least) & (lag < 2 * least)
        starts, lags = place[:-1][good], lag[good]
        by_place = np.argsort(starts)
        starts, lags = starts[by_place], lags[by_place]
        if len(starts):
            begins = np.concatenate([[True], (np.diff(starts) != 1) | (np.diff(lags) != 0)])
            first = np.flatnonzero(begins)
            many = np.diff(np.concatenate([first, [len(starts)]]))
            period = lags[first]
            length = many - 1 + 2 * least + period
            whole = length >= np.maximum(LEAST_LENGTH, LEAST_PERIODS * period)
            found.append(np.stack([at[starts[first]], length, period], axis=1)[whole])
        new = np.cumsum(np.concatenate([[0], ~same]))
        shared = np.bincount(new)[new] > 1
        name = np.full(len(at), -1, dtype=np.int64)
        name[place[shared]] = new[shared]
        least *= 2
    return np.concatenate(found)


def runs_of_texts(column: pa.Array) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """For each text: its runs (start, length, period) by start and period, and the bytes of its words that stay, joined by one space."""
    for _, data, offsets in text_chunks(column):
        starts, stops, firsts = word_bounds(data, offsets)
        runs = np.empty((0, 3), dtype=np.int64)
        if len(starts) >= LEAST_LENGTH:
            words = np.unique(RangeHasher(data, folded=False).hashes(starts, stops), return_inverse=True)[1]
            texts = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
            runs = scanned(words, texts, surviving(words, texts))
        runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
        covered = np.zeros(len(starts) + 1, dtype=np.int64)
        np.add.at(covered, runs[:, 0] + runs[:, 2], 1)
        np.add.at(covered, runs[:, 0] + runs[:, 1], -1)
        kept = np.cumsum(covered)[:-1] == 0
        bounds = np.searchsorted(runs[:, 0], firsts)
        raw = data.tobytes()
        for i in range(len(offsets) - 1):
            parts = raw[offsets[i] : offsets[i + 1]].split()
            own = runs[bounds[i] : bounds[i + 1]]
            if len(own):
                parts = compress(parts, kept[firsts[i] : firsts[i + 1]].tolist())
                own = own - [firsts[i], 0, 0]
            yield [tuple(r) for r in own.tolist()], b" ".join(parts)


def _with_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE_ROWS):
            part = batch.slice(at, PIECE_ROWS)
            found, texts = zip(*runs_of_texts(part.column("text")), strict=True)
            each = np.array([r for runs in found for r in runs], dtype=np.int64).reshape(-1, 3)
            values = pa.StructArray.from_arrays([pa.array(c) for c in each.T], fields=list(run))
            ends = np.concatenate([[0], np.cumsum([len(runs) for runs in found])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), pa.ListArray.from_arrays(pa.array(ends), values), pa.array(texts, pa.binary()).cast(pa.string())], ["row", "runs", "collapsed"]
            )


def with_runs(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """For each row of ``docs``: ``row`` with its columns ``keep``, else all; ``runs``, by start and period; and ``collapsed``, the text
    without the words that a run holds after its first period."""
    given = docs.select(F.struct(*(docs.columns if keep is None else keep)).alias("row"), "text")
    row = given.schema["row"].dataType.simpleString()
    return given.mapInArrow(_with_runs, f"row {row}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
