"""Variable-capacity best-fit packing of documents into training sequences.

Pieces of documents go into bins of several permitted lengths. A document longer than the longest is cut into full pieces
and a rest. Pieces are dealt to shards by hash, so that a shard's share of every length is like the whole's, and each shard
is packed alone; the number of shards follows the number of pieces, so that a shard has a bounded size on average and no key
can make it larger. Within a shard pieces come by descending length, equal lengths at once. A piece goes to the open bin that
it leaves least room in. If none has room, the permitted length with the least cost for it is opened: the room that would stay
empty after the remaining pieces have filled it as full as they can, for each unit of length, and a fixed overhead a bin. In
the end every bin shrinks to the least permitted length that holds its contents.

Defined cases: a null text and a text without words have length 0 and no piece, and are given with a null bin; a null id is
packed like any other; rows that repeat an id are pieces of their own, numbered apart; names of further columns do not matter; an
empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retort.llm.common import checkpointed, n_words, written

#: Permitted sequence lengths, in words.
LENGTHS = (256, 512, 1024, 2048)
#: Pieces in a shard, on average.
SHARD_PIECES = 20_000
#: Cost of a bin of length n: n + OVERHEAD + QUADRATIC * n * n (attention), for each word that it holds.
OVERHEAD, QUADRATIC = 8.0, 1 / 16384


def _opened(size: int, lengths: Sequence[int], left: np.ndarray) -> int:
    """The permitted length with the least cost a word for a new bin that starts with ``size``; ``left`` counts the pieces to come by length."""
    best, least = lengths[-1], np.inf
    present = np.flatnonzero(left)
    for capacity in lengths:
        if capacity < size:
            continue
        room, upto = capacity - size, len(present)
        while room > 0:  # what could follow: the longest pieces that fit, as often as there are and fit, then shorter ones
            upto = int(np.searchsorted(present[:upto], room, side="right"))
            if not upto:
                break
            upto -= 1
            longest = int(present[upto])
            room -= longest * min(room // longest, int(left[longest]))
        cost = (capacity + OVERHEAD + QUADRATIC * capacity * capacity) / (capacity - room)
        if cost <= least:
            best, least = capacity, cost
    return best


def pack(sizes: np.ndarray, lengths: Sequence[int] = LENGTHS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset in it and final length of the bin, for each piece; every size is at least 1 and at most the longest length."""
    lengths = sorted(lengths)
    longest = lengths[-1]
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    left = np.bincount(sizes, minlength=longest + 1) if len(sizes) else np.zeros(longest + 1, np.int64)
    by_room: list[list[int]] = [[] for _ in range(longest + 1)]  # heaps of bins, the oldest first
    occupied = np.zeros(longest + 1, dtype=bool)
    filled, capacity = [], []
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        left[size] -= 1
        ahead = occupied[size:].argmax() + size
        if occupied[ahead]:
            b = heapq.heappop(by_room[ahead])
            occupied[ahead] = bool(by_room[ahead])
        else:
            b = len(filled)
            filled.append(0)
            capacity.append(_opened(size, lengths, left))
        bins[i], offsets[i] = b, filled[b]
        filled[b] += size
        room = capacity[b] - filled[b]
        heapq.heappush(by_room[room], b)
        if room:
            occupied[room] = True
    final = np.array(lengths)[np.searchsorted(lengths, filled)] if filled else np.empty(0, np.int64)
    return bins, offsets, final[bins]


def pieces_of(docs: DataFrame, longest: int) -> DataFrame:
    """Pieces of the documents: ``doc_id, copy, n_words, piece, size``; ``copy`` numbers rows that repeat an id, ``size`` is null for texts without words."""
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), n_words(F.col("text")).alias("n_words"), F.spark_partition_id().alias("part")), "lengths")
    # rows of an id are numbered in each part of the table, after those of the parts before
    parts = rows.groupBy("doc_id", "part").agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy("doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    later = checkpointed(parts.withColumn("offset", F.sum("rows").over(earlier)).filter("offset is not null").select(F.col("doc_id").alias("of"), F.col("part").alias("in_part"), "offset"))
    inside = F.row_number().over(Window.partitionBy("doc_id", "part").orderBy("n_words"))
    rows = rows.withColumn("inside", inside).join(later, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in_part")), "left")
    rows = rows.select("doc_id", "n_words", (F.col("inside") + F.coalesce("offset", F.lit(0))).cast("int").alias("copy"))
    count = F.greatest(F.ceil(F.col("n_words") / longest), F.lit(1))
    cut = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    size = F.least(F.col("n_words") - F.col("piece") * longest, F.lit(longest))
    return cut.withColumn("size", F.when(F.col("n_words") > 0, size))


def packed(docs: DataFrame, lengths: Sequence[int] = LENGTHS, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Where each piece of ``docs (doc_id, text)`` goes: ``doc_id, copy, piece, size, bin_id, bin_offset, bin_length``, offsets in words."""
    pieces = checkpointed(pieces_of(docs, max(lengths)))
    shards = max(1, -(-pieces.count() // shard_pieces))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "copy", "piece"), F.lit(shards)).cast("int"))

    def pack_shard(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id", "copy", "piece"], ascending=[False, True, True, True], kind="stable")
        bins, offsets, final = pack(rows["size"].to_numpy(np.int64), lengths)
        shard = rows["shard"].to_numpy(np.int64)
        return rows.assign(bin_id=(shard << 32) + bins, bin_offset=offsets, bin_length=final)[["doc_id", "copy", "piece", "size", "bin_id", "bin_offset", "bin_length"]]

    schema = "doc_id long, copy int, piece long, size long, bin_id long, bin_offset long, bin_length long"
    full = dealt.filter("size is not null").groupBy("shard").applyInPandas(pack_shard, schema)
    none = pieces.filter("size is null").select("doc_id", "copy", "piece", F.lit(0).cast("long").alias("size"), *[F.lit(None).cast("long").alias(c) for c in ("bin_id", "bin_offset", "bin_length")])
    return full.unionByName(none)
