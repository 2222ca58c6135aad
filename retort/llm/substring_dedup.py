"""Repeated passages by bucket-pointer refinement of suffixes.

Suffixes are sorted only as far as needed: whether two share their first ``LENGTH`` bytes. A bucket identifier is the hash of what
a bucket's suffixes are known to share.

* Suffixes of one window of ``LENGTH`` bytes go by an anchor: of the window's q-grams (q = ``GRAM``), the leftmost of least hash. Equal windows have
  equal anchors, so the initial buckets are those of the anchors' q-grams, about one suffix in thirty enters, and each
  stands for the windows that it anchors (its hull: all their bytes).
* In each bucket, suffixes are sorted by the identifier of their hull. All but the first of equal hulls are settled: their windows come
  earlier. A bucket of one hull is settled too.
* Open buckets of more than ``MOST`` suffixes are refined: each suffix goes to up to two buckets, for the windows that begin further left or
  right, by the identifiers of what these share, and so on, until a bucket is small or one window is left.
* Small open buckets are refined within a task: their bytes get identifiers of 25-grams, which are refined by those 25 and then, reusing
  the updates, 50 bytes later; suffixes alone in their bucket leave. Of windows with equal identifiers all but the first are repeats.

Texts are written once to files in the shared folder. Tasks read a file beside the narrow rows for it, so that texts are never
shuffled: to make anchors, to add the bytes of open hulls, and to cut the repeats out. A bucket with very many suffixes (found by
counting those of one document in ``SAMPLED``; this chooses where rows go, not what comes out) is spread over ``SALTS`` keys by hull.

Documents are ordered by id (null first), then by a hash of the text, then by place. Defined cases: a null text is an empty one; texts shorter
than ``LENGTH`` lose nothing; a repeated row loses all windows of its first occurrence; passages that overlap themselves lose
all but their first window; an empty table gives an empty result; further columns may have any names, as the given row travels in one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retort.llm.common import checkpointed, fresh_path, written
from retort.llm.hashing import CHUNK_BYTES, RangeHasher, mixed, text_chunks
from retort.llm.shared_files import opened, partition

LENGTH, GRAM = 100, 40
#: Windows of one anchor begin at most so many bytes before it.
REACH = LENGTH - GRAM
#: Suffixes of a bucket that one task may take at once.
MOST = 2000
#: One document in so many is counted to find buckets of very many suffixes; such buckets go to so many keys.
SAMPLED, SALTS = 64, 64
_BATCH_ROWS, _HELD = 1000, 400_000
_PLACE = np.uint64((1 << 24) - 1)
_ANCHOR = "bucket long, hull long, rank long, at long, first long, last long, anchor long"
_NAMES = ["bucket", "hull", "rank", "at", "first", "last", "anchor"]


def anchors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Anchors of all windows of the texts in ``data``: text, bucket, hull identifier, first and last window start, and place of the anchor, as columns."""
    if len(data) < LENGTH:
        return np.empty((0, 6), dtype=np.int64)
    hasher, i = RangeHasher(data, folded=False), np.arange(len(data) - GRAM + 1)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    grams = hasher.hashes(i, i + GRAM)
    packed = np.where(i + GRAM > ends[i], np.uint64(2**64 - 1), (grams & ~_PLACE) | i.astype(np.uint64))
    width = REACH + 1
    tiled = np.full(-(-len(packed) // width) * width, np.uint64(2**64 - 1))
    tiled[: len(packed)] = packed
    tiled = tiled.reshape(-1, width)
    upto = np.minimum.accumulate(tiled, axis=1).ravel()[width - 1 : len(packed)]
    since = np.minimum.accumulate(tiled[:, ::-1], axis=1)[:, ::-1].ravel()[: len(upto)]
    start = np.flatnonzero(np.arange(len(upto)) + LENGTH <= ends[: len(upto)])
    place = (np.minimum(since[start], upto[start]) & _PLACE).astype(np.int64)
    if not len(start):
        return np.empty((0, 6), dtype=np.int64)
    cut = np.flatnonzero((np.diff(place) != 0) | (np.diff(start) != 1))
    first, last = start[np.concatenate([[0], cut + 1])], start[np.concatenate([cut, [len(start) - 1]])]
    place = place[np.concatenate([[0], cut + 1])]
    text = np.searchsorted(offsets, first, side="right") - 1
    return np.stack([text, grams[place].view(np.int64), hull_ids(hasher, first, last, place), first - offsets[text], last - offsets[text], place - offsets[text]], axis=1)


def hull_ids(hasher: RangeHasher, first: np.ndarray, last: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Identifiers of the bytes of all windows that an anchor stands for and of its place among them."""
    inside = mixed((place - first).astype(np.uint64) * np.uint64(1009) + (last - first).astype(np.uint64) + np.uint64(1))
    return mixed(hasher.hashes(first, last + LENGTH) ^ inside).view(np.int64)


def _texts(path: str, columns: list[str]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches of a file of texts with the number of their first row."""
    system, name = opened(path)
    at = 0
    with system.open_input_file(name) as f:
        for batch in pq.ParquetFile(f).iter_batches(batch_size=_BATCH_ROWS, columns=columns):
            yield at, batch
            at += batch.num_rows


def _pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces of texts: first row, place in it, bytes, offsets. Pieces of one long text share ``LENGTH - 1`` bytes with the next."""
    for row, data, offsets in text_chunks(column):
        if len(offsets) == 2 and len(data) > CHUNK_BYTES:
            for at in range(0, len(data) - LENGTH + 1, CHUNK_BYTES):
                piece = data[at : at + CHUNK_BYTES + LENGTH - 1]
                yield row, at, piece, np.array([0, len(piece)])
        else:
            yield row, 0, data, offsets


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals, as maximal ones in order."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order]) if len(ends) else ends
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > ends[:-1]])) if len(starts) else np.empty(0, np.int64)
    return starts[new], ends[np.concatenate([new[1:] - 1, [len(ends) - 1]])] if len(new) else ends


def _settled(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``_NAMES`` cut to the first of each hull, and the others as intervals of their documents (with a null hull)."""
    order = np.lexsort((rows[:, 6], rows[:, 2], rows[:, 1], rows[:, 0]))
    rows = rows[order]
    again = np.concatenate([[False], (rows[1:, :2] == rows[:-1, :2]).all(axis=1)])
    same = rows[again]
    # intervals of all documents on one line, none of them touching another document's
    base = same[:, 3] - same[:, 3].min() if len(same) else same[:, 3]
    each, which = np.unique(base, return_inverse=True)
    line = which * np.int64(1 << 33)
    starts, ends = merged(line + same[:, 4], line + same[:, 5] + LENGTH)
    doc = starts >> 33
    low = doc << 33
    lone = np.stack([mixed(starts.astype(np.uint64)).view(np.int64), *[np.zeros_like(starts)] * 2, each[doc] + same[:, 3].min(), starts - low, ends - low, starts - low], axis=1) if len(same) else same
    return rows[~again], lone


def _anchored(every: int):
    """A task function: files with the ranks of their rows to the anchors of texts, of each document whose rank ``every`` divides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.to_pylist():
                ranks, held, n = np.array(source["ranks"], dtype=np.int64), [], 0
                base = source["file"] << 32
                for start, texts in _texts(source["path"], ["text"]):
                    picked = np.flatnonzero(ranks[start : start + texts.num_rows] % every == 0)
                    column = texts.column("text") if every == 1 else texts.column("text").take(pa.array(picked))
                    for row, at, data, offsets in _pieces(column):
                        found = anchors(data, offsets)
                        rows = start + picked[row + found[:, 0]]
                        held.append(np.column_stack([found[:, 1], found[:, 2], ranks[rows], base + rows, found[:, 3:] + at]))
                        n += len(found)
                    if n >= _HELD:
                        yield from _given(held)
                        held, n = [], 0
                yield from _given(held)

    def _given(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if held:
            kept, lone = _settled(np.concatenate(held))
            for rows, alone in ((kept, False), (lone, True)):
                for at in range(0, len(rows), 20_000):
                    part = rows[at : at + 20_000]
                    columns = [pa.array(np.ascontiguousarray(c)) for c in part.T]
                    columns[1] = pa.nulls(len(part), pa.int64()) if alone else columns[1]
                    yield pa.RecordBatch.from_arrays(columns, _NAMES)

    return run


def ranked_files(docs: DataFrame, keep: list[str] | None) -> DataFrame:
    """``docs`` written to files: ``file, path, ranks``, the ranks of the documents in the order of the file's rows."""
    spark = docs.sparkSession
    row = F.struct(*(docs.columns if keep is None else keep)).alias("row")
    path = fresh_path(spark, "texts")
    given = docs.select(row, F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    given.write.option("compression", "zstd").parquet(path)
    texts = spark.read.schema(given.schema).parquet(path)
    paths = sorted(texts.inputFiles())
    files = spark.createDataFrame(list(enumerate(paths)), "file long, path string").repartition(max(1, len(paths)))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.to_pylist():
                for start, rows in _texts(source["path"], ["doc_id", "h"]):
                    n = rows.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, source["file"])), pa.array(np.arange(start, start + n)), rows.column("doc_id"), rows.column("h")], ["file", "row", "doc_id", "h"])

    order = ["doc_id", "h", "file", "row"]
    sorted_rows = files.mapInArrow(listed, "file long, row long, doc_id long, h long").repartitionByRange(*order).sortWithinPartitions(*order).select("file", "row")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            more = [pa.array(np.full(batch.num_rows, partition(), dtype=np.int64)), pa.array(np.arange(n, n + batch.num_rows))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], ["file", "row", "part", "no"])
            n += batch.num_rows

    rows = checkpointed(sorted_rows.mapInArrow(placed, "file long, row long, part long, no long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("part").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ranks = rows.join(F.broadcast(counts), "part").select("file", F.struct("row", (F.col("base") + F.col("no")).alias("rank")).alias("x"))  # a row a partition
    per_file = ranks.groupBy("file").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["rank"]).alias("ranks"))
    return checkpointed(files.join(per_file, "file").repartition(max(1, len(paths)), "file"))


def refined(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """``rows`` without the settled buckets, and with ``repeat``: true for all but the first of equal hulls. ``hot`` lists buckets to be spread."""
    spread = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), "bucket", "left")  # at most a few keys a partition
    spread = spread.withColumn("_salt", F.when(F.col("_hot"), F.pmod("hull", F.lit(SALTS))))
    bucket = Window.partitionBy("bucket", "_salt")
    sorted_hulls = bucket.orderBy("hull", "rank", "anchor", "first")
    seen = spread.withColumns({
        "repeat": F.coalesce(F.lag("hull").over(sorted_hulls) == F.col("hull"), F.lit(False)),
        "_open": (F.min("hull").over(bucket) != F.max("hull").over(bucket)) | F.coalesce(F.col("_hot"), F.lit(False)),
    })
    return seen.filter(F.col("repeat") | F.col("_open") | F.col("hull").isNull()).drop("_salt", "_hot", "_open")


def _most_frequent(rows: DataFrame, least: int) -> DataFrame:
    """Buckets of ``least`` rows or more, the largest first, at most eight a shuffle partition."""
    spark = rows.sparkSession
    most = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = rows.filter("hull is not null").groupBy("bucket").count().filter(F.col("count") >= least).orderBy(F.desc("count"), "bucket").limit(most).collect()
    return spark.createDataFrame([(r["bucket"],) for r in found], "bucket long")


def _with_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors, sorted by place, with the bytes of their hulls."""
    path, source, texts, start = None, None, None, 0
    for batch in batches:
        at, paths = np.asarray(batch.column("at")), batch.column("path").to_pylist()
        first, last = np.asarray(batch.column("first")), np.asarray(batch.column("last"))
        found, held = [], (None, b"")
        for i in range(batch.num_rows):
            if paths[i] != path:
                path, source, texts, start = paths[i], _texts(paths[i], ["text"]), None, 0
            row = int(at[i]) & 0xFFFFFFFF
            while texts is None or row >= start + texts.num_rows:
                start, texts = next(source)
            if held[0] != at[i]:
                held = (at[i], texts.column("text")[row - start].as_buffer())
            found.append(held[1].slice(int(first[i]), int(last[i] - first[i]) + LENGTH).to_pybytes())
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in _NAMES], pa.array(found, pa.binary())], [*_NAMES, "bytes"])


def _split(low: int, high: int):
    """A task function: suffixes of buckets for anchors ``low`` to ``high`` bytes after the windows' starts to those of either half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = (low + high) // 2
        for batch in batches:
            bucket, rank, at, first, last, place = (np.asarray(batch.column(c)) for c in ("bucket", "rank", "at", "first", "last", "anchor"))
            sizes = last - first + LENGTH
            ends = np.cumsum(sizes)
            base = ends - sizes - first  # from a place in the text to one in the joined bytes
            data = np.frombuffer(b"".join(batch.column("bytes").to_pylist()), dtype=np.uint8)
            hasher = RangeHasher(data, folded=False)
            raw = data.tobytes()
            for a, b in ((low, middle), (middle + 1, high)):
                f, e = np.maximum(first, place - b), np.minimum(last, place - a)
                i = np.flatnonzero(f <= e)
                if not len(i):
                    continue
                f, e, p, o = f[i], e[i], place[i], base[i]
                core = hasher.hashes(p - a + o, p - b + LENGTH + o)
                key = mixed(core ^ mixed(bucket[i].astype(np.int64).view(np.uint64) + np.uint64(64 * a + b + 1))).view(np.int64)
                hull = hull_ids(hasher, f + o, e + o, p + o)
                # equal hulls of this batch go on once, so that a passage of very many texts is few rows
                kept, lone = _settled(np.column_stack([key, hull, rank[i], at[i], f, e, p, np.arange(len(i))]))
                j = kept[:, 7]
                own = [raw[x:y] for x, y in zip((f + o)[j].tolist(), (e + LENGTH + o)[j].tolist(), strict=True)]
                for rows, texts, alone in ((kept[:, :7], own, False), (lone, None, True)):
                    if len(rows):
                        columns = [pa.array(np.ascontiguousarray(c)) for c in rows.T]
                        columns[1] = pa.nulls(len(rows), pa.int64()) if alone else columns[1]
                        low_high = [pa.array(np.full(len(rows), x)) for x in (a, b)]
                        yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(rows), pa.binary()) if alone else pa.array(texts, pa.binary()), *low_high], [*_NAMES, "bytes", "low", "high"])

    return run


def _identifiers(data: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Identifiers of the ``LENGTH`` bytes from each place on, -1 where they are alone or do not fit; ``valid[i]`` bytes are left from place i on."""
    q = LENGTH // 4
    names = np.full(len(data), -1, dtype=np.int64)
    here = np.flatnonzero(valid >= q)
    names[here] = np.unique(RangeHasher(data, folded=False).hashes(here, here + q), return_inverse=True)[1]
    while q < LENGTH:
        here = np.flatnonzero((names >= 0) & (valid >= 2 * q))
        later = names[here + q]
        here, later = here[later >= 0], later[later >= 0]
        key = names[here] * (len(data) + 1) + later
        _, which, counts = np.unique(key, return_inverse=True, return_counts=True)
        names[:] = -1
        names[here] = np.where(counts[which] > 1, which, -1)
        q *= 2
    return names


def _resolved(rows: list[tuple]) -> pa.RecordBatch:
    """Repeated windows of the suffixes of whole buckets, as intervals: ``at, start, end``."""
    rank, at, first, last = (np.array(c, dtype=np.int64) for c in list(zip(*rows, strict=True))[:4])
    sizes = last - first + LENGTH
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(r[4] for r in rows), dtype=np.uint8)
    names = _identifiers(data, np.repeat(ends, sizes) - np.arange(len(data)))
    windows = np.flatnonzero(names >= 0)
    row = np.searchsorted(ends, windows, side="right")
    start = windows - (ends - sizes)[row] + first[row]
    order = np.lexsort((start, rank[row], names[windows]))
    again = np.concatenate([[False], np.diff(names[windows][order]) == 0]) if len(order) else np.empty(0, bool)
    repeats = np.sort(windows[order][again])
    row = np.searchsorted(ends, repeats, side="right")
    cut = np.concatenate([[True], (np.diff(repeats) != 1) | (np.diff(row) != 0)]) if len(repeats) else np.empty(0, bool)
    begin = np.flatnonzero(cut)
    finish = np.concatenate([begin[1:] - 1, [len(repeats) - 1]]) if len(begin) else begin
    shift = first - (ends - sizes)
    doc = row[begin]
    return pa.RecordBatch.from_arrays([pa.array(at[doc]), pa.array(repeats[begin] + shift[doc]), pa.array(repeats[finish] + shift[doc] + LENGTH)], ["at", "start", "end"])


def _within_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes sorted by bucket, taken as many whole buckets at a time as make up ``MOST`` rows."""
    held, last = [], None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("bucket", "rank", "at", "first", "last", "bytes")]
        for bucket, *row in zip(*columns, strict=True):
            if bucket != last:
                if len(held) >= MOST:
                    yield _resolved(held)
                    held = []
                last = bucket
            held.append(tuple(row))
    if held:
        yield _resolved(held)


def repeats(files: DataFrame) -> DataFrame:
    """Intervals of all repeated windows, ``at, start, end``; ``at`` is the file's number times 2^32 and the row's."""
    spark = files.sparkSession
    interval = lambda df: df.select("at", F.col("first").alias("start"), (F.col("last") + F.when(F.col("hull").isNull(), 0).otherwise(LENGTH)).alias("end"))
    hot = _most_frequent(files.mapInArrow(_anchored(SAMPLED), _ANCHOR), 32)
    level = checkpointed(refined(files.mapInArrow(_anchored(1), _ANCHOR), hot))
    found = [interval(level.filter("repeat or hull is null"))]
    opened_rows = level.filter("not repeat and hull is not null").withColumn("file", F.shiftright("at", 32)).join(files.select("file", "path"), "file")
    placed = opened_rows.repartition("file").sortWithinPartitions("file", "at", "first").select(*_NAMES, "path")
    left = written(placed.mapInArrow(_with_bytes, f"{_ANCHOR}, bytes binary"), "hulls").withColumns({"low": F.lit(0).cast("long"), "high": F.lit(REACH).cast("long")})
    spans = [(0, REACH)]
    while True:
        large = checkpointed(left.groupBy("bucket").count().filter(F.col("count") > MOST).select("bucket"))
        small = left.join(large, "bucket", "left_anti")
        found.append(small.repartition("bucket").sortWithinPartitions("bucket").select("bucket", "rank", "at", "first", "last", "bytes").mapInArrow(_within_buckets, "at long, start long, end long"))
        if large.isEmpty():
            break
        split = f"{_ANCHOR}, bytes binary, low long, high long"
        parts = [left.join(large, "bucket", "left_semi").filter((F.col("low") == a) & (F.col("high") == b)).mapInArrow(_split(a, b), split) for a, b in spans]
        rows = written(_all(parts), "halves")
        spans = sorted({(x, y) for a, b in spans for x, y in ((a, (a + b) // 2), ((a + b) // 2 + 1, b)) if x <= y})
        level = written(refined(rows, _most_frequent(rows, MOST)), "refined")
        found.append(interval(level.filter("repeat or hull is null")))
        left = level.filter("not repeat and hull is not null").drop("repeat")
    return _all(found)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def without_repeats(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """For each row of ``docs``: ``row`` with its columns ``keep``, else all; ``kept``, the bytes of its text that are no repeat, ``n_bytes``
    of the whole text, and ``spans``, the maximal stretches that are left out."""
    row = docs.select(F.struct(*(docs.columns if keep is None else keep)).alias("row")).schema["row"].dataType
    files = ranked_files(docs, keep)
    cut = repeats(files).select(F.shiftright("at", 32).alias("file"), F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).alias("r"), "start", "end", F.lit(None).cast("string").alias("path"))
    heads = files.select("file", F.lit(-1).cast("long").alias("r"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), "path")
    met = cut.unionByName(heads).repartition("file").sortWithinPartitions("file", "r", "start")
    return met.mapInArrow(_cut, f"row {row.simpleString()}, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files, each followed by the intervals to leave out, to texts without these."""

    def done(path: str, cuts: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows, starts, ends = (np.concatenate(c) for c in zip(*cuts, strict=True)) if cuts else [np.empty(0, np.int64)] * 3
        for start, batch in _texts(path, ["row", "text"]):
            a, b = np.searchsorted(rows, [start, start + batch.num_rows])
            bounds = np.searchsorted(rows[a:b], np.arange(start, start + batch.num_rows + 1)) + a
            kept, spans, sizes = [], [], []
            for i in range(batch.num_rows):
                raw = batch.column("text")[i].as_buffer()
                raw = memoryview(raw) if raw is not None else memoryview(b"")
                f, e = merged(starts[bounds[i] : bounds[i + 1]], ends[bounds[i] : bounds[i + 1]])
                at, parts = 0, []
                for x, y in zip(f.tolist(), e.tolist(), strict=True):
                    parts.append(raw[at:x])
                    at = y
                kept.append(b"".join([*parts, raw[at:]]))
                spans.append([{"start": x, "end": y} for x, y in zip(f.tolist(), e.tolist(), strict=True)])
                sizes.append(len(raw))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["row", "n_bytes", "spans", "kept"])

    path, cuts = None, []
    for batch in batches:
        paths, columns = batch.column("path"), [np.asarray(batch.column(c)) for c in ("r", "start", "end")]
        at = 0
        for i in np.flatnonzero(np.asarray(paths.is_valid())).tolist():
            cuts.append(tuple(c[at:i] for c in columns))
            if path is not None:
                yield from done(path, cuts)
            path, cuts, at = paths[i].as_py(), [], i + 1
        cuts.append(tuple(c[at:] for c in columns))
    if path is not None:
        yield from done(path, cuts)
