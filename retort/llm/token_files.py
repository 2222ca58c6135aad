"""Token ids of documents in binary files, Simple-8b coded, written and read by tasks.

Documents are put in ascending id order by a range shuffle; each task encodes its texts and writes files of whole documents:
magic, words of all blocks, then an index with the document ids, the start of each document in ids, the word offset of each
block, and a fixed tail that says where the index begins. The start of a document among all is the number of ids in the
earlier files (a running sum over the table of files) plus its start in its own file.

A text is cut where a space follows a character that is not white space: the tokenizer's own pattern always starts a new
piece there, so that each distinct piece of some megabytes of text is encoded once and its ids are gathered where it occurs.
Texts in which a space follows white space or that hold the name of an added token, which the tokenizer takes as that token,
are encoded whole. Both give the tokenizer's ids for the whole text, and a piece may have any number of ids.

Defined cases: a null text is an empty one and has only the end id; null ids come first; rows with equal ids follow each
other by text; names of further columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retort.llm import simple8b
from retort.llm.common import checkpointed, fresh_path
from retort.llm.shared_files import new_file, opened, partition

MAGIC = b"IDS8B\x00\x00\x01"
#: A file is closed at the first document end after so many ids.
FILE_IDS = 4_000_000
#: Texts are tokenized together up to so many bytes; a longer text is taken alone.
CHUNK_BYTES = 16 << 20
#: The library gets so many bytes at a time, or one text.
LIBRARY_BYTES = 1 << 18
#: Pieces whose ids are gathered at once, and words that go to the library end to end.
SLOTS, RUN = 1 << 19, 1000
END_ID = 0
#: All ASCII marks but the apostrophe, with which the tokenizer's contractions begin; as a class of a pattern.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_A_MARK = f"[{re.escape(_MARKS)}]"
_ANY_SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
_WIDE_SPACE = f"{_ANY_SPACE} "
_FILES = "shard int, part int, path string, n_docs long, n_ids long"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _spaced(path: str) -> np.ndarray:
    """Which ids begin with a space."""
    tokenizer = _tokenizer(path)
    heads = np.zeros(tokenizer.get_vocab_size(), dtype=bool)
    heads[[i for token, i in tokenizer.get_vocab().items() if token.startswith("\u0120")]] = True
    return heads


@dataclass
class _Units:
    """Sequences of ids, end to end, each with its start and its count."""

    ids: np.ndarray
    starts: np.ndarray
    counts: np.ndarray

    @staticmethod
    def of(parts: list[tuple[np.ndarray, np.ndarray]]) -> _Units:
        """From pairs of ids, end to end, and counts."""
        counts = np.concatenate([np.asarray(c, np.int64) for _, c in parts])
        return _Units(np.concatenate([np.asarray(i, np.uint32) for i, _ in parts]), np.cumsum(counts) - counts, counts)

    def taken(self, which: np.ndarray) -> np.ndarray:
        """Ids of the units ``which``, end to end."""
        out = []
        for at in range(0, len(which), SLOTS):
            block = which[at : at + SLOTS]
            counts = self.counts[block]
            upto = np.cumsum(counts)
            out.append(self.ids[np.repeat(self.starts[block] - (upto - counts), counts) + np.arange(upto[-1])])
        return np.concatenate(out) if out else np.empty(0, np.uint32)


def _cuts(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """First row and number of rows of pieces of at most ``most`` bytes, or of one row."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    upto, at = np.concatenate([[0], np.cumsum(lengths)]), 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + most, side="right")) - 1)
        yield at, end - at
        at = end


def _parts(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    for at, n in _cuts(texts, most):
        yield texts.slice(at, n)


class Encoder:
    """Token ids of string columns. Each distinct piece of a column is encoded once."""

    def __init__(self, path: str):
        self.tokenizer, self.spaced = _tokenizer(path), _spaced(path)
        self.added = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())

    def _each(self, texts: pa.Array, before: str = "") -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, each after ``before``, end to end, and their counts. What the library returns is large, so that it gets a part of them at a time."""
        ids, counts = [], []
        for part in _parts(texts, LIBRARY_BYTES):
            found = [e.ids for e in self.tokenizer.encode_batch_fast([before + t for t in part.to_pylist()], add_special_tokens=False)]
            ids.append(np.fromiter(chain.from_iterable(found), np.uint32))
            counts.append(np.array([len(x) for x in found], dtype=np.int64))
        return (np.concatenate(ids), np.concatenate(counts)) if ids else (np.empty(0, np.uint32), np.empty(0, np.int64))

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words after a space. They go to the library end to end, a run at a time, and come apart where an id begins with a space;
        words with white space of their own go one by one."""
        wide = np.asarray(pc.or_(pc.match_substring_regex(words, _ANY_SPACE), pc.equal(words, "")).to_numpy(zero_copy_only=False), dtype=bool)
        plain = np.flatnonzero(~wide)
        bounds = np.append(np.arange(0, len(plain), RUN), len(plain)).astype(np.int32)
        runs = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), words.take(pa.array(plain))), " ")
        ids, lengths = self._each(runs, " ")
        # a run of as many spaces as words comes apart; the words of others go one by one
        ends = np.cumsum(lengths)
        spaced = np.concatenate([[0], np.cumsum(self.spaced[ids])])[np.concatenate([[0], ends])]
        whole = np.diff(spaced) == np.diff(bounds)
        in_whole = np.repeat(whole, lengths)
        ids = ids[in_whole]
        starts = np.flatnonzero(self.spaced[ids])
        apart = plain[np.repeat(whole, np.diff(bounds))]
        rest = np.concatenate([np.flatnonzero(wide), plain[np.repeat(~whole, np.diff(bounds))]])
        units = _Units.of([(ids, np.diff(starts, append=len(ids))), self._each(words.take(pa.array(rest)), " ")])
        place = np.empty(len(words), np.int64)
        place[np.concatenate([apart, rest])] = np.arange(len(words))
        return units.taken(place), units.counts[place]

    def _pieces(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces after a space. Marks after a letter or digit are pieces of their own to the tokenizer, so that they are split off and the rest is encoded once."""
        marked = np.asarray(pc.match_substring_regex(names, rf"[\p{{L}}\p{{N}}]{_A_MARK}+$").to_numpy(zero_copy_only=False), dtype=bool)
        split = pc.dictionary_encode(pc.if_else(pa.array(marked), pc.utf8_rtrim(names, _MARKS), names))
        marks = pc.dictionary_encode(pc.extract_regex(names.filter(pa.array(marked)), f"(?P<marks>{_A_MARK}+)$").field("marks"))
        units = _Units.of([self._words(split.dictionary), self._each(marks.dictionary)])
        which = np.zeros(2 * len(names), np.int64)
        which[::2] = np.asarray(split.indices)
        used = np.ones(2 * len(names), dtype=bool)
        used[1::2] = marked
        which[1::2][marked] = len(split.dictionary) + np.asarray(marks.indices)
        counts = np.where(used, units.counts[which] if len(units.counts) else 0, 0).reshape(-1, 2).sum(axis=1)
        return units.taken(which[used]), counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, each with the end id after it, and the counts."""
        plain = pc.invert(pc.match_substring_regex(texts, f"{_WIDE_SPACE}|{self.added}" if self.added else _WIDE_SPACE))
        # a text with wide white space or an added token is one piece
        split = pc.split_pattern(pc.if_else(plain, texts, pa.scalar("", texts.type)), " ")
        offsets = np.asarray(split.offsets)
        pieces = pc.dictionary_encode(split.flatten())
        number = np.asarray(pieces.indices)
        firsts, first_at = np.unique(number[offsets[:-1]], return_inverse=True)
        whole_rows = np.flatnonzero(~np.asarray(plain.to_numpy(zero_copy_only=False), dtype=bool))
        parts = [self._pieces(pieces.dictionary), self._each(pieces.dictionary.take(pa.array(firsts))), self._each(texts.take(pa.array(whole_rows)))]
        units = _Units.of([*parts, (np.array([END_ID]), np.array([1]))])
        # the end id is one more unit after the last of each text
        lengths = np.diff(offsets)
        slots = np.full(len(number) + len(texts), len(units.counts) - 1, dtype=np.int64)
        slots[np.arange(len(number)) + np.repeat(np.arange(len(texts)), lengths)] = number
        heads = offsets[:-1] + np.arange(len(texts))
        slots[heads] = len(parts[0][1]) + first_at
        slots[heads[whole_rows]] = len(parts[0][1]) + len(parts[1][1]) + np.arange(len(whole_rows))
        upto = np.concatenate([[0], np.cumsum(units.counts[slots])])
        return units.taken(slots), np.diff(upto[np.append(heads, len(slots))])


def write_file(folder: str, doc_ids: pa.Array, counts: np.ndarray, ids: np.ndarray) -> str:
    """Write documents to a new file and return its URI."""
    words, blocks = simple8b.encode(ids.astype(np.uint64))
    index = {"docs": len(counts), "ids": len(ids), "blocks": len(blocks) - 1, "block": simple8b.BLOCK}
    valid = np.asarray(doc_ids.is_valid().to_numpy(zero_copy_only=False), dtype=np.uint8)
    parts = [json.dumps(index).encode().ljust(256), np.asarray(doc_ids.fill_null(0)).astype("<i8").tobytes(), valid.tobytes(), np.concatenate([[0], np.cumsum(counts)]).astype("<i8").tobytes(), blocks.astype("<i8").tobytes()]
    uri = new_file(folder, ".ids")
    system, path = opened(uri)
    with system.open_output_stream(path, compression=None) as out:
        out.write(MAGIC)
        out.write(words.astype("<u8").tobytes())
        out.write(b"".join(parts))
        out.write((8 + 8 * len(words)).to_bytes(8, "little") + MAGIC)
    return uri


def read_file(uri: str, group: int = 4096) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """Documents of a file in order: id, start in the file, ids. At most ``group`` blocks are decoded at once, beside one document."""
    system, path = opened(uri)
    with system.open_input_file(path) as f:
        size = f.size()
        tail = f.read_at(16, size - 16)
        at = int.from_bytes(tail[:8], "little")
        if tail[8:] != MAGIC or f.read_at(8, 0) != MAGIC:
            raise ValueError(f"{uri} is not a whole token file")
        raw = f.read_at(size - 16 - at, at)
        index = json.loads(raw[:256])
        n, spot = index["docs"], 256
        doc_ids, spot = np.frombuffer(raw, "<i8", n, spot), spot + 8 * n
        valid, spot = np.frombuffer(raw, np.uint8, n, spot), spot + n
        starts, spot = np.frombuffer(raw, "<i8", n + 1, spot), spot + 8 * (n + 1)
        blocks = np.frombuffer(raw, "<i8", index["blocks"] + 1, spot)
        held, held_from, doc = [], 0, 0
        for b in range(0, index["blocks"], group):
            upto = min(b + group, index["blocks"])
            last_id = min(upto * index["block"], index["ids"])
            words = np.frombuffer(f.read_at(8 * int(blocks[upto] - blocks[b]), 8 + 8 * int(blocks[b])), "<u8")
            held.append(simple8b.decode(words, blocks[b : upto + 1] - blocks[b], last_id - b * index["block"]))
            if doc < n and starts[doc + 1] <= last_id:
                have = np.concatenate(held)
                while doc < n and starts[doc + 1] <= last_id:
                    yield (int(doc_ids[doc]) if valid[doc] else None), int(starts[doc]), have[starts[doc] - held_from : starts[doc + 1] - held_from]
                    doc += 1
                held, held_from = [have[starts[doc] - held_from :]], int(starts[doc])


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of at most ``CHUNK_BYTES`` of text each, or one row."""
    for at, n in _cuts(batch.column("text"), CHUNK_BYTES):
        yield batch.slice(at, n)


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, partitions: int | None = None) -> DataFrame:
    """Encode ``docs (doc_id, text)`` and write token files to ``folder``; the files by name, a row each, in document order."""
    partitions = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, held, n = Encoder(tokenizer), 0, [], 0
        shard = partition()

        def flush() -> pa.RecordBatch:
            doc_ids = pa.concat_arrays([h[0] for h in held])
            counts, ids = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            uri = write_file(folder, doc_ids, counts, ids)
            return pa.RecordBatch.from_pylist([{"shard": shard, "part": part, "path": uri, "n_docs": len(counts), "n_ids": len(ids)}], schema)

        for batch in batches:
            for chunk in _chunks(batch):
                ids, counts = encoder.encode(chunk.column("text").cast(pa.string()).fill_null(""))
                held.append((chunk.column("doc_id"), counts, ids))
                n += len(ids)
                if n >= FILE_IDS:
                    yield flush()
                    part, held, n = part + 1, [], 0
        if held:
            yield flush()

    schema = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(partitions, "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    return checkpointed(ordered.mapInArrow(write, _FILES))


def read_tokens(files: DataFrame, partitions: int | None = None) -> DataFrame:
    """Documents of token files in order: ``doc_id, start`` (ids of all documents before it), ``n_tokens, ids_crc32``."""
    partitions = partitions or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    earlier = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    based = files.withColumn("base", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out = [(i, row["base"] + s, len(x), zlib.crc32(x.astype("<u4").tobytes())) for i, s, x in read_file(row["path"])]
                columns = list(zip(*out, strict=True)) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return based.select("path", "base").repartition(partitions, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and read them back."""
    return read_tokens(write_tokens(docs, tokenizer, fresh_path(docs.sparkSession, "tokens")))
