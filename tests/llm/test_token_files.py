"""Token files: exact round trips, and the library's own encoding of whole texts."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from retort.llm import simple8b, token_files
from retort.llm.queries import op5_token_files

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "  ", " a", "a ", "a  b", "a \n b", "a\n b", "a\n\n  b c", "x  y", "\t z", "don't stop 's 1 22,3 é😀 ñandú", "a b c ", "<|endoftext|> a<|endoftext|>b",
    "wide　 space", "w x y", "12 34  56", "line\r\n next", "\u0085 q", "\x1c r s",
]


@pytest.mark.parametrize("n", [0, 1, 5, 511, 512, 513, 3000])
def test_simple8b_round_trip(n):
    rng = np.random.default_rng(n)
    for high in (1, 2, 50, 50_257, 2**31, 2**60, 2**64):
        ids = rng.integers(0, high, n, dtype=np.uint64) if high < 2**64 else rng.integers(0, 2**64 - 1, n, dtype=np.uint64)
        if n > 4:
            ids[:: max(1, n // 4)] = 0
        words, offsets = simple8b.encode(ids)
        assert np.array_equal(simple8b.decode(words, offsets, n), ids)


def test_long_runs_of_small_ids_pack_tightly():
    words, _ = simple8b.encode(np.ones(512, dtype=np.uint64))
    assert len(words) == 9


def test_encoder_equals_library():
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice([" ", "a", "B", "é", "\n", "1", ".", "'s", "  ", "word", "\t", "Ends.", "x's,", "5;", "²!", "한국?", "'ll.", ".a"]) for _ in range(60)) for _ in range(300)]
    tokenizer = token_files._tokenizer(TOKENIZER)
    ids, counts = token_files.Encoder(TOKENIZER).encode(pa.array([t or "" for t in texts]))
    at = 0
    for text, n in zip(texts, counts, strict=True):
        assert list(ids[at : at + n]) == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], repr(text)
        at += n


def expected(rows):
    tokenizer, at, out = token_files._tokenizer(TOKENIZER), 0, []
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_query_equals_library(spark, sf_small):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    out = op5_token_files(spark, sf_small)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, out.collect())) == expected(rows)


def test_odd_rows_small_files_and_groups(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_IDS", 50)
    rows = [(None, "x y")] + [(i, t) for i, t in enumerate(ODD)] + [(100, "long " * 4000), (101, "a"), (101, "a"), (101, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, token_files.round_trip(docs, TOKENIZER).collect()), key=lambda r: r[1])
    assert got == expected(rows)
    assert token_files.round_trip(docs.limit(0), TOKENIZER).count() == 0


def test_read_file_in_small_groups(tmp_path):
    rng = np.random.default_rng(1)
    counts = np.array([3, 2000, 1, 700, 512])
    ids = rng.integers(0, 50_000, counts.sum()).astype(np.uint32)
    uri = token_files.write_file(str(tmp_path), pa.array([5, 6, None, 8, 9]), counts, ids)
    for group in (1, 2, 100):
        docs = list(token_files.read_file(uri, group))
        assert [d[0] for d in docs] == [5, 6, None, 8, 9] and np.array_equal(np.concatenate([d[2] for d in docs]), ids)


def test_added_tokens_are_the_librarys():
    import pyarrow as pa
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENIZER)
    texts = ["<|endoftext|>", "one text.<|endoftext|>Another, <|endoftext|> and more <|endoftext|>.", "<| endoftext |> not one", "a b", ""]
    ids, counts = token_files.Encoder(TOKENIZER).encode(pa.array(texts))
    parts = np.split(ids, np.cumsum(counts)[:-1])
    assert [list(p) for p in parts] == [[*plain.encode(t, add_special_tokens=False).ids, token_files.END_ID] for t in texts]
    assert 50256 in parts[0] and list(parts[1]).count(50256) == 3


def test_marks_after_words_are_encoded_apart():
    """A word with other marks after it goes to the library once; every ASCII mark, alone, beside others and after the apostrophe, gives the library's ids."""
    encoder, given = token_files.Encoder(TOKENIZER), []

    class Counting:
        def encode_batch_fast(self, texts, **options):
            given.extend(texts)
            return plain.encode_batch_fast(texts, **options)

    plain = encoder.tokenizer
    encoder.tokenizer = Counting()
    marks = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    ends = ["", *marks, "$$$", "&&&", "%%%", ",###", ".***", "]^", "^]", "\\-", "'.", ".'", "'s", "'s.", "s'", "'s'", "_a", "²;"]
    texts = [" ".join(["first", *(f"word{i}é{e}" for i in range(200)), e, f"é{e}{e}"]) for e in ends]
    ids, counts = encoder.encode(pa.array(texts))
    parts = np.split(ids, np.cumsum(counts)[:-1])
    assert [list(p) for p in parts] == [[*plain.encode(t, add_special_tokens=False).ids, token_files.END_ID] for t in texts]
    assert sum(map(len, given)) < sum(map(len, texts)) / 4
