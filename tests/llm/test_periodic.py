"""Periodic runs against a scan of all lags."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from retort.llm import periodic


def plain_runs(words):
    """All runs by trying each period at each place."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                found.setdefault((i, length), q)  # a multiple of the period has the same stretch
            i = j + 1
    return sorted((i, n, q) for (i, n), q in found.items())


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = plain_runs(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    return runs, " ".join(w for i, w in enumerate(words) if i not in dropped)


def texts():
    rng = random.Random(5)
    out = [None, "", "   \n", "a", "a " * 5, "a " * 6, "a b " * 4, "a b a b a b a", "x" * 100_000, "a b " * 3000 + "c " * 17 + "a b " * 4]
    for k in range(120):
        made = []
        while len(made) < 5 + 3 * k:
            part = [rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.randint(1, 9))]
            made += (part * rng.randint(1, 8))[: rng.randint(1, 60)]
        out.append(rng.choice([" ", "\n", " \t"]).join(made))
    out += [" ".join(rng.choice("ab") for _ in range(900)), "A a " * 9 + "é É " * 9, "nested " * 7 + "in a b " * 6 + "nested " * 7, "a b c " * 5 + "a b c " * 5 + "a b"]
    fib = ["a", "b"]
    while len(fib[-1]) < 800:
        fib.append(fib[-1] + fib[-2])
    return [*out, " ".join(fib[-1]), " ".join(fib[-1] * 5)]


def test_equal_to_all_lags():
    given = texts()
    got = list(periodic.runs_of_texts(pa.array(given, pa.string())))
    for text, (runs, left) in zip(given, got, strict=True):
        assert (runs, left.decode()) == plain(text)


def test_splitting_leaves_what_runs_need():
    words = np.array([0, 1, 0, 1, 0, 1, 0, 1, 9, 0, 1, 2, 3])
    assert periodic.surviving(words, np.zeros(13, int)).tolist() == list(range(8))
    assert len(periodic.surviving(np.arange(50), np.zeros(50, int))) == 0
    # a word that is frequent in the whole, but in no part that rarer words leave
    assert len(periodic.surviving(np.array([0, 9, 0, 8, 0, 7, 0, 6, 0]), np.zeros(9, int))) == 0


def test_long_texts_take_one_sort_a_scale():
    rng = random.Random(1)
    block = [f"w{rng.randrange(3000)}" for _ in range(40_000)]
    words = block * 5 + block[:7]
    ((runs, left),) = periodic.runs_of_texts(pa.array([" ".join(words)]))
    assert (0, len(words), 40_000) in runs and len(left.split()) <= 40_000


def test_odd_rows(spark):
    rows = [(None, None, 1), (1, None, 2), (1, "a " * 9, 3), (1, "a " * 9, 3), (2, "", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = sorted((str(r["row"]["doc_id"]), r["row"]["runs"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.with_runs(docs).collect())
    assert got == [("1", 2, [], ""), ("1", 3, [(0, 9, 1)], "a"), ("1", 3, [(0, 9, 1)], "a"), ("2", 4, [], ""), ("None", 1, [], "")]
    empty = periodic.with_runs(docs.limit(0))
    assert empty.columns == ["row", "runs", "collapsed"] and empty.count() == 0


@pytest.mark.parametrize("size", [1, 7])
def test_pieces_of_batches(spark, size, monkeypatch):
    monkeypatch.setattr(periodic, "PIECE_ROWS", size)
    given = pa.record_batch({"row": pa.array(range(20)), "text": pa.array(["a " * i for i in range(20)])})
    out = list(periodic._with_runs(iter([given])))
    assert [len(r) for b in out for r in b.column("runs").to_pylist()] == [0] * 6 + [1] * 14
