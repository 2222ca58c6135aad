"""Repeated passages against a table of all windows."""

import random

import numpy as np
import pyarrow as pa
import pytest

from retort.llm import substring_dedup as s

SCHEMA = "doc_id long, text string, kept int"


def plain(rows):
    """(id, text) in order to (id, bytes left, spans)."""
    seen, out = set(), []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, dtype=bool)
        for i in range(len(raw) - 99):
            w = raw[i : i + 100]
            if w in seen:
                gone[i : i + 100] = True
            seen.add(w)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], gone])))
        spans = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
        out.append((doc, bytes(b for b, g in zip(raw, gone, strict=False) if not g), spans))
    return out


def got(df):
    return sorted(((r["row"]["doc_id"], bytes(r["kept"]), [tuple(x) for x in r["spans"]]) for r in s.without_repeats(df).collect()), key=str)


def check(spark, rows, parts=3):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], SCHEMA).repartition(parts)
    assert got(df) == sorted(plain(rows), key=str)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeéf") for _ in range(rng.randint(1, 9))) for _ in range(n))


def test_passages_copies_and_edges(spark):
    rng = random.Random(2)
    shared, line = words(rng, 40), "The line that they all hold, of sixty bytes or a little more."
    rows = [(None, shared), (0, words(rng, 3) + shared[:150]), (1, "x" * 99), (2, "x" * 100), (3, "x" * 101), (4, "x" * 350), (5, None), (6, "")]
    for k in range(60):
        base = words(rng, rng.randint(5, 80))
        at = rng.randrange(len(shared) - 50)
        rows.append((10 + 3 * k, base + shared[at : at + rng.randint(60, 260)] + words(rng, 12)))
        rows.append((11 + 3 * k, base if k % 3 else base[: len(base) // 2] + "ZZ" + base[len(base) // 2 + rng.randint(0, 3) :]))
        rows.append((12 + 3 * k, words(rng, 9) + line + words(rng, 9)))
    check(spark, rows)
    check(spark, rows, parts=1)


def test_a_long_text_over_pieces(spark):
    rng = random.Random(8)
    a = words(rng, 60_000)
    b = a[300_000:]
    check(spark, [(1, "intro " + b[5:200_000]), (2, a * 3 + "tail"), (3, "q" * 50_000 + a[:500])])


def test_buckets_of_very_many_suffixes(spark, monkeypatch):
    """One line with its own neighbours in each of 2,600 texts, and two windows more in some: its buckets are split before a task takes them."""
    split, calls = s._split, []
    monkeypatch.setattr(s, "_split", lambda low, high: calls.append((low, high)) or split(low, high))
    rng = random.Random(9)
    line = "".join(rng.choice("abcdefghij") for _ in range(102))
    rows = [(i, words(rng, 14) + (line[:99] if i % 5 else line) + words(rng, 14)) for i in range(2600)]
    check(spark, rows)
    assert (0, s.REACH) in calls and len(calls) > 1


def test_repeated_ids_and_rows(spark):
    t = "abcdefghij" * 3 + "".join(map(chr, range(300, 420)))
    df = spark.createDataFrame([(1, t, 1), (1, t, 1), (1, t + "!", 1)], SCHEMA)
    found = got(df)
    assert len(found) == 3 and sum(len(k) for _, k, _ in found) == len((t + "!").encode())  # whichever text comes first
    assert min(len(k) for _, k, _ in found) == 0


def test_empty_table_and_names(spark):
    df = spark.createDataFrame([], "doc_id long, text string, spans string, file int, path string, row int")
    out = s.without_repeats(df)
    assert out.columns == ["row", "n_bytes", "spans", "kept"] and out.count() == 0
    one = spark.createDataFrame([(1, "é" * 60, "p", 2, "q", 3)], df.schema)
    r = s.without_repeats(one).collect()[0]
    assert r["row"].asDict() == {"doc_id": 1, "text": "é" * 60, "spans": "p", "file": 2, "path": "q", "row": 3} and r["n_bytes"] == 120 and [tuple(x) for x in r["spans"]] == [(2, 120)]


def test_anchors_cover_each_window_once():
    rng = random.Random(1)
    texts = [words(rng, 70).encode(), b"a" * 130, b"short", b"", words(rng, 200).encode()]
    offsets = np.cumsum([0] + [len(t) for t in texts])
    rows = s.anchors(np.frombuffer(b"".join(texts), dtype=np.uint8), offsets)
    for i, t in enumerate(texts):
        windows = [w for r in rows[rows[:, 0] == i] for w in range(r[3], r[4] + 1)]
        assert windows == list(range(max(0, len(t) - 99)))
    assert ((rows[:, 5] >= rows[:, 4]) & (rows[:, 5] - rows[:, 3] <= s.REACH)).all()
    # fewer anchors than one in twenty windows of prose
    prose = rows[rows[:, 0] == 4]
    assert len(prose) < (len(texts[4]) - 99) / 20


@pytest.mark.parametrize("given, want", [([], []), ([(0, 5)], [(0, 5)]), ([(3, 9), (0, 3), (20, 30), (4, 6)], [(0, 9), (20, 30)]), ([(0, 50), (1, 2), (50, 51), (53, 54)], [(0, 51), (53, 54)])])
def test_merged(given, want):
    f, e = (np.array([x[i] for x in given], dtype=np.int64) for i in (0, 1))
    assert list(zip(*(x.tolist() for x in s.merged(f, e)), strict=True)) == want


def test_identifiers_are_those_of_hundred_bytes():
    rng = random.Random(3)
    data = bytes(rng.choice(b"ab") for _ in range(60)) * 6 + b"c" + b"ab" * 120
    names = s._identifiers(np.frombuffer(data, dtype=np.uint8), np.arange(len(data), 0, -1))
    where = {}
    for i in range(len(data) - 99):
        where.setdefault(data[i : i + 100], []).append(i)
    for places in where.values():
        assert len({names[i] for i in places}) == 1 and (names[places[0]] >= 0) == (len(places) > 1)
    assert (names[len(data) - 99 :] == -1).all()
    assert isinstance(s._resolved([(0, 7, 0, 0, data[:100]), (1, 8, 4, 4, data[:100])]), pa.RecordBatch)
