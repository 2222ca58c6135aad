"""Mixing against plain Python."""

import hashlib
import math
import random
import re

from retort.llm import mixing
from retort.llm.queries import op3_source_mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(totals):
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(totals.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * totals[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = 2.0 * totals[s]
            left -= 2 * totals[s]
        open_ -= over
    return target


def plain(rows, seed="mix-1"):
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    sized = [(i, s, len(WORD.findall(t or "")), md5(f"{seed}:{'null' if i is None else i}:{md5(t or '')}")[:16]) for i, t, s in rows]
    totals = {}
    for _, s, n, _ in sized:
        totals[s] = totals.get(s, 0) + n
    target, out = plain_targets(totals), []
    for s in totals:
        mine = sorted((key, i is not None, i or 0, n) for i, t, n, key in sized if t == s)
        quota, at = math.floor(target[s] + 1e-9), 0
        full = quota // totals[s] if totals[s] else 0
        rest = quota - full * totals[s]
        for _, known, i, n in mine:
            out.append((i if known else None, n, totals[s], target[s], full * n + max(0, min(n, rest - at))))
            at += n
    return sorted(out, key=lambda r: (r[0] is None, r))


def same(got, expected):
    got = sorted((tuple(r) for r in got), key=lambda r: (r[0] is None, r))
    assert len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-6 and a[4] == b[4]


def test_query_matches_plain(spark, sf_small):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text", "source").collect()]
    out = op3_source_mixing(spark, sf_small)
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken"]
    same(out.collect(), plain(rows))


def test_odd_sources_ties_and_bucket_counts(spark, monkeypatch):
    draw = random.Random(2)
    rows = [(i, "w " * draw.randrange(40), draw.choice(["b", "a", None, "", "é", "hot", "hot", "hot", "hot"])) for i in range(300)]
    rows += [(5, "w w", "a"), (5, "w w", "a"), (None, None, None), (900, "x", "solo"), (901, None, "zero")] + [(None, f"n{i} " * (i % 9), "hot") for i in range(30)] + [(7, f"m{i} " * (i % 9), "hot") for i in range(30)]
    docs = spark.createDataFrame([(*r, 1, "k", 2, 3) for r in rows], "doc_id long, text string, source string, size int, key string, row int, _size int")
    for buckets, broadcast in ((1, 0), (7, 9), (1024, 9)):
        monkeypatch.setattr(mixing, "MOST_BROADCAST_SOURCES", broadcast)
        out = mixing.mix(docs, buckets=buckets).select("row.doc_id", "size", "source_size", "target", "taken").collect()
        same(out, plain(rows))
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixed_documents_follow_the_plan(spark):
    docs = spark.createDataFrame([(i, "  a b\tc d " * (i % 5), "s" if i % 4 else "t", 0) for i in range(40)], "doc_id long, text string, source string, n_chars long")
    plan = {r["row"]["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    got = {}
    for r in mixing.mixed_documents(docs).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    assert got == {i: n for i, n in plan.items() if n}
