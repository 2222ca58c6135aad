"""Repair of conversations against a plain program over whole conversations."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from retort.llm import conversations as c

AFTER = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def plain(rows):
    """Counts, cost, audit and digest of one conversation: forward, with the least (cost, audit) and the lines of each state."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None)
        seen.add((role, text))
    best = {"": (0, "", [])}

    def inserted(best):
        out = dict(best)
        for _ in range(3):
            for s, (cost, audit, lines) in list(out.items()):
                for new in "ua":
                    if (t := AFTER.get((s, new))) and (cost + 2, audit + "I") < out.get(t, (1e9, ""))[:2]:
                        out[t] = (cost + 2, audit + "I", [*lines, c._ROLES[new] + ":"])
        return out

    for (_, role, text), fault in zip(rows, faults, strict=True):
        made = {}
        for s, (cost, audit, lines) in inserted(best).items():
            more = fault == "truncated"
            ways = [(3, "D", s, None)]
            if fault not in ("blank", "duplicate"):
                ways += [(more, "K", AFTER.get((s, role[:1])), f"{role}:{text}")] + [(2 + more, "R", AFTER.get((s, x)), f"{c._ROLES[x]}:{text}") for x in "ua"]
            for price, act, t, line in ways:
                if t is not None and (cost + price, audit + act) < made.get(t, (1e9, ""))[:2]:
                    made[t] = (cost + price, audit + act, lines if line is None else [*lines, line])
        best = made
    cost, audit, lines = min(v[:3] for s, v in inserted(best).items() if s in ("", "a"))
    known = [t for t, _, _ in rows if t is not None]
    pairs = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (max(known) - min(known) + 1 - len(set(known)) if known else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], pairs, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def compared(spark, rows):
    got = {r[0]: tuple(r)[1:] for r in c.digests(c.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    want = {k: plain([(t, r if r is not None else " ", x if x is not None else " ") for i, t, r, x in rows if i == k]) for k in {r[0] for r in rows}}
    assert got == want
    return got


def made(rng, n):
    roles = ["user", "assistant", "system", "tool", "", None, "assistant", "user"]
    texts = ["Yes.", "No", "Well?", "", " \t", "So it is!", "cut off,", "Yes.", None, "é.", "…"]
    return [(rng.choice([None, i, i, i, i // 2]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.4 else f"{rng.random()}{rng.choice(['.', '', '?'])}") for i in range(n)]


def test_short_conversations(spark):
    rng = random.Random(3)
    compared(spark, [(k if k else None, *row) for k in range(150) for row in made(rng, rng.randint(1, 9))])


def test_long_conversations_over_blocks_and_partitions(spark):
    rng = random.Random(4)
    rows = [(k, *row) for k, n in ((1, 1500), (2, 64), (3, 65), (4, 3), (5, 400)) for row in made(rng, n)]
    got = compared(spark, rows)
    assert len(got[1][6]) > 1000
    # one state leads into every block: turns of one role only
    compared(spark, [(9, i, "user", f"{i}.") for i in range(700)] + [(8, i, "assistant", f"{i}") for i in range(300)])


def test_blocks_grow_and_folds_hold():
    rng = random.Random(6)
    for _ in range(50):
        codes = "".join(rng.choice("suaxSUAXd") for _ in range(rng.randint(2, 60)))
        cut = rng.randint(1, len(codes) - 1)
        m = c.matrix(codes[cut:])
        end = [min(m[4 * s + t] + c.FINAL[t] for t in range(4)) for s in range(4)]
        first, state = c.walk(codes[:cut], 0, tuple(end), False)
        second, _ = c.walk(codes[cut:], state, tuple(c.FINAL), True)
        assert first + second == c.walk(codes, 0, tuple(c.FINAL), True)[0]


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert c.digests(c.repaired(c.damaged(empty))).count() == 0
    rows = spark.createDataFrame([(None, None, None, None, "x", 1), (1, 0, "user", "Hi." + "y" * 100_000, "x", 2)], "conv_id long, turn long, role string, text string, edits string, code int")
    got = {r["conv_id"]: r for r in c.digests(c.repaired(rows)).collect()}
    assert got[None]["audit"] == "D" and got[None]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[1]["audit"] in ("DII", "D", "KI") and got[1]["truncated"] == 1


def test_dropped_conversations_stay(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi.", True), (2, 0, "user", "Hi.", False), (2, 1, "user", "Hi.", True), (2, 3, "assistant", "Ho.", False)], "conv_id long, turn long, role string, text string, dropped boolean")
    got = sorted(tuple(r)[:8] for r in c.digests(c.repaired(rows)).collect())
    assert got == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 2, 0, 0, 0, 0, 0, "KK")]


@pytest.mark.parametrize("kind, want", [(0, []), (1, [("user", "")]), (2, [("user", "ab")]), (3, [("user", "a.b!")] * 2), (4, [("user", "a.b!")]), (5, [("user", "a.b!")])])
def test_damage(spark, kind, want):
    import zlib

    turn = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == kind)
    given = spark.createDataFrame([(7, turn, "assistant" if kind == 4 else "user", "a.b!")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in c.damaged(given).filter(~F.col("dropped")).select("role", "text").collect()] == want
