"""Near duplicates against all pairs."""

import itertools
import random
import re

import numpy as np
import pytest

from retort.llm import near_dedup
from retort.llm.queries import op8_near_duplicates


def shingles(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(sorted(sets), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def got(frame):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in frame.collect()}


def test_matches_all_pairs_on_documents(spark, sf_small):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op8_near_duplicates(spark, sf_small)) == plain(rows)


@pytest.mark.parametrize("productive, block", [(10, 1024), (0, 4), (10**9, 4)])
def test_chains_groups_and_odd_texts(spark, monkeypatch, productive, block):
    monkeypatch.setattr(near_dedup, "PRODUCTIVE", productive)  # none or many further rounds of hubs
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    draw = random.Random(5)
    base = [f"w{draw.randrange(400)}" for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(["", "   ", "one", "One", "one two three four", "ONE TWO three four", None, "é ü ö ß ñ", "É ü ö ß ñ"])]
    at = 20
    for step in range(12):  # a chain: each differs a little from the one before
        base = base[:]
        base[10 * step % 120] = f"x{step}"
        rows.append((at, " ".join(base)))
        at += 1
    rows += [(at + i, "same text of more than five words here") for i in range(30)]
    rows += [(200 + i, " ".join(base[:110] + [f"y{draw.randrange(3)}" for _ in range(5)])) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(near_dedup.near_duplicates(frame)) == plain(rows)


def test_large_group_just_below_and_above(spark):
    """Copies of one text that is not there itself, two at a time mostly a little below 0.75; every replacement is new, so that sets share shingles of the text only."""
    draw, new = random.Random(9), itertools.count()
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(2500):
        text = base[:]
        for at in draw.sample(range(2, 148), draw.choice((1, 2, 2, 3, 3, 3, 3))):
            text[at] = f"n{next(new)}"
        rows.append((i, " ".join(text)))
    bare = [tuple(base[i : i + 5]) for i in range(146)]
    holds = np.array([[s in own for s in bare] for own in (shingles(t) for _, t in rows)], dtype=np.float32)
    both = holds @ holds.T
    linked = 100 * both >= 75 * (2 * 146 - both)
    assert 0.02 < linked.mean() < 0.5
    want, left = {}, set(range(len(rows)))
    for i in range(len(rows)):
        if i in left:
            reached, fresh = {i}, [i]
            while fresh:
                more = set(np.flatnonzero(linked[fresh].any(axis=0)).tolist()) - reached
                reached |= more
                fresh = sorted(more)
            left -= reached
            want |= dict.fromkeys(reached, i)
    assert {i: c[1] for i, c in got(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))).items()} == want


def test_repeated_ids_with_texts_of_their_own(spark):
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, one), (1, two), (2, one), (3, two), (4, one + " z"), (5, two + " z"), (1, one)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(tuple(r) for r in near_dedup.near_duplicates(frame).select("doc_id", "component_id", "kept").collect())
    assert found == [(1, 1, True)] * 3 + [(i, 1, False) for i in (2, 3, 4, 5)]
    assert sorted(tuple(r) for r in near_dedup.deduplicated(frame).collect()) == [(1, one), (1, two)]


def test_empty_null_ids_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_duplicates(empty).count() == 0
    rows = [(None, "a b c d e f g", 1, "q"), (None, "a b c d e f g", 2, "r"), (3, "a b c d e f g", 3, "s"), (3, "a b c d e f g", 3, "s"), (4, "A b c d e f g", 4, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long, component string")
    kept = near_dedup.deduplicated(docs)
    assert kept.columns == docs.columns and sorted((r[0] or 0) for r in kept.collect()) == [0, 0, 3]


def test_small_tables_between_steps_are_few_tasks(spark, sf_small):
    """What the driver keeps of tasks must not be a multiple of the shuffle partitions for each of many small tables."""
    settings = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    context = spark.sparkContext
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        context.setJobGroup("few tasks", "near duplicates")
        assert op8_near_duplicates(spark, sf_small).count() > 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("few tasks") for s in tracker.getJobInfo(j).stageIds]
    tasks = sum(s.numCompletedTasks for s in stages if s)
    assert 0 < tasks < 2500  # 1,462; with checkpoints 4,885
