"""Fingerprints whose points are read once, as a row a molecule."""

import math
import random
from collections import Counter

import pytest

from retort.operators import fingerprints
from retort.streaming import jobs

SCHEMA = "mol_id string, conf_id int, point_no int, feat string, x double, y double, z double"


def drawn():
    draw = random.Random(5)
    rows = []
    for m in ["a", "b", None, *"cdefg"]:
        for c in (*range(draw.randrange(1, 4)), None):
            for i in range(draw.randrange(0, 12)):
                at = [draw.choice((draw.uniform(-9, 9), draw.uniform(-30, 30), 1.5, None, math.nan)) if draw.random() < 0.2 else draw.uniform(-9, 9) for _ in range(3)]
                rows.append((m, c, draw.choice((i, i, i, i // 2, None)), draw.choice((*fingerprints.FEATURES, "other", None)), *at))
    return rows


def pairs(rows, kept):
    """Molecule, conformer, number of the pair of types and distance of the pairs that ``kept`` takes."""
    known = [(*r[:3], fingerprints.FEATURES.index(r[3]), *r[4:]) for r in rows if r[3] in fingerprints.FEATURES and None not in r[:2] + r[4:]]
    for p in known:
        for q in known:
            if p[:2] == q[:2] and kept(p, q):
                i, j = sorted((p[3], q[3]))
                yield p[0], p[1], i * 6 - i * (i - 1) // 2 + j - i, math.dist(p[4:], q[4:])


def one_read(frame):
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    return "Join" not in plan and plan.count("LogicalRDD") == 1


def soft(rows):
    sums = {}
    for m, c, slot, d in pairs(rows, lambda p, q: None not in (p[2], q[2]) and p[2] < q[2]):
        if d < 20:
            low, part = int(d / 0.5), d / 0.5 - int(d / 0.5)
            for b, w in ((low, 1 - part), (low + 1, part)):
                if b < 40 and w > 0:
                    sums[m, slot * 40 + b, c] = sums.get((m, slot * 40 + b, c), 0) + w
    want = {}
    for (m, s, _), v in sums.items():
        want[m, s] = max(v, want.get((m, s), 0))
    return want


def histogram(rows):
    return Counter((m, slot * 40 + min(math.floor((d + 20) / 1.5), 39)) for m, _, slot, d in pairs(rows, lambda p, q: p[3] <= q[3]) if d <= 40)


def test_soft_fingerprint_reads_its_points_once(spark):
    rows = drawn()
    out = fingerprints.ph4_soft_fp(spark.createDataFrame(rows, SCHEMA))
    assert {(r[0], r[1]): r[2] for r in out.collect()} == pytest.approx(soft(rows)) and one_read(out)
    capped = fingerprints.ph4_soft_fp(spark.createDataFrame(rows, SCHEMA), cap=1.0)
    assert max(r["value"] for r in capped.collect()) == 1.0


def test_histogram_reads_its_points_once(spark):
    rows = drawn()
    out = fingerprints.ph4_histogram_fp(spark.createDataFrame(rows, SCHEMA))
    assert {(r[0], r[1]): r[2] for r in out.collect()} == dict(histogram(rows)) and one_read(out)
    many = [("a", 0, i, "ARO", 0.0, 0.0, 0.0) for i in range(17)]  # 289 pairs at one place
    for overflow, n in (("wrap", 33), ("cap", 255)):
        assert [tuple(r) for r in fingerprints.ph4_histogram_fp(spark.createDataFrame(many, SCHEMA), overflow).collect()] == [("a", 13, n)]
    assert fingerprints.ph4_histogram_fp(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("limit", [1, 7, 40])
def test_blocks_of_distances_do_not_matter(limit, monkeypatch):
    import numpy as np
    import pyarrow as pa

    draw = random.Random(limit)
    rows = [[{"conf_id": draw.randrange(3), "t": draw.randrange(6), "point_no": i, **{c: draw.uniform(0, 9) for c in "xyz"}} for i in range(n)] for n in (0, 1, 9, 2, 0, 12)]
    kind = pa.list_(pa.struct([("conf_id", pa.int32()), ("t", pa.int64()), ("point_no", pa.int32()), *((c, pa.float64()) for c in "xyz")]))

    def weigh(slot, distance):
        yield distance >= 0, slot, distance

    found = lambda: fingerprints._conformer_sums(pa.array(rows, kind), True, weigh, 21, np.maximum)
    whole = found()
    monkeypatch.setattr(fingerprints, "PAIRS_AT_ONCE", limit)
    monkeypatch.setattr(fingerprints, "CONFORMERS_AT_ONCE", 2)
    cut = found()
    assert all(a.tolist() == b.tolist() for a, b in zip(whole[:2], cut[:2], strict=True)) and cut[2].tolist() == pytest.approx(whole[2].tolist()) and len(cut[0]) > 10


def test_numbers_beside_nulls_stay_whole_in_state(spark, tmp_path):
    schema = "mol_id long, tag long, n_points long"
    big = 2**60 + 1

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = jobs.gathered(jobs.arriving(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema), "mol_id", "n_points")
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()

    run([(big, big, 4), (big, None, None), (None, big, 1)])
    run([(big, None, 4), (big, big + 1, None)])
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(big, big, 4, True), (big, None, None, True), (big, None, 4, True), (big, big + 1, None, True), (None, big, 1, True)], key=str)


def test_rows_of_a_batch_are_computed_once(spark, tmp_path):
    rows = [(m, 0, i, "ARO HBD HYD".split()[i % 3], float(i), 0.0, 1.0) for m in range(40) for i in range(6)]
    schema = spark.createDataFrame([], SCHEMA.replace("string", "long", 1)).schema
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    log = str(tmp_path / "log")

    def seen(batches):
        for batch in batches:
            with open(log, "a") as f:
                f.write(f"{batch.num_rows}\n")
            yield batch

    jobs.fingerprint_stream(jobs.arriving(spark, f"{tmp_path}/in", schema).mapInArrow(seen, schema), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    with open(log) as f:
        assert sum(map(int, f)) == len(rows)
