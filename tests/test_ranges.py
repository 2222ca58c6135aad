"""Records by byte ranges and packed files."""

import os
import random

import pytest
from pyspark.sql import functions as F

from retort.sources import io, ranges

ATOM = "{:>10.4f}{:>10.4f}{:>10.4f} {:<3} 0  0  0  0  0  0  0  0  0  0  0  0"


def sdf(name, n, end="\n", field="a value"):
    atoms = [ATOM.format(i * 1.5, 0.25 * i, -i, "CNO"[i % 3]) for i in range(n)]
    bonds = [f"{i:>3}{i + 1:>3}  1  0  0  0  0" for i in range(1, n)]
    return end.join([name, "  made", "", f"{n:>3}{n - 1:>3}  0  0  0  0  0  0  0  0999 V2000", *atoms, *bonds, "M  END", "> <note>", field, "", "$$$$", ""])


def test_sdf_ranges_give_the_same_records(spark, tmp_path):
    rng = random.Random(1)
    texts = [sdf(f"m{i}", rng.randint(1, 6), "\r\n" if i % 4 == 0 else "\n", "cost $$$$ in a field" if i % 5 == 0 else "x") for i in range(40)]
    (tmp_path / "a.sdf").write_bytes("".join(texts[:39]).encode())
    (tmp_path / "b.sdf").write_bytes(texts[39].rstrip("\r\n").encode())
    (tmp_path / "empty.sdf").write_bytes(b"")
    want = None
    for size in (100, 333, 10_000, 1 << 20):
        mols, atoms, bonds, rejects = io.read_sdf_ranges(spark, str(tmp_path), size)
        places = sorted((os.path.basename(r["file"]), r["start"], r["name"], r["properties"]["note"]) for r in mols.collect())
        counts = (atoms.count(), bonds.count(), rejects.count(), atoms.join(mols, "mol_id").count())
        want = want or (places, counts)
        assert (places, counts) == want
    assert len(want[0]) == 40 and want[1][2] == 0 and want[1][0] == want[1][3]
    assert ("a.sdf", 0, "m0", "cost $$$$ in a field") in want[0] and ("b.sdf", 0, "m39", "x") in want[0]


def test_unreadable_records_are_rows_of_their_own(spark, tmp_path):
    bad = ["short\n$$$$\n", "b\n\n\n  x  y\n$$$$\n", sdf("c", 4).replace("    1.5000", "    zzzzzz")]
    (tmp_path / "a.sdf").write_text(sdf("one", 3) + "".join(bad) + sdf("two", 2))
    mols, _, _, rejects = io.read_sdf_ranges(spark, str(tmp_path), 64)
    assert sorted(r["name"] for r in mols.collect()) == ["one", "two"]
    got = sorted((r["start"], r["reason"]) for r in rejects.collect())
    assert [x for _, x in got] == ["no counts line", "unreadable counts line", "unreadable or missing atom or bond lines"] and got[0][0] == len(sdf("one", 3))


@pytest.mark.parametrize("size", [1, 7, 50, 10_000])
def test_lines_and_points(spark, tmp_path, size):
    (tmp_path / "x.smi").write_text("title\nCCO a\n\nC" + "C" * 300 + " long\nN\n")
    got = sorted((r["start"], r["record"].split()[0][:3]) for r in ranges.read_records(spark, str(tmp_path / "x.smi"), "smi", size).collect())
    assert got == [(0, "tit"), (6, "CCO"), (13, "CCC"), (320, "N")]
    (tmp_path / "p.txt").write_text("3:one\nARO 1 2 3\nHBD 0 0 0.5\n3:two:x\n\n3:three\nbad line\nHYD -1 2 1e1")
    records = ranges.read_records(spark, str(tmp_path / "p.txt"), "points", size)
    assert records.count() == 3
    points = sorted(tuple(r) for r in ranges.parsed_points(records).collect())
    assert points == [("one", 0, "ARO", 1.0, 2.0, 3.0), ("one", 1, "HBD", 0.0, 0.0, 0.5), ("three", 1, "HYD", -1.0, 2.0, 10.0)]


def test_packed_points_and_their_index(spark, tmp_path):
    path = str(tmp_path / "packed")
    rows = [(m, i, "ARO", float(m), float(i), 0.5) for m in range(200) for i in range(m % 4 + 1)]
    points = spark.createDataFrame(rows, "mol_id long, point_no int, feat string, x double, y double, z double")
    ranges.write_records(ranges.point_records(points).repartition(3, "mol_id"), path)
    files = os.listdir(path)
    assert len([f for f in files if not f.endswith(".index")]) <= 3 and not any(f.startswith("_temporary") for f in files)
    back = ranges.parsed_points(ranges.read_records(spark, path, "points", 100))
    assert sorted((int(r["name"]), *tuple(r)[1:]) for r in back.collect()) == sorted((m, *rest) for m, *rest in rows)
    for r in ranges.read_index(spark, path).filter("mol_id in (0, 77, 199)").collect():
        with open(f"{path}/{r['file']}", "rb") as f:
            f.seek(r["start"])
            assert f.read(r["length"]).decode().startswith(f"3:{r['mol_id']}\nARO {r['mol_id']}.0000")
    ranges.write_records(spark.createDataFrame([(1, "3:1\nARO 1 1 1")], "mol_id long, record string"), path, overwrite=True)
    assert ranges.read_index(spark, path).count() == 1 and ranges.read_records(spark, path, "points").count() == 1


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "packed")
    rows = spark.range(100).repartition(4).select(F.col("id").alias("mol_id"), F.when(F.col("id") == 57, F.raise_error(F.lit("no"))).otherwise(F.lit("3:x")).cast("string").alias("record"))
    with pytest.raises(Exception):
        ranges.write_records(rows, path)
    assert not os.path.exists(path) or os.listdir(path) == []
    with pytest.raises(Exception, match="unknown kind"):
        ranges.read_records(spark, str(tmp_path), "mol2").count()
