"""Hand-worked values for the rules that are easy to get wrong."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from retort.operators import evaluation, features, fingerprints, molecules, ranking, reactions, routes, similarity, voxels
from retort.sources import io
from retort.streaming import jobs

POINTS = "mol_id long, conf_id int, point_no int, feat string, x double, y double, z double"


def slots(df):
    return {r["slot"]: r["value"] for r in df.collect()}


def test_histogram_counts_ordered_pairs_with_self_pairs(spark):
    points = spark.createDataFrame([(1, 0, 0, "ARO", 0.0, 0.0, 0.0), (1, 0, 1, "ARO", 3.0, 0.0, 0.0), (1, 0, 2, "HBD", 0.0, 0.0, 0.0)], POINTS)
    got = slots(fingerprints.ph4_histogram_fp(points))
    assert got[13] == 2 and got[15] == 2  # ARO-ARO: self pairs at 0, both orders at 3
    assert got[40 + 13] == 1 and got[40 + 15] == 1  # ARO-HBD, each once
    assert got[6 * 40 + 13] == 1 and sum(got.values()) == 7


def test_histogram_wraps_or_caps(spark):
    points = spark.createDataFrame([(1, 0, i, "HYD", 1.0, 1.0, 1.0) for i in range(16)], POINTS)
    assert slots(fingerprints.ph4_histogram_fp(points)) == {}
    assert slots(fingerprints.ph4_histogram_fp(points, "cap")) == {20 * 40 + 13: 255}


def test_histogram_bins_match_numpy(spark):
    distances = [0.0, 1.4999999, 1.5, 3.0, 7.5, 39.999, 40.0, 40.0001, 2.9999999999, 12.0]
    got = [r[0] for r in spark.createDataFrame([(d,) for d in distances], "d double").select(fingerprints.histogram_bin(F.col("d"))).collect()]
    for d, b in zip(distances, got, strict=True):
        counts, _ = np.histogram([d], bins=40, range=(-20, 40))
        assert (int(counts.argmax()) if counts.sum() else None) == b


def test_greedy_clusters_chain(spark):
    points = spark.createDataFrame([(1, 0, i, "HYD", 1.5 * i, 0.0, 0.0) for i in range(3)] + [(1, 0, 3, "ARO", 9.0, 0.0, 0.0)], POINTS)
    rows = {r["feat"]: r for r in fingerprints.cluster_points(points).collect()}
    assert len(rows) == 2 and rows["HYD"]["x"] == pytest.approx(1.5)
    assert fingerprints.cluster_points(points, enabled=False).count() == 4


def test_gaussian_is_normalized(spark):
    points = spark.createDataFrame([(1, 0, i, f, float(i), 0.0, 0.0) for i, f in enumerate(("ARO", "ARO", "HBD", "NEG"))], POINTS)
    values = slots(fingerprints.ph4_gaussian_fp(points))
    assert sum(v * v for v in values.values()) == pytest.approx(1.0)
    with pytest.raises(ValueError):
        fingerprints.fingerprint("none")
    with pytest.raises(ValueError):
        fingerprints.fingerprint("ph4_gaussian", points, dim=64)


def test_major_fragment_first_on_ties(spark):
    rows = spark.createDataFrame([("CC.CCC.OOO",), ("CCO",), ("",), ("A.BB",)], "s string").select(molecules.major_fragment(F.col("s"))).collect()
    assert [r[0] for r in rows] == ["CCC", "CCO", "", "BB"]


def test_matrix_seeds_counts_and_partners(spark):
    matches = spark.createDataFrame([(1, 7, 0), (2, 7, 1), (3, 7, 0), (3, 7, 1), (3, 7, 1), (1, 8, 0), (2, 9, 1)], "reactant_id int, rxn_id int, slot int")
    table = spark.createDataFrame([(7, 2), (8, 1), (9, 2), (10, 2)], "rxn_id int, n_reactants int")
    matrix = reactions.reaction_matrix(matches)
    assert {(r[0], r[1]): r[2] for r in matrix.collect()} == {(1, 7): 1, (2, 7): 2, (3, 7): 3, (1, 8): 1, (2, 9): 2}
    assert sorted(r["rxn_id"] for r in reactions.seed_reactions(matrix, table).collect()) == [7, 8]
    assert {r[0]: r[1] for r in reactions.reactant_count(matrix, table).collect()} == {7: 3, 8: 1, 9: 1, 10: 0}
    picks = spark.createDataFrame([(1, 7, 1)], "pick_id int, rxn_id int, slot_flag int")
    assert sorted(r["reactant_id"] for r in reactions.partners(matrix, picks).collect()) == [2, 3]
    assert reactions.partner_counts(matrix, picks).first()["n_partners"] == 2
    assert {r[0]: r[1] for r in reactions.match_reactions(matches).collect()}[3] == {7: [0, 1]}


def test_ranking_ties_and_missing(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 1.0, 0), ("a", None, 2), (None, 5.0, 3), ("b", None, 4)], "k string, v double, s int")
    assert sorted((r["k"], r["s"]) for r in ranking.top_n(df, ["k"], "v", 2, "s").collect()) == [("a", 0), ("a", 1), ("b", 4)]
    assert [(r["k"], r["s"]) for r in ranking.best_row(df.filter("k is not null"), ["k"], "v", "s").collect()] == [("a", 0)]


def route_frame(spark):
    rows = [(1, 0, 0, 4, "A"), (1, 1, 0, 9, "B"), (1, 2, 2, 5, "AB"), (1, 3, 1, 7, "ABC")]
    return features.route_arrays(spark.createDataFrame(rows, "route_id long, pos int, n_reactants int, ref_idx int, smiles string"))


def test_route_forms(spark):
    row = features.route_sequences(route_frame(spark)).select("*", features.action_string().alias("act"), features.count_reactions().alias("n"), features.molecule_indices().alias("m")).first()
    assert row["act"] == "A;B;R5;R7" and row["n"] == 2 and row["m"] == [4, 9, None, None]
    assert row["token_types"] == [1, 3, 3, 2, 2, 0] and row["rxn_indices"] == [0, 0, 0, 5, 7, 0] and row["reactant_indices"] == [None, 4, 9, None, None, None]
    edges = {(r["child_pos"]): (r["parent_pos"], r["child_no"], r["depth"]) for r in routes.route_edges(route_frame(spark)).collect()}
    assert edges == {3: (None, 0, 0), 2: (3, 0, 1), 0: (2, 0, 2), 1: (2, 1, 2)}


def test_padding_crops_and_batches(spark):
    row = spark.createDataFrame([([1, 2, 3],)], "a array<int>").select(features.padded(F.col("a"), 2, F.lit(0)), features.padded(F.col("a"), 5, F.lit(0)), *features.time_shift(F.col("a"))).first()
    assert list(row) == [[1, 2], [1, 2, 3, 0, 0], [1, 2], [2, 3]]
    df = spark.range(7).withColumn("v", F.col("id") * 2)
    assert sorted(len(r["rows"]) for r in features.batches(df, 3, "id").collect()) == [1, 3, 3]
    assert features.batches(df, 3, "id", drop_last=True).count() == 2


def test_tokens_take_the_longest_and_skip_unknown(spark):
    ids = spark.createDataFrame([("CClBr?C[nH]",)], "s string").select(features.tokenize_smiles(F.col("s"), ("C", "Cl", "Br", "[nH]", "B"))).first()[0]
    assert ids == [1, 2, 3, 1, 4]


@pytest.mark.parametrize("parts", [1, 5])
def test_knn_is_exact(spark, parts):
    rng = np.random.default_rng(parts)
    base, ask = rng.integers(0, 9, (200, 12)), rng.integers(0, 9, (15, 12))
    index = spark.createDataFrame([(i, [int(x) for x in v]) for i, v in enumerate(base)], "idx long, fp array<int>").repartition(parts)
    queries = spark.createDataFrame([(i, [int(x) for x in v]) for i, v in enumerate(ask)], "query_id long, fp array<int>")
    got = {(r["query_id"], r["rank"]): (r["distance"], r["idx"]) for r in similarity.knn_l1(queries, index, 4, block=6).collect()}
    for q, v in enumerate(ask):
        best = sorted((float(np.abs(base[i] - v).sum()), i) for i in range(200))[:4]
        assert [got[(q, k + 1)] for k in range(4)] == best


def test_average_precision_with_ties(spark):
    rng = np.random.default_rng(2)
    truth, score = rng.integers(0, 2, 60), np.round(rng.random(60), 1)
    df = spark.createDataFrame([(0, int(t), float(s)) for t, s in zip(truth, score, strict=True)] + [(1, 0, 0.5)], "bit int, truth int, score double")
    (row,) = evaluation.evaluate_bits(df).collect()
    ap = auc = tp = seen = 0.0
    for s in sorted(set(score), reverse=True):
        p, n = truth[score == s].sum(), (score == s).sum()
        auc += (n - p) * (tp + p / 2)
        tp, seen = tp + p, seen + n
        ap += p / truth.sum() * tp / seen
    assert row["average_precision"] == pytest.approx(ap) and row["roc_auc"] == pytest.approx(auc / (truth.sum() * (60 - truth.sum())))


def test_atom_at_the_origin(spark):
    atom = spark.createDataFrame([(1, "C", 0.0, 0.0, 0.0)], "mol_id int, element string, x double, y double, z double")
    assert [tuple(r) for r in voxels.grid_coordinates(atom).select("gx", "gy", "gz").collect()] == [(30, 30, 30)]
    whole = voxels.shapes(atom, voxels.atom_stamps(spark))
    cells = {tuple(r)[1:] for r in voxels.shapes(atom, voxels.atom_stamps(spark), crop=21).collect()}
    ball = {(10 + i, 10 + j, 10 + k) for i in range(-4, 5) for j in range(-4, 5) for k in range(-4, 5) if math.sqrt(i * i + j * j + k * k) * 0.5 <= 1.908}
    assert cells == ball and {tuple(r) for r in voxels.crop(whole, 21).select("x", "y", "z").collect()} == ball
    out = voxels.patches(voxels.crop(whole, 21), 3, 21).collect()
    assert len(out) == 343 and all(len(r["values"]) == 27 for r in out) and sum(sum(r["values"]) for r in out) == len(ball)
    with pytest.raises(ValueError):
        voxels.patches(whole, 4, 21)


def test_grid_rounds_half_to_even_and_rotations(spark):
    atoms = spark.createDataFrame([(1, "C", 0.25, 0.75, -0.25)], "mol_id int, element string, x double, y double, z double")
    assert tuple(voxels.grid_coordinates(atoms).select("gx", "gy", "gz").first()) == (30, 32, 30)
    turns = voxels.box_rotations()
    assert len(turns) == 24 and len({m.tobytes() for m in turns}) == 24 and np.array_equal(turns[0], np.eye(3))
    for sp, rp in ((2, 4), (3, 5)):
        fine = voxels.fine_rotations(sp, rp)
        assert len(fine) == 1 + 3 * sp * sp * (rp - 1) and np.array_equal(fine[0], np.eye(3))
        grid = [(i - sp // 2) / sp for i in range(sp)]
        axes = [(0.5, a, b) for a in grid for b in grid] + [(a, b, 0.5) for a in grid for b in grid] + [(a, 0.5, b) for a in grid for b in grid]
        for n, m in enumerate(fine[1:]):
            axis, angle = np.array(axes[n // (rp - 1)]), (n % (rp - 1) + 1) * math.pi / (rp / 2)
            assert np.allclose(m @ axis, axis) and np.trace(m) == pytest.approx(1 + 2 * math.cos(angle)) and np.linalg.det(m) == pytest.approx(1)
            assert (m[2, 1] - m[1, 2]) * axis[0] + (m[0, 2] - m[2, 0]) * axis[1] + (m[1, 0] - m[0, 1]) * axis[2] == pytest.approx(2 * math.sin(angle) * np.linalg.norm(axis))
    point = spark.createDataFrame([(1, 1.0, 2.0, 3.0)], "mol_id int, x double, y double, z double")
    m = turns[7]
    row = voxels.rotate_all(point, voxels.rotation_table(spark, [m])).first()
    assert np.allclose([row["x"], row["y"], row["z"]], m @ [1, 2, 3])


def test_neighbourhood_matches_box_counts(spark):
    marked = [(1, 0, 0, 0), (1, 1, 0, 0), (1, 4, 4, 4)]
    got = {tuple(r)[1:4]: r["value"] for r in voxels.neighbourhood_counts(spark.createDataFrame(marked, "mol_id int, x int, y int, z int"), 5, 1).collect()}
    expected = {}
    for _, x, y, z in marked:
        for i in range(max(0, x - 1), min(5, x + 2)):
            for j in range(max(0, y - 1), min(5, y + 2)):
                for k in range(max(0, z - 1), min(5, z + 2)):
                    expected[(i, j, k)] = expected.get((i, j, k), 0) + 1
    assert got == expected


def test_push_reaction_and_routes_do_not_depend_on_partitions(spark):
    products = spark.createDataFrame([(5, "A", "B", "P"), (5, "B", "A", "Q"), (5, "A", "B", "R"), (6, "P", None, "S")], "rxn_id int, left string, right string, product string")
    run = routes.table_executor(products)
    state = spark.createDataFrame([(1, 5, 2, [], [["A"], ["B"]]), (2, 6, 1, [], [["X"]]), (3, 5, 2, [], [["A"]])], f"route_id long, rxn_id int, n_reactants int, steps array<{routes.STEP}>, stack array<array<string>>")
    (out,) = routes.push_reaction(state, run).collect()
    assert out["route_id"] == 1 and len(out["stack"]) == 1 and sorted(out["stack"][0]) == ["P", "Q", "R"]
    (cut,) = routes.push_reaction(state, run, limit=1).collect()
    assert len(cut["stack"][0]) == 1
    other = routes.push_reaction(state.filter("route_id = 2"), routes.function_executor(lambda f: pd.Series([["Y"] for _ in range(len(f))])))
    assert other.first()["stack"] == [["Y"]]


def test_no_reaction_is_run_twice(spark):
    asked = []

    def execute(pairs):
        asked.extend(tuple(r) for r in pairs.collect())
        return pairs.filter("rxn_id <> 7").withColumn("product", F.concat("left", F.coalesce("right", F.lit("-")), F.col("rxn_id").cast("string")))

    state = spark.createDataFrame([(1, 5, 2, [], [["A"], ["B"]]), (2, 6, 1, [], [["X"]]), (3, 5, 2, [], [["A"], ["B"]]), (4, 7, 2, [], [["A"], ["B"]])], f"route_id long, rxn_id int, n_reactants int, steps array<{routes.STEP}>, stack array<array<string>>")
    want = sorted((r["route_id"], r["stack"]) for r in routes.push_reaction(state, execute).collect())
    plain, asked[:] = len(asked), []
    run = routes.Remembered(execute)
    for rounds in range(3):
        assert sorted((r["route_id"], r["stack"]) for r in routes.push_reaction(state, run).collect()) == want
    assert run.executed == len(asked) == len(set(asked)) == 5 < plain  # A-B and B-A by two reactions, X alone; those without a product are known too
    more = state.filter("route_id = 2").withColumn("stack", F.array(F.array(F.lit("Y"))))
    assert routes.push_reaction(more, run).first()["stack"] == [["Y-6"]] and run.executed == 6
    assert routes.Remembered(execute)(state.limit(0).select("route_id", "rxn_id", F.lit("A").alias("left"), F.lit("B").alias("right"))).count() == 0


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "r.txt").write_text("C.O>>CO\n\nN>Cl>NC\n")
    rows = io.read_reactions(spark, str(tmp_path / "r.txt")).orderBy("rxn_id").collect()
    assert [(r["reactants"], r["agents"], r["products"]) for r in rows] == [(["C", "O"], [], ["CO"]), (["N"], ["Cl"], ["NC"])]
    (tmp_path / "m.smi").write_text("title\nCCO eth\nCC\n")
    assert sorted(r["smiles"] for r in io.read_smi_molecules(spark, str(tmp_path / "m.smi")).collect()) == ["CC", "CCO"]
    (tmp_path / "crlf.smi").write_bytes(b"title x\r\nCCO eth\r\n\r\n  CC\r\n" + b"".join(b"C%d n\r\n" % i for i in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    rows = io.read_smi_molecules(spark, str(tmp_path / "crlf.smi")).orderBy("seq").collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["smiles"] for r in rows] == ["CCO", "CC"] + [f"C{i}" for i in range(500)] and len({r["mol_id"] for r in rows}) == 502 and rows[0]["name"] == "eth" and rows[1]["name"] is None
    (tmp_path / "m.csv").write_text("SMILES,v\nCCO,1\n")
    assert io.read_molecules(spark, str(tmp_path / "m.csv")).first()["smiles"] == "CCO"
    with pytest.raises(ValueError):
        io.read_csv_molecules(spark, str(tmp_path / "m.csv"), "none")
    (tmp_path / "v.txt").write_text("C\nCl\n")
    assert {r[0]: r[1] for r in io.read_vocabulary(spark, str(tmp_path / "v.txt")).collect()} == {"C": 1, "Cl": 2}
    (tmp_path / "p.pdbqt").write_text("MODEL 1\n VINA RESULT:  -7.5  0 0\nx\n VINA RESULT:  -7.1 1 2\n")
    assert [(r["mode_id"], r["affinity"]) for r in io.read_docked_poses(spark, str(tmp_path / "p.pdbqt")).orderBy("mode_id").collect()] == [(1, -7.5), (2, -7.1)]
    (tmp_path / "k.txt").write_text("Pocket 1 10.5\njunk\nPocket x 3\nPocket 2 12\n")
    assert [r["pocket_id"] for r in io.read_pockets(spark, str(tmp_path / "k.txt")).orderBy("line_no").collect()] == [1, 2]
    (tmp_path / "f.ph4").write_text("3:mol\nARO 1 2 3\nHBD 0 0 1.5\n")
    assert [tuple(r)[2:] for r in io.read_points(spark, str(tmp_path / "f.ph4")).orderBy("point_no").collect()] == [("ARO", 1.0, 2.0, 3.0), ("HBD", 0.0, 0.0, 1.5)]
    atom = "{:10.4f}{:10.4f}{:10.4f} {:<3} 0  0\n"
    sdf = "eth\n  x\n\n  3  2  0  0\n" + atom.format(0, 0, 0, "C") + atom.format(1.5, 0, 0, "O") + atom.format(2, 1, 0, "H") + "  1  2  1\n  2  3  1\nM  END\n> <id>\n7\n\n$$$$\n"
    (tmp_path / "m.sdf").write_text(sdf * 2)
    mol, atoms, bonds = io.read_sdf(spark, str(tmp_path / "m.sdf"), without_hydrogens=True)
    assert mol.first()["properties"] == {"id": "7"} and {r["element"] for r in atoms.collect()} == {"C", "O"} and {(r["a"], r["b"]) for r in bonds.collect()} == {(0, 1)}
    assert mol.count() == 2 and sorted(r["count"] for r in atoms.groupBy("mol_id").count().collect()) == [2, 2]
    blank = sdf.replace("eth", "")
    (tmp_path / "crlf.sdf").write_bytes((sdf + blank + sdf + "junk\n$$$$\n" + sdf.replace("eth", "last")).replace("\n", "\r\n").encode())
    mol, atoms, _ = io.read_sdf(spark, str(tmp_path / "crlf.sdf"))
    assert [r["name"] for r in mol.orderBy("seq").collect()] == ["eth", "", "eth", "last"]
    assert sorted(r["count"] for r in atoms.groupBy("mol_id").count().collect()) == [3] * 4
    io.write_results(spark.createDataFrame([(1.23456, None), (None, "x")], "v double, s string").coalesce(1), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert "1.235" in text and text.count("v,s") >= 1
    io.write_pdb(atoms, str(tmp_path / "pdb"))
    assert any("TER" in p.read_text() for p in (tmp_path / "pdb").glob("*/*.txt"))
    built = []
    for _ in range(2):
        io.saved_or_built(spark, str(tmp_path / "cache"), lambda: built.append(1) or spark.range(3))
    assert built == [1]


def test_streams_restart_where_they_stopped(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "csmiles string, n int")
    rows.write.parquet(f"{tmp_path}/in")
    out, state = f"{tmp_path}/out", f"{tmp_path}/state"
    stream = lambda: jobs.distinct_stream(jobs.arriving(spark, f"{tmp_path}/in", rows.schema), "csmiles", out, state)
    stream().awaitTermination()
    spark.createDataFrame([("b", 4), ("c", 5)], "csmiles string, n int").write.mode("append").parquet(f"{tmp_path}/in")
    stream().awaitTermination()
    assert sorted(r["csmiles"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_goal_report_drops_nulls_and_property_scores(spark):
    evaluation.register_scorer("my property", lambda s: s.str.len())
    df = spark.createDataFrame([("my_property", "CCO")], "property string, smiles string")
    assert evaluation.property_scores(df, "property", "smiles").first()["property_score"] == 3.0
    source = spark.createDataFrame([("m", "A", "p", 1.0, -1.0, 0), ("n", "best_from_chembl", "p", 2.0, -1.0, 1), ("o", "A", "p", 3.0, -1.0, 2)], "original_smiles string, method string, property string, objective double, tb_synthesizability double, seq int")
    projected = spark.createDataFrame([("m", "x", 0.5, 0), ("m", "y", 0.7, 1), ("m", None, 0.9, 2)], "original_smiles string, smiles string, morgan_sim double, pseq int")
    row = evaluation.goal_directed_report(source, projected, F.col("objective"), F.col("morgan_sim")).first()
    assert row["n"] == 1 and row["max_projected"] == 0.7


def test_key_is_digested_as_a_stream(spark):
    import base64
    import hashlib

    texts = ["b", "\u00e9", "a;c", "B", "b", "\U0001f600", "\uffee", "left out"]
    df = spark.createDataFrame([(t,) for t in texts], "csmiles string")
    hints = df.filter("csmiles <> 'left out'").select(F.md5("csmiles").alias("hint"))
    out = molecules.match_key_molecules(df, hints)
    joined = b";".join(sorted({t.encode() for t in texts[:-1]}))
    assert [tuple(r) for r in out.collect()] == [(6, 6, base64.b64encode(hashlib.sha256(joined).digest()).decode())]
    assert "collect_list" not in out._jdf.queryExecution().toString()
    none = molecules.match_key_molecules(df, hints.limit(0)).first()
    assert tuple(none) == (0, 0, base64.b64encode(hashlib.sha256(b"").digest()).decode())
    assert tuple(molecules.match_key_molecules(df.limit(0), hints).first()) == (0, 6, None)


def test_all_tokens_of_long_smiles(spark):
    row = spark.createDataFrame([("CCl" * 150,)], "s string").select(features.tokenize_smiles(F.col("s"), ("C", "Cl")).alias("all"), features.tokenize_smiles(F.col("s"), ("C", "Cl"), 192).alias("cut")).first()
    assert row["all"] == [1, 2] * 150 and row["cut"] == row["all"][:192]


def test_similar_pairs_are_of_classes(spark):
    import itertools
    import random

    draw = random.Random(3)
    sets = {i: frozenset(draw.sample(range(30), draw.randrange(1, 14))) for i in range(60)}
    for i in range(60, 120):  # near and equal copies
        old = set(sets[draw.randrange(60)])
        sets[i] = frozenset(old ^ set(draw.sample(range(40), draw.choice((0, 0, 1, 2)))) or {1})
    frame = spark.createDataFrame([(i, b) for i, s in sets.items() for b in s] * 2, "id int, bit int")
    pairs, members = similarity.similar_pairs(frame, 0.7)
    own = {}
    for i, s in sorted(sets.items()):
        own.setdefault(s, i)
    assert {r["id"]: r["class_id"] for r in members.collect()} == {i: own[s] for i, s in sets.items()}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(sorted(own.values()), 2)}
    got = {(r["id_a"], r["id_b"]): r["similarity"] for r in pairs.collect()}
    assert got == {k: v for k, v in want.items() if v >= 0.7} and len(got) > 10


def test_ring_components(spark):
    atoms = spark.createDataFrame([(1, i) for i in range(6)] + [(2, 0)], "mol_id int, atom_idx int")
    bonds = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 0), (1, 3, 4)], "mol_id int, a int, b int")
    assert {r[0]: r[1] for r in molecules.ring_components(atoms, bonds).collect()} == {1: 3, 2: 1}
