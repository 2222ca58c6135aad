"""Pruned nearest neighbours, rings, and numbering and curves whose groups no single task takes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from retort.functions import numbering
from retort.operators import evaluation, features, molecules, ranking, similarity


def plain_knn(queries, index, k):
    out = {}
    for q, v in queries:
        best = sorted((float(np.abs(np.array(v) - np.array(p)).sum()), i) for i, p in index)[:k]
        out[q] = [(r + 1, i, d) for r, (d, i) in enumerate(best)]
    return out


def asked(spark, queries, index, k, **more):
    q, x = spark.createDataFrame(queries, "query_id long, fp array<double>"), spark.createDataFrame(index, "idx long, fp array<double>")
    out = {}
    for r in sorted(similarity.knn_l1(q, x, k, **more).collect()):
        out.setdefault(r["query_id"], []).append((r["rank"], r["idx"], r["distance"]))
    return out


def test_pruned_search_of_clusters(spark, monkeypatch):
    monkeypatch.setattr(similarity, "CELL_ROWS", 40)
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 400, (25, 12))
    rows = [(i, (centres[i % 25] + rng.integers(0, 4, 12)).astype(float).tolist()) for i in range(1500)]
    queries, visits = [(i, v) for i, v in rows[::50]], []
    assert asked(spark, queries, rows, 7, block=3, index_block=25, visits=visits) == plain_knn(queries, rows, 7)
    searched, every = visits
    assert 3 * searched <= every


def test_search_without_clusters_and_with_ties(spark, monkeypatch):
    monkeypatch.setattr(similarity, "CELL_ROWS", 10)
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(0, 3, 5).astype(float).tolist()) for i in range(300)]
    queries = [(i, rng.integers(0, 3, 5).astype(float).tolist()) for i in range(20)]
    assert asked(spark, queries, rows, 12) == plain_knn(queries, rows, 12)
    same = [(i, [1.0, 2.0]) for i in range(100)]
    assert asked(spark, [(0, [1.0, 2.0])], same, 4, index_block=7) == {0: [(r + 1, r, 0.0) for r in range(4)]}
    assert asked(spark, [(0, [0.1, 0.2])], same[:2], 4) == plain_knn([(0, [0.1, 0.2])], same[:2], 4)
    assert asked(spark, [(0, [1.0])], [], 3) == {} and asked(spark, [], same, 3) == {} and asked(spark, [(0, None), (1, [1.0, 1.0])], [*same, (500, None)], 1) == {1: [(1, 0, 1.0)]}


def plain_ring(bonds, bond):
    seen, todo = {bond[0]}, [bond[0]]
    while todo:
        at = todo.pop()
        for a, b in bonds - {bond}:
            for x, y in ((a, b), (b, a)):
                if x == at and y not in seen:
                    seen.add(y)
                    todo.append(y)
    return bond[1] in seen


def test_rings(spark):
    rng = random.Random(4)
    rows = {m: {tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.randint(1, n + 2))} for m, n in enumerate([3, 5, 8, 8, 12, 20, 30])}
    rows[99] = {(i, i + 1) for i in range(3000)} | {(0, 3000)}
    given = [(m, b, a) for m, bonds in rows.items() for a, b in bonds] + [(5, 2, 2), (5, None, 1), (None, 1, 2), (None, 2, 3), (None, 3, 1)]
    df = spark.createDataFrame(given, "mol_id long, a long, b long")
    got = {(r["mol_id"], r["b"], r["a"]): r["in_ring"] for r in molecules.ring_flags(df).collect()}
    assert len(got) == len(given)
    for m, bonds in rows.items():
        for bond in bonds:
            assert got[(m, *bond)] == (m == 99 or plain_ring(bonds, bond))
    assert not got[(5, 2, 2)] and not got[(5, 1, None)] and got[(None, 2, 1)]
    assert {r["mol_id"]: r["n_rings"] for r in molecules.rings(df).collect()}[99] == 1
    atoms = spark.createDataFrame([(None, 1), (99, 7), (5, 77)], "mol_id long, atom_idx long")
    flags = spark.createDataFrame([(99, 7, 8, True)], "mol_id long, a long, b long, in_ring boolean")
    assert sorted((r["atom_idx"], r["in_ring"]) for r in molecules.with_ring_atoms(atoms, flags).collect()) == [(1, False), (7, True), (77, False)]


@pytest.fixture
def small_ranges(spark):
    """Small partitions are not put together, as large ones would not be."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def largest_group(df, *keys):
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0]


def test_numbers_in_a_group_of_most_rows(spark, small_ranges):
    rows = [("hot" if i % 10 else None if i % 3 else "cold", (i * 7919) % 5003) for i in range(5000)]
    df = spark.createDataFrame(rows, "receptor string, seq int").repartition(5)
    got = {(r["receptor"], r["seq"]): r["number"] for r in ranking.number_rows(df, "receptor", "seq").collect()}
    for key in ("hot", "cold", None):
        own = sorted(s for k, s in rows if k == key)
        assert [got[(key, s)] for s in own] == list(range(len(own)))
    ranged = numbering.in_ranges(df, ["receptor"], [F.col("seq")])
    assert largest_group(ranged, "_range") < 0.6 * len(rows)  # four partitions; a task a receptor would take 0.9


def test_curves_of_one_bit_with_very_many_scores(spark, small_ranges):
    rng = random.Random(5)
    rows = [(0 if rng.random() < 0.9 else 1, rng.randint(0, 1), round(rng.random(), 3 if i % 2 else 6)) for i in range(6000)] + [(2, 1, 0.5), (None, 0, 0.1), (None, 1, 0.3)]
    df = spark.createDataFrame(rows, "bit int, truth int, score double")
    got = {r["bit"]: (r["average_precision"], r["roc_auc"]) for r in evaluation.evaluate_bits(df).collect()}
    assert set(got) == {0, 1, None}
    for bit in got:
        own = [(s, t) for b, t, s in rows if b == bit]
        pos, neg = (np.array([s for s, t in own if t == x]) for x in (1, 0))
        auc = np.mean([(pos > n).mean() + (pos == n).mean() / 2 for n in neg])
        steps, ap, last = sorted({s for s, _ in own}, reverse=True), 0.0, 0.0
        for s in steps:
            hits = [t for x, t in own if x >= s]
            recall = sum(hits) / len(pos)
            ap += (recall - last) * sum(hits) / len(hits)
            last = recall
        assert got[bit] == pytest.approx((ap, auc), abs=1e-9)
    assert largest_group(numbering.in_ranges(df, ["bit"], [F.desc("score")]), "_range") < 0.6 * len(rows)


def test_null_keys_stay(spark):
    df = spark.createDataFrame([(None, "a"), (1, "b"), (2, "c"), (None, "d")], "k long, v string")
    parts = evaluation.split_ids(df, "k", 0.5).collect()
    assert len(parts) == 4 and len({r["part"] for r in parts if r["k"] is None}) == 1
    assert {r["part"] for r in evaluation.split_ids(df, "k", 0.0).collect()} == {"valid"} and evaluation.split_ids(df.limit(0), "k").count() == 0
    rows = [r["rows"] for r in features.batches(df, 3, "k").orderBy("batch_id").collect()]
    assert [[x["k"] for x in r] for r in rows] == [[None, None, 1], [2]] and rows[0][0].asDict().keys() == {"k", "v"}
    assert features.batches(df, 3, "k", drop_last=True).count() == 1
    same = spark.createDataFrame([(1, None), (2, ""), (3, None), (4, "")], "mol_id long, csmiles string")
    assert sorted(r["mol_id"] for r in molecules.first_of_each(same).collect()) == [1, 2]


def test_split_is_exact_inside_a_crowded_group(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "SMALL_GROUP", 3)
    df = spark.range(3001)
    got = {r["id"]: r["part"] for r in evaluation.split_ids(df, "id", 0.37).collect()}
    import hashlib

    order = sorted(range(3001), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
    assert [got[i] for i in order] == ["train"] * 1110 + ["valid"] * 1891


def test_batches_of_hashed_keys_are_sorted_in_ranges(spark):
    df = spark.range(2000).select(F.xxhash64("id").alias("k"), "id")
    rows = features.batches(df, 64, "k").orderBy("batch_id").collect()
    keys = [x["k"] for r in rows for x in r["rows"]]
    assert keys == sorted(keys) and [len(r["rows"]) for r in rows] == [64] * 31 + [16]


@pytest.mark.parametrize("most", [1, 5, 50])
def test_cut_tokens_equal_those_of_the_whole(spark, most):
    tokens = ["C", "Cl", "Br", "[nH]", "c", "1", "(", ")", "="]
    rng = random.Random(6)
    texts = ["", None, "xyz", "C" * 400, "Cl" * 400] + ["".join(rng.choice([*tokens, "x", "y", "B", "[n"]) for _ in range(rng.randint(1, 400))) for _ in range(60)] + ["x" * 3000 + "ClBr" * 40]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    whole = {r["i"]: r["x"] for r in df.select("i", features.tokenize_smiles(F.col("t"), tokens).alias("x")).collect()}
    for r in df.select("i", features.tokenize_smiles(F.col("t"), tokens, most).alias("x")).collect():
        assert r["x"] == (whole[r["i"]][:most] if whole[r["i"]] is not None else None)


def test_shapes_travel_as_sums_and_bits(spark):
    import numpy as np

    from retort.operators import voxels

    rng = np.random.default_rng(4)
    rows = [(m, "C N O S Br".split()[int(e)], *map(float, p)) for m in range(30) for e, p in zip(rng.integers(0, 5, 6), rng.uniform(-16, 16, (6, 3)) / (1 + m % 3), strict=True)]
    atoms = spark.createDataFrame(rows, "mol_id int, element string, x double, y double, z double")
    stamps = voxels.atom_stamps(spark)
    want = {}
    reach = {r: [tuple(s)[1:] for s in stamps.collect() if s["element"] == r] for r in "C N O S Br".split()}
    for m, e, *at in rows:
        g = [int(np.round((c + 15) / 0.5)) for c in at]
        if all(0 <= c < 61 for c in g):
            moved = [tuple(a + b - 20 for a, b in zip(g, d, strict=True)) for d in reach[e]]
            want.setdefault(m, set()).update(v for v in moved if all(0 <= c < 21 for c in v))
    want = {m: v for m, v in want.items() if v}
    cells = {}
    for r in voxels.shapes(atoms, stamps, crop=21).collect():
        cells.setdefault(r["mol_id"], set()).add(tuple(r)[1:])
    assert cells == want
    sums = {r["mol_id"]: tuple(r)[1:] for r in voxels.shape_sums(atoms, stamps, crop=21).collect()}
    assert sums == {m: (len(v), *map(sum, zip(*v, strict=True))) for m, v in want.items()}
    bits = voxels.shape_patches(atoms, stamps, 3, crop=21)
    assert bits._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    plain = {(r["mol_id"], r["patch_id"]): r["values"] for r in voxels.patches(voxels.shapes(atoms, stamps, crop=21), 3, 21).collect()}
    assert {(r["mol_id"], i): [float(w >> c & 1) for c in range(27)] for r in bits.collect() for i, w in enumerate(r["patches"])} == plain


def test_neighbourhoods_are_counted_in_rows(spark):
    from retort.operators import voxels

    marked = [(m, x * m % 7, x % 6 - 1, x * x % 5) for m in (1, 2, 3) for x in range(9)]
    want = {}
    for m, *at in marked:
        for d in range(27):
            v = tuple(c + d // w % 3 - 1 for c, w in zip(at, (9, 3, 1), strict=True))
            if all(0 <= c < 6 for c in v):
                want[m, *v] = want.get((m, *v), 0) + 1
    out = voxels.neighbourhood_counts(spark.createDataFrame(marked, "mol_id int, x int, y int, z int"), 6, 1)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    assert {tuple(r)[:4]: r["value"] for r in out.collect()} == want


def _chemistry_of_a_few(spark):
    matrix = spark.createDataFrame([(i, r, 1 + (i + r) % 3) for i in range(1, 21) for r in range(5) if (i * r) % 4 != 3], "reactant_id long, rxn_id long, flag int")
    molecules = spark.createDataFrame([(i, f"m{i % 15}") for i in range(1, 21)], "reactant_id long, smiles string")  # some names are of two reactants
    table = spark.createDataFrame([(r, 1 + r % 2) for r in range(5)], "rxn_id long, n_reactants int")
    return matrix, molecules, table, lambda pairs: pairs.withColumn("product", F.concat(F.lit("m"), (F.length("left") + F.col("rxn_id")) % 15))


def test_a_route_draws_from_one_row_of_reactions(spark):
    from retort.operators import routes

    matrix, molecules, table, execute = _chemistry_of_a_few(spark)
    own = spark.range(40).select(F.col("id").alias("route_id"), F.array().cast(f"array<{routes.STEP}>").alias("steps"), F.array(F.array(F.concat(F.lit("m"), F.col("id") % 17))).alias("stack"), F.lit(0).alias("rxn_id"), F.lit(0).alias("n_reactants"))
    changed, stuck = routes.expand_routes(own, matrix, table, molecules, execute, 3, 2)
    # plainly: each route with each reaction of its product, the least hash first
    every = own.select("route_id", F.get(F.get("stack", F.lit(0)), F.lit(0)).alias("smiles")).join(molecules, "smiles").join(matrix, "reactant_id").withColumn("h", F.xxhash64(F.lit(3), F.lit(2), "route_id", "rxn_id"))
    least = {}
    for r in every.collect():
        least[r["route_id"]] = min(least.get(r["route_id"], (1 << 64, 0)), (r["h"], r["rxn_id"]))
    assert {r["route_id"]: r["steps"][-1]["ref_idx"] for r in changed.collect()} == {k: v for k, (_, v) in least.items()}
    assert {r["route_id"] for r in stuck.collect()} == set(range(40)) - set(least)
    assert "Window" not in changed._jdf.queryExecution().executedPlan().toString()


def test_model_outputs_are_cut_before_they_meet_states(spark):
    from retort.operators import routes

    _, molecules, table, execute = _chemistry_of_a_few(spark)
    states = spark.range(6).select(F.lit(0).cast("long").alias("target_id"), F.lit("m3").alias("target"), F.col("id").alias("state_id"), F.col("id").alias("seq"), F.array().cast(f"array<{routes.STEP}>").alias("steps"), F.array(F.array(F.lit("m1"), F.lit("m22")), F.array(F.lit("m4"))).alias("stack"), F.array(F.lit(0.5)).alias("scores"))
    outputs = states.select("state_id", F.when(F.col("state_id") % 3 == 0, F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))).alias("token_logits"), F.array(*[(F.col("state_id") * k % 5).cast("double") for k in range(5)]).alias("reaction_logits"))
    near = spark.createDataFrame([], "state_id long, rank int, idx long, smiles string, score double")
    active, finished = routes.beam_step(states, outputs, near, table, execute, lambda p, t: F.when(p == t, 1.0).otherwise(0.5), 3, 100)
    assert sorted(r["state_id"] for r in finished.collect()) == [0, 3]
    best = {(s, sorted(range(5), key=lambda k: (-(s * k % 5), k))[i], s * 3 + i) for s in (1, 2, 4, 5) for i in range(3)}
    got = {(r["seq"] // 3, r["steps"][-1]["ref_idx"], r["seq"]) for r in active.collect()}
    assert got == best
    assert "reaction_logits" not in active._jdf.queryExecution().toString()


def test_rings_are_found_for_many_molecules_together(spark):
    import random

    import numpy as np

    from retort.operators import molecules

    draw = random.Random(5)
    mols = [sorted({tuple(sorted(draw.sample(range(n), 2))) for _ in range(draw.randrange(0, n + 3))}) for n in (2, 3, 5, 7, 9, 12) for _ in range(60)]
    mols += [[(i, i + 1) for i in range(200)], [(0, 1), (1, 2), (0, 2), (5, 6), (6, 7), (5, 7)], [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (4, 5), (3, 5)], []]
    of = np.array([i for i, m in enumerate(mols) for _ in m])
    a, b = np.array([e for m in mols for e in m]).T
    flags, n = molecules._in_rings(of, a, b, len(mols))
    assert flags.tolist() == [f for m in mols for f in molecules._rings(m)[0]] and n.tolist() == [molecules._rings(m)[1] for m in mols]
    empty = np.zeros(0, dtype=np.int64)
    assert [x.tolist() for x in molecules._in_rings(empty, empty, empty, 2)] == [[], [0, 0]]
    bonds = spark.createDataFrame([(1, 2, 1, "x"), (1, 1, 2, "y"), (1, 2, 3, "z"), (1, 3, 1, None), (1, 3, 4, "v"), (1, 4, 4, "w"), (None, None, 1, "u")], "mol_id int, a long, b long, kind string")
    out = molecules.ring_flags(bonds)
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, 2, 1, "x", True), (1, 1, 2, "y", True), (1, 2, 3, "z", True), (1, 3, 1, None, True), (1, 3, 4, "v", False), (1, 4, 4, "w", False), (None, None, 1, "u", False)], key=str)
    assert "Join" not in molecules.ring_flags(bonds)._jdf.queryExecution().executedPlan().toString()


def test_ring_graphs_find_flags_once(spark):
    from retort.plans import queries

    assert "MapInArrow" not in queries.QUERIES["ring_graphs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
