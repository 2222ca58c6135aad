"""Clusters by cells and circular fingerprints, against plain versions."""

import math
import random
import time

import numpy as np

from retort.operators import fingerprints


def plain_labels(xyz, radius):
    labels = list(range(len(xyz)))
    for i in range(len(xyz)):
        for j in range(i + 1, len(xyz)):
            if math.dist(xyz[i], xyz[j]) <= radius:
                labels[j] = labels[i]
    return labels


def test_cells_give_the_clusters_of_the_plain_loop():
    rng = np.random.default_rng(1)
    for n, wide in ((0, 1), (1, 1), (60, 3), (200, 6), (200, 30), (300, 1)):
        xyz = rng.uniform(-wide, wide, (n, 3)) if n % 7 else rng.integers(-wide, wide + 1, (n, 3)).astype(float)
        assert fingerprints._cluster_labels(xyz, 2.0) == plain_labels(xyz.tolist(), 2.0)
    assert fingerprints._cluster_labels(np.zeros((50, 3)), 0.0) == [0] * 50


def test_clusters_take_time_in_proportion():
    rng = np.random.default_rng(2)
    for xyz in (rng.uniform(0, 120, (20_000, 3)), rng.uniform(0, 1, (20_000, 3))):
        began = time.process_time()
        assert len(fingerprints._cluster_labels(xyz, 2.0)) == len(xyz)
        assert time.process_time() - began < 20


def plain_bits(atoms, bonds, radius, bits):
    """Environments as sets of bonds found by walking, round by round."""
    near = {i: {} for i in atoms}
    for (a, b), o in bonds.items():
        near[a][b] = near[b][a] = o
    ids = {0: {i: fingerprints._identifier(f"{z},{c}") for i, (z, c) in atoms.items()}}
    out, seen, dead = set(ids[0].values()), set(), {i for i in atoms if not near[i]}
    for r in range(1, radius + 1):
        ids[r] = dict(ids[r - 1])
        rows = []
        for i in atoms:
            if i in dead:
                continue
            ids[r][i] = fingerprints._identifier(f"{r}|{ids[r - 1][i]}|" + ",".join(f"{o}:{h}" for o, h in sorted((o, ids[r - 1][j]) for j, o in near[i].items())))
            ball, edge = {i}, set()
            for _ in range(r):
                edge |= {frozenset((x, y)) for x in ball for y in near[x]}
                ball |= {y for x in ball for y in near[x]}
            rows.append((ids[r][i], i, frozenset(edge)))
        for h, i, edge in sorted(rows, key=lambda x: x[:2]):
            if edge in seen:
                dead.add(i)
            else:
                seen.add(edge)
                out.add(h)
    return {h % bits for h in out}


def test_circular_fingerprints(spark):
    rng = random.Random(3)
    mols = {m: ({i: (rng.randint(5, 8), rng.randint(-1, 1)) for i in range(n)}, {}) for m, n in enumerate([1, 2, 2, 3, 5, 8, 12])}
    for atoms, bonds in mols.values():
        for i in range(1, len(atoms)):
            bonds[(rng.randrange(i), i)] = rng.randint(1, 3)
        if len(atoms) > 4:
            bonds[(0, len(atoms) - 1)] = 1
    a = spark.createDataFrame([(m, i, z, c) for m, (atoms, _) in mols.items() for i, (z, c) in atoms.items()] + [(None, 0, 6, None)], "mol_id long, atom_idx int, atomic_num int, charge int")
    b = spark.createDataFrame([(m, x, y, o) for m, (_, bonds) in mols.items() for (x, y), o in bonds.items()] + [(1, None, 0, 1), (99, 0, 1, 1)], "mol_id long, a int, b int, order int")
    for radius in (0, 1, 2, 3):
        got = {}
        for r in fingerprints.circular_fp(a, b, radius, 4096).collect():
            got.setdefault(r["mol_id"], set()).add(r["bit"])
        assert got.pop(None) == {fingerprints._identifier("6,0") % 4096}
        assert got == {m: plain_bits(atoms, bonds, radius, 4096) for m, (atoms, bonds) in mols.items()}
