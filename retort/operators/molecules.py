"""Preparation of molecule tables: fragments, digests, duplicates, exclusion, key matching, atom and bond features."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType

#: Atomic numbers by element class of the one-hot features. Fixed values.
ELEMENT_CLASSES = {
    "B": [5], "C": [6], "N": [7], "O": [8], "P": [15], "S": [16], "Se": [34], "halogen": [9, 17, 35, 53],
    "metal": [3, 4, 11, 12, 13, *range(19, 32), *range(37, 51), *range(55, 84), *range(87, 104)],
}


def drop_invalid(df: DataFrame, smiles: str = "smiles", valid: Column | None = None) -> DataFrame:
    """Rows whose molecule could be read."""
    known = df.filter(F.col(smiles).isNotNull())
    return known.filter(valid) if valid is not None else known


def major_fragment(smiles: Column) -> Column:
    """The longest part between dots, the first on ties."""
    parts = F.split(smiles, r"\.")
    longest = F.array_max(F.transform(parts, lambda p, i: F.struct(F.char_length(p).alias("n"), (-i).alias("i"))))
    return F.when(smiles.contains("."), F.get(parts, -longest["i"])).otherwise(smiles)


def digests(df: DataFrame, csmiles: str = "csmiles") -> DataFrame:
    """``df`` with the md5 and sha256 digests of the canonical SMILES as binary columns."""
    return df.withColumns({f"{csmiles}_md5": F.unhex(F.md5(csmiles)), f"{csmiles}_sha256": F.unhex(F.sha2(csmiles, 256))})


def first_of_each(df: DataFrame, key: str = "csmiles", seq: str = "mol_id") -> DataFrame:
    """The first row of each key, null being one. Shuffles a digest rather than the key, which may be long."""
    digest = F.coalesce(F.md5(F.col(key)), F.lit("null"))
    order = Window.partitionBy("_digest").orderBy(seq)
    return df.withColumn("_digest", digest).withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_digest", "_rank")


def prepare_molecules(df: DataFrame, major_only: bool = True, drop_duplicates: bool = True, canonicalize: Callable[[Column], Column] | None = None, smiles: str = "smiles", seq: str = "mol_id") -> DataFrame:
    """Readable molecules, cut to the major fragment, with ``csmiles``, one row each of it."""
    out = drop_invalid(df, smiles)
    if major_only:
        out = out.withColumn(smiles, major_fragment(F.col(smiles)))
    out = out.withColumn("csmiles", canonicalize(F.col(smiles)) if canonicalize else F.col(smiles))
    return first_of_each(out, "csmiles", seq) if drop_duplicates else out


def exclude_molecules(df: DataFrame, excluded: DataFrame, key: str = "smiles") -> DataFrame:
    """Rows whose ``key`` is not in ``excluded``."""
    return df.join(excluded.select(key).distinct(), key, "left_anti")


def _joined_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count and base64 sha256 of texts joined by ``;``."""
    digest, n = hashlib.sha256(), 0
    for batch in batches:
        for text in batch.column(0):
            digest.update((b";" if n else b"") + text.as_py().encode())
            n += 1
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([base64.b64encode(digest.digest()).decode()])], ["matched", "key"])


def match_key_molecules(df: DataFrame, hints: DataFrame, csmiles: str = "csmiles") -> DataFrame:
    """The one-row result of matching md5 ``hints`` (column ``hint``, hexadecimal): ``matched, wanted, key``.

    The key is the base64 of the sha256 of the sorted matched SMILES, joined by ``;``, and null unless as many match as there are hints.
    """
    wanted = hints.select("hint").distinct()
    matched = df.select(csmiles).distinct().join(wanted, F.md5(csmiles) == F.col("hint"), "left_semi")
    # a sha256 is taken from front to back: one task reads the sorted rows as a stream, whatever their number and size
    digested = matched.select(F.col(csmiles).alias("text")).repartition(1).sortWithinPartitions("text").mapInArrow(_joined_digest, "matched long, key string")
    found = digested.agg(F.coalesce(F.sum("matched"), F.lit(0)).alias("matched"), F.coalesce(F.max("key"), F.base64(F.unhex(F.sha2(F.lit("").cast("binary"), 256)))).alias("digest"))
    count = wanted.agg(F.count("*").alias("wanted"))
    return found.crossJoin(count).select("matched", "wanted", F.when(F.col("matched") == F.col("wanted"), F.col("digest")).alias("key"))


def suitable(molecules: DataFrame, atoms: DataFrame, bonds: DataFrame, least: tuple[int, int, int] = (15, 15, 2), components: DataFrame | None = None) -> DataFrame:
    """``molecules`` with at least so many atoms, bonds and rings; rings are bonds - atoms + components (1 a molecule if not given)."""
    a = atoms.groupBy("mol_id").agg(F.count("*").alias("_atoms"))
    b = bonds.groupBy("mol_id").agg(F.count("*").alias("_bonds"))
    rows = molecules.join(a, "mol_id").join(b, "mol_id", "left").na.fill(0, ["_bonds"])
    if components is None:
        rows = rows.withColumn("_parts", F.lit(1))
    else:
        rows = rows.join(components.select("mol_id", F.col("components").alias("_parts")), "mol_id")
    rings = F.col("_bonds") - F.col("_atoms") + F.col("_parts")
    return rows.filter((F.col("_atoms") >= least[0]) & (F.col("_bonds") >= least[1]) & (rings >= least[2])).drop("_atoms", "_bonds", "_parts")


def ring_components(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """Connected parts of each molecule's graph: ``mol_id, components``. Rings are bonds - atoms + components. A molecule's graph is small and is walked in one row."""
    edges = bonds.groupBy("mol_id").agg(F.collect_set(F.struct("a", "b")).alias("edges"))
    graphs = atoms.groupBy("mol_id").agg(F.collect_set("atom_idx").alias("nodes")).join(edges, "mol_id", "left")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for nodes, pairs in zip(batch.column("nodes").to_pylist(), batch.column("edges").to_pylist(), strict=True):
                root = {n: n for n in nodes}

                def find(n, root=root):
                    while root[n] != n:
                        root[n] = n = root[root[n]]
                    return n

                for e in pairs or []:
                    if e["a"] in root and e["b"] in root:
                        root[find(e["a"])] = find(e["b"])
                found.append(sum(root[n] == n for n in root))
            yield pa.RecordBatch.from_arrays([batch.column("mol_id"), pa.array(found, pa.int32())], ["mol_id", "components"])

    return graphs.mapInArrow(count, graphs.select("mol_id").schema.add("components", IntegerType()))


def is_flat(atoms: DataFrame) -> DataFrame:
    """``mol_id, is_2d``: true where every z is 0."""
    return atoms.groupBy("mol_id").agg(F.bool_and(F.col("z") == 0).alias("is_2d"))


def synthesizable_sources(df: DataFrame) -> DataFrame:
    """Generated molecules that no known route makes."""
    return df.filter((F.col("method") != "best_from_chembl") & (F.col("tb_synthesizability") <= 0))


def atom_code(atomic_number: Column) -> Column:
    """Atomic number up to 100; 0 for none."""
    return F.coalesce(F.least(atomic_number, F.lit(100)), F.lit(0))


def bond_code(kind: Column) -> Column:
    """1, 2, 3 for single, double and triple bonds, 4 for aromatic, 5 for any other, 0 for none."""
    known = F.when(kind == "SINGLE", 1).when(kind == "DOUBLE", 2).when(kind == "TRIPLE", 3).when(kind == "AROMATIC", 4)
    return F.when(kind.isNull(), 0).otherwise(F.coalesce(known, F.lit(5)))


def graph_features(atoms: DataFrame, bonds: DataFrame, atom_features: Sequence[str], bond_features: Sequence[str], both_ways: bool = True) -> DataFrame:
    """A row a molecule: ``atoms`` (feature arrays by atom, degree last), ``edges`` ([a, b] in both directions), ``edge_features``, ``positions``, ``mask``."""
    ends = bonds.select("mol_id", F.explode(F.array("a", "b")).alias("atom_idx")).groupBy("mol_id", "atom_idx").agg(F.count("*").cast("double").alias("degree"))
    rows = atoms.join(ends, ["mol_id", "atom_idx"], "left").na.fill(0.0, ["degree"])
    values = F.array(*[F.col(c).cast("double") for c in (*atom_features, "degree")])
    by_atom = rows.groupBy("mol_id").agg(F.sort_array(F.collect_list(F.struct("atom_idx", values.alias("f"), F.array("x", "y", "z").alias("p")))).alias("all"))
    half = bonds.select("mol_id", "a", "b", F.array(*[F.col(c).cast("double") for c in bond_features]).alias("f"))
    edges = half.union(half.select("mol_id", F.col("b"), F.col("a"), "f")) if both_ways else half
    by_edge = edges.groupBy("mol_id").agg(F.sort_array(F.collect_list(F.struct("a", "b", "f"))).alias("edge"))
    return by_atom.join(by_edge, "mol_id", "left").select(
        "mol_id",
        F.transform("all", lambda x: x["f"]).alias("atoms"),
        F.transform("edge", lambda x: F.array(x["a"], x["b"])).alias("edges"),
        F.transform("edge", lambda x: x["f"]).alias("edge_features"),
        F.transform("all", lambda x: x["p"]).alias("positions"),
        F.transform("all", lambda x: F.lit(True)).alias("mask"),
    )


def _rings(ends: list[tuple[int, int]]) -> tuple[list[bool], int]:
    """For each bond (two different atoms, no bond twice) whether it is in a ring, and the number of independent rings.

    A bond is in a ring unless it is a bridge: unless no atom below it in a depth-first search leads above it by another bond.
    """
    around: dict[int, list[tuple[int, int]]] = {}
    for i, (a, b) in enumerate(ends):
        around.setdefault(a, []).append((b, i))
        around.setdefault(b, []).append((a, i))
    in_ring, seen, low, parts = [True] * len(ends), {}, {}, 0
    for root in around:
        if root in seen:
            continue
        parts += 1
        seen[root] = low[root] = len(seen)
        path = [(root, -1, iter(around[root]))]
        while path:
            atom, by, rest = path[-1]
            for other, bond in rest:
                if bond == by:
                    continue
                if other in seen:
                    low[atom] = min(low[atom], seen[other])
                else:
                    seen[other] = low[other] = len(seen)
                    path.append((other, bond, iter(around[other])))
                    break
            else:
                path.pop()
                if path:
                    above = path[-1][0]
                    low[above] = min(low[above], low[atom])
                    in_ring[by] = low[atom] <= seen[above]
    return in_ring, len(ends) - len(around) + parts


#: Rounds in which bonds of end atoms are dropped; what is left of longer chains is walked.
PRUNED = 32


def _in_rings(of: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the different bonds ``a`` to ``b`` of molecule ``of`` whether it is in a ring, and the number of independent rings of each of ``n`` molecules.

    All molecules lose the bonds of their end atoms together, round after round. Where each atom that is left has two bonds, and there are too few
    bonds for two rings, what is left is one ring; only the others are walked one by one.
    """
    _, atom = np.unique(np.concatenate([a, b]), return_inverse=True)
    _, atom = np.unique(np.concatenate([of, of]) * (atom.max(initial=0) + 1) + atom, return_inverse=True)
    u, v = atom[: len(a)], atom[len(a) :]
    left = np.ones(len(a), dtype=bool)
    for _ in range(PRUNED):
        bound = np.bincount(np.concatenate([u[left], v[left]]), minlength=len(atom))
        ends = left & ((bound[u] == 1) | (bound[v] == 1))
        if not ends.any():
            break
        left &= ~ends
    bound = np.bincount(np.concatenate([u[left], v[left]]), minlength=len(atom))
    size = np.bincount(of[left], minlength=n)
    odd = np.bincount(of[left & ((bound[u] != 2) | (bound[v] != 2))], minlength=n) > 0
    found = ((size > 0) & ~odd).astype(np.int64)
    walked = odd | (size >= 6)
    at = np.flatnonzero(left & walked[of])
    at = at[np.argsort(of[at], kind="stable")]
    first, pairs = 0, list(zip(u[at].tolist(), v[at].tolist(), strict=True))
    for i in np.flatnonzero(walked).tolist():
        last = first + int(size[i])
        left[at[first:last]], found[i] = _rings(pairs[first:last])
        first = last
    return left, found


def _with_rings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = batch.column("ends")
        a, b = (np.asarray(held.flatten().field(c)) for c in "ab")
        offsets = np.asarray(held.offsets)
        flags, n = _in_rings(np.repeat(np.arange(batch.num_rows), np.diff(offsets)), a, b, batch.num_rows)
        ends = pa.StructArray.from_arrays([pa.array(a), pa.array(b), pa.array(flags)], ["a", "b", "in_ring"])
        yield pa.RecordBatch.from_arrays([batch.column("mol_id"), pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), ends), pa.array(n)], ["mol_id", "ends", "n_rings"])


def rings(bonds: DataFrame) -> DataFrame:
    """``mol_id, ends, n_rings`` from ``bonds (mol_id, a, b)``: the bonds of each molecule with a < b, each with its ``in_ring``, and the number of
    independent rings. A bond given twice, or both ways, is one; one without two different atoms is none."""
    pairs = bonds.filter("a <> b").select("mol_id", F.struct(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).alias("e"))
    held = pairs.groupBy("mol_id").agg(F.sort_array(F.collect_set("e")).alias("ends"))
    kind = dict(bonds.dtypes)["mol_id"]
    return held.mapInArrow(_with_rings, f"mol_id {kind}, ends array<struct<a:bigint,b:bigint,in_ring:boolean>>, n_rings long")


def ring_flags(bonds: DataFrame) -> DataFrame:
    """``bonds`` with ``in_ring``, true for bonds that are part of a ring; null or equal ends give false. The bonds of a molecule come together in one row."""
    others = [c for c in bonds.columns if c != "mol_id"]
    ends = F.struct(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b"), F.struct(*others).alias("given"))
    held = bonds.groupBy("mol_id").agg(F.collect_list(ends).alias("ends"))

    def flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("ends")
            a, b = (rows.flatten().field(c) for c in "ab")
            of = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(rows.offsets)))
            real = ~(np.asarray(a.is_null()) | np.asarray(b.is_null()))
            a, b = (np.asarray(x.fill_null(0)) for x in (a, b))
            real &= a != b
            order = np.flatnonzero(real)
            order = order[np.lexsort((b[order], a[order], of[order]))]
            same = np.zeros(len(order), dtype=bool)
            same[1:] = (np.diff(of[order]) == 0) & (np.diff(a[order]) == 0) & (np.diff(b[order]) == 0)
            once = order[~same]
            flags, _ = _in_rings(of[once], a[once], b[once], batch.num_rows)
            given = np.zeros(len(of), dtype=bool)
            given[order] = flags[np.cumsum(~same) - 1]
            offsets = np.asarray(rows.offsets)
            yield batch.append_column("flags", pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), pa.array(given)))

    schema = held.select("*").schema.add("flags", ArrayType(BooleanType()))
    each = held.mapInArrow(flagged, schema).select("mol_id", F.explode(F.arrays_zip("ends", "flags")).alias("t"))
    return each.select(*["mol_id" if c == "mol_id" else F.col("t.ends.given")[c].alias(c) for c in bonds.columns], F.col("t.flags").alias("in_ring"))


def with_ring_atoms(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """``atoms`` with ``in_ring`` from ``bonds`` that have it: an atom is in a ring if one of its bonds is."""
    held = bonds.filter("in_ring").select("mol_id", F.explode(F.array("a", "b")).alias("atom_idx")).distinct().withColumn("in_ring", F.lit(True))
    return atoms.join(held, ["mol_id", "atom_idx"], "left").na.fill(False, ["in_ring"])


def element_one_hot(atomic_number: Column) -> Column:
    """One of nine element classes as 0/1 values; all 0 for an unknown element."""
    return F.array(*[F.when(atomic_number.isin(numbers), 1).otherwise(0) for numbers in ELEMENT_CLASSES.values()])


def heavy_atoms(atoms: DataFrame, without_hydrogens: bool = True) -> DataFrame:
    """Atoms that are not masked, without hydrogens unless wanted."""
    kept = atoms.filter(F.coalesce(F.col("mask"), F.lit("")) != "true") if "mask" in atoms.columns else atoms
    return kept.filter(F.col("atomic_num") != 1) if without_hydrogens else kept


def clipped(fp: Column) -> Column:
    """Fingerprint values held between 0 and 1."""
    return F.transform(fp, lambda x: F.least(F.greatest(x, F.lit(0).cast("double")), F.lit(1).cast("double")))
