"""Voxel shapes of molecules as sparse rows. Atoms are ``mol_id, element, x, y, z`` (and ``rot_id`` after rotation)."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, LongType, StructField, StructType

#: Van der Waals radii by element, in angstrom. Fixed values.
RADII = {"C": 1.908, "F": 1.75, "Cl": 1.948, "Br": 2.22, "I": 2.35, "N": 1.824, "O": 1.6612, "P": 2.1, "S": 2.0, "H": 1.0}
RESOLUTION, MAX_DIST = 0.5, 15.0


def box_side(resolution: float = RESOLUTION, max_dist: float = MAX_DIST) -> int:
    """Voxels along a side of the box."""
    return math.ceil(2 * max_dist / resolution + 1)


def centred(atoms: DataFrame, others: DataFrame | None = None) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Atoms moved so that each molecule's centroid is the origin, and ``others`` by the same vectors."""
    middle = atoms.groupBy("mol_id").agg(*[F.avg(c).alias(f"_{c}") for c in "xyz"])
    move = lambda df: df.join(middle, "mol_id").withColumns({c: F.col(c) - F.col(f"_{c}") for c in "xyz"}).drop("_x", "_y", "_z")
    return move(atoms) if others is None else (move(atoms), move(others))


def box_rotations() -> list[np.ndarray]:
    """The 24 rotations that map a box onto itself, the identity first."""
    found = []
    for axes in itertools.permutations(range(3)):
        for signs in itertools.product((1, -1), repeat=3):
            m = np.zeros((3, 3))
            m[range(3), axes] = signs
            if round(np.linalg.det(m)) == 1:
                found.append(m)
    return sorted(found, key=lambda m: (not np.array_equal(m, np.eye(3)), m.tolist()))


def rotation_about(axis: Sequence[float], angle: float) -> np.ndarray:
    """Rotation by ``angle`` about ``axis``, counter-clockwise."""
    u = np.asarray(axis, dtype=float) / np.linalg.norm(axis)
    cross = np.array([[0, -u[2], u[1]], [u[2], 0, -u[0]], [-u[1], u[0], 0]])
    return np.eye(3) * math.cos(angle) + math.sin(angle) * cross + (1 - math.cos(angle)) * np.outer(u, u)


def fine_rotations(sp: int, rp: int) -> list[np.ndarray]:
    """The identity and, for axes through a grid of ``sp`` x ``sp`` points on three faces of a unit cube (x, then z, then y at 0.5), ``rp - 1`` angles each."""
    found, steps = [np.eye(3)], (np.arange(sp) - sp // 2) / sp
    for face in (0, 2, 1):
        for a, b in itertools.product(steps, steps):
            axis = np.insert(np.array([a, b]), face, 0.5)
            found += [rotation_about(axis, 2 * math.pi * k / rp) for k in range(1, rp)]
    return found


def rotation_table(spark: SparkSession, rotations: list[np.ndarray]) -> DataFrame:
    """``rot_id`` and the nine numbers of each rotation; as many rows as rotations."""
    names = [f"r{i}{j}" for i in range(3) for j in range(3)]
    return spark.createDataFrame([(k, *map(float, m.ravel())) for k, m in enumerate(rotations)], "rot_id int, " + ", ".join(f"{n} double" for n in names))


def rotate_all(atoms: DataFrame, rotations: DataFrame, columns_first: bool = True) -> DataFrame:
    """Atoms under every rotation of the small table: R p, or p R where not ``columns_first``."""
    r = lambda i, j: F.col(f"r{i}{j}" if columns_first else f"r{j}{i}")
    turned = {c: sum((r(i, j) * F.col(d) for j, d in enumerate("xyz")), F.lit(0.0)) for i, c in enumerate("xyz")}
    return atoms.crossJoin(F.broadcast(rotations)).withColumns(turned).drop(*[f"r{i}{j}" for i in range(3) for j in range(3)])


def grid_coordinates(atoms: DataFrame, resolution: float = RESOLUTION, max_dist: float = MAX_DIST) -> DataFrame:
    """``gx, gy, gz`` of each atom, rounded half to even; atoms outside the box are dropped."""
    side = box_side(resolution, max_dist)
    placed = atoms.withColumns({f"g{c}": F.bround((F.col(c) + max_dist) / resolution).cast("int") for c in "xyz"})
    return placed.filter(" and ".join(f"g{c} between 0 and {side - 1}" for c in "xyz"))


def voxelize(atoms: DataFrame, feature: str, keys: Sequence[str] = ("mol_id",), resolution: float = RESOLUTION, max_dist: float = MAX_DIST) -> DataFrame:
    """Sum of a feature over the atoms of each voxel: keys, ``gx, gy, gz, value``."""
    return grid_coordinates(atoms, resolution, max_dist).groupBy(*keys, "gx", "gy", "gz").agg(F.sum(feature).alias("value"))


def atom_stamps(spark: SparkSession, resolution: float = RESOLUTION, noise: tuple[float, float] | None = None, seed: int = 0) -> DataFrame:
    """Voxel offsets within the radius of each element: ``element, dx, dy, dz``; with ``noise`` (mean, deviation) radii grow by a seeded draw, never shrink."""
    draw, rows = np.random.default_rng(seed), []
    for element, radius in RADII.items():
        reach = radius + (max(0.0, float(draw.normal(*noise))) if noise else 0.0)
        n = int(reach / resolution) + 1
        rows += [(element, i, j, k) for i, j, k in itertools.product(range(-n, n + 1), repeat=3) if math.sqrt(i * i + j * j + k * k) * resolution <= reach]
    return spark.createDataFrame(rows, "element string, dx int, dy int, dz int")


def _laid(atoms: DataFrame, stamps: DataFrame, keys: Sequence[str], crop: int | None, resolution: float, max_dist: float, finish: Callable[[np.ndarray], pa.Array], kind: DataType) -> DataFrame:
    """Keys and ``shape``: what ``finish`` makes of the boxes (molecules x side x side x side of bits) in which the stamps of each molecule's atoms lie.

    Atoms travel, not voxels: the distinct grid places of a molecule's atoms (at most elements x voxels of the box, however many
    atoms) come together in one row, as numbers, and a task lays their stamps. Boxes have a margin of two reaches of the widest stamp, so that
    stamps need no clipping. The stamp table has a fixed size (elements x offsets).
    """
    side = box_side(resolution, max_dist)
    width = crop or side
    start = side // 2 - crop // 2 if crop else 0
    offsets: dict[str, list[tuple[int, int, int]]] = {}
    for r in stamps.collect():
        offsets.setdefault(r["element"], []).append((r["dx"], r["dy"], r["dz"]))
    number = {e: i for i, e in enumerate(sorted(offsets))}
    margin = max((abs(d) for o in offsets.values() for at in o for d in at), default=0)
    wide = width + 4 * margin
    laid = [np.array(offsets[e], dtype=np.int64) @ np.array([wide * wide, wide, 1]) for e in sorted(offsets)]
    element = F.create_map(*[F.lit(x) for pair in number.items() for x in pair])[F.col("element")]
    placed = grid_coordinates(atoms, resolution, max_dist).withColumn("_e", element).filter("_e is not null")
    place = F.expr(f"((_e * {side}L + gx) * {side} + gy) * {side} + gz")
    rows = placed.groupBy(*keys).agg(F.collect_set(place).alias("places"))
    at_once = max(1, (4 << 20) // wide**3)

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, at_once):
                part = batch.slice(first, at_once)
                held = part.column("places")
                row = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(held.offsets)))
                e, at = np.divmod(np.asarray(held.flatten()), side**3)
                x, y, z = (at // w % side - start + 2 * margin for w in (side * side, side, 1))
                near = np.ones(len(at), dtype=bool)
                for c in (x, y, z):  # stamps farther out reach nothing of the box
                    near &= (c >= margin) & (c < wide - margin)
                box = np.zeros(part.num_rows * wide**3, dtype=bool)
                middle = ((row * wide + x) * wide + y) * wide + z
                for i, stamp in enumerate(laid):
                    box[(middle[near & (e == i)][:, None] + stamp).ravel()] = True
                inner = slice(2 * margin, 2 * margin + width)
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keys], finish(box.reshape(-1, wide, wide, wide)[:, inner, inner, inner])], [*keys, "shape"])

    return rows.mapInArrow(lay, rows.select(*keys).schema.add("shape", kind))


def shapes(atoms: DataFrame, stamps: DataFrame, keys: Sequence[str] = ("mol_id",), crop: int | None = None, resolution: float = RESOLUTION, max_dist: float = MAX_DIST) -> DataFrame:
    """Union of the stamps at every atom, within the box or its central ``crop``: keys and ``x, y, z``, a row a voxel."""
    width = crop or box_side(resolution, max_dist)

    def listed(box: np.ndarray) -> pa.Array:
        of, voxel = np.nonzero(box.reshape(len(box), -1))
        ends = np.searchsorted(of, np.arange(len(box) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(voxel.astype(np.int32)))

    each = _laid(atoms, stamps, keys, crop, resolution, max_dist, listed, ArrayType(IntegerType())).select(*keys, F.explode("shape").alias("v"))
    return each.select(*keys, F.expr(f"cast(v div {width * width} as int)").alias("x"), F.expr(f"cast(v div {width} % {width} as int)").alias("y"), F.expr(f"v % {width}").alias("z"))


def shape_sums(atoms: DataFrame, stamps: DataFrame, keys: Sequence[str] = ("mol_id",), crop: int | None = None, resolution: float = RESOLUTION, max_dist: float = MAX_DIST) -> DataFrame:
    """Number of voxels of each of the ``shapes`` and the sums of their coordinates, a row a molecule: keys, ``n, sx, sy, sz``; no row for an empty shape."""

    def summed(box: np.ndarray) -> pa.Array:
        planes = box.sum(axis=3, dtype=np.int64)
        along = [planes.sum(axis=2), planes.sum(axis=1), box.sum(axis=(1, 2), dtype=np.int64)]
        places = np.arange(box.shape[1])
        return pa.StructArray.from_arrays([pa.array(v) for v in (along[0].sum(axis=1), *[a @ places for a in along])], ["n", "sx", "sy", "sz"])

    kind = StructType([StructField(c, LongType()) for c in ("n", "sx", "sy", "sz")])
    return _laid(atoms, stamps, keys, crop, resolution, max_dist, summed, kind).select(*keys, "shape.*").filter("n > 0")


def shape_patches(atoms: DataFrame, stamps: DataFrame, p: int, keys: Sequence[str] = ("mol_id",), crop: int | None = None, resolution: float = RESOLUTION, max_dist: float = MAX_DIST) -> DataFrame:
    """The ``patches`` of ``shapes`` as bits, a row a molecule: keys and ``patches``, a number for each patch in row-major order, empty ones too.

    Bit i of a number is cell i of the patch, in row-major order; a patch has at most 62 cells.
    """
    side = crop or box_side(resolution, max_dist)
    if side % p:
        raise ValueError(f"a side of {side} is not divisible by {p}")
    if p**3 > 62:
        raise ValueError(f"a patch of {p**3} cells does not fit a number")
    n = side // p

    def packed(box: np.ndarray) -> pa.Array:
        cells = box.reshape(len(box), n, p, n, p, n, p)
        words = np.zeros((len(box), n, n, n), dtype=np.int64)
        for i, (x, y, z) in enumerate(itertools.product(range(p), repeat=3)):
            words |= cells[:, :, x, :, y, :, z].astype(np.int64) << i
        return pa.ListArray.from_arrays(pa.array(np.arange(len(box) + 1, dtype=np.int32) * n**3), pa.array(words.ravel()))

    laid = _laid(atoms, stamps, keys, crop, resolution, max_dist, packed, ArrayType(LongType())).withColumnRenamed("shape", "patches")
    return laid.filter(F.exists("patches", lambda w: w != 0))


def rejected(atoms: DataFrame) -> DataFrame:
    """Molecules with an element that has no radius."""
    return atoms.filter(~F.col("element").isin(*RADII)).select("mol_id").distinct()


def crop(voxels: DataFrame, size: int, side: int | None = None) -> DataFrame:
    """Central cube of ``size`` voxels of a box, moved to the origin."""
    start = (side or box_side()) // 2 - size // 2
    moved = voxels.withColumns({c: F.col(c) - start for c in "xyz"})
    return moved.filter(" and ".join(f"{c} between 0 and {size - 1}" for c in "xyz"))


def patches(voxels: DataFrame, p: int, side: int, keys: Sequence[str] = ("mol_id",)) -> DataFrame:
    """All non-overlapping patches of ``p``^3 voxels in row-major order, also empty ones: keys, ``patch_id, values``."""
    if side % p:
        raise ValueError(f"a side of {side} is not divisible by {p}")
    n = side // p
    of = lambda f, w: F.expr(f"cast((({f.format('x')}) * {w} + ({f.format('y')})) * {w} + ({f.format('z')}) as int)")
    value = F.col("value").cast("double") if "value" in voxels.columns else F.lit(1.0)
    cells = voxels.select(*keys, of(f"{{}} div {p}", n).alias("patch_id"), of(f"{{}} % {p}", p).alias("cell"), value.alias("value"))
    full = cells.groupBy(*keys, "patch_id").agg(F.map_from_entries(F.collect_list(F.struct("cell", "value"))).alias("m"))
    every = voxels.select(*keys).distinct().withColumn("patch_id", F.explode(F.sequence(F.lit(0), F.lit(n**3 - 1))))
    values = F.transform(F.sequence(F.lit(0), F.lit(p**3 - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)))
    return every.join(full, [*keys, "patch_id"], "left").select(*keys, "patch_id", F.when(F.col("m").isNull(), F.array_repeat(F.lit(0.0), p**3)).otherwise(values).alias("values"))


def neighbourhoods(voxels: DataFrame, side: int, reach: int = 4, keys: Sequence[str] = ("mol_id",)) -> DataFrame:
    """How many marked voxels have each voxel in their cube of ``2 * reach + 1``, inside the box, a row a molecule: keys, ``voxels`` (their numbers in
    row-major order) and ``counts``.

    A molecule's distinct marked voxels, with how often each is marked, come together in one row (at most the voxels of the box and of what
    lies within reach of it), and a task counts the molecules of a batch one axis after the other.
    """
    wide = side + 4 * reach  # of places whose cubes may meet the box, and of their cubes
    near = " and ".join(f"{c} between {-reach} and {side - 1 + reach}" for c in "xyz")
    place = F.expr(f"((x + {2 * reach}) * {wide}L + y + {2 * reach}) * {wide} + z + {2 * reach}")
    times = voxels.filter(near).groupBy(*keys, place.alias("_place")).agg(F.count("*").alias("_n"))
    rows = times.groupBy(*keys).agg(F.collect_list(F.struct("_place", "_n")).alias("marked"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            longest = max(1, int(np.diff(np.asarray(whole.column("marked").offsets)).max(initial=0)))
            at_once = max(1, (4 << 20) // (longest * (2 * reach + 1) ** 3))
            for first in range(0, whole.num_rows, at_once):
                batch = whole.slice(first, at_once)
                held = batch.column("marked")
                row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(held.offsets)))
                at, n = (np.asarray(held.flatten().field(i)).astype(np.int64) for i in range(2))
                at = at + row * wide**3
                for step in (wide * wide, wide, 1):
                    at, of = np.unique((at[:, None] + np.arange(-reach, reach + 1) * step).ravel(), return_inverse=True)
                    total = np.zeros(len(at), dtype=np.int64)
                    np.add.at(total, of, np.repeat(n, 2 * reach + 1))
                    n = total
                x, y, z = (at // w % wide - 2 * reach for w in (wide * wide, wide, 1))
                inside = (x >= 0) & (x < side) & (y >= 0) & (y < side) & (z >= 0) & (z < side)
                ends = pa.array(np.searchsorted((at // wide**3)[inside], np.arange(batch.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(v[inside])) for v in ((x * side + y) * side + z, n)]
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *lists], [*keys, "voxels", "counts"])

    schema = rows.select(*keys).schema.add("voxels", ArrayType(LongType())).add("counts", ArrayType(LongType()))
    return rows.mapInArrow(counted, schema).filter("size(counts) > 0")


def neighbourhood_counts(voxels: DataFrame, side: int, reach: int = 4, keys: Sequence[str] = ("mol_id",)) -> DataFrame:
    """``neighbourhoods`` a row a voxel: keys, ``x, y, z, value``."""
    each = neighbourhoods(voxels, side, reach, keys).select(*keys, F.explode(F.arrays_zip("voxels", "counts")).alias("v"))
    at = [F.expr(f"cast(v.voxels div {w} % {side} as int)").alias(c) for c, w in zip("xyz", (side * side, side, 1), strict=True)]
    return each.select(*keys, *at, F.col("v.counts").alias("value"))


def union_of_seeds(voxels: DataFrame, n: int = 10, seed: int = 0) -> DataFrame:
    """Voxels of ``n`` molecules, taken by hash of the id, each once: ``x, y, z``."""
    chosen = voxels.select("mol_id").distinct().orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("mol_id").cast("string"))), "mol_id").limit(n)
    return voxels.join(F.broadcast(chosen), "mol_id", "left_semi").select("x", "y", "z").distinct()


def diagonal_overlap(cavity: DataFrame, union: DataFrame, least: int = 2400, most: int = 121) -> DataFrame:
    """Overlap of the cavity with the union moved along the diagonal: ``offset, overlap`` for offsets 0 to ``most`` over ``least``; the first one counts.

    Two voxels meet at offset d where they differ by d on all axes, that is, where x - y and y - z agree.
    """
    line = lambda df, n: df.select((F.col("x") - F.col("y")).alias("u"), (F.col("y") - F.col("z")).alias("v"), F.col("z").alias(n))
    met = line(cavity, "zc").join(line(union, "zu"), ["u", "v"]).select((F.col("zc") - F.col("zu")).alias("offset"))
    return met.filter(F.col("offset").between(0, most)).groupBy("offset").agg(F.count("*").alias("overlap")).filter(F.col("overlap") > least)


def overlap_crop(cavity: DataFrame, union: DataFrame, polar: DataFrame, least: int = 2400, most: int = 121, before: int = 13, after: int = 14) -> tuple[DataFrame, DataFrame] | None:
    """Cubes of ``before + after + 1`` voxels round the mean of the overlap at the first offset over ``least``: the overlap ``x, y, z`` and the same
    cube of ``polar (x, y, z, value)``, both moved to the origin; None where no offset is over ``least``. Means are rounded half to even.
    """
    found = diagonal_overlap(cavity, union, least, most).agg(F.min("offset")).first()[0]
    if found is None:
        return None
    moved = union.select(*[(F.col(c) + found).alias(c) for c in "xyz"])
    overlap = cavity.select(*"xyz").join(moved, list("xyz"), "left_semi").distinct()
    middle = overlap.agg(*[F.bround(F.avg(c)).cast("int") for c in "xyz"]).first()

    def cube(voxels: DataFrame) -> DataFrame:
        at = voxels.withColumns({c: F.col(c) - (m - before) for c, m in zip("xyz", middle, strict=True)})
        return at.filter(" and ".join(f"{c} between 0 and {before + after}" for c in "xyz"))

    return cube(overlap), cube(polar)


def _draw(seed: int, what: str) -> Column:
    """A number from 0 to 1 for each molecule and purpose, by hash."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:{what}:"), F.col("mol_id").cast("string"))), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 32)


def _with_rotation(rows: DataFrame, rotations: DataFrame, n_rotations: int, most: float, seed: int) -> DataFrame:
    """Rows with the rotation drawn for their molecule (``rot_id, r00`` to ``r22``) and its translation ``tx, ty, tz``."""
    drawn = rows.withColumn("rot_id", F.floor(_draw(seed, "rotation") * n_rotations).cast("int")).join(F.broadcast(rotations), "rot_id")
    return drawn.withColumns({f"t{c}": _draw(seed, c) * most for c in "xyz"})


_DRAWN = [f"r{i}{j}" for i in range(3) for j in range(3)] + ["tx", "ty", "tz"]


def augmented(atoms: DataFrame, rotations: DataFrame, n_rotations: int, most: float, seed: int = 0) -> DataFrame:
    """Each molecule under one rotation of the table, then moved by up to ``most`` along each axis, both drawn by hash of its id."""
    turned = {c: sum((F.col(f"r{i}{j}") * F.col(d) for j, d in enumerate("xyz")), F.lit(0.0)) + F.col(f"t{c}") for i, c in enumerate("xyz")}
    return _with_rotation(atoms, rotations, n_rotations, most, seed).withColumns(turned).drop(*_DRAWN)


def augmented_fragments(fragments: DataFrame, rotations: DataFrame, n_rotations: int, most: float, seed: int = 0) -> DataFrame:
    """Fragments ``mol_id, rotate_mat (nine numbers by rows), trans_vec`` moved as ``augmented`` moves their molecule: R M and R v + t."""
    r = lambda i, j: F.col(f"r{i}{j}")
    matrix = F.array(*[sum((r(i, k) * F.get("rotate_mat", F.lit(3 * k + j)) for k in range(3)), F.lit(0.0)) for i in range(3) for j in range(3)])
    vector = F.array(*[sum((r(i, k) * F.get("trans_vec", F.lit(k)) for k in range(3)), F.lit(0.0)) + F.col(f"t{c}") for i, c in enumerate("xyz")])
    return _with_rotation(fragments, rotations, n_rotations, most, seed).withColumns({"rotate_mat": matrix, "trans_vec": vector}).drop(*_DRAWN)


def shape_dataset(atoms: DataFrame, crop_side: int = 21, patch: int = 3) -> DataFrame:
    """Patches of the cropped shape of every molecule under the 24 rotations; molecules with an unknown element are left out."""
    spark = atoms.sparkSession
    known = atoms.join(rejected(atoms), "mol_id", "left_anti")
    turned = rotate_all(centred(known), rotation_table(spark, box_rotations()))
    shape = shapes(turned, atom_stamps(spark), ("mol_id", "rot_id"), crop_side)
    return patches(shape, patch, crop_side, ("mol_id", "rot_id"))


def assembled(shapes: DataFrame, grids: DataFrame, fingerprints: DataFrame, graphs: DataFrame) -> DataFrame:
    """One row for each rotation of each molecule that has all parts: ``shapes`` and ``grids`` by ``mol_id, rot_id``, ``fingerprints`` and ``graphs`` by ``mol_id``."""
    return shapes.join(grids, ["mol_id", "rot_id"]).join(fingerprints, "mol_id").join(graphs, "mol_id")
