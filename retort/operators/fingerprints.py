"""Fingerprints of pharmacophore points ``mol_id, conf_id, point_no, feat, x, y, z`` and of atom graphs, and their statistics.

Distances as rows come from a self equi-join on the molecule, aggregated right after the join. Histograms read their points once, as a row
a molecule, and lay out a bounded number of distances at a time.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Feature types in the order of the fingerprints. Fixed values.
FEATURES = ("ARO", "HBD", "HBA", "POS", "NEG", "HYD")
#: Histogram of distances: 40 bins of width 1.5 from -20 to 40.
BINS, LOW, WIDTH = 40, -20.0, 1.5
#: Pairs of points, conformers and molecules whose distances and sums a task holds at a time.
PAIRS_AT_ONCE, CONFORMERS_AT_ONCE, MOLECULES_AT_ONCE = 1 << 18, 1024, 1024


def feature_number(feat: Column) -> Column:
    """Number of a feature type in the fixed order; null for others."""
    return F.array_position(F.array(*[F.lit(f) for f in FEATURES]), feat) - 1


def _pair_slot(i: Column, j: Column) -> Column:
    """Number of the unordered pair of types, i <= j, row by row."""
    n = len(FEATURES)
    return i * n - F.floor(i * (i - 1) / 2) + (j - i)


def point_distances(points: DataFrame, unordered: bool = False) -> DataFrame:
    """Distances of point pairs in a molecule: ``mol_id, conf_id, slot, distance``, slots numbering the pairs of types.

    Equal types give all ordered pairs with self pairs, different types each pair once; ``unordered`` gives pairs of different
    points, each once.
    """
    known = points.withColumn("t", feature_number(F.col("feat"))).filter("t >= 0")
    a, b = known.alias("a"), known.alias("b")
    same = (F.col("a.mol_id") == F.col("b.mol_id")) & (F.col("a.conf_id") == F.col("b.conf_id"))
    kept = (F.col("a.point_no") < F.col("b.point_no")) if unordered else (F.col("a.t") <= F.col("b.t"))
    square = sum((F.pow(F.col(f"a.{c}") - F.col(f"b.{c}"), F.lit(2.0)) for c in ("x", "y", "z")), F.lit(0.0))
    low, high = F.least("a.t", "b.t"), F.greatest("a.t", "b.t")
    return a.join(b, same & kept).select("a.mol_id", "a.conf_id", _pair_slot(low, high).cast("int").alias("slot"), F.sqrt(square).alias("distance"))


def histogram_bin(distance: Column) -> Column:
    """Bin of a distance by comparison with the edges, the last closed on the right; null beyond."""
    guess = F.floor((distance - LOW) / WIDTH)
    edge = lambda i: F.lit(LOW) + i * WIDTH
    fixed = F.when(distance < edge(guess), guess - 1).when(distance >= edge(guess + 1), guess + 1).otherwise(guess)
    return F.when((distance < LOW) | (distance > LOW + BINS * WIDTH), None).otherwise(F.least(fixed, F.lit(BINS - 1))).cast("int")


def _conformer_sums(lists: pa.ListArray, unordered: bool, weigh: Callable, size: int, across: np.ufunc) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, places and values, zeros left out, of the sums over the distances in each conformer, put together by ``across`` for each row's conformers.

    ``lists`` has the points of a molecule in a row. ``weigh`` gives, for numbers of pairs of types and distances, some arrays of which pairs count,
    at which of ``size`` places, and how much.
    """
    flat = lists.flatten()
    row = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
    conformer = flat.field("conf_id").dictionary_encode().indices.to_numpy(zero_copy_only=False)
    order = np.lexsort((conformer, row))
    row, conformer = row[order], conformer[order]
    t, number, x, y, z = (flat.field(c).to_numpy(zero_copy_only=False)[order] for c in ("t", "point_no", "x", "y", "z"))
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (conformer[1:] != conformer[:-1])]) if len(row) else np.zeros(0, dtype=np.int64)
    n = np.diff(np.r_[first, len(row)])
    own = np.repeat(np.arange(len(first)), n)  # the conformer of a point
    squares, found, at = np.cumsum(n * n), [], 0
    while at < len(first):
        to = max(at + 1, min(at + CONFORMERS_AT_ONCE, int(np.searchsorted(squares, squares[at] - n[at] ** 2 + PAIRS_AT_ONCE, "right"))))
        sums, point, last = np.zeros((to - at) * size), first[at], first[to - 1] + n[to - 1]
        while point < last:  # once, but for a conformer that has more pairs alone
            end = min(last, point + max(1, PAIRS_AT_ONCE // int(n[at]))) if to == at + 1 else last
            partners = n[own[point:end]]
            a = np.repeat(np.arange(point, end), partners)
            b = np.arange(len(a)) - np.repeat(np.cumsum(partners) - partners, partners) + first[own[a]]
            kept = number[a] < number[b] if unordered else t[a] <= t[b]
            a, b = a[kept], b[kept]
            low, high = np.minimum(t[a], t[b]), np.maximum(t[a], t[b])
            distance = np.sqrt((x[a] - x[b]) ** 2 + (y[a] - y[b]) ** 2 + (z[a] - z[b]) ** 2)
            for counts, place, weight in weigh(low * len(FEATURES) - low * (low - 1) // 2 + high - low, distance):
                sums += np.bincount((own[a[counts]] - at) * size + place, weight, len(sums))
            point = end
        held = np.flatnonzero(sums)
        found.append((row[first[at + held // size]] * size + held % size, sums[held]))
        at = to
    keys, sums = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, dtype=(np.int64, float)[i]) for i in (0, 1))
    keys, where = np.unique(keys, return_inverse=True)
    values = np.zeros(len(keys))
    across.at(values, where, sums)  # sums are above zero
    return keys // size, keys % size, values


def _distance_sums(points: DataFrame, unordered: bool, weigh: Callable, size: int, across: np.ufunc) -> DataFrame:
    """``mol_id, slot, value``: ``_conformer_sums`` of each molecule. The points are read once."""
    known = points.withColumn("t", feature_number(F.col("feat")).cast("long")).filter("t >= 0 and mol_id is not null and conf_id is not null")
    if unordered:
        known = known.filter("point_no is not null")
    point = F.struct("conf_id", "t", "point_no", *[F.col(c).cast("double").alias(c) for c in "xyz"])
    held = known.groupBy("mol_id").agg(F.collect_list(point).alias("points"))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, MOLECULES_AT_ONCE):
                part = batch.slice(at, MOLECULES_AT_ONCE)
                row, place, value = _conformer_sums(part.column("points"), unordered, weigh, size, across)
                yield pa.RecordBatch.from_arrays([part.column("mol_id").take(pa.array(row)), pa.array(place.astype(np.int32)), pa.array(value)], ["mol_id", "slot", "value"])

    return held.mapInArrow(summed, f"mol_id {known.schema['mol_id'].dataType.simpleString()}, slot int, value double")


def ph4_histogram_fp(points: DataFrame, overflow: str = "wrap") -> DataFrame:
    """Sparse distance histogram, 21 pairs of types x 40 bins: ``mol_id, slot, value``; values wrap at 256 or are capped at 255."""

    def weigh(slot: np.ndarray, distance: np.ndarray):
        counts = (distance >= LOW) & (distance <= LOW + BINS * WIDTH)
        d = distance[counts]
        guess = np.floor((d - LOW) / WIDTH)
        guess += np.where(d < LOW + guess * WIDTH, -1, np.where(d >= LOW + (guess + 1) * WIDTH, 1, 0))
        yield counts, slot[counts] * BINS + np.minimum(guess, BINS - 1).astype(np.int64), None

    counted = _distance_sums(points, False, weigh, len(FEATURES) * (len(FEATURES) + 1) // 2 * BINS, np.add)
    value = F.col("value").cast("long")
    value = F.pmod(value, F.lit(256)) if overflow == "wrap" else F.least(value, F.lit(255))
    return counted.select("mol_id", "slot", value.alias("value")).filter("value != 0")


def ph4_gaussian_fp(points: DataFrame, sigma: float = 2.0, cutoff: float = 10.0, normalize: bool = True) -> DataFrame:
    """Mean, population deviation and maximum of exp(-d^2 / (2 sigma^2)) over the pairs within ``cutoff``: ``mol_id, slot, value``, 63 slots, zeros left out."""
    near = point_distances(points).filter(F.col("distance") <= cutoff)
    kernel = near.withColumn("g", F.exp(-F.col("distance") * F.col("distance") / (2 * sigma * sigma)))
    moments = kernel.groupBy("mol_id", "slot").agg(F.avg("g").alias("m0"), F.stddev_pop("g").alias("m1"), F.max("g").alias("m2"))
    if normalize:
        norms = moments.groupBy("mol_id").agg(F.sqrt(F.sum(F.expr("m0 * m0 + m1 * m1 + m2 * m2"))).alias("norm"))
        moments = moments.join(norms, "mol_id")
    each = moments.select("mol_id", *(["norm"] if normalize else []), F.explode(F.expr("array(struct(slot * 3 as slot, m0 as value), struct(slot * 3 + 1 as slot, m1 as value), struct(slot * 3 + 2 as slot, m2 as value))")).alias("x"))
    value = F.col("x.value") / F.col("norm") if normalize else F.col("x.value")
    return each.select("mol_id", F.col("x.slot").alias("slot"), value.alias("value")).filter("value != 0")


def ph4_grid_fp(points: DataFrame, cells: int = 20, low: float = -20.0, high: float = 40.0) -> DataFrame:
    """Occupancy of a grid for each type, clamped to its sides: ``mol_id, slot, value``."""
    cell = lambda c: F.least(F.greatest(F.floor((F.col(c) - low) / ((high - low) / cells)), F.lit(0)), F.lit(cells - 1))
    slot = ((feature_number(F.col("feat")) * cells + cell("x")) * cells + cell("y")) * cells + cell("z")
    return points.withColumn("slot", slot.cast("long")).filter("slot is not null").groupBy("mol_id", "slot").agg(F.count("*").alias("value"))


def ph4_soft_fp(points: DataFrame, width: float = 0.5, most: float = 20.0, cap: float | None = None) -> DataFrame:
    """Distances split linearly over two neighbouring bins, unordered pairs, the maximum over conformers: ``mol_id, slot, value``."""
    bins = int(most / width)

    def weigh(slot: np.ndarray, distance: np.ndarray):
        near = distance < most
        low = np.floor(distance[near] / width)
        part = distance[near] / width - low
        for bin_, weight in ((low, 1 - part), (low + 1, part)):
            inside = bin_ < bins
            counts = np.flatnonzero(near)[inside]
            yield counts, slot[counts] * bins + bin_[inside].astype(np.int64), weight[inside]

    summed = _distance_sums(points, True, weigh, len(FEATURES) * (len(FEATURES) + 1) // 2 * bins, np.maximum)
    value = F.col("value")
    return summed.select("mol_id", F.col("slot").cast("long").alias("slot"), (F.least(value, F.lit(cap)) if cap else value).alias("value"))


def _cluster_labels(xyz: np.ndarray, radius: float) -> list[int]:
    """For each point its cluster: that of the latest point before it within ``radius``, or its own number if there is none.

    Points lie in cells so small that any two of one are within the radius; a point looks at its own and the cells around, the latest points first.
    """
    edge = radius / math.sqrt(3) if radius > 0 else 1.0
    reach = range(-2, 3)
    cells: dict[tuple[int, int, int], list[int]] = {}
    labels: list[int] = []
    places = np.floor(xyz / edge).astype(np.int64).tolist()
    points = xyz.tolist()
    for j, (cx, cy, cz) in enumerate(places):
        latest = -1
        for dx in reach:
            for dy in reach:
                for dz in reach:
                    for i in reversed(cells.get((cx + dx, cy + dy, cz + dz), ())):
                        if i <= latest:
                            break
                        if math.dist(points[i], points[j]) <= radius:
                            latest = i
                            break
        labels.append(labels[latest] if latest >= 0 else j)
        cells.setdefault((cx, cy, cz), []).append(j)
    return labels


def cluster_points(points: DataFrame, radius: float = 2.0, feat: str = "HYD", enabled: bool = True) -> DataFrame:
    """Points of one type replaced by the centroids of greedy clusters within ``radius``; a later seed takes over what it reaches, its label being its own cluster's."""
    if not enabled:
        return points
    columns = ["mol_id", "conf_id", "point_no", "feat", "x", "y", "z"]

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = []
            for rows in batch.column("p").to_pylist():
                labels.append(_cluster_labels(np.array([[r["x"], r["y"], r["z"]] for r in rows], dtype=np.float64).reshape(-1, 3), radius))
            yield batch.append_column("labels", pa.array(labels, pa.list_(pa.int32())))

    chosen = points.select(*columns).filter((F.col("feat") == feat) & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull())
    held = chosen.groupBy("mol_id", "conf_id").agg(F.sort_array(F.collect_list(F.struct("point_no", *[F.col(c).cast("double").alias(c) for c in "xyz"]))).alias("p"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema)
    each = held.mapInArrow(labelled, f"{fields}, labels array<int>").select("mol_id", "conf_id", F.explode(F.arrays_zip("p", "labels")).alias("t")).select("mol_id", "conf_id", "t.p.*", F.col("t.labels").alias("label"))
    centres = each.groupBy("mol_id", "conf_id", "label").agg(F.min("point_no").alias("point_no"), *[F.avg(c).alias(c) for c in "xyz"]).withColumn("feat", F.lit(feat))
    return points.select(*columns).filter(F.col("feat") != feat).unionByName(centres.select(*columns))


@functools.lru_cache(maxsize=1 << 17)  # like environments are in many molecules
def _identifier(text: str) -> int:
    """A number of 60 bits for a text: the first fifteen digits of its MD5."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def _environments(atoms: list[tuple[int, int, int]], bonds: list[tuple[int, int, int]], radius: int) -> list[int]:
    """Identifiers of the environments of a molecule's atoms up to ``radius`` bonds, each set of bonds counted once.

    ``atoms`` are number, atomic number and charge, ``bonds`` two numbers and the order.

    An atom's identifier of a round is made of its own and those of its neighbours of the round before, by bond orders. An environment whose bonds are those of
    one already counted, or of one of the same round with a lesser identifier, is left out, and its atom takes no part in later rounds.
    """
    current = {i: _identifier(f"{number},{charge}") for i, number, charge in atoms}
    around: dict[int, list[tuple[int, int, tuple[int, int]]]] = {i: [] for i in current}
    for x in {(a, b, o) if a < b else (b, a, o) for a, b, o in bonds}:
        if x[0] in around and x[1] in around and x[0] != x[1]:
            around[x[0]].append((x[2], x[1], x[:2]))
            around[x[1]].append((x[2], x[0], x[:2]))
    found = list(current.values())
    covered = {i: frozenset(bond for _, _, bond in n) for i, n in around.items()}
    alive, counted = sorted(i for i in current if around[i]), set()
    for r in range(1, radius + 1):
        new = {i: _identifier(f"{r}|{current[i]}|" + ",".join(f"{o}:{h}" for o, h in sorted((o, current[j]) for o, j, _ in around[i]))) for i in alive}
        sets = {i: covered[i] if r == 1 else covered[i].union(*(covered[j] for _, j, _ in around[i])) for i in alive}
        kept = []
        for i in sorted(alive, key=lambda i: (new[i], i)):
            if sets[i] not in counted:
                counted.add(sets[i])
                kept.append(i)
                found.append(new[i])
        current |= new
        covered |= sets
        alive = sorted(kept)
    return found


def _tuples(lists: pa.ListArray) -> Iterator[list[tuple]]:
    """The structs of each row of a column of lists as tuples; none where a row is null."""
    flat = lists.flatten()
    rows = list(zip(*[flat.field(i).to_pylist() for i in range(flat.type.num_fields)], strict=True))
    first = 0
    for n in lists.value_lengths().fill_null(0).to_pylist():
        yield rows[first : first + n]
        first += n


def circular_fp(atoms: DataFrame, bonds: DataFrame, radius: int = 2, bits: int = 256) -> DataFrame:
    """Set bits of a circular fingerprint: ``mol_id, bit``. All rounds run on a molecule's row; equal environments count once. Null charges read as 0."""
    a = atoms.groupBy("mol_id").agg(F.collect_list(F.struct(F.col("atom_idx").cast("long").alias("atom_idx"), F.col("atomic_num").cast("long").alias("atomic_num"), F.coalesce(F.col("charge"), F.lit(0)).cast("long").alias("charge"))).alias("atoms"))
    b = bonds.filter("a is not null and b is not null").groupBy("mol_id").agg(F.collect_list(F.struct(*[F.col(c).cast("long").alias(c) for c in ("a", "b", "order")])).alias("bonds"))
    both = a.join(b.withColumnRenamed("mol_id", "_m"), F.col("mol_id").eqNullSafe(F.col("_m")), "left").select("mol_id", "atoms", "bonds")

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine, theirs = (_tuples(batch.column(c)) for c in ("atoms", "bonds"))
            found = [sorted({h % bits for h in _environments(x, y, radius)}) for x, y in zip(mine, theirs, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("mol_id"), pa.array(found, pa.list_(pa.int32()))], ["mol_id", "set"])

    kind = dict(atoms.dtypes)["mol_id"]
    return both.mapInArrow(folded, f"mol_id {kind}, set array<int>").select("mol_id", F.explode("set").alias("bit"))


def densify(molecules: DataFrame, sparse: DataFrame, dim: int) -> DataFrame:
    """One array of ``dim`` values for each molecule, zeros where nothing is: ``mol_id, fp``."""
    gathered = sparse.groupBy("mol_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("slot").cast("int"), F.col("value").cast("double")))).alias("m"))
    value = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)))
    return molecules.select("mol_id").join(gathered, "mol_id", "left").select("mol_id", F.when(F.col("m").isNull(), F.array_repeat(F.lit(0.0), dim)).otherwise(value).alias("fp"))


def fp_stats(fps: DataFrame) -> DataFrame:
    """One row over all values of ``fp``: count, mean, population deviation, minimum, maximum, non-zeros, sparsity, zero vectors and their share."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    rows = fps.select(
        F.size("fp").alias("n"), total("fp").alias("s"), total(F.transform("fp", lambda x: x * x)).alias("q"), F.array_min("fp").alias("low"), F.array_max("fp").alias("high"),
        F.size(F.filter("fp", lambda x: x != 0)).alias("nz"),
    )
    n = F.sum("n")
    mean = F.sum("s") / n
    return rows.agg(
        n.alias("n_values"), mean.alias("mean"), F.sqrt(F.greatest(F.sum("q") / n - mean * mean, F.lit(0.0))).alias("std"), F.min("low").alias("min"), F.max("high").alias("max"), F.sum("nz").alias("non_zeros"),
        (1 - F.sum("nz") / n).alias("sparsity"), F.sum(F.when(F.col("nz") == 0, 1).otherwise(0)).alias("zero_vectors"), F.avg(F.when(F.col("nz") == 0, 1.0).otherwise(0.0)).alias("zero_share"),
    )


def common_values(fps: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most common values with their counts and shares."""
    counts = fps.select(F.explode("fp").alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.orderBy(F.desc("n"), "value").limit(n).crossJoin(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("total")).alias("share"))


def section_stats(fps: DataFrame, width: int = 40) -> DataFrame:
    """Mean, non-zeros and maximum of each run of ``width`` positions: ``section, mean, non_zeros, max``."""
    each = fps.select(F.posexplode("fp").alias("pos", "value"))
    return each.groupBy(F.floor(F.col("pos") / width).alias("section")).agg(F.avg("value").alias("mean"), F.count_if(F.col("value") != 0).alias("non_zeros"), F.max("value").alias("max"))


_REGISTRY: dict[str, tuple[int, Callable]] = {}


def register_fingerprint(name: str, dim: int, make: Callable[..., DataFrame]) -> None:
    """Make a fingerprint available by name; ``make`` returns sparse ``mol_id, slot, value`` rows."""
    _REGISTRY[name] = (dim, make)


def fingerprint(name: str, *args, dim: int | None = None, **options) -> DataFrame:
    """The sparse fingerprint of a registered type; ``dim``, if given, must be its dimension."""
    if name not in _REGISTRY:
        raise ValueError(f"unknown fingerprint type {name}")
    if dim is not None and dim != _REGISTRY[name][0]:
        raise ValueError(f"{name} has {_REGISTRY[name][0]} values, not {dim}")
    return _REGISTRY[name][1](*args, **options)


register_fingerprint("ph4_histogram", 21 * BINS, ph4_histogram_fp)
register_fingerprint("ph4_gaussian", 63, ph4_gaussian_fp)
register_fingerprint("ph4_grid", 6 * 20**3, ph4_grid_fp)
