"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations give every signature coordinate: the first scatters shingles over a universe of ``UNIVERSE`` places,
the second is a table of ranks, and coordinate ``k`` is the least rank after shifting the table circularly by ``k``; a
shingle's ranks for all shifts are one slice of the table. Bands of the signature are bucket keys.

Texts with equal shingle sets form a class, and only one text of each goes on. Within a bucket all classes are first checked
against one hub, the class that shares most buckets with others; as long as that joins many of them, further hubs follow from
outside the bucket's main component. Then all pairs of a bucket that still lie in different components are met in blocks. A
pair is dropped unchecked only if it cannot be alike: by the sizes of its sets, or by a bound of the intersection from one
bit for each place that shingles fall on, which never is too low. The others are checked on the full shingle sets, as are
those of the hubs. Pairs inside one component need no check, for they cannot change it. So a group of near copies costs about
its size, no partner is capped, and no link between two classes of a bucket is lost.

Tables between the steps are written and read again rather than checkpointed: they are computed once, and small ones come back
in few partitions with a known size, so that the driver plans and tracks few tasks.

Defined cases: a null or empty text, or one without words, has no shingles and is linked with nothing; a text of fewer
than five words is one shingle; a null id is never linked; rows that repeat an id are documents of their own, linked by their
own texts (those of one set with the same id are copies like any others, of which one stays); names of further columns do not
matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retort.llm.common import unused, written
from retort.llm.hashing import mixed, shingle_sets

BANDS, ROWS = 40, 5
UNIVERSE = 1 << 20
#: Percent of the union that the intersection must reach.
PERCENT = 75
#: Another round of hubs follows if so many times its links are at least its checked pairs.
PRODUCTIVE = 10
#: Bits of the bound of an intersection.
BITS = 2048
#: Rows of a bucket that meet in one task, on either side.
BLOCK = 1024
#: So many rows of an id and a hash or two, about 100 MB in a task's memory, go to every task; more are joined by a shuffle.
MOST_BROADCAST = 2_000_000


@lru_cache(maxsize=1)
def _shifted_ranks() -> np.ndarray:
    """Row ``s`` holds the ranks of place ``s`` under every shift."""
    ranks = np.random.Generator(np.random.PCG64(77)).permutation(UNIVERSE).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([ranks, ranks[: BANDS * ROWS - 1]]), BANDS * ROWS)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Circulant MinHash signature of a non-empty set of 64-bit shingle hashes."""
    shifted, places = _shifted_ranks(), (mixed(shingles) >> np.uint64(64 - 20)).astype(np.int64)
    least = shifted[places[0]].copy()
    for at in range(0, len(places), 2048):
        np.minimum(least, shifted[places[at : at + 2048]].min(axis=0), out=least)
    return least


def _band_keys(signatures: np.ndarray) -> np.ndarray:
    """64-bit keys of the bands of each signature."""
    weights = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)).reshape(BANDS, ROWS) | np.uint64(1)
    parts = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64) + np.uint64(1)
    return mixed((parts * weights).sum(axis=2, dtype=np.uint64) + mixed(np.arange(BANDS, dtype=np.uint64))).view(np.int64)


def _bits(shingles: np.ndarray) -> np.ndarray:
    """One bit for each place of ``BITS`` that a shingle of the set falls on, as 64-bit values."""
    out = np.zeros(BITS, dtype=np.uint8)
    out[(mixed(shingles ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        n = batch.num_rows
        size, one, two = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        filled, signatures = [], []
        for i, shingles in shingle_sets(batch.column("text")):
            size[i] = len(shingles)
            if len(shingles):
                one[i] = shingles.sum(dtype=np.uint64).astype(np.int64)
                two[i] = mixed(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)
                filled.append(i)
                signatures.append(signature(shingles))
        lengths = np.zeros(n + 1, np.int32)
        lengths[np.array(filled, dtype=np.int64) + 1] = BANDS
        keys = _band_keys(np.array(signatures)).ravel() if filled else np.empty(0, np.int64)
        bands = pa.ListArray.from_arrays(pa.array(np.cumsum(lengths, dtype=np.int32)), pa.array(keys))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(size), pa.array(one), pa.array(two), bands], ["doc_id", "digest", "n", "one", "two", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        sets = [s for _, s in shingle_sets(batch.column("text"))]
        ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        shingles = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
        bits = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * (BITS // 64)), pa.array(np.concatenate([_bits(s) for s in sets])))
        yield pa.RecordBatch.from_arrays([batch.column("id"), shingles, bits], ["id", "shingles", "bits"])


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links (a, b)``: ``id, component`` for every linked id, the component being its least id.

    Labels go over the links and then to their own label's label, until none that comes over a link is less than what is there.
    ``links`` is read every round.
    """
    ends = F.explode(F.array(*[F.struct(F.col(x).alias("id"), F.col(y).alias("near")) for x, y in ("ab", "ba", "aa", "bb")]))
    both = links.select(ends.alias("e")).select("e.id", "e.near")
    labels = written(both.groupBy("id").agg(F.min("near").alias("component")), "labels")
    own = F.min(F.when(F.col("id") == F.col("near"), F.col("component"))).alias("own")
    while True:
        sent = written(both.join(labels.withColumnRenamed("id", "near"), "near").groupBy("id").agg(own, F.min("component").alias("to")), "sent")
        if sent.filter("to < own").isEmpty():
            return labels
        roots = sent.select(F.col("id").alias("root"), F.col("to").alias("root_to"))
        labels = written(sent.join(roots, F.col("to") == F.col("root"), "left").select("id", F.least("to", F.coalesce("root_to", "to")).alias("component")), "labels")


def _joined(labels: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """Components after ``fresh (a, b)`` links; only links between components are followed."""
    if labels is None:
        return components(fresh)
    of_a, of_b = (labels.select(F.col("id").alias(x), F.col("component").alias(f"of_{x}")) for x in "ab")
    between = fresh.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    moved = components(written(between.filter("a != b").distinct(), "between"))
    known = labels.unionByName(fresh.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(labels, "id", "left_anti").withColumn("component", F.col("id")))
    return written(known.join(moved.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left").select("id", F.coalesce("to", "component").alias("component")), "labels")


def _enough(both: Column, n_a: Column, n_b: Column) -> Column:
    """True where an intersection of ``both`` shingles, or a bound of it, reaches ``PERCENT`` of the union."""
    return 100 * both >= PERCENT * (n_a + n_b - both)


def _fitting(n_a: Column, n_b: Column) -> Column:
    """Sizes of sets that can be alike enough."""
    return _enough(F.least(n_a, n_b), n_a, n_b)


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs (a, b)`` whose full shingle sets are alike enough."""
    first, second = (sets.select(F.col("id").alias(x), F.col("shingles").alias(f"of_{x}")) for x in "ab")
    joined = pairs.join(first, "a").join(second, "b")
    return joined.filter(_enough(F.size(F.array_intersect("of_a", "of_b")), F.size("of_a"), F.size("of_b"))).select("a", "b")


def _most_shared(a: str, b: str) -> Column:
    """What the intersection of two sets holds at most: every common shingle sets a bit of both, and those that share a bit
    with another shingle of their set are at most the spare ones of either."""
    return sum((F.bit_count(F.get(F.col(f"{a}bits"), F.lit(i)).bitwiseAND(F.get(F.col(f"{b}bits"), F.lit(i)))) for i in range(BITS // 64)), F.least(F.col(f"{a}spare"), F.col(f"{b}spare")))


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs ``a < b`` of ``id, b``."""
    return pairs.select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct()


def _hub_pairs(open_rows: DataFrame) -> DataFrame:
    """Each row of a bucket with the bucket's hub, where they lie in different components and their sizes fit.

    The hub is the row that shares most buckets with others, outside the bucket's main component if there is one: copies of one
    text are closer to it than to each other, and share more buckets with it.
    """
    hub = F.max(F.struct((F.col("component") != F.col("main")).alias("aside"), "mates", "id", "n", "component"))
    hubs = open_rows.groupBy("band").agg(hub.alias("hub")).select("band", F.col("hub.id").alias("b"), F.col("hub.n").alias("n_b"), F.col("hub.component").alias("of_b"))
    met = open_rows.join(written(hubs, "hubs"), "band").filter((F.col("component") != F.col("of_b")) & _fitting(F.col("n"), F.col("n_b")))
    return _ordered(met)


def _block_pairs(open_rows: DataFrame, sets: DataFrame) -> DataFrame:
    """All pairs of a bucket in different components whose bits leave it open whether they are alike.

    Each such pair has a row outside the bucket's main component, so that these meet all rows. Both sides are cut by hash into
    blocks of about ``BLOCK`` rows, and every pair of blocks is a join key of its own: a bucket of any size is spread.
    """
    bits = sets.select("id", "bits", (F.size("shingles") - F.aggregate("bits", F.lit(0), lambda a, x: a + F.bit_count(x))).alias("spare"))
    rows = open_rows.join(bits, "id")
    block = lambda count, side: F.pmod(F.xxhash64("id", F.lit(side)), F.ceil(F.col(count) / BLOCK)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.ceil(F.col(count) / BLOCK).cast("int") - 1))
    own = ["id", "n", "component", "bits", "spare"]
    aside = rows.filter("component != main").select("band", "main", *own, block("n_aside", 1).alias("i"), every("size").alias("j"))
    whole = rows.select("band", *[F.col(c).alias(f"b_{c}") for c in own], block("size", 2).alias("j"), every("n_aside").alias("i"))
    once = (F.col("b_component") == F.col("main")) | (F.col("component") < F.col("b_component"))
    likely = _fitting(F.col("n"), F.col("b_n")) & _enough(_most_shared("", "b_"), F.col("n"), F.col("b_n"))
    met = aside.join(whole, ["band", "i", "j"]).filter((F.col("component") != F.col("b_component")) & once & likely)
    return _ordered(met.select("id", F.col("b_id").alias("b")))


def _open_rows(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Rows of the buckets with classes of different components: with ``component``, the bucket's main component, its size, and how many rows lie outside that."""
    if labels is None:
        placed = members.withColumn("component", F.col("id"))
    else:
        placed = written(members.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")), "placed")
    parts = placed.groupBy("band", "component").agg(F.count("*").alias("part"))
    largest = F.max(F.struct("part", "component")).alias("largest")
    totals = parts.groupBy("band").agg(F.sum("part").alias("size"), largest).filter("size > largest.part")
    return placed.join(written(totals.selectExpr("band", "size", "largest.component main", "size - largest.part n_aside"), "totals"), "band")


def _classes(signed: DataFrame) -> DataFrame:
    """Sets of shingles, numbered: ``n, one, two, id``, the least document ``doc_id`` with its ``digest``, and ``bands``."""
    grouped = signed.filter("n > 0 and doc_id is not null").groupBy("n", "one", "two").agg(F.min(F.struct("doc_id", "digest")).alias("of"), F.first("bands").alias("bands"))
    return written(grouped.select("n", "one", "two", "of.doc_id", "of.digest", "bands", F.monotonically_increasing_id().alias("id")), "classes")


def _few(rows: DataFrame) -> DataFrame:
    """``rows``, narrow ones, marked to go to every task if they are few, so that the texts which they are joined to need not move."""
    return F.broadcast(rows) if rows.count() <= MOST_BROADCAST else rows


def _labels(texts: DataFrame, classes: DataFrame) -> DataFrame | None:
    """``id, component`` of the linked classes; None where no class is linked."""
    buckets = classes.select("id", "n", F.explode("bands").alias("band"))
    shared = written(buckets.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1"), "shared")
    members = written(buckets.join(shared, "band"), "buckets")
    mates = members.groupBy("id").agg(F.sum("size").alias("mates"))
    members = written(members.drop("size").join(mates, "id"), "members")
    wanted = written(members.select("id").distinct().join(classes.select("id", "doc_id", "digest"), "id"), "wanted")
    sets = written(texts.join(_few(wanted), ["doc_id", "digest"]).dropDuplicates(["id"]).select("id", "text").mapInArrow(_sets, "id long, shingles array<long>, bits array<long>"), "sets")
    labels, productive = None, True
    while True:
        if labels is None and productive:  # the first hubs come before any components
            open_rows = members.withColumns({"component": F.col("id"), "main": F.lit(None).cast("long")})
        else:
            open_rows = _open_rows(members, labels)
        pairs = written(_hub_pairs(open_rows) if productive else _block_pairs(open_rows, sets), "pairs")
        fresh = written(_alike(pairs, sets), "links")
        n_links = fresh.count()
        if n_links:
            labels = _joined(labels, fresh)
        if not productive:
            return labels
        productive = n_links > 0 and PRODUCTIVE * n_links >= pairs.count()


def _verdicts(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, n, one, two, component_id`` for each row of ``docs (doc_id, text)``: a hash of the text, the size of its set, two hashes of that, and its component, if it can have one."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text")
    signed = written(texts.mapInArrow(_signed, "doc_id long, digest long, n long, one long, two long, bands array<long>"), "signatures")
    classes = _classes(signed)
    labels = _labels(texts, classes)
    named = classes.select("n", "one", "two", "id", F.col("doc_id").alias("component_id"))
    if labels is not None:
        least = written(named.join(labels, "id").groupBy("component").agg(F.min("component_id").alias("least")), "least")
        named = named.join(labels.join(least, "component").select("id", "least"), "id", "left").withColumn("component_id", F.coalesce("least", "component_id"))
    out = signed.select("doc_id", "digest", "n", "one", "two").join(written(named.select("n", "one", "two", "component_id"), "named"), ["n", "one", "two"], "left")
    return out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs (doc_id, text)``."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return _verdicts(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each component, with the columns of ``docs``; of rows with equal id and set one stays, rows with a null id all stay."""
    verdicts = written(_verdicts(docs).filter("doc_id is not null"), "verdicts")
    texts = verdicts.groupBy("doc_id", "digest", "n", "one", "two", "component_id").agg(F.count("*").alias("rows"))
    first = F.min("digest").over(Window.partitionBy("doc_id", "n", "one", "two"))
    stays = (F.col("doc_id") == F.col("component_id")) & (F.col("digest") == F.col("first"))
    key, twice = unused("key", docs.columns), unused("twice", docs.columns)
    # only texts that go, or that stand in several rows, are looked up
    marked = texts.withColumn("first", first).withColumn(twice, stays).filter(~F.col(twice) | (F.col("rows") > 1))
    marked = written(marked.select(F.struct("doc_id", "digest").alias(key), twice), "marked")
    keyed = docs.filter(F.col("doc_id").isNotNull()).withColumn(key, F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest")))
    joined = keyed.join(_few(marked), key, "left")
    out = joined.filter(F.col(twice).isNull()).drop(key, twice).unionByName(docs.filter(F.col("doc_id").isNull()))
    if marked.filter(F.col(twice)).isEmpty():
        return out
    return out.unionByName(joined.filter(F.col(twice)).dropDuplicates([key]).drop(key, twice))
