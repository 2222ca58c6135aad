"""Document fingerprints, with DataFrame functions only: bottom-k sketches of shingle hashes.

The sketch of a text holds the ``k`` least hashes of its distinct shingles, ascending: a uniform sample without
replacement of the shingle set. Sketches of parts merge into the sketch of the whole, and two sketches estimate the
resemblance and the containment of their sets; one alone estimates the number of distinct shingles. Sets of at most
``k`` shingles are held whole, and the estimates over them are exact.

Shingles are runs of five words after A-Z become lower case; a text with fewer words is one shingle.

Defined cases: a null or empty text, or one without words, has an empty sketch; two empty sets are alike (1), an empty
and a non-empty one are not (0); equal texts have equal sketches; null ids come last, and rows with equal ids are ordered by the
hash of their text; names of further columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retort.llm.common import ascii_lower, joined_hashes, unused, words

#: Hashes in a sketch; the standard error of a resemblance r is about sqrt(r (1 - r) / K).
K = 256


def with_sketch(rows: DataFrame, text: str, name: str, k: int = K) -> DataFrame:
    """``rows`` with the sketch of column ``text`` as ``name``, an array of at most ``k`` ascending hashes."""
    h1, h2, h4 = (unused(h, rows.columns) for h in ("h1", "h2", "h4"))
    one = rows.withColumn(h1, F.transform(words(ascii_lower(F.col(text))), lambda w: F.xxhash64(w)))
    two = one.withColumn(h2, joined_hashes(F.col(h1), 1))
    four = two.withColumn(h4, joined_hashes(F.col(h2), 2)).drop(h2)
    left = F.greatest(F.size(h1) - 4, F.lit(0))
    five = F.zip_with(F.slice(h4, 1, left), F.slice(h1, 5, left), lambda a, b: F.xxhash64(a, b))
    few = F.when(F.size(h1) > 0, F.array(F.xxhash64(h1))).otherwise(F.array().cast("array<bigint>"))
    shingles = F.when(F.size(h1) >= 5, five).otherwise(few)
    return four.withColumn(name, F.slice(F.sort_array(F.array_distinct(shingles)), 1, k)).drop(h1, h4)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merged_by(rows: DataFrame, keys: list[str], sketch: str, k: int = K) -> DataFrame:
    """One sketch a group from the sketches of its parts; both steps cut down before the shuffle."""
    hashes = rows.select(*keys, F.explode(sketch).alias("_hash")).distinct()
    least = hashes.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("_hash"))).filter(F.col("_rank") <= k)
    return least.groupBy(*keys).agg(F.sort_array(F.collect_list("_hash")).alias(sketch))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of intersection size / union size, 0 to 1."""
    union = merged(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) > 0, both / F.size(union)).otherwise(1.0)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimate of the number of distinct shingles: exact below ``k``, else (k - 1) / the share of the hash range up to the k-th hash."""
    share = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the share of the first set that lies in the second."""
    r = resemblance(a, b, k)
    size_a, size_b = distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), r / (1 + r) * (size_a + size_b) / size_a))


def as_text(sketch: Column) -> Column:
    """The hashes of a sketch in hexadecimal, comma-joined."""
    return F.array_join(F.transform(sketch, lambda h: F.hex(h)), ",")


def with_next(rows: DataFrame, id_col: str, carried: list[str], buckets: int) -> DataFrame:
    """``rows`` with the columns ``carried`` of the next row as ``_next_<name>``, by descending id, nulls last; the first row follows the last.

    Ids are cut at quantiles into ranges of like numbers of rows, one window partition each. The head of each range is
    copied to the end of the range before it, so that no step sees more than one range; the table of heads has one row a
    range. Rows with equal ids follow each other by the hash of the first column carried; rows with null ids are cut into ranges by that.
    """
    cuts = sorted({int(x) for x in rows.stat.approxQuantile(id_col, [i / buckets for i in range(1, buckets)], 0.25 / buckets)}) if buckets > 1 else []
    width = max(1, int(len(cuts) ** 0.5))
    bucket = F.lit(0)
    if cuts:
        above = lambda points: F.size(F.filter(points, lambda c: c < F.col(id_col)))
        coarse = above(F.array(*[F.lit(c) for c in cuts[::width]]))  # a cut is looked up in two short lists
        fine = F.slice(F.array(*[F.lit(c) for c in cuts]), F.greatest(coarse - 1, F.lit(0)) * width + 1, F.lit(width))
        bucket = F.when(coarse == 0, 0).otherwise((coarse - 1) * width + above(fine))
    tie, span, head, onto, place = (unused(c, [*rows.columns, *(f"_next_{c}" for c in carried)]) for c in ("tie", "span", "head", "onto", "place"))
    of_null = F.shiftright(F.col(tie), 58).cast("int") - 33  # 64 ranges below all others
    placed = rows.withColumn(tie, F.xxhash64(carried[0])).withColumn(span, F.when(F.col(id_col).isNull(), of_null).otherwise(bucket).cast("int"))
    by_range = Window.orderBy(span)
    heads = placed.groupBy(span).agg(F.max(F.struct(id_col, tie)).alias(head))
    follow = heads.withColumn(onto, F.coalesce(F.lead(span).over(by_range), F.min(span).over(Window.partitionBy())))
    is_head = F.struct(id_col, tie).eqNullSafe(F.col(head))
    here = F.struct(F.col(span).alias("at"), F.lit(0).alias("guest"))
    there = F.struct(F.col(onto).alias("at"), F.lit(1).alias("guest"))
    copied = placed.join(F.broadcast(follow), span).withColumn(place, F.explode(F.when(is_head, F.array(here, there)).otherwise(F.array(here)))).drop(head, onto, span)
    order = Window.partitionBy(f"{place}.at").orderBy(f"{place}.guest", F.col(id_col).desc_nulls_last(), F.col(tie).desc())
    led = copied.withColumns({f"_next_{c}": F.lead(c).over(order) for c in carried})
    return led.filter(F.col(f"{place}.guest") == 0).drop(place, tie)


def edited_pairs(docs: DataFrame, k: int = K) -> DataFrame:
    """Each whole text with its sketch, its edited text (its last third replaced by the head of the next document), that text's sketch, and both likenesses."""
    session = docs.sparkSession
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).withColumn("_n", F.char_length("_text"))
    buckets = 4 * int(session.conf.get("spark.sql.shuffle.partitions"))
    pairs = with_next(with_sketch(base, "_text", "_sketch", k), "doc_id", ["_text", "_sketch"], buckets)
    third = F.floor(F.col("_n") / 3).cast("int")
    edited = pairs.withColumn("_edited", F.concat(F.substr("_text", F.lit(1), F.col("_n") - third), F.substr("_next__text", F.lit(1), third)))
    both = with_sketch(edited.drop("_text", "_next__text"), "_edited", "_edited_sketch", k)
    return both.withColumns({"_near_edited": resemblance(F.col("_sketch"), F.col("_edited_sketch"), k), "_near_next": resemblance(F.col("_sketch"), F.col("_next__sketch"), k)})
