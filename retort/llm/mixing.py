"""Mixing sources to target weights, with DataFrame functions only.

Every row gets a hash-random key. Within a source the rows are laid out in key order: the key's leading bits are a
range bucket, equal in expected size for every bucket because the key is uniform, so no source, however hot, lands
in one task. Prefix sums of the sizes over the buckets of a source (a table of sources x buckets) say in which bucket its
budget ends: rows of earlier buckets are within it, rows of later ones are not, and only the rows of that one bucket
are sorted and summed one by one. So texts are not shuffled. A source whose target is ``e`` times its size plus a rest
takes every row ``e`` times and the first ``rest`` words of the layout once more; the row that the cut falls in is taken in part.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; keys are of id and text, so that rows
with a null or a repeated id are spread like others; equal rows share a key and are interchangeable; names of further columns
do not matter, as the given row travels in a column of its own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retort.llm.common import WORD, checkpointed, n_words, written

#: Budgets of at most so many sources go to every task; beyond, they are joined by a shuffle.
MOST_BROADCAST_SOURCES = 50_000


def mix_key(doc_id: Column, text: Column, seed: str) -> Column:
    """Uniform key of a row: 16 hexadecimal digits, the same on every run."""
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))), 1, 16)


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """Target of each source: ``source, size`` in, ``source, source_size, target`` out, a row a source.

    The sources, by code point with null last, take the weights in turn and share ``share`` times all sizes; a target
    stops at ``epochs`` times its source's size and the excess is shared again by weight. The fixed point gives each
    source min(cap, level * weight), and the level follows from one sort by cap / weight.
    """
    by_name, by_cap = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, onward = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("weight", weight)
        .withColumn("cap", F.lit(epochs) * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward))
        .withColumn("found", F.min(F.when(F.col("level") <= F.col("ratio"), F.col("ratio"))).over(everything))
        .withColumn("water", F.max(F.when(F.col("ratio") == F.col("found"), F.col("level"))).over(everything))
    )
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("water") * F.col("weight"), F.col("cap").cast("double")))
    return rows.select("source", "source_size", target.alias("target"))


def budgets(sums: DataFrame, weights: Sequence[int], share: float, epochs: int) -> DataFrame:
    """What each source gives, from the sizes of its buckets ``source, bucket, size``: ``source, source_size, target``, how often all of it is
    taken (``full``), and the bucket where the rest ends (``cut``, null for none) with the words that are left for it (``cut_left``)."""
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    quota = F.floor("target").cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size"))).otherwise(0).cast("long")
    placed = sums.withColumn("offset", F.coalesce(F.sum("size").over(earlier), F.lit(0))).join(source_targets(sums, weights, share, epochs), "source")
    placed = placed.withColumn("full", full).withColumn("rest", quota - F.col("full") * F.col("source_size"))
    ends = F.when(F.col("offset") + F.col("size") > F.col("rest"), F.struct("bucket", (F.col("rest") - F.col("offset")).alias("left")))
    found = placed.groupBy("source", "source_size", "target", "full").agg(F.min(ends).alias("end"))
    return found.select("source", "source_size", "target", "full", F.col("end.bucket").alias("cut"), F.col("end.left").alias("cut_left"))


def mix(docs: DataFrame, keep: list[str] | None = None, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, epochs: int = 2, seed: str = "mix-1", buckets: int = 1024) -> DataFrame:
    """For each row of ``docs (doc_id, text, source)``: ``row`` with its columns ``keep``, else all; ``size, source_size, target`` and ``taken``, the words taken of it."""
    key = mix_key(F.col("doc_id"), F.col("text"), seed)
    # "=" sorts before "n", so that the name keeps the order by code point with null last
    name = F.when(F.col("source").isNotNull(), F.concat(F.lit("="), F.col("source"))).otherwise(F.lit("null"))
    rows = docs.select(F.struct(*(docs.columns if keep is None else keep)).alias("row"), F.col("doc_id").alias("id"), n_words(F.col("text")).alias("size"), key.alias("key"), name.alias("source"))
    if keep is not None:
        rows = written(rows, "sizes")  # narrow: words are counted once
    rows = rows.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 4), 16, 10).cast("long") * buckets / 65536).cast("int"))
    plan = checkpointed(budgets(checkpointed(rows.groupBy("source", "bucket").agg(F.sum("size").alias("size"))), weights, share, epochs))
    joined = rows.join(F.broadcast(plan) if plan.count() <= MOST_BROADCAST_SOURCES else plan, "source")
    whole = joined.filter("cut is null or bucket != cut").withColumn("more", F.when(F.col("bucket") < F.col("cut"), F.col("size")).otherwise(F.lit(0).cast("long")))
    inside = Window.partitionBy("source").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("cut_left") - F.coalesce(F.sum("size").over(inside), F.lit(0))
    edge = joined.filter("bucket = cut").withColumn("more", F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("long"))
    return whole.unionByName(edge).select("row", "size", "source_size", "target", (F.col("full") * F.col("size") + F.col("more")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture as documents: a row for each epoch that takes a document, its text cut after the last word taken; same columns as ``docs``."""
    plan = mix(docs, **options).filter(F.col("taken") > 0)
    epochs = F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))
    copies = plan.withColumn("left", F.explode(F.transform(epochs, lambda e: F.col("taken") - (e - 1) * F.col("size"))))
    text = F.when(F.col("left") >= F.col("size"), F.col("row.text")).otherwise(_first_words(F.col("row.text"), F.col("left").cast("int")))
    out = copies.select(F.col("row").withField("text", text).alias("row"))
    if "n_chars" in docs.columns:
        out = out.select(F.col("row").withField("n_chars", F.char_length("row.text").cast(docs.schema["n_chars"].dataType)).alias("row"))
    return out.select("row.*")


def _first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word."""
    found, gaps = F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.split(text, WORD)
    return F.array_join(F.zip_with(F.slice(gaps, 1, n), F.slice(found, 1, n), lambda g, w: F.concat(g, w)), "")
