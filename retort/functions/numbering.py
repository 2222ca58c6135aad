"""Running numbers and sums over sorted rows, without a task that takes all rows of a group or of the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retort.functions.lineage import checkpointed


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``df`` with ``_range``: the number of the range of (keys, order) that a row is in. A key of very many rows has many ranges."""
    dealt = df.repartitionByRange(*[F.col(k) for k in keys], *order)
    return checkpointed(dealt.withColumn("_range", F.spark_partition_id()))


def with_running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: dict[str, str], totals: dict[str, str] | None = None) -> DataFrame:
    """``df`` with running sums within ``keys`` in the order of ``order``, ties included: ``sums`` gives the new column for each summed one.

    ``totals`` gives the columns for the sums over all rows of the keys. Rows are sorted within ranges only; what comes before a range is
    the sum of the totals of the ranges before it, of which a key has as many as there are partitions at most. Null keys count as keys. Rows
    that tie must fall in one range, which they do, as ranges are cut by the values of ``order``.
    """
    totals = totals or {}
    ranged = in_ranges(df, keys, order)
    columns = sorted({*sums, *totals})
    each = ranged.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in columns])
    by = Window.partitionBy(*keys)
    earlier = by.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    places = each.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_k__range"),
        *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_b_{c}") for c in sums], *[F.sum(f"_t_{c}").over(by).alias(name) for c, name in totals.items()],
    )
    same = F.col("_range") == F.col("_k__range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = Window.partitionBy(*keys, "_range").orderBy(*order)
    joined = ranged.join(places, same).withColumns({name: F.sum(c).over(inside) + F.col(f"_b_{c}") for c, name in sums.items()})
    return joined.select(*df.columns, *sums.values(), *totals.values())


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "number") -> DataFrame:
    """``df`` with ``name``: rows numbered from 0 within ``keys`` in the order of ``order``, nulls first; rows that tie in any order."""
    ranged = in_ranges(df, keys, [F.col(c) for c in order])
    sizes = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    earlier = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    places = sizes.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_k__range"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    same = F.col("_range") == F.col("_k__range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)) - 1
    return ranged.join(places, same).withColumn(name, inside + F.col("_before")).select(*[c for c in df.columns if c != name], name)
