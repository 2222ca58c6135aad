"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; a temporary one where that is unset, in local mode only."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(where)
    return where


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder; for narrow tables that several later steps read."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again; for wide tables and for cut columns."""
    path = f"{shared_dir(df.sparkSession)}/retort-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder name inside the shared folder."""
    return f"{shared_dir(spark)}/retort-{uuid.uuid4().hex}/{name}"


def unused(name: str, columns: list[str]) -> str:
    """``name`` with as many underscores before it as it takes to differ from all ``columns``, whatever their case."""
    taken, found = {c.lower() for c in columns}, f"_{name}"
    while found.lower() in taken:
        found = f"_{found}"
    return found


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """The words of a text, in order; an empty array for null."""
    inner = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(inner != "", F.split(inner, SPACES)).otherwise(F.array().cast("array<string>"))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def joined_hashes(h: Column, step: int) -> Column:
    """Hashes of windows twice as wide: element ``i`` joins the hashes at ``i`` and ``i + step``; an empty array where none fits."""
    left = F.greatest(F.size(h) - step, F.lit(0))
    return F.zip_with(F.slice(h, 1, left), F.slice(h, step + 1, left), lambda a, b: F.xxhash64(a, b))
