"""Derived tables kept in buckets by a key, with a manifest of what they were made from.

A kept table is written once, in ``buckets`` parts by the hash of its key, each sorted by it. Tables of one key and number of buckets are joined, and
grouped by the key, without a shuffle. The manifest holds, for each bucket, the number of its rows and an order-free digest of them. When the
table is asked for again, what it should hold is digested the same way (one aggregation), and only buckets that differ are written again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
_BUCKET = "_bucket"


def _digests(df: DataFrame) -> DataFrame:
    """``_bucket, n, digest``: rows of each bucket, and the sum of their hashes."""
    values = F.xxhash64(*[c for c in df.columns if c != _BUCKET])
    return df.groupBy(_BUCKET).agg(F.count("*").alias("n"), F.sum(values.cast("decimal(38,0)")).cast("string").alias("digest"))


def _known(spark: SparkSession, name: str, path: str, df: DataFrame, key: str, buckets: int, filled: bool) -> None:
    """Make the table at ``path`` known to the session's catalog, if it is not yet, with its buckets if it is ``filled``."""
    if spark.catalog.tableExists(name):
        return
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY (`{_BUCKET}`) CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}/rows'")
    if filled:
        spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")


def kept(df: DataFrame, name: str, path: str, key: str, buckets: int = BUCKETS, written: list | None = None) -> DataFrame:
    """``df`` as a table of the catalog, in buckets by ``key`` at ``path``; buckets that already hold the same rows are not written again.

    A list given as ``written`` gets the numbers of the buckets that are. Null keys are in one bucket; ``df`` should give the same rows whenever it is computed.
    """
    spark = df.sparkSession
    columns = df.columns
    placed = df.withColumn(_BUCKET, F.pmod(F.hash(key), F.lit(buckets)))
    now = {r[_BUCKET]: (r["n"], r["digest"]) for r in _digests(placed).collect()}  # a row a bucket
    try:
        old = {r[_BUCKET]: (r["n"], r["digest"]) for r in spark.read.schema(f"{_BUCKET} int, n long, digest string").parquet(f"{path}/manifest").collect()}
    except Exception as error:  # no such path: nothing is kept yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        old = {}
    _known(spark, name, path, placed, key, buckets, bool(old))
    changed = sorted(b for b in now if now[b] != old.get(b))
    gone = sorted(b for b in old if b not in now)
    if changed:
        parts = placed.filter(F.col(_BUCKET).isin(changed)).repartition(len(changed), _BUCKET)
        mode = "spark.sql.sources.partitionOverwriteMode"
        before = spark.conf.get(mode)
        spark.conf.set(mode, "dynamic")  # only the partitions that are written are replaced
        try:
            parts.select(*columns, _BUCKET).write.mode("overwrite").insertInto(name)
        finally:
            spark.conf.set(mode, before)
    for b in gone:
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION (`{_BUCKET}` = {b})")
        emptied = spark.createDataFrame([], placed.schema)
        emptied.write.mode("overwrite").parquet(f"{path}/rows/{_BUCKET}={b}")
    if changed or gone or not old:
        manifest = spark.createDataFrame([(b, *v) for b, v in sorted(now.items())], f"{_BUCKET} int, n long, digest string")
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")  # last, so that a job that failed before is done again
    if written is not None:
        written += [*changed, *gone]
    spark.catalog.refreshTable(name)
    return spark.table(name).select(*columns)
