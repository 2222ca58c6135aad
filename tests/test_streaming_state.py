"""Streams that hold state over batches and restarts."""

from pyspark.sql import functions as F

from retort.operators.fingerprints import ph4_histogram_fp
from retort.streaming import jobs

SCHEMA = "mol_id long, conf_id int, point_no int, feat string, x double, y double, z double, n_points long"


def points(mols):
    return [(m, 0, i, "ARO HBD HYD".split()[(i + (m or 0)) % 3], float(i * (m or 7) % 11), float(i), 0.5 * i, n) for m, n in mols for i in range(n)]


def written(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_molecules_that_straddle_batches_and_a_restart(spark, tmp_path):
    rows = points([(1, 7), (2, 5), (3, 9), (None, 4), (4, 1)])
    parts = [rows[0::3], rows[1::3], rows[2::3]]
    schema = spark.createDataFrame([], SCHEMA).schema
    run = lambda n=1: jobs.gathered_fingerprint_stream(jobs.arriving(spark, f"{tmp_path}/in", schema, n), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    read = lambda: sorted((tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("mol_id", "slot", "value").collect()), key=str)
    written(spark, parts[0], f"{tmp_path}/in")
    written(spark, parts[1], f"{tmp_path}/in")
    run()
    early = {m for m, _, _ in read()} if any(p.name.startswith("batch=") for p in (tmp_path / "out").iterdir()) else set()
    assert early <= {4}  # all others lack points still
    written(spark, parts[2], f"{tmp_path}/in")
    run()
    want = ph4_histogram_fp(spark.createDataFrame(rows, SCHEMA)).select("mol_id", "slot", "value")
    assert read() == sorted((tuple(r) for r in want.collect()), key=str) and {1, 2, 3, 4} <= {m for m, _, _ in read()}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("RocksDBStateStoreProvider")


def test_what_stays_incomplete_expires(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    rows = points([(1, 4), (2, 3)])
    out = f"{tmp_path}/out"

    def run():
        stream = jobs.gathered(jobs.arriving(spark, f"{tmp_path}/in", schema), "mol_id", "n_points", wait_ms=1)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()

    written(spark, [r for r in rows if r[:3] != (1, 0, 3)], f"{tmp_path}/in")
    run()
    written(spark, points([(9, 1)]), f"{tmp_path}/in")
    run()
    got = spark.read.parquet(out).groupBy("mol_id", "complete").agg(F.count("*").alias("n")).collect()
    assert sorted(tuple(r) for r in got) == [(1, False, 3), (2, True, 3), (9, True, 1)]
    # the state of a key that was given up is gone: its last row starts anew
    written(spark, [r for r in rows if r[:3] == (1, 0, 3)], f"{tmp_path}/in")
    run()
    assert spark.read.parquet(out).filter("mol_id = 1").count() == 3


def test_bounded_memory_of_distinct_keys(spark, tmp_path):
    schema = "csmiles string, at timestamp"
    add = lambda rows: spark.createDataFrame(rows, "csmiles string, at string").select("csmiles", F.to_timestamp("at").alias("at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    kind = spark.createDataFrame([], schema).schema
    run = lambda: jobs.distinct_stream(jobs.arriving(spark, f"{tmp_path}/in", kind), "csmiles", f"{tmp_path}/out", f"{tmp_path}/state", "at", "1 hour").awaitTermination()
    add([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:10:00"), (None, "2024-01-01 00:10:00"), ("", "2024-01-01 00:10:00")])
    run()
    add([("a", "2024-01-01 00:20:00"), ("b", "2024-01-01 09:00:00"), (None, "2024-01-01 00:20:00")])
    run()
    add([("a", "2024-01-01 12:00:00"), ("b", "2024-01-01 09:10:00")])
    run()
    got = sorted(((r["csmiles"], r["at"].hour) for r in spark.read.parquet(f"{tmp_path}/out").collect()), key=str)
    assert got == sorted([("", 0), ("a", 0), ("a", 12), ("b", 9), (None, 0)], key=str)
