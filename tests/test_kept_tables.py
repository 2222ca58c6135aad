"""Kept tables: joins without a shuffle, and only changed buckets written again."""

import uuid

import pytest
from pyspark.sql import functions as F

from retort.sources import tables


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_and_groups_without_a_shuffle(spark, tmp_path, no_broadcast):
    name = f"t{uuid.uuid4().hex}"
    mols = spark.range(2000).select((F.col("id") % 700).alias("reactant_id"), (F.col("id") % 5).alias("rxn_id"), F.lit(1).alias("flag"))
    texts = spark.range(700).select(F.col("id").alias("reactant_id"), F.concat(F.lit("C"), F.col("id")).alias("smiles"))
    a = tables.kept(mols, f"{name}_a", str(tmp_path / "a"), "reactant_id", 8)
    b = tables.kept(texts, f"{name}_b", str(tmp_path / "b"), "reactant_id", 8)
    joined = a.join(b, "reactant_id")
    assert "Exchange" not in plan(joined) and joined.count() == 2000
    counts = a.groupBy("reactant_id").agg(F.count("*").alias("n"))
    assert "Exchange" not in plan(counts) and counts.agg(F.sum("n")).first()[0] == 2000
    assert "Exchange" in plan(mols.join(texts, "reactant_id"))


def test_only_changed_buckets_are_written(spark, tmp_path):
    name, path, rows = f"t{uuid.uuid4().hex}", str(tmp_path / "t"), [(i, f"m{i}") for i in range(300)] + [(None, "x"), (7, "m7")]
    make = lambda rows: spark.createDataFrame(rows, "mol_id long, smiles string").repartition(3)
    read = lambda df: sorted(((r["mol_id"], r["smiles"]) for r in df.collect()), key=str)
    written = []
    assert read(tables.kept(make(rows), name, path, "mol_id", 16, written)) == sorted(rows, key=str) and len(written) == 16
    again = []
    assert read(tables.kept(make(rows[::-1]), name, path, "mol_id", 16, again)) == sorted(rows, key=str) and again == []
    changed, one = [(i, s + "!") if i == 11 else (i, s) for i, s in rows], []
    assert read(tables.kept(make(changed), name, path, "mol_id", 16, one)) == sorted(changed, key=str) and len(one) == 1
    twice = []
    assert read(tables.kept(make([*changed, (11, "m11!")]), name, path, "mol_id", 16, twice)) == sorted([*changed, (11, "m11!")], key=str) and twice == one
    # a session that does not know the table finds it by its path
    spark.sql(f"DROP TABLE {name}")
    third = []
    assert read(tables.kept(make([*changed, (11, "m11!")]), name, path, "mol_id", 16, third)) == sorted([*changed, (11, "m11!")], key=str) and third == []
    few = [(1, "m1")]
    assert read(tables.kept(make(few), name, path, "mol_id", 16)) == few
    assert read(tables.kept(make(few).limit(0), f"{name}_e", str(tmp_path / "e"), "mol_id", 16)) == []
