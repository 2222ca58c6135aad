"""Sketches against exact sets, edited texts against plain Python, odd rows."""

import hashlib

from pyspark.sql import functions as F

from retort.llm import fingerprints
from retort.llm.queries import op1_document_fingerprints
from tests.llm.test_near_dedup import shingles


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_query_against_exact_sets(spark, sf_small):
    out = op1_document_fingerprints(spark, sf_small)
    assert out.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "share_in_edited", "distinct_shingles"]
    got = {r["doc_id"]: r for r in out.collect()}
    docs = sorted(((r[0], r[1]) for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()), reverse=True)
    errors, by_text = [], {}
    for at, (i, text) in enumerate(docs):
        after = docs[(at + 1) % len(docs)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        assert got[i]["n_chars"] == len(text) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        errors.append(abs(got[i]["near_edited"] - likeness(shingles(text), shingles(edited))))
        own = shingles(text)
        assert abs(got[i]["share_in_edited"] - (len(own & shingles(edited)) / len(own) if own else 1.0)) < 0.25 and abs(got[i]["distinct_shingles"] - len(own)) <= 0.25 * len(own)
        assert abs(got[i]["near_next"] - likeness(shingles(text), shingles(after))) < 0.15
        assert by_text.setdefault(text, got[i]["fingerprint"]) == got[i]["fingerprint"]
    assert max(errors) < 0.15 and sum(errors) / len(errors) < 0.03


def test_merging_parts_and_estimates(spark):
    a = [f"w{i}" for i in range(3000)]
    rows = [(1, " ".join(a[:2000])), (1, " ".join(a[1000:])), (2, " ".join(a)), (3, " ".join(a[:1500]))]
    frame = fingerprints.with_sketch(spark.createDataFrame(rows, "part int, text string"), "text", "sketch")
    merged = {r["part"]: r["sketch"] for r in fingerprints.merged_by(frame, ["part"], "sketch").collect()}
    assert merged[1] == merged[2] and len(merged[2]) == fingerprints.K
    sizes = {r["part"]: r["n"] for r in frame.select("part", fingerprints.distinct_shingles(F.col("sketch")).alias("n")).collect()}
    assert abs(sizes[2] - 2996) < 0.25 * 2996
    pair = spark.createDataFrame([(merged[3], merged[2])], "a array<long>, b array<long>")
    row = pair.select(fingerprints.containment(F.col("a"), F.col("b")).alias("in"), fingerprints.resemblance(F.col("a"), F.col("b")).alias("like")).first()
    assert row["in"] > 0.8 and abs(row["like"] - 0.5) < 0.12


def test_odd_rows(spark):
    rows = [(None, "a b"), (1, None), (2, ""), (3, "one"), (4, "é😀x"), (5, "w " * 20_000), (5, "other text of this id"), (5, "w " * 20_000), (9, " ")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_chars int, _text string").drop("_text")
    out = fingerprints.edited_pairs(docs).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    assert by[1]["_sketch"] == [] and by[2]["_near_next"] == 1.0 and by[1]["_edited"] == ""
    assert by[4]["_edited"] == "é😀" + "o"  # the next by descending id is 3
    assert by[3]["_edited"] == "on" and len(by[3]["_sketch"]) == 1
    single = fingerprints.edited_pairs(spark.createDataFrame([(7, "abcdef")], "doc_id long, text string")).first()
    assert single["_edited"] == "abcd" + "ab" and single["_near_next"] == 1.0
    assert fingerprints.edited_pairs(docs.limit(0)).count() == 0


def test_order_holds_over_many_ranges(spark):
    rows = spark.range(1000).select((F.col("id") * 37 % 1009).alias("doc_id"), F.col("id").cast("string").alias("t"))
    ids = {r["doc_id"]: r["t"] for r in rows.collect()}
    got = {r["doc_id"]: r["_next_t"] for r in fingerprints.with_next(rows, "doc_id", ["t"], 50).collect()}
    order = sorted(ids, reverse=True)
    assert got == {i: ids[order[(k + 1) % len(order)]] for k, i in enumerate(order)}
