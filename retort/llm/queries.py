"""The thin queries over the operators of this subpackage, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.llm import conversations, fingerprints, html_extract, mixing, near_dedup, oracles, packing, periodic, pii, quality, substring_dedup, token_files, toxicity, warc
from retort.llm.common import table, words


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fingerprints.edited_pairs(table(spark, sf_dir, "documents"))
    return pairs.select(
        "doc_id",
        F.col("_n").cast("long").alias("n_chars"),
        F.sha2("_edited", 256).alias("edited_sha256"),
        fingerprints.as_text(F.col("_sketch")).alias("fingerprint"),
        fingerprints.as_text(F.col("_edited_sketch")).alias("edited_fingerprint"),
        F.col("_near_edited").alias("near_edited"),
        F.col("_near_next").alias("near_next"),
        fingerprints.containment(F.col("_sketch"), F.col("_edited_sketch")).alias("share_in_edited"),
        fingerprints.distinct_shingles(F.col("_sketch")).alias("distinct_shingles"),
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("row.doc_id", "size", "source_size", "target", "taken")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality.judged(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return verdicts.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _count_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda x: x["no"] < len(pii.BASE_KINDS))
    counts = [_count_of(k.name).alias(f"n_{k.name}") for k in pii.BASE_KINDS]
    return found.select("row.doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def _made_periodic(docs: DataFrame) -> DataFrame:
    """``doc_id, text``; every tenth text, by the checksum of its id, repeats a stretch of its words up to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    numbered = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words(F.col("text"))).alias("w"))
    n = F.size("w")
    start = (F.col("g") % n).cast("int")
    planned = numbered.filter("h % 10 = 0").filter(n > 0).withColumns({"n": n, "a": start})
    planned = planned.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    again = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    text = F.array_join(F.slice(F.concat(F.slice("w", F.lit(1), F.col("a")), again), F.lit(1), F.col("n")), " ")
    other = numbered.filter(F.coalesce((F.col("h") % 10 != 0) | (n == 0), F.lit(True)))
    return other.select("doc_id", "text").union(planned.select("doc_id", text))


def op11_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.select(
        "row.doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.with_runs(_made_periodic(table(spark, sf_dir, "documents").select("doc_id", "text")), keep=["doc_id"])
    longest = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    found = found.select("row.doc_id", "runs", "collapsed", longest.alias("r"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("r.start").alias("start"), (-F.col("r.l")).alias("length"), F.col("r.period").alias("period"),
        F.floor(-1000 * F.col("r.l") / F.col("r.period")).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digests(conversations.repaired(conversations.damaged(table(spark, sf_dir, "conversations"))))


QUERIES = {
    "op1_document_fingerprints": op1_document_fingerprints,
    "op2_toxicity": op2_toxicity,
    "op3_source_mixing": op3_source_mixing,
    "op4_warc": op4_warc,
    "op5_token_files": op5_token_files,
    "op6_main_text": op6_main_text,
    "op7_quality_rules": op7_quality_rules,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_personal_data": op10_personal_data,
    "op11_repeated_passages": op11_repeated_passages,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLES = oracles.ORACLES
