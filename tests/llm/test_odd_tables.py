"""All operators over tables with odd rows and names: nulls, repeated rows, a very long text, an empty table, clashing columns."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from retort.llm import fingerprints, html_extract, mixing, near_dedup, packing, pii, quality, token_files, toxicity, warc

#: Names that helper columns have or had, and that their like might have.
NAMES = ["row", "size", "key", "spans", "kept", "n", "n_words", "h1", "id", "digest", "component_id", "bucket", "place", "taken", "part", "copy", "found_email", "by_lang"]
NAMES += [f"_{c}" for c in ("n_words", "size", "spans", "key", "text", "h1", "range", "tie", "lines", "kept", "source")]
TEXTS = ["", " \n\t", "one", "Some words that are written twice. " * 12, "Some words that are written twice. " * 12, "a@b.cd called +49 30 1234567 from 1.2.3.4 " * 3, "word " * 200_000, "x" * 1_000_000, None, "é 😀 ñ " * 40, " ".join(f"clean{i}" for i in range(60))]
N = len(TEXTS)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, len(t or "")) for i, t in enumerate(TEXTS)]
    rows += rows[3:6] + [(None, t, None, None, None) for t in TEXTS[2:6]] + [(None, None, None, None, None)] * 2
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return frame.withColumns({c: F.lit(7) for c in NAMES}).repartition(3)


def labels(spark):
    return spark.createDataFrame([(i, i % 2, 1) for i in range(N)] + [(None, 1, 1), (3, None, 1)], "doc_id long, toxic int, votes int")


#: Rows out for the rows in: the same number, unless the operator says otherwise.
OPERATORS = {
    "fingerprints": lambda s, d: fingerprints.edited_pairs(d),
    "toxicity": lambda s, d: toxicity.scored(d, labels(s)),
    "mixing": lambda s, d: mixing.mix(d),
    "token_files": lambda s, d: token_files.round_trip(d, public_tokenizers.path("byte_bpe_50k.json")),
    "quality": lambda s, d: quality.judged(d),
    "near_duplicates": lambda s, d: near_dedup.near_duplicates(d),
    "personal_data": lambda s, d: pii.with_spans(d),
    "redacted": lambda s, d: pii.redacted(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_a_result(spark, docs, name):
    out = OPERATORS[name](spark, docs).collect()
    assert len(out) == docs.count()
    assert OPERATORS[name](spark, docs.limit(0)).count() == 0


def test_pages(spark, docs):
    pages = docs.drop("id", "digest").withColumnsRenamed({"doc_id": "page_id", "text": "html"}).withColumns({"url": F.lit("u"), "sha": F.lit(1), "bytes": F.lit(2), "refers_to": F.lit(3)})
    for made in (html_extract.extract, warc.round_trip):
        assert made(pages).count() == docs.count() and made(pages.limit(0)).count() == 0


def test_packing(spark, docs):
    out = packing.packed(docs).collect()
    assert sum(r["size"] for r in out) == sum(len((t or "").split()) for (t,) in docs.select("text").collect())
    assert len({(r["doc_id"], r["copy"], r["piece"]) for r in out}) == len(out)
    assert packing.packed(docs.limit(0)).count() == 0


def test_stages_keep_the_columns(spark, docs):
    for given in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, given, "")
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
            rows = out.collect()
            assert all(r[c] == 7 for r in rows for c in NAMES)
            assert name == "quality_rules" or (len(rows) > 0) == (given is docs)


def test_stage_near_duplicates_keeps_rows_without_ids(spark, docs):
    kept = corpus_pipeline.STAGES[1][1](spark, docs, "").select("doc_id", "text").collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [0, 1, 2, 3, 5, 6, 7, 8, 9, 10]
    assert sum(r["doc_id"] is None for r in kept) == 6
