"""Personal data against plain regular expressions."""

import hashlib
import re

import pytest

from retort.llm import pii
from retort.llm.queries import op10_personal_data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def plain_base(text):
    out = []
    for no, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and plain_luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), no, m.end(), kind))
    return sorted(out)


TEXTS = [
    None, "", "no data", "a@b.c@d.e a@b.c_d@e.f", "é 😀 x.y@z.example 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.255 1.2.3",
    "+1 (017) 555-7713 +49-30-1234567.", "4026083977531332 4929 3483 8514 6306 4111-1111-1111-1111 4111 1111 1111 1111 1",
    "IBAN DE89 3704 0044 0532 0130 00 account", "SSN 078-05-1120 or 078-05-1120", "1" * 50_000, "a" * 50_000 + "@", "1 " * 30_000 + "x", ("q@w.er " * 2000) + "ü 1.1.1.1",
]


def test_base_spans_match_plain_patterns(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for frame in (docs, more):
        rows = pii.with_spans(frame).select("row.text", "spans").collect()
        assert rows
        for text, spans in rows:
            got = [(s["start"], s["no"], s["end"], s["kind"]) for s in spans if s["no"] < 4]
            assert got == plain_base(text)


def test_added_spans_and_redaction(spark):
    docs = spark.createDataFrame([(1, TEXTS[7], 3), (2, TEXTS[8], 3), (3, "x 078-05-1120 DE89370400440532013001", 36), (4, None, None)], "doc_id long, text string, n_chars long")
    spans = {r[0]: r[1] for r in pii.with_spans(docs).select("row.doc_id", pii.listed(pii.F.col("spans"))).collect()}
    assert spans == {1: "iban:5:32", 2: "ssn:4:15,ssn:19:30", 3: "", 4: ""}
    rows = {r["doc_id"]: r for r in pii.redacted(docs).collect()}
    assert rows[1]["text"] == "IBAN <IBAN> account" and rows[1]["n_chars"] == 19
    assert rows[3]["n_chars"] == 36 and rows[4]["text"] is None


@pytest.mark.parametrize("name", ["op10"])
def test_query_columns(spark, sf_small, name):
    out = op10_personal_data(spark, sf_small)
    assert out.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    text = {r[0]: r[1] for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()}
    for r in out.collect():
        listed = ",".join(f"{k}:{s}:{e}" for s, _, e, k in plain_base(text[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()


def test_cards_of_single_digits_and_ibans_before_capitals(spark):
    texts = [
        "pay 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 now", "4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1", "DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", "to NO93 8601 1117 947 NOK 5 and GB29NWBK60161331926819 OK",
        "DE89 3704 0044 0532 0130 0 BIC", "ZZ",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = pii.with_spans(frame).select("row.text", "spans", pii.listed(pii.F.filter("spans", lambda x: x["kind"] == "iban")).alias("ibans")).collect()
    for text, spans, _ in rows:
        assert [(s["start"], s["no"], s["end"], s["kind"]) for s in spans if s["no"] < 4] == plain_base(text)
    assert [len(plain_base(t)) for t in texts[:2]] == [1, 1]
    assert {r[0]: r[2] for r in rows} == dict(zip(texts, ["", "", "iban:0:27", "iban:3:21,iban:32:54", "", ""], strict=True))
    clean = {r["doc_id"]: r["text"] for r in pii.redacted(frame).collect()}
    assert clean[0] == "pay <CARD> now" and clean[1] == "<CARD>" and clean[2] == "<IBAN> BIC COBADEFFXXX"


def test_context_reaches_over_other_matches(spark):
    """Words within forty characters count, whatever lies between."""
    texts = ["SSN " + ", ".join(["078-05-1120"] * 3), "SSN " + "x" * 40 + " 078-05-1120", "078-05-1120 078-05-1120 is an SSN", "078-05-1120 " + "y " * 20 + "SSN", "ssn 1.1.1.1 a@b.cd 078-05-1120", "078-05-1120"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in pii.with_spans(frame).select("row.text", "spans").collect():
        want = []
        for m in re.finditer("[0-9]{3}-[0-9]{2}-[0-9]{4}", r["text"]):
            if re.search(r"(?i)\b(?:ssn|social security)\b", r["text"][max(0, m.start() - 40) : m.start()] + " " + r["text"][m.end() : m.end() + 40]):
                want.append(m.start())
        assert [x["start"] for x in r["spans"] if x["kind"] == "ssn"] == want


def plain_redacted(text, spans):
    out, at = "", 0
    for x in spans:
        if x["start"] >= at:
            out += text[at : x["start"]] + f"<{x['kind'].upper()}>"
        at = max(at, x["end"])
    return out + text[at:]


def test_redaction_of_overlapping_and_very_many_spans(spark):
    texts = ["+1 017 555 7713 4111 1111 1111 1111 and a@1.2.3.4 ü 1.2.3.4", "é" * 1023 + " 1.2.3.4" + "ü" * 1500 + "a@b.cd", "a@b.cd", " ".join(f"user{i}@mail.example 😀" for i in range(40_000)) + " end", "1.1.1.1 " * 300 + "x" * 5000]
    frame = spark.createDataFrame([(i, t, len(t), None) for i, t in enumerate(texts)], "doc_id int, text string, n_chars int, spans string").repartition(4)
    spans = {r[0]: r[1] for r in pii.with_spans(frame).select("row.doc_id", "spans").collect()}
    out = pii.redacted(frame)
    assert out.columns == frame.columns and out.schema["n_chars"].dataType == frame.schema["n_chars"].dataType
    for r in out.collect():
        assert r["text"] == plain_redacted(texts[r["doc_id"]], spans[r["doc_id"]]) and r["n_chars"] == len(r["text"])
    assert len(spans[3]) == 40_000


def test_odd_tables_and_names(spark):
    schema = "doc_id long, text string, row int, spans int, found_email string, _spans int"
    assert pii.redacted(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, "a@b.cd", 1, 2, "x", 3)] * 2 + [(None, None, None, None, None, None), (2, "", 1, 2, "y", 3)]
    got = sorted(map(tuple, pii.redacted(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(1, "<EMAIL>", 1, 2, "x", 3)] * 2 + rows[2:], key=str)
