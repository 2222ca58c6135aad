"""Quality counts against plain Python, fences against exact quantiles, odd rows."""

import re
from collections import Counter

from retort.llm import quality
from retort.llm.queries import op7_quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    base = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), base


def test_counts_on_documents(spark, sf_small):
    text = {r[0]: r[1] for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()}
    out = op7_quality_rules(spark, sf_small)
    assert out.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    rows = out.collect()
    assert len(rows) == len(text)
    for r in rows:
        assert tuple(r)[1:7] == plain(text[r["doc_id"]]) and not (r["kept"] and r["base_failed"])


def test_clean_labels_stay_and_poor_ones_go(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality").collect()}
    rows = [(r["kept"], r["base_failed"], labels[r["doc_id"]]) for r in op7_quality_rules(spark, folder).collect() if r["doc_id"] in labels]
    clean = [k for k, base, q in rows if q == 1 and not base]
    poor = [k for k, base, q in rows if q == 0]
    assert sum(clean) / len(clean) > 0.995 and sum(poor) / len(poor) < 0.05


def measures_frame(spark, rows):
    """Rows of (source, rate of each measure, size of each measure)."""
    names = [f"{m} double, {m}_size double" for m in quality.SHARES]
    return spark.createDataFrame([(s, 30, *[v, float(size)] * 5) for s, v, size in rows], "by_source string, n_words int, " + ", ".join(names))


def test_sketches_merge_and_bound_quantiles(spark):
    frame = measures_frame(spark, [("s", 0.01 * i, 100) for i in range(1, 1001)] + [("zero", 0.0, 7)] * 3)
    whole = {(r["by_source"], r["measure"], r["bucket"]): r["count"] for r in quality.sketches(frame, ["by_source"]).collect()}
    parts = Counter()
    for part in frame.randomSplit([0.3, 0.7], 1):
        parts.update({(r["by_source"], r["measure"], r["bucket"]): r["count"] for r in quality.sketches(part, ["by_source"]).collect()})
    assert whole == dict(parts)
    for r in quality.quantiles(quality.sketches(frame, ["by_source"]), ["by_source"]).collect():
        if r["by_source"] == "zero":
            assert r["rows"] == 3 and (0.98 < r["mid"] / 7 < 1.03 if r["measure"].endswith("_size") else r["mid"] == r["low"] == 0)
        elif not r["measure"].endswith("_size"):
            assert r["rows"] == 1000 and 0.98 < r["low"] / 2.5 < 1.03 and 0.98 < r["mid"] / 5.0 < 1.03


def fences_of(spark, rows):
    found = quality.fences(quality.sketches(measures_frame(spark, rows), ["by_source"]), ["by_source"]).collect()
    return {r["by_source"]: {m: r[f"fence_{m}"] for m in quality.SHARES} for r in found}


def test_fences_follow_the_groups(spark):
    """A group of values twice as large has fences twice as high, poor texts hardly move them, and small groups lean on the whole."""
    rows = [(s, scale * (1 + i / 2000), 100_000) for s, scale in (("a", 0.1), ("b", 0.2)) for i in range(2000)]
    rows += [("c", 0.1 * (1 + i / 2000), 100_000) for i in range(2000)] + [("c", 5.0, 100_000)] * 200 + [("d", 9.0, 100_000)] * 2
    found = fences_of(spark, rows)
    for m in quality.SHARES:
        a, b, c, d = (found[s][m] for s in "abcd")
        assert 1.7 < b / a < 2.2 and 1.0 <= c / a < 1.5 and d < 9.0


def test_equal_quartiles_leave_the_least_distance(spark):
    """Quartile and median are equal: the fence is four sampling errors of a text of the median size above the median, for any size of the group."""
    for rows in ([("s", 0.1, 400)] * 1000, [("s", 0.1, 400)], [("s", 0.0, 400)] * 1000):
        rate, size = rows[0][1], 400
        want = ((rate * size) ** 0.5 + 2) ** 2 / size
        for fence in fences_of(spark, rows)["s"].values():
            assert abs(fence / want - 1) < 0.05 and fence > rate


def verdicts(spark, texts, lang="en", source="s"):
    docs = spark.createDataFrame([(i, t, lang, source) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    return [r["kept"] for r in sorted(quality.judged(docs, ["doc_id"]).collect(), key=lambda r: r["row"]["doc_id"])]


def test_groups_of_little_spread_keep_sound_texts(spark):
    import random

    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    alike = ["\n".join(" ".join(word() for _ in range(8)) for _ in range(100)) for _ in range(300)]
    assert sum(verdicts(spark, alike)) >= 0.98 * 300
    short = [" ".join(word() for _ in range(24)) for _ in range(10)]
    assert all(verdicts(spark, short)) and all(verdicts(spark, short + alike[:50])) and all(verdicts(spark, [alike[0]] * 40))
    sizes = [" ".join(word() for _ in range(n)) for n in range(20, 3000, 60)]
    assert all(verdicts(spark, sizes))


def test_each_measure_rejects_what_is_beyond_its_fence(spark):
    import random

    rng = random.Random(8)
    word = lambda n=9: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, n)))
    text = lambda n=480, w=9: "\n".join(" ".join(word(w) for _ in range(8)) for _ in range(n // 8))
    line = " ".join(word() for _ in range(6))
    clean = [text() for _ in range(200)]
    poor = {
        "symbol_share": text() + " # $ % & |" * 30, "dup_line_share": text(60) + "\n" + "\n".join(f"{line} {word()}" if i % 2 else "so be it" for i in range(160)),
        "repeat_share": text(1200) + (" " + text(40)) * 9, "word_length": text(400, 40), "shout_share": " ".join(word().upper() for _ in range(300)),
    }
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate([*clean, *poor.values()])], "doc_id long, text string, lang string, source string")
    measures = quality.measured(docs, ["doc_id"])
    fence = quality.fences(quality.sketches(measures, ["by_source"]), ["by_source"]).first()
    rows = {r["row"]["doc_id"]: r for r in measures.select("row", *[quality.surely(m).alias(f"{m}_surely") for m in quality.SHARES]).collect()}
    for i, m in enumerate(poor):
        assert rows[200 + i][f"{m}_surely"] > fence[f"fence_{m}"], m
    verdict = [r["kept"] for r in sorted(quality.judged(docs, ["doc_id"]).collect(), key=lambda r: r["row"]["doc_id"])]
    assert sum(verdict[:200]) >= 198 and not any(verdict[200:])


def test_sources_with_symbols_or_without_spaces_keep_their_texts(spark):
    import random

    rng = random.Random(9)
    code = lambda: "\n".join(f"if (x{rng.randint(0, 99)} > {rng.randint(0, 99)}) {{ y &= z{rng.randint(0, 999)} | {rng.randint(0, 9999)}; }} # {rng.random()}" for _ in range(rng.randint(5, 60)))
    dense = lambda: " ".join("".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(rng.randint(20, 60))) for _ in range(rng.randint(20, 90)))
    prose = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(30, 300)))
    rows = [(k * 1000 + i, make(), lang, s) for k, (make, lang, s) in enumerate([(code, "en", "code"), (dense, "zh", "web"), (prose, "en", "web")]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = Counter(r["row"]["doc_id"] // 1000 for r in quality.judged(docs, ["doc_id"]).filter("kept").collect())
    assert all(kept[k] >= 294 for k in range(3))


def test_fences_of_documents_differ(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    keys = ["by_lang", "by_source"]
    rows = quality.fences(quality.sketches(quality.measured(docs, ["doc_id"]), keys), keys).collect()
    for m in quality.SHARES:
        assert len({round(r[f"fence_{m}"], 6) for r in rows}) > 0.3 * len(rows)  # numbers of lines are small, and many medians of them equal


def test_joining_many_groups(spark, sf_small, monkeypatch):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    want = sorted(tuple(r) for r in quality.judged(docs, ["doc_id"]).select("row.doc_id", "kept").collect())
    monkeypatch.setattr(quality, "MOST_BROADCAST_GROUPS", 0)
    assert sorted(tuple(r) for r in quality.judged(docs, ["doc_id"]).select("row.doc_id", "kept").collect()) == want


def test_odd_rows_and_clashing_columns(spark):
    clean = " ".join(f"word{i} text" for i in range(40))
    rows = [(None, None, None, None), (1, "", "en", "s"), (2, " \n\t ", None, "s"), (3, clean, None, None), (3, clean, None, None), (4, "a b c d e f g h " * 3000, "en", "s"), (5, clean + " | # % " * 60, None, None), (6, "é " * 30, "en", "")]
    docs = spark.createDataFrame([(*r, 5, 6, 7) for r in rows], "doc_id long, text string, lang string, source string, kept int, n_words int, row int")
    out = quality.judged(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        got = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
        assert got == plain(r["row"]["text"]) and tuple(r["row"])[4:] == (5, 6, 7)
    assert [r["kept"] for r in out if r["row"]["doc_id"] == 3] == [True, True] and not next(r for r in out if r["row"]["doc_id"] == 5)["kept"]
    kept = quality.filtered(docs)
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == sorted(tuple(r["row"]) for r in out if r["kept"])
    assert quality.judged(docs.limit(0)).count() == 0
