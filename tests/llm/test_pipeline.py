"""The stages of the pipeline against plain Python, each on its own input."""

import re

import corpus_pipeline
from tests.llm.test_near_dedup import plain as plain_components
from tests.llm.test_pii import plain_base

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_and_run(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "personal_data", "source_mixing", "best_fit_packing"]
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frames[-1], sf_small)
        if name != names[-1]:
            assert out.columns == docs.columns
        frames.append(spark.createDataFrame(out.collect(), out.schema))
    kept, single, clean, mixed, packed = ([tuple(r) for r in f.collect()] for f in frames[1:])
    given = [tuple(r) for r in docs.collect()]
    assert set(kept) <= set(given) and 0.7 * len(given) < len(kept) < len(given)
    components = plain_components([(r[0], r[1]) for r in kept])
    assert sorted(r[0] for r in single) == sorted(i for i, c in components.items() if c[2]) and set(single) <= set(kept)
    text = {r[0]: r[1] for r in single}
    for r in clean:
        assert not plain_base(r[1]) and (r[1] == text[r[0]]) == (not plain_base(text[r[0]]) and "<IBAN>" not in r[1]) and r[4] == len(r[1])
    size = {r[0]: len(WORD.findall(r[1])) for r in clean}
    taken = {}
    for r in mixed:
        n = len(WORD.findall(r[1]))
        assert 0 < n <= size[r[0]] and r[4] == len(r[1])
        taken[r[0]] = taken.get(r[0], 0) + n
    assert all(n <= 2 * size[i] for i, n in taken.items())
    total = sum(size.values())
    assert abs(sum(taken.values()) - 1.5 * total) <= 25
    # every piece lies in its bin, bins overlap nowhere, lengths are permitted and least
    placed = [r for r in packed if r[4] is not None]
    assert sum(r[3] for r in placed) == sum(taken.values())
    bins = {}
    for _, _, _, n, b, at, length in placed:
        bins.setdefault(b, (length, []))[1].append((at, n))
    for length, parts in bins.values():
        upto = 0
        for at, n in sorted(parts):
            assert at == upto
            upto += n
        assert length in (256, 512, 1024, 2048) and upto <= length and (length == 256 or upto > length // 2)
    assert corpus_pipeline.run(spark, sf_small).count() == len(packed)
