"""Toxicity: accuracy on held-out labels, the label model on made votes, odd rows."""

import math
import zlib

import numpy as np
import pytest

from retort.llm import toxicity
from retort.llm.queries import op2_toxicity


def test_held_out_accuracy_and_columns(spark):
    folder = "/root/testdata/sf0.1"
    out = op2_toxicity(spark, folder)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = {r["doc_id"]: r for r in out.collect()}
    labels = [(r[0], r[1]) for r in spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic").collect()]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows.values())
    kept = [(rows[i]["predicted"], t) for i, t in labels if rows[i]["held_out"]]
    hit = sum(p and t for p, t in kept)
    assert hit / sum(t for _, t in kept) > 0.85 and hit / max(1, sum(p for p, _ in kept)) > 0.95


def test_held_out_labels_are_not_read(spark):
    docs = spark.createDataFrame([(i, ("vile " if i % 3 == 0 else "kind ") + f"word{i % 7} more words") for i in range(200)], "doc_id long, text string")
    honest = [(i, int(i % 3 == 0)) for i in range(200)]
    lied = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in honest]
    scores = [sorted(map(tuple, toxicity.scored(docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect())) for x in (honest, lied)]
    assert scores[0] == scores[1]
    assert all(p == int(i % 3 == 0) for i, _, _, p in scores[0])


def test_label_model_finds_rates_and_correlated_voters():
    rng = np.random.default_rng(4)
    truth = rng.random(20_000) < 0.2
    said = np.zeros((len(truth), toxicity.VOTERS), dtype=np.int64)
    for j in range(6):
        said[:, j] = np.where(truth, rng.random(len(truth)) < 0.7, rng.random(len(truth)) < 0.02 * (j + 1))
    said[:, 6] = said[:, 0]  # repeats another voter
    said[:, 7:] = rng.random((len(truth), toxicity.VOTERS - 7)) < 0.1  # knows nothing
    bits = (said << np.arange(toxicity.VOTERS)).sum(axis=1)
    labels = np.where(rng.random(len(truth)) < 0.2, truth, -1)
    model = toxicity.LabelModel(bits, labels, np.ones(len(bits)))
    assert np.allclose(model.rates[1][:6], 0.7, atol=0.05) and abs(model.prior - 0.2) < 0.03
    assert model.correlation[0, 6] > 0.9 and abs(model.correlation[0, 1]) < 0.1 and model.trust[0] < 0.6 < model.trust[1]
    assert ((model.posterior(bits) > 0.5) == truth).mean() > 0.97


def test_label_model_against_plain_expectation_maximisation():
    """Row by row, in plain Python."""
    rng, voters, rounds = np.random.default_rng(8), range(toxicity.VOTERS), 3
    truth = rng.random(300) < 0.3
    said = np.where(truth[:, None], rng.random((300, toxicity.VOTERS)) < 0.6, rng.random((300, toxicity.VOTERS)) < 0.1).astype(int)
    labels = np.where(rng.random(300) < 0.3, truth, -1).astype(int)
    bits = (said << np.arange(toxicity.VOTERS)).sum(axis=1)
    seen = sorted({(int(b), int(t)) for b, t in zip(bits, labels, strict=True)})
    counts = [sum(int(b) == p and int(t) == q for b, t in zip(bits, labels, strict=True)) for p, q in seen]
    model = toxicity.LabelModel(np.array([p for p, _ in seen]), np.array([q for _, q in seen]), np.array(counts), rounds=rounds)
    said, labels = said.tolist(), labels.tolist()
    kinds = [c for c in (0, 1) for _ in range(toxicity.KINDS[c])]
    anchor = max(1, labels.count(-1) / (len(labels) - labels.count(-1)))
    shares, use = [], [0 if t < 0 else anchor for t in labels]
    for row, t in zip(said, labels, strict=True):
        level = sum(row) * toxicity.KINDS[max(t, 0)] // (len(row) + 1) + (toxicity.KINDS[0] if t == 1 else 0)
        raw = [(0.8 if k == level else 0.2) if t == c else 0 for k, c in enumerate(kinds)]
        shares.append([x / max(sum(raw), 1e-9) for x in raw])
    for _ in range(rounds + 1):
        mass = [sum(u * s[k] for u, s in zip(use, shares, strict=True)) for k in range(len(kinds))]
        size = [(m + 0.5) / (sum(mass) + 0.5 * len(kinds)) for m in mass]
        rate = [[(sum(u * s[k] * row[j] for u, s, row in zip(use, shares, said, strict=True)) + (0.5 if c else 0.1)) / (mass[k] + 2) for j in voters] for k, c in enumerate(kinds)]
        rate = [[min(max(x, 1e-4), 1 - 1e-4) for x in r] for r in rate]
        shared = [[sum(u * s[k] * (row[i] - rate[k][i]) * (row[j] - rate[k][j]) for u, s, row in zip(use, shares, said, strict=True) for k in range(len(kinds))) for j in voters] for i in voters]
        trust = [1 / (1 + sum(max(shared[i][j] / math.sqrt(shared[i][i] * shared[j][j]), 0) for j in voters if j != i)) for i in voters]
        likely = [[math.log(size[k]) + sum(trust[j] * math.log(rate[k][j] if row[j] else 1 - rate[k][j]) for j in voters) for k in range(len(kinds))] for row in said]
        shares, use = [], [1 if t < 0 else anchor for t in labels]
        for row, t in zip(likely, labels, strict=True):
            raw = [math.exp(x) if t < 0 or t == c else 0 for x, c in zip(row, kinds, strict=True)]
            shares.append([x / sum(raw) for x in raw])
    assert np.allclose(model.size, size) and np.allclose(model.kinds, rate) and np.allclose(model.trust, trust)
    want = [sum(math.exp(x) for x, c in zip(row, kinds, strict=True) if c) / sum(map(math.exp, row)) for row in likely]
    assert np.allclose(model.posterior(bits), want)


def test_the_label_model_decides(spark, monkeypatch):
    """Without what the label model says the scores are gone: the classifier has no other labels."""
    docs = spark.createDataFrame([(i, ("vile " if i % 3 == 0 else "kind ") + f"word{i % 7} more words") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id long, toxic int")
    assert sum(r["predicted"] for r in toxicity.scored(docs, labels).collect()) == 67
    monkeypatch.setattr(toxicity.LabelModel, "logit", lambda self, patterns: np.full(len(patterns), -9.0))
    assert sum(r["predicted"] for r in toxicity.scored(docs, labels).collect()) == 0


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0)], [(None, 1), (1, None)]])
def test_without_two_classes(spark, labels):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "a b", "z"), (2, "c", "z")], "doc_id long, text string, score string")
    rows = toxicity.scored(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(rows) == 4 and all(r["score"] == 0.0 and r["predicted"] == 0 for r in rows)


def test_odd_texts_get_scores(spark):
    docs = [(i, f"{'foul' if i % 2 else 'fine'} text {i}") for i in range(60)] + [(None, "foul"), (100, None), (101, ""), (102, "!!! ??? 123"), (103, "é" * 5000), (5, "foul text 5"), (104, "fine words " * 100_000)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 0), (3, 1)], "doc_id long, toxic int")
    rows = toxicity.scored(spark.createDataFrame(docs, "doc_id long, text string"), labels).collect()
    assert len(rows) == len(docs) and all(0 <= r["score"] <= 1 for r in rows)
    assert next(r for r in rows if r["doc_id"] is None)["predicted"] == 1
    assert toxicity.scored(spark.createDataFrame([], "doc_id long, text string"), labels).count() == 0


def test_scores_do_not_depend_on_the_size_of_the_sample(spark, monkeypatch):
    rng = np.random.default_rng(6)
    vile, kind = [f"vile{i}" for i in range(5)], [f"word{i}" for i in range(60)]
    rows = []
    for i in range(3000):
        toxic = int(rng.random() < 0.13)
        said = rng.choice(kind, 8).tolist() + rng.choice(vile, 2).tolist() * int(rng.random() < (0.7 if toxic else 0.05))
        rows.append((i, " ".join(said), toxic))
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([r[::2] for r in rows], "doc_id long, toxic int")
    scores = []
    for n in (toxicity.SAMPLE_ROWS, 60):
        monkeypatch.setattr(toxicity, "SAMPLE_ROWS", n)
        scores.append([r["score"] for r in toxicity.scored(docs, labels).orderBy("doc_id").collect()])
    assert np.allclose(*scores, atol=1e-6) and max(scores[0]) > 0.5
