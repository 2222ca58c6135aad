"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier.

1. Terms are words of letters and their heads of four to six bytes, held as hashes. They are counted in all labelled rows, and
   the terms that tell toxic rows from others are kept, if their likelihood ratio is beyond what the best of so many terms has
   by chance. Those that hardly occur in other rows make four lexicons, one for each kind of term: words as they stand, heads of
   four, five and six bytes.
2. One pass over all documents finds the terms and patterns of each; what it writes is a few numbers a document.
3. Each lexicon has two voters, which speak up where a text has one term of it at least, and two at least; four more voters go by
   patterns (exclamation marks, doubled marks, capitals, digits). The label model is a mixture of a few kinds of rows in either
   class; it holds for each voter how often it speaks up, and so how accurate it is. It is fitted by expectation maximisation
   to the votes in all documents that are not held out (counts of vote patterns: at most 3 * 2 ** voters rows, however many
   documents); rows with a label keep their class there, and so say which is which. What voters still share within a kind is
   their correlation, and correlated voters weigh less, so that several lexicons that repeat each other count about once.
4. A logistic regression over terms and patterns is trained on the label model's posterior labels of all documents that are not
   held out, with a label of their own or not, and scores every document; given labels take no part in it. Its Newton steps start from the fit of a weighted
   sample and sum slope and curvature over all rows in tasks, so that the sample (``SAMPLE_ROWS``) decides only how many steps
   are needed.

Labels of rows whose crc32 of the id as text is 0 modulo 5 are never read. Neither labels, languages, sources nor ids are
inputs of a score.

Defined cases: a null or empty text has no terms and gets a score all the same; without toxic or without other labels the
score is the share of toxic labels, 0 without any; a null id is not held out and has no label; of several labels of an id the
largest counts; rows that repeat an id each get a row; a text of any length is read whole; names of further columns do not
matter; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from retort.llm.common import written
from retort.llm.hashing import RangeHasher, text_chunks, word_bounds

#: Rows on either side of the label model, about, from whose weighted fit the training on all rows starts.
SAMPLE_ROWS = 8_000
#: The classifier has at most so many terms, those with the greatest likelihood ratios; a parameter of its size, as is the number of patterns.
TERMS = 512
#: Share of toxic rows, classes taken as equally frequent, that a term must reach, and that a lexicon's term must, unless three quarters of its kind's do not.
LEAST_SHARE, SURE_SHARE = 0.7, 0.97
HEADS = (4, 5, 6)
#: Lexicons by kind of term: words and each length of heads.
LEXICONS, PATTERNS = 1 + len(HEADS), 4
VOTERS = 2 * LEXICONS + PATTERNS
#: Kinds of rows that the label model knows in the class without toxicity and with it: voters of different lexicons need not go together.
KINDS = (2, 3)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
#: A task's slope and curvature travel in so many pieces, which are added up apart from each other.
_PIECES = 16
_FEATURES = "doc_id long, held_out boolean, terms array<int>, counts array<int>, marks array<float>"


@dataclass(frozen=True)
class Model:
    """What a score needs: term hashes, sorted, the lexicon of each or -1, and the weights of terms and patterns."""

    terms: np.ndarray
    lexicon: np.ndarray
    weights: np.ndarray
    bias: float


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels are kept for evaluation."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all terms, their kind in the last two bits, the text of each, and words in each text."""
    starts, stops, firsts = word_bounds(data, offsets, _LETTER)
    hasher, text = RangeHasher(data), np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    of_kind = lambda h, kind: (h & ~np.uint64(3)) | np.uint64(kind)
    hashes, texts = [of_kind(hasher.hashes(starts, stops), 0)], [text]
    for kind, n in enumerate(HEADS, 1):
        longer = stops - starts > n
        hashes.append(of_kind(hasher.hashes(starts[longer], starts[longer] + n), kind))
        texts.append(text[longer])
    return np.concatenate(hashes), np.concatenate(texts), np.diff(firsts)


def _marks(data: np.ndarray, offsets: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Pattern measures of each text: exclamation marks, doubled marks, capitals, and digits, each to its size."""
    shout, upper, digit = data == 33, (data >= 65) & (data <= 90), (data >= 48) & (data <= 57)
    double = np.zeros(len(data), dtype=bool)
    double[1:] = (shout[1:] | (data[1:] == 63)) & (shout[:-1] | (data[:-1] == 63))
    capitals = upper.copy()
    capitals[1:] &= upper[:-1]
    sums = [np.concatenate([[0], np.cumsum(x)])[offsets] for x in (shout, double, capitals, digit)]
    return np.minimum(np.stack([np.diff(s) / (n_words + 5.0) for s in sums], axis=1), 2.0).astype(np.float32)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of rows of either class that hold a term, added up for each batch."""
    for batch in batches:
        toxic = np.asarray(batch.column("toxic"))
        found = [[], []]
        for at, data, offsets in text_chunks(batch.column("text")):
            hashes, texts, _ = _terms(data, offsets)
            order = np.lexsort((hashes, texts))
            hashes, texts = hashes[order], texts[order]
            new = np.ones(len(hashes), dtype=bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (texts[1:] != texts[:-1])
            for c in (0, 1):
                found[c].append(hashes[new & (toxic[at + texts] == c)])
        for c in (0, 1):
            terms, counts = np.unique(np.concatenate(found[c] or [np.empty(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(counts * (c == 1)), pa.array(counts * (c == 0))], ["term", "toxic", "other"])


def mine_terms(rows: DataFrame, n_toxic: int, n_other: int) -> tuple[np.ndarray, np.ndarray]:
    """Terms that tell the classes of ``rows (text, toxic)`` apart, sorted by hash, with a lexicon number each, -1 for none; at most ``TERMS``."""
    tested = Observation()
    counts = rows.mapInArrow(_counted, "term long, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("other").alias("b"))
    a, b = F.col("a"), F.col("b")
    share = F.lit(n_toxic / (n_toxic + n_other))
    rate = (a / n_toxic) / (a / n_toxic + (b + 0.5) / n_other)
    part = lambda x, p: F.when(x > 0, x * F.ln(x / ((a + b) * p))).otherwise(0.0)
    told = counts.observe(tested, F.count(F.lit(1)).alias("n")).filter("a >= 2").withColumns({"ratio": 2 * (part(a, share) + part(b, 1 - share)), "rate": rate}).filter(F.col("rate") >= LEAST_SHARE)
    best = told.orderBy(F.desc("ratio"), "term").limit(TERMS).select("term", "ratio", "rate").collect()
    bar = 2 * math.log(max(tested.get["n"], 1))
    best = sorted((np.uint64(r["term"] % (1 << 64)), r["rate"]) for r in best if r["ratio"] >= bar)
    terms, rates = np.array([t for t, _ in best], dtype=np.uint64), np.array([x for _, x in best])
    lexicon = (terms & np.uint64(3)).astype(np.int64)
    for kind in range(LEXICONS):
        mine = lexicon == kind
        if mine.any():
            lexicon[mine & (rates < min(SURE_SHARE, np.quantile(rates[mine], 0.75)))] = -1
    return terms, lexicon


def features(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """Terms and marks of each whole text of ``docs (doc_id, text)``."""
    gate = np.zeros(1 << 16, dtype=bool)
    gate[terms >> np.uint64(48)] = True

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in text_chunks(batch.column("text")):
                n, hits, counts, ends = len(offsets) - 1, np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
                hashes, texts, n_words = _terms(data, offsets)
                if len(terms):
                    may = np.flatnonzero(gate[hashes >> np.uint64(48)])
                    place = np.minimum(np.searchsorted(terms, hashes[may]), len(terms) - 1)
                    real = terms[place] == hashes[may]
                    pairs, counts = np.unique(texts[may][real] * len(terms) + place[real], return_counts=True)
                    hits, ends = pairs % len(terms), np.searchsorted(pairs // len(terms), np.arange(n + 1))
                bounds, marks = pa.array(ends.astype(np.int32)), _marks(data, offsets, n_words)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, n), batch.column("held_out").slice(at, n), pa.ListArray.from_arrays(bounds, pa.array(hits.astype(np.int32))),
                        pa.ListArray.from_arrays(bounds, pa.array(counts.astype(np.int32))), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * PATTERNS), pa.array(marks.ravel())),
                    ],
                    ["doc_id", "held_out", "terms", "counts", "marks"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(find, _FEATURES)


def votes(lexicon: np.ndarray) -> Column:
    """The voters that speak up, a bit each: lexicons with a term in the text, then those with two, then patterns above their measure."""
    table = F.array(*[F.lit(1 << 12 * int(x) if x >= 0 else 0).cast("long") for x in lexicon]) if len(lexicon) else F.array(F.lit(0).cast("long"))
    terms = F.zip_with("terms", "counts", lambda t, c: F.get(table, t) * F.least(c, F.lit(2)))
    hits = F.aggregate(terms, F.lit(0).cast("long"), lambda a, x: a + x)  # twelve bits a lexicon: at most two for each of its terms
    of = lambda k: F.shiftright(hits, 12 * k).bitwiseAND(F.lit(4095))
    said = [F.when(of(k) >= n, 1 << LEXICONS * (n - 1) + k).otherwise(0) for n in (1, 2) for k in range(LEXICONS)]
    bars = (0.05, 0.02, 0.2, 0.5)
    said += [F.when(F.get("marks", F.lit(i)) > bar, 1 << (2 * LEXICONS + i)).otherwise(0) for i, bar in enumerate(bars)]
    return sum(said[1:], said[0])


class LabelModel:
    """Rates, accuracies and correlations of voters, and the posterior of a vote pattern: a mixture of a few kinds of rows in either class."""

    def __init__(self, patterns: np.ndarray, labels: np.ndarray, counts: np.ndarray, rounds: int = 60):
        """Vote patterns as bits, the label of each (-1: none), and the rows of each. Rows with a label keep their class and weigh as much as the others together, at least: they say what the classes are."""
        said, known = (patterns[:, None] >> np.arange(VOTERS)) & 1, labels >= 0
        weight = counts.astype(np.float64)
        weight = weight * np.where(known, max(1.0, weight[~known].sum() / max(weight[known].sum(), 1e-9)), 1.0)
        self.toxic = np.repeat([0, 1], KINDS)
        # the first kinds of a class go by how many voters speak up
        level = np.where(labels == 1, KINDS[0] + said.sum(axis=1) * KINDS[1] // (VOTERS + 1), said.sum(axis=1) * KINDS[0] // (VOTERS + 1))
        mine = labels[:, None] == self.toxic
        share = mine * np.where(level[:, None] == np.arange(len(self.toxic)), 0.8, 0.2)
        self._fit(said, weight * known, share / np.maximum(share.sum(axis=1, keepdims=True), 1e-9))
        for _ in range(rounds):
            likely = np.where(mine | ~known[:, None], self._likely(patterns), -np.inf)
            share = np.exp(likely - likely.max(axis=1, keepdims=True))
            self._fit(said, weight, share / share.sum(axis=1, keepdims=True))

    def _fit(self, said: np.ndarray, weight: np.ndarray, share: np.ndarray) -> None:
        """Rates and correlations from weighted rows and their shares in the kinds."""
        part = weight[:, None] * share
        mass = part.sum(axis=0)
        self.size = (mass + 0.5) / (mass.sum() + 0.5 * len(mass))
        self.kinds = np.clip((part.T @ said + np.where(self.toxic, 0.5, 0.1)[:, None]) / (mass + 2.0)[:, None], 1e-4, 1 - 1e-4)
        self.prior = self.size[self.toxic == 1].sum()
        self.rates = np.array([self.size[self.toxic == c] @ self.kinds[self.toxic == c] / self.size[self.toxic == c].sum() for c in (0, 1)])
        self.accuracy = self.prior * self.rates[1] / (self.prior * self.rates[1] + (1 - self.prior) * self.rates[0])
        shared = sum(((said - rate) * part[:, k : k + 1]).T @ (said - rate) for k, rate in enumerate(self.kinds))
        scale = np.sqrt(np.maximum(np.diag(shared), 1e-9))
        self.correlation = shared / scale[:, None] / scale
        self.trust = 1.0 / (1.0 + np.maximum(self.correlation - np.eye(VOTERS), 0.0).sum(axis=1))

    def _likely(self, patterns: np.ndarray) -> np.ndarray:
        """Log likelihood of patterns in each kind, with its size."""
        said = (patterns[:, None] >> np.arange(VOTERS)) & 1
        return np.log(self.size) + (said * self.trust) @ np.log(self.kinds).T + ((1 - said) * self.trust) @ np.log(1 - self.kinds).T

    def logit(self, patterns: np.ndarray) -> np.ndarray:
        likely = self._likely(patterns)
        top = likely.max(axis=1, keepdims=True)
        both = [np.exp(likely[:, self.toxic == c] - top).sum(axis=1) for c in (0, 1)]
        return np.log(np.maximum(both[1], 1e-300)) - np.log(np.maximum(both[0], 1e-300))

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(patterns), -30, 30)))


def _penalty(n: int, ridge: float = 0.3) -> np.ndarray:
    """The ridge of ``n`` weights; the last is the bias."""
    return np.append(np.full(n - 1, ridge), 1e-3)


def _slope_and_curve(x: np.ndarray, soft: np.ndarray, weight: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the logistic loss over rows, without the ridge."""
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return x.T @ (weight * (p - soft)), (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x


def fit_linear(x: np.ndarray, soft: np.ndarray, weight: np.ndarray, steps: int = 30) -> np.ndarray:
    """Weights, the bias last, of a ridge logistic regression on soft labels, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = _penalty(len(w))
    for _ in range(steps):
        slope, curve = _slope_and_curve(x, soft, weight, w)
        step = np.linalg.solve(curve + np.diag(penalty), slope + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _soft(logits: np.ndarray, said: np.ndarray) -> np.ndarray:
    """Posterior labels of rows from the label model's logit of each vote pattern."""
    return 1 / (1 + np.exp(-np.clip(logits[said], -30, 30)))


def _added(rows: pa.Table) -> pa.Table:
    """One piece of the sums of all tasks, added in the order of the tasks."""
    rows = rows.sort_by("task")
    total = np.sum([np.frombuffer(x.as_buffer()) for x in rows.column("sums")], axis=0)
    return pa.table({"piece": rows.column("piece").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})


def fit_all(training: DataFrame, logits: np.ndarray, w: np.ndarray, steps: int = 30) -> np.ndarray:
    """``fit_linear`` over all rows of ``training (terms, counts, marks, votes)``, from the weights ``w``."""
    penalty, n_terms = _penalty(len(w)), len(w) - 1 - PATTERNS

    def summed(now: np.ndarray):
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, slope, curve = 0.0, np.zeros(len(now)), np.zeros((len(now), len(now)))
            for batch in batches:
                for at in range(0, batch.num_rows, 2000):
                    part = batch.slice(at, 2000)
                    soft = _soft(logits, np.asarray(part.column("votes")))
                    marks = np.asarray(part.column("marks").flatten()).reshape(-1, PATTERNS)
                    sizes = np.diff(np.asarray(part.column("terms").offsets))
                    some = sizes > 0
                    # rows without terms have patterns and bias only
                    x = np.zeros((int(some.sum()), len(now)))
                    x[np.repeat(np.arange(len(x)), sizes[some]), np.asarray(part.column("terms").flatten())] = 1 + np.log(np.asarray(part.column("counts").flatten()))
                    x[:, n_terms:-1], x[:, -1] = marks[some], 1
                    few = np.hstack([marks[~some], np.ones((len(marks) - len(x), 1))])
                    for rows, mine, at_w in ((x, soft[some], slice(None)), (few, soft[~some], slice(n_terms, None))):
                        logit = rows @ now[at_w]
                        more = _slope_and_curve(rows, mine, np.ones(len(rows)), now[at_w])
                        loss += (np.logaddexp(0, logit) - mine * logit).sum()
                        slope[at_w] += more[0]
                        curve[at_w, at_w] += more[1]
            pieces = [x.tobytes() for x in np.array_split(np.concatenate([[loss], slope, curve.ravel()]), _PIECES)]
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(range(_PIECES), pa.int32()), pa.array([task] * _PIECES, pa.int32()), pa.array(pieces, pa.binary())], ["piece", "task", "sums"])

        return add

    kept, least, step = w, math.inf, np.zeros(len(w))
    for _ in range(steps):
        pieces = training.mapInArrow(summed(w), "piece int, task int, sums binary").groupBy("piece").applyInArrow(_added, "piece int, sums binary").collect()
        sums = np.concatenate([np.frombuffer(bytes(r["sums"])) for r in sorted(pieces)])
        slope, curve = sums[1 : len(w) + 1], sums[len(w) + 1 :].reshape(len(w), len(w))
        loss = sums[0] + (penalty * w * w).sum() / 2
        if loss > least * (1 + 1e-12):  # too far: half of the step
            step = step / 2
        else:
            kept, least = w, loss
            step = np.linalg.solve(curve + np.diag(penalty), slope + penalty * w)
        w = kept - step
        if np.abs(step).max() < 1e-6:
            break
    return kept


def _matrix(terms: list, counts: list, marks: np.ndarray, n_terms: int) -> np.ndarray:
    """Features of rows: 1 + log of the count of each term, and the marks."""
    x = np.zeros((len(terms), n_terms + PATTERNS))
    for i, (t, c) in enumerate(zip(terms, counts, strict=True)):
        if len(t):
            x[i, t] = 1 + np.log(c)
    x[:, n_terms:] = marks
    return x


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs (doc_id, text)``, learnt from ``labels (doc_id, toxic)``."""
    given = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    given = given.filter(~held_out(F.col("doc_id")))
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    sizes = dict(given.groupBy("toxic").count().collect())
    n_other, n_toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not n_other or not n_toxic:
        return texts.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.lit(1.0 if n_toxic else 0.0).alias("score"), F.lit(1 if n_toxic else 0).alias("predicted"))
    terms, lexicon = mine_terms(texts.filter(~held_out(F.col("doc_id"))).join(given.hint("merge"), "doc_id"), n_toxic, n_other)
    found = written(features(texts, terms), "features").withColumn("votes", votes(lexicon))
    training = found.filter(~F.col("held_out"))
    patterns = training.select("doc_id", "votes").join(given, "doc_id", "left").groupBy("votes", F.coalesce("toxic", F.lit(-1)).alias("toxic")).count().collect()
    table = np.array(sorted(tuple(r) for r in patterns), dtype=np.int64).reshape(-1, 3)
    if not len(table):  # no document to learn from
        table = np.array([[0, 0, 1], [0, 1, 1]])
    label_model = LabelModel(table[:, 0], table[:, 1], table[:, 2])
    logits = label_model.logit(np.arange(1 << VOTERS))
    side = logits[table[:, 0]] >= 0
    sizes = [int(table[side == s, 2].sum()) for s in (False, True)]
    toxic_side = F.col("votes").isin(sorted({int(v) for v in table[side, 0]})) if side.any() else F.lit(False)
    share = F.when(toxic_side, SAMPLE_ROWS / max(sizes[1], 1)).otherwise(SAMPLE_ROWS / max(sizes[0], 1))
    key = F.xxhash64("doc_id", "terms", "marks")
    sample = training.select("terms", "counts", "marks", "votes", key.alias("key")).filter(F.pmod("key", F.lit(1 << 20)) < share * (1 << 20))
    rows = sample.orderBy("key").limit(4 * SAMPLE_ROWS).toPandas()
    x = _matrix(rows["terms"], rows["counts"], np.array(rows["marks"].tolist()).reshape(-1, PATTERNS), len(terms))
    said = rows["votes"].to_numpy().astype(np.int64)
    sides = (logits[said] >= 0).astype(np.int64)
    weight = (np.array(sizes) / np.maximum(np.bincount(sides, minlength=2), 1))[sides]
    weights = fit_linear(x, _soft(logits, said), weight)
    if len(rows) < sum(sizes):
        weights = fit_all(training.select("terms", "counts", "marks", "votes"), logits, weights)
    weights, bias = weights[:-1], float(weights[-1])
    model = Model(terms, lexicon, weights, bias)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ends = np.asarray(part.column("terms").offsets) - part.column("terms").offsets[0].as_py()
                hits, counts = np.asarray(part.column("terms").flatten()), np.asarray(part.column("counts").flatten())
                value = np.concatenate([[0.0], np.cumsum(model.weights[hits] * (1 + np.log(np.maximum(counts, 1))))])[ends]
                marks = np.asarray(part.column("marks").flatten()).reshape(-1, PATTERNS)
                logit = np.diff(value) + marks @ model.weights[len(model.terms) :] + model.bias
                likely = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(likely), pa.array((likely >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return found.drop("votes").mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
