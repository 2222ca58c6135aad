"""Packing: whole pieces, permitted lengths, little waste, odd rows."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from retort.llm import packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_bins_hold_their_pieces(sizes):
    sizes = np.array(sizes, dtype=np.int64)
    bins, offsets, final = packing.pack(sizes, (16, 32, 64))
    for b in set(bins.tolist()):
        mine = np.flatnonzero(bins == b)
        order = mine[np.argsort(offsets[mine])]
        assert np.array_equal(offsets[order], np.cumsum(sizes[order]) - sizes[order])
        used = sizes[mine].sum()
        assert set(final[mine]) == {min(n for n in (16, 32, 64) if n >= used)}


def test_little_waste_and_mixed_lengths():
    sizes = np.minimum(2048, np.maximum(1, np.random.default_rng(1).lognormal(5.8, 1.0, 5000).astype(int)))
    bins, _, final = packing.pack(sizes)
    one = np.unique(bins, return_index=True)[1]
    assert sizes.sum() / final[one].sum() > 0.98 and len(set(final[one])) >= 3


def test_best_fit_takes_the_least_room():
    bins, _, _ = packing.pack(np.array([50, 40, 12, 20]), (64,))
    assert bins[3] == bins[1] and bins[2] == bins[0]


def plain_pack(sizes, lengths):
    """Best fit with the cost of a new bin reckoned piece by piece, in plain Python."""
    order, bins, out = sorted(range(len(sizes)), key=lambda i: -sizes[i]), [], [None] * len(sizes)
    for at, i in enumerate(order):
        fit = [(cap - used, b) for b, (cap, used) in enumerate(bins) if cap - used >= sizes[i] and cap > used]
        if fit:
            b = min(fit)[1]
        else:
            costs = []
            for cap in lengths:
                if cap >= sizes[i]:
                    room = cap - sizes[i]
                    for j in order[at + 1 :]:
                        room -= sizes[j] if sizes[j] <= room else 0
                    costs.append(((cap + packing.OVERHEAD + packing.QUADRATIC * cap * cap) / (cap - room), -cap))
            b = len(bins)
            bins.append((-min(costs)[1], 0))
        out[i] = (b, bins[b][1])
        bins[b] = (bins[b][0], bins[b][1] + sizes[i])
    final = [min(n for n in lengths if n >= used) for _, used in bins]
    return [(b, at, final[b]) for b, at in out]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_bins_are_those_of_plain_best_fit(sizes):
    got = packing.pack(np.array(sizes, dtype=np.int64), (16, 32, 64))
    assert list(zip(*(x.tolist() for x in got), strict=True)) == plain_pack(sizes, (16, 32, 64))


def test_odd_rows_and_many_shards(spark):
    rows = [(None, "a b"), (1, None), (2, " "), (3, "w " * 5000), (4, "x y"), (4, "x y"), (4, "x")] + [(10 + i, "z " * (i % 50 + 1)) for i in range(200)]
    rows += [(None, "n " * (i % 7)) for i in range(50)] + [(9, "r " * (i % 7)) for i in range(50)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, copy int, part int").repartition(5)
    out = packing.packed(docs, shard_pieces=30).collect()
    assert sum(r["size"] for r in out) == sum(len((t or "").split()) for _, t in rows)
    assert sorted(r["size"] for r in out if r["doc_id"] == 3) == [904, 2048, 2048]
    assert [r["bin_id"] for r in out if r["doc_id"] in (1, 2)] == [None, None]
    assert len({(r["doc_id"], r["copy"], r["piece"]) for r in out}) == len(out)
    assert sorted({r["copy"] for r in out if r["doc_id"] == 9}) == list(range(1, 51))
    assert packing.packed(docs.limit(0)).count() == 0
