"""Packing and mixing: every promise, on random input."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from talliard.llm import mixing, packing
from talliard.llm.mixing import mix, pivot
from talliard.llm.packing import Places, pack, pack_histogram, packing_report


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 50), st.integers(1, 40), max_size=20))
def test_histogram(sizes):
    patterns = pack_histogram(sizes, 50)
    got = defaultdict(int)
    for n, items in patterns:
        assert sum(k * c for k, c in items) <= 50
        for k, c in items:
            got[k] += n * c
    assert got == {k: v for k, v in sizes.items() if k}
    # No two containers that are at most half full can both exist: one would have taken the other's items.
    assert sum(n for n, items in patterns if sum(k * c for k, c in items) <= 25) <= 1
    places = Places(patterns)
    length = np.concatenate([np.full(v, k) for k, v in sizes.items()] or [np.empty(0, int)]).astype(int)
    rank = np.concatenate([np.arange(v) for v in sizes.values()] or [np.empty(0, int)]).astype(int)
    c, p = places.find(length, rank)
    assert len(set(zip(c, p))) == len(length)
    for k in set(c):
        assert sorted(p[c == k]) == list(range((c == k).sum())) and length[c == k].sum() <= 50


@pytest.mark.parametrize("part_rows", [3, 1 << 20])
def test_pack(spark, monkeypatch, part_rows):
    monkeypatch.setattr(packing, "PART_ROWS", part_rows)
    rnd = random.Random(2)
    rows = [(rnd.choice([None, i, i]), rnd.choice([None, 0, 0, 100, 100, 100, 7, 1000, rnd.randrange(1, 350)]), 1) for i in range(300)]
    rows += [(5, 100, 1)] * 3
    out = pack(spark.createDataFrame(rows, "d BIGINT, t BIGINT, container INT"), "d", "t", 100).collect()
    used, places = defaultdict(int), set()
    for r in out:
        assert 0 <= r["n_tokens"] <= 100 and r["token_start"] == r["piece"] * 100
        used[r["container"]] += r["n_tokens"]
        places.add((r["container"], r["position"]))
    assert len(places) == len(out) and max(used.values()) <= 100 and sorted(used) == list(range(len(used)))
    sizes = Counter()
    for d, t, _ in rows:
        sizes[(d, t or 0)] += 1
    assert sum(r["n_tokens"] for r in out) == sum(t or 0 for _, t, _ in rows)
    want = Counter()
    for d, t, _ in rows:
        t = t or 0
        for piece in range(max(1, -(-t // 100))):
            want[(d, piece, min(100, t - 100 * piece))] += 1
    assert Counter((r["d"], r["piece"], r["n_tokens"]) for r in out) == want


def test_pack_nothing_and_empty_texts(spark):
    df = spark.createDataFrame([], "d BIGINT, t BIGINT")
    assert pack(df, "d", "t").count() == 0
    r = packing_report(pack(df, "d", "t")).head()
    assert (r["n_items"], r["n_containers"], r["used"]) == (0, 0, None)
    out = pack(spark.createDataFrame([(1, 0), (2, None)], "d BIGINT, t BIGINT"), "d", "t").collect()
    assert sorted((r["container"], r["position"]) for r in out) == [(0, 0), (0, 1)]


def test_little_space_is_wasted(spark):
    rnd = random.Random(1)
    df = spark.createDataFrame([(i, max(1, int(rnd.lognormvariate(6.2, 0.8)))) for i in range(5000)], "d BIGINT, t BIGINT")
    r = packing_report(pack(df, "d", "t")).head()
    assert r["n_containers"] <= 1.01 * r["least_containers"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 5000), st.floats(0, 1)), max_size=60), st.integers(0, 9))
def test_pivot_keeps_the_mass(items, seed):
    sizes, p = np.array([s for s, _ in items], float), np.array([q for _, q in items], float)
    out = pivot(np.arange(len(items)), sizes, p, seed)
    assert ((out == 0) | (out == 1)).sum() >= len(items) - 1
    assert abs((out * sizes).sum() - (p * sizes).sum()) < 1e-6 * max(1, sizes.sum())


def test_pivot_is_unbiased():
    rng = np.random.default_rng(0)
    sizes, p = rng.integers(1, 1000, 40).astype(float), np.full(40, 0.3)
    # The one that stays undecided counts with its probability.
    mean = np.mean([pivot(np.arange(40), sizes, p, s * 97) for s in range(3000)], axis=0)
    assert abs(mean - 0.3).max() < 0.04


DOCS, TARGETS = "doc_id BIGINT, source STRING, tokens BIGINT, copies INT", "source STRING, target_share DOUBLE, max_uses INT"


def test_mix(spark):
    rnd = random.Random(4)
    spell = {"a": ["a", "A ", " a"], "b": ["B", "b"], "c": ["c"], None: [None], "z": ["z"]}
    rows = []
    for i in range(4000):
        s = rnd.choice(["a", "a", "a", "b", "c", None, "z"])
        rows.append((i, rnd.choice(spell[s]), rnd.choice([None, 0, rnd.randrange(1, 900)]), 1))
    df = spark.createDataFrame(rows, DOCS).repartition(40)
    targets = spark.createDataFrame([("a", 0.3, 1), ("B", 0.4, 4), ("c", 0.3, 1), ("none", 0.0, 2), (None, 0.5, 1)], TARGETS)
    mixture, report = mix(df, targets)
    size = sum(t or 0 for _, s, t, _ in rows if s and s.strip().lower() in "abc")
    got = {r["source"]: r for r in report.collect()}
    uses = defaultdict(list)
    for r in mixture.collect():
        uses[r["source"]].append(r)
    assert set(got) == {"a", "B", "c", "none"} and set(uses) <= set(got)
    assert {s: r["short"] for s, r in got.items()} == {"a": False, "B": False, "c": True, "none": False}
    for s, most in (("a", 1), ("B", 4), ("c", 1)):
        assert max(r["copies"] for r in uses[s]) <= most
        assert len({r["doc_id"] for r in uses[s]}) == len(uses[s])
        total = sum(r["tokens"] * r["copies"] for r in uses[s])
        assert total == got[s]["reached_tokens"]
        if not got[s]["short"]:
            assert abs(total - got[s]["target_share"] * size) <= 900
    assert abs(sum(r["share_of_mixture"] for r in got.values()) - 1) < 1e-9
    assert Counter(map(tuple, mixture.collect())) == Counter(map(tuple, mix(df, targets)[0].collect()))


def test_mix_of_nothing(spark):
    docs, targets = spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 0.5, None), ("A", None, 3)], TARGETS)
    mixture, report = mix(docs, targets)
    assert mixture.count() == 0
    assert [tuple(r)[:3] for r in report.collect()] == [("A", 0.5, 1)]
    mixture, report = mix(docs, targets.limit(0))
    assert mixture.count() == 0 and report.count() == 0


@pytest.mark.parametrize("few", [0, 500_000])
def test_targets_are_met_beside_very_long_documents(spark, monkeypatch, few):
    """One document as large as its source's target, and a few of a third of it; nothing is short."""
    monkeypatch.setattr(mixing, "FEW", few)
    rnd = random.Random(8)
    rows = [(i, "a", rnd.randrange(100, 300), 0) for i in range(3000)] + [(None, "a", 0, 0)]
    rows += [(5000, "a", 60_000, 0), *((6000 + i, "a", 20_000, 0) for i in range(5))]
    rows += [(10_000 + i, "b", rnd.randrange(100, 300), 0) for i in range(3000)] + [(20_000, "c", 2**53 + 1 & 0xFFFF, 0)]
    df = spark.createDataFrame(rows, DOCS)
    size = sum(r[2] for r in rows)
    targets = spark.createDataFrame([("a", 60_000 / size, 1), ("b", 0.2, 1), ("c", 0.7, 2)], TARGETS)
    for seed in (0, 1, 2):
        mixture, report = mix(df, targets, seed)
        got = {r["source"]: r for r in report.collect()}
        assert [got[s]["short"] for s in "abc"] == [False, False, True]
        for s in "ab":
            assert abs(got[s]["reached_tokens"] / got[s]["target_tokens"] - 1) < 0.01
        assert sum(r["tokens"] * r["copies"] for r in mixture.where("source = 'a'").collect()) == got["a"]["reached_tokens"]
