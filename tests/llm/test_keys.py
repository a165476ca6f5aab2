"""Frequent items and seen keys against brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from talliard.llm.frequent import exact_counts, frequent_items, shrink, summary
from talliard.llm.seen import SeenKeys, error_report
from talliard.operators import bitmaps
from talliard.workspace import fresh_dir


@pytest.mark.parametrize("seed, parts", [(1, 1), (2, 7), (3, 150)])
def test_summary_bounds_every_count(spark, seed, parts):
    rnd = random.Random(seed)
    values = [rnd.choice(["hot", "hot", "null", "", None, f"v{int(rnd.paretovariate(0.6))}"]) for _ in range(6000)]
    df = spark.createDataFrame([(v, 1) for v in values], "v STRING, value INT").repartition(parts)
    true = Counter(v for v in values if v is not None)
    n = sum(true.values())
    items = {r["value"]: r for r in frequent_items(df, "v", 0.02, 60).collect()}
    assert set(items) >= {v for v, c in true.items() if c >= 0.02 * n}
    assert all(r["at_least"] <= true[v] <= r["at_most"] and r["n_rows"] == n for v, r in items.items())
    assert summary(df, "v", 60).count() <= 61
    exact = {r["value"]: r["n"] for r in exact_counts(df, "v", frequent_items(df, "v", 0.02, 60)).collect()}
    assert exact == {v: true[v] for v in items}


def test_summary_of_nothing(spark):
    df = spark.createDataFrame([(None,)] * 3, "v STRING")
    assert frequent_items(df, "v", 0.5, 10).count() == 0
    assert frequent_items(df.limit(0), "v", 0.5, 10).count() == 0
    with pytest.raises(ValueError):
        frequent_items(df, "v", 0.01, 10)


def test_shrink_subtracts_the_next_largest():
    v, n = shrink(pa.array(["a", "b", "c", "a", "d"]), np.array([5, 4, 2, 1, 2]), 2)
    assert dict(zip(v.to_pylist(), n.tolist())) == {"a": 4, "b": 2}
    v, n = shrink(pa.array(["a", "b", "c"]), np.array([3, 3, 3]), 2)
    assert len(v) == 0


def seen_model(history, batch):
    known, first = {k for k in history if k}, {}
    for o, k in batch:
        if k and o is not None and (k not in first or o < first[k]):
            first[k] = o
    return sorted((str(o), str(k), None if k and o is None else bool(k) and (k in known or o > first[k])) for o, k in batch)


@pytest.mark.parametrize("seed", [1, 2])
def test_seen_keys(spark, monkeypatch, seed):
    rnd = random.Random(seed)
    key = lambda: rnd.choice([None, "", "hot", "hot", "x", "X", "x ", f"k{rnd.randrange(300)}"])
    history = [[key() for _ in range(300)] for _ in range(2)]
    batch = [(o, key()) for o in rnd.sample(range(9999), 400)] + [(None, "hot"), (None, None), (None, "new")]
    s = SeenKeys(spark, fresh_dir(spark, "t"))
    for h in history:
        s.admit(spark.createDataFrame([(k, 1) for k in h], "tx STRING, o INT"), "tx")
    df = spark.createDataFrame([(o, k, "z") for o, k in batch], "o BIGINT, tx STRING, key STRING")
    rows = s.probe(df, "tx", "o").collect()
    assert sorted((str(r["o"]), str(r["tx"]), r["seen"]) for r in rows) == seen_model(history[0] + history[1], batch)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("talliard_")]
    monkeypatch.setattr(bitmaps, "MOST_CHUNKS", 0)  # as with filters too large to be sent
    assert Counter(map(tuple, SeenKeys(spark, s.path).probe(df, "tx", "o").collect())) == Counter(map(tuple, rows))


def test_segments_merge(spark):
    s = SeenKeys(spark, fresh_dir(spark, "t"))
    for n in (400, 10, 10, 30):
        s.admit(spark.range(n).selectExpr(f"concat('{n}-', id) AS k"), "k")
    assert [x["rows"] for x in s.log.current()[1]["segments"]] == [400, 40]  # the second ten are the first ten
    batch = spark.createDataFrame([(i, f"{n}-9") for i, n in enumerate((400, 10, 30, 31))], "o INT, k STRING")
    assert [r["seen"] for r in s.probe(batch, "k", "o").orderBy("o").collect()] == [True, True, True, False]


def test_filter_errors_are_measured(spark):
    s = SeenKeys(spark, fresh_dir(spark, "t"))
    s.admit(spark.range(20000).selectExpr("concat('a', id) AS k"), "k")
    batch = spark.range(20000).selectExpr("id AS o", "concat(if(id < 5000, 'a', 'b'), id) AS k")
    r = error_report(s.probe(batch, "k", "o")).head()
    assert r["n_verified"] == 5000 and r["n_filter"] + r["n_disproved"] == 15000
    assert 0 < r["filter_error_rate"] < 0.02
    assert abs(r["filter_error_rate"] - r["n_disproved"] / 15000) < 1e-12


def test_seen_without_history(spark):
    s = SeenKeys(spark, fresh_dir(spark, "t"))
    df = spark.createDataFrame([(2, "a"), (1, "a"), (3, "")], "o BIGINT, k STRING")
    want = {(2, True), (1, False), (3, False)}
    assert {(r["o"], r["seen"]) for r in s.probe(df, "k", "o").collect()} == want
    s.admit(df.limit(0), "k")
    assert {(r["o"], r["seen"]) for r in s.probe(df, "k", "o").collect()} == want
    assert s.probe(df.limit(0), "k", "o").count() == 0
    assert error_report(s.probe(df.limit(0), "k", "o")).head()["filter_error_rate"] == 0
