"""The message store against brute force, in several ingests, with odd rows."""

import datetime
import random

import pytest

from talliard.operators.redelivery import MessageStore
from talliard.workspace import VersionLog, fresh_dir

DDL = "delivery_id BIGINT, tx_id STRING, at TIMESTAMP, part STRING, note STRING"
DAY = datetime.datetime(2025, 3, 1)


def store(spark):
    return MessageStore(spark, fresh_dir(spark, "t"), "tx_id", "delivery_id", "at", "day")


def brute(rows):
    first = {}
    for r in rows:
        if r[1] and (r[1] not in first or r[0] < first[r[1]]):
            first[r[1]] = r[0]
    kept = sorted(r[0] for r in rows if not r[1] or first[r[1]] == r[0])
    return kept, sorted(r[0] for r in rows if r[1] and first[r[1]] != r[0])


@pytest.mark.parametrize("seed", [1, 2])
def test_ingests_in_any_order(spark, seed):
    rnd = random.Random(seed)
    ids = [None, "", "a", "A", "a ", "hot"] + [f"t{i}" for i in range(40)]
    rows = []
    for i in rnd.sample(range(10**6, 10**6 + 5000), 400):
        tx = "hot" if rnd.random() < 0.3 else rnd.choice(ids)
        at = None if rnd.random() < 0.1 else DAY + datetime.timedelta(hours=rnd.randrange(100))
        rows.append((i, tx, at, rnd.choice(["x", None]), rnd.choice([None, "", "é" * 2000])))
    rnd.shuffle(rows)
    s = store(spark)
    for k in range(3):
        s.ingest(spark.createDataFrame(rows[k::3], DDL))
    kept, removed = brute(rows)
    assert sorted(r[0] for r in s.messages().collect()) == kept
    assert sorted(r[0] for r in s.removed().collect()) == removed
    assert {tuple(r) for r in s.messages().collect()} <= set(rows)


def test_untouched_partitions_keep_their_files(spark):
    s = store(spark)
    s.ingest(spark.createDataFrame([(10, "a", DAY, "", ""), (11, "b", DAY + datetime.timedelta(days=1), "", "")], DDL))
    before = s._state()["parts"]
    s.ingest(spark.createDataFrame([(5, "b", DAY + datetime.timedelta(days=9), "", ""), (12, "a", DAY, "", "")], DDL))
    after = s._state()["parts"]
    first, second = sorted(before)
    assert after[first] == before[first]
    assert second not in after  # its only row lost to an earlier delivery that arrived late
    assert sorted(r[0] for r in s.messages().collect()) == [5, 10]


def test_vacuum_keeps_what_the_newest_version_names(spark):
    s = store(spark)
    for rows in ([(10, "a"), (11, "b")], [(5, "b"), (12, "a"), (13, "c")]):
        s.ingest(spark.createDataFrame([(i, tx, DAY, "", "") for i, tx in rows], DDL))
    kept, removed = sorted(map(tuple, s.messages().collect())), sorted(map(tuple, s.removed().collect()))
    assert s.vacuum() == 3  # the rewritten day and the two index segments that were merged
    assert sorted(map(tuple, s.messages().collect())) == kept and sorted(map(tuple, s.removed().collect())) == removed
    assert s.vacuum() == 0
    s.ingest(spark.createDataFrame([(1, "c", DAY, "", "")], DDL))
    assert sorted(r[0] for r in s.messages().collect()) == [1, 5, 10]


def test_ties_nulls_and_empty_input(spark):
    s = store(spark)
    with pytest.raises(ValueError):
        s.messages()
    s.ingest(spark.createDataFrame([], DDL))
    assert s.messages().count() == 0 and s.removed().count() == 0
    rows = [(1, "a", DAY, "p", "x"), (1, "a", DAY, "p", "x"), (1, "a", DAY, "p", "y"), (None, "a", DAY, "p", "z"), (None, None, DAY, "p", "n"), (None, None, DAY, "p", "n")]
    s.ingest(spark.createDataFrame(rows, DDL))
    assert sorted(str(r[0]) for r in s.messages().collect()) == ["1", "None", "None"]
    assert s.removed().count() == 0
    assert [r["note"] for r in s.unranked().collect()] == ["z"]
    with pytest.raises(ValueError):
        s.ingest(spark.createDataFrame([(1,)], "__t_rank INT"))


def test_repeats_over_several_ingests_are_one_row(spark):
    batch = [(10, "a", DAY, "p", "x"), (11, "b", DAY + datetime.timedelta(days=1), "p", "x"), (12, "a", DAY, "p", "x")]
    one, two = [*batch, (20, "c", DAY, "p", "x")], [*batch, (20, "c", DAY + datetime.timedelta(days=3), "p", "y")]
    kept = []
    for order in ((one, two), (two, one)):  # a retry after a crash behind publish, with one repeat in another partition
        s = store(spark)
        for rows in order:
            s.ingest(spark.createDataFrame(rows, DDL))
        kept.append(sorted(tuple(r) for r in s.messages().collect()))
        assert [r[0] for r in kept[-1]] == [10, 11, 20]
        assert [tuple(r) for r in s.removed().collect()] == [(12, "a")]
    assert kept[0] == kept[1]


def test_a_failed_ingest_changes_nothing(spark, monkeypatch):
    s = store(spark)
    s.ingest(spark.createDataFrame([(2, "a", DAY, "", "")], DDL))

    def crash(*_):
        raise RuntimeError("lost the driver")

    monkeypatch.setattr(VersionLog, "publish", crash)
    with pytest.raises(RuntimeError):
        s.ingest(spark.createDataFrame([(1, "a", DAY, "", ""), (3, "c", DAY, "", "")], DDL))
    monkeypatch.undo()
    assert [r[0] for r in s.messages().collect()] == [2]
    s.ingest(spark.createDataFrame([(1, "a", DAY, "", ""), (3, "c", DAY, "", "")], DDL))
    assert sorted(r[0] for r in s.messages().collect()) == [1, 3]
    assert [r[0] for r in s.removed().collect()] == [2]


def test_two_writers_cannot_both_publish(spark):
    path = fresh_dir(spark, "t")
    log = VersionLog(spark, path)
    log.publish(1, {"a": 1})
    with pytest.raises(FileExistsError):
        log.publish(1, {"a": 2})
    assert log.current() == (1, {"a": 1})
