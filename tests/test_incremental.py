"""Incremental runs against brute force, over failures and repeats."""

import datetime
import random

import pytest

from talliard.operators.incremental import IncrementalJob, last_successful
from talliard.workspace import VersionLog, fresh_dir

LOG = "partition_id INT, wal_index BIGINT, delivery_id BIGINT, tx_id STRING, user_id BIGINT, amount BIGINT, received_at TIMESTAMP, mark_ STRING"
RUNS = "run_id BIGINT, partition_id INT, last_wal_index BIGINT, outcome STRING, started_at TIMESTAMP, finished_at TIMESTAMP, mark STRING"
T = [datetime.datetime(2025, 3, 1) + datetime.timedelta(hours=i) for i in range(50)]


def job(spark):
    return IncrementalJob(spark, fresh_dir(spark, "t"), ["partition_id", "wal_index"], "delivery_id", ["tx_id", "user_id", "amount"], "received_at")


def rows_of(rnd, n, first=0):
    out = []
    for i in range(first, first + n):
        p = rnd.choice([0, 0, 0, 1, 2, None])
        w = rnd.choice([None, *range(12)])
        out.append((p, w, i, rnd.choice([None, "", "a", "b"]), rnd.choice([None, 1]), rnd.choice([None, 5]), rnd.choice([None, *T[:30]]), "z"))
    return out


def brute(rows, marks):
    out = set()
    groups = {}
    for r in rows:
        if r[0] is not None and r[1] is not None:
            groups.setdefault(r[:2], []).append(r)
    for (p, w), g in groups.items():
        mark, began = marks.get(p, (None, None))
        old = [r for r in g if began is not None and r[6] is not None and r[6] <= began]
        newest = max(g, key=lambda r: r[2])
        beyond = mark is not None and w > mark
        if beyond or not old or max(old, key=lambda r: r[2])[3:6] != newest[3:6]:
            out.add((p, w))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_first_run_from_a_run_log(spark, seed):
    rnd = random.Random(seed)
    rows = rows_of(rnd, 150)
    runs = [
        (1, 0, 3, "SAVED", T[5], T[6], "m"),
        (2, 0, 7, "SAVED", T[12], T[13], "m"),
        (2, 0, 7, "SAVED", T[12], T[13], "m"),
        (3, 0, 9, "SAVED", T[20], None, "m"),
        (4, 0, 9, "FAILED", T[20], T[21], "m"),
        (5, 1, None, "SAVED", T[25], T[26], "m"),
        (6, None, 4, "SAVED", T[25], T[26], "m"),
        (7, 2, 4, None, T[25], T[26], "m"),
    ]
    marks = last_successful(spark.createDataFrame(runs, RUNS))
    assert {tuple(r) for r in marks.collect()} == {(0, 7, T[12]), (1, None, T[25])}
    got = [tuple(r)[:2] for r in job(spark).run(spark.createDataFrame(rows, LOG), marks=marks).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, {0: (7, T[12]), 1: (None, T[25])})


def test_runs_neither_skip_nor_repeat_over_failures(spark, monkeypatch):
    rnd = random.Random(9)
    first, second = rows_of(rnd, 60), rows_of(rnd, 40, 60)
    j = job(spark)
    a = {tuple(r)[:2]: tuple(r)[3:] for r in j.run(spark.createDataFrame(first, LOG)).collect()}
    real = VersionLog.publish
    monkeypatch.setattr(VersionLog, "publish", lambda *_: (_ for _ in ()).throw(RuntimeError("crash")))
    with pytest.raises(RuntimeError):
        j.run(spark.createDataFrame(first + second, LOG))
    monkeypatch.setattr(VersionLog, "publish", real)
    assert j.watermark() == 59
    b = {tuple(r)[:2]: tuple(r)[3:] for r in j.run(spark.createDataFrame(first + second, LOG)).collect()}
    assert j.watermark() == 99
    newest = {}
    for r in sorted(first + second, key=lambda r: r[2]):
        if r[0] is not None and r[1] is not None:
            newest[r[:2]] = r[3:6]
    assert {**a, **b} == newest
    old = {}
    for r in first:
        if r[0] is not None and r[1] is not None:
            old[r[:2]] = r[3:6]
    assert set(b) == {k for k, v in newest.items() if old.get(k, "absent") != v}
    assert j.run(spark.createDataFrame(first + second, LOG)).count() == 0
    assert j.outputs(j.run(spark.createDataFrame(first + second, LOG)).schema).count() == len(a) + len(b)


def test_the_output_of_a_failing_step_is_never_seen(spark):
    j = job(spark)
    rows = spark.createDataFrame(rows_of(random.Random(4), 30), LOG)

    def broken(df):
        raise RuntimeError("in the middle")

    with pytest.raises(RuntimeError):
        j.run(rows, broken)
    assert j.watermark() is None
    assert j.run(rows, lambda df: df.select("wal_index")).count() > 0


def test_empty_log(spark):
    j = job(spark)
    assert j.run(spark.createDataFrame([], LOG)).count() == 0
    assert j.run(spark.createDataFrame([], LOG), marks=last_successful(spark.createDataFrame([], RUNS))).count() == 0


def test_later_runs_read_only_what_is_new(spark):
    """A second run that gets the new rows alone does the same as one that gets the whole log."""
    rnd = random.Random(12)
    first, second, third = rows_of(rnd, 80), rows_of(rnd, 30, 80), rows_of(rnd, 30, 110)
    whole, part = job(spark), job(spark)
    for j, batches in ((whole, (first, first + second, first + second + third)), (part, (first, second, third))):
        j.result = [sorted((tuple(r) for r in j.run(spark.createDataFrame(b, LOG)).collect()), key=str) for b in batches]
    assert whole.result == part.result and len(whole.result[2]) > 0
    assert sum(len(s["files"]) for s in part.log.current()[1]["state"]) <= 3


def test_later_run_after_marks(spark):
    """Positions that the first run left out are compared with what the log held when it ran."""
    rnd = random.Random(5)
    first, second = rows_of(rnd, 120), rows_of(rnd, 60, 120)
    runs = [(2, 0, 7, "SAVED", T[12], T[13], "m"), (5, 1, None, "SAVED", T[25], T[26], "m"), (6, 2, 5, "SAVED", None, T[26], "m")]
    j = job(spark)
    j.run(spark.createDataFrame(first, LOG), marks=last_successful(spark.createDataFrame(runs, RUNS)))
    got = {tuple(r)[:2] for r in j.run(spark.createDataFrame(first + second, LOG)).collect()}
    newest = lambda rows: {r[:2]: r[3:6] for r in rows if r[0] is not None and r[1] is not None}
    old, new = newest(first), newest(first + second)
    assert got == {k for k, v in new.items() if old.get(k, "absent") != v}
