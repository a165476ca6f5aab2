"""Money, routing, numbering, log pages, snapshots, sink, configuration."""

import pytest
from pyspark.sql import functions as F

from talliard.config import LedgerConfig
from talliard.functions import money, routing
from talliard.operators import sink, snapshot
from talliard.operators.fold import journal
from talliard.operators.numbering import number
from talliard.operators.state import balances
from talliard.sources import wal
from talliard.sources.commands import COMMAND, from_events, generated
from talliard.workspace import fresh_dir

DEMO = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).head()[0]


@pytest.mark.parametrize("text, units", [("100.00", 1000000), ("0.0001", 1), ("10.55559", 105555), ("-10.55559", -105555), (None, 0)])
def test_to_mem(spark, text, units):
    assert one(spark, money.to_mem(F.lit(text).cast("decimal(18,5)"))) == units


@pytest.mark.parametrize("units, text", [(1000000, "100.0000"), (1, "0.0001"), (0, "0.0000"), (-105555, "-10.5555"), (2**63 - 1, "922337203685477.5807")])
def test_format(spark, units, text):
    assert one(spark, money.format_mem(F.lit(units).cast("bigint"))) == text


def test_string_hash_and_modulo(spark):
    assert one(spark, routing.string_hash(F.lit("1234567"))) == 2018166324
    assert one(spark, routing.string_hash(F.lit(""))) == 0

    def plain(s):
        h = 0
        raw = s.encode("utf-16-le")
        for i in range(0, len(raw), 2):
            h = (h * 31 + int.from_bytes(raw[i : i + 2], "little")) & 0xFFFFFFFF
        return h

    keys = ["a", "kasse-süd", "余额123", "x😀y", "😀", "0" * 300]
    df = spark.createDataFrame([(k,) for k in keys], "k STRING")
    assert {r[0]: r[1] for r in df.select("k", routing.string_hash(F.col("k"))).collect()} == {k: plain(k) for k in keys}
    df = spark.createDataFrame([(str(i),) for i in range(16)], "k STRING")
    got = {r[0]: r[1] for r in df.select("k", routing.modulo(F.col("k"), 4)).collect()}
    assert [got[str(i)] for i in range(16)] == [0, 1, 2, 3, 0, 1, 2, 3, 0, 1, 3, 0, 1, 2, 3, 0]
    assert one(spark, routing.modulo(F.lit(None).cast("string"), 4)) == 0


def test_rendezvous_vectors(spark):
    import numpy as np

    df = spark.createDataFrame([(str(i),) for i in range(16)], "k STRING")
    got = {r[0]: r[1] for r in df.select("k", routing.rendezvous(F.col("k"), 4)).collect()}
    assert [got[str(i)] for i in range(16)] == [2, 2, 3, 3, 3, 0, 3, 2, 0, 1, 1, 2, 2, 0, 2, 1]
    want = {
        "0": [-6606475147719912082, 6735007852924479271, 8395497519700746656, 1396806276295642767],
        "user-abcdefghijkl": [3355619418734316112, -7102260603771053158, 7419332069312481409, -6787964124717149838],
        "余额123": [7807470990709139896, -9126289923686501869, -8068721253509716861, 1732947094633410562],
    }
    for key, weights in want.items():
        for i, w in enumerate(weights):
            raw = np.frombuffer(key.encode() + np.array([i], "<i4").tobytes(), np.uint8)
            assert routing.murmur3_low(raw.reshape(1, -1))[0] == w
    assert one(spark, routing.rendezvous(F.lit(None).cast("string"), 4)) == 0
    assert one(spark, routing.rendezvous(F.lit("a"), 0)) == -1


def test_few_keys_move_when_a_partition_is_added():
    keys = [str(i) for i in range(5000)]
    a, b = routing.highest_weight(keys, 4), routing.highest_weight(keys, 5)
    assert set(b[a != b]) == {4}
    assert 0.15 < (a != b).mean() < 0.25


def test_odd_even(spark):
    keys = {"3": 1, "4": 0, "-3": 1, "x": routing_modulo("x")}
    df = spark.createDataFrame([(k,) for k in keys], "k STRING")
    assert {r[0]: r[1] for r in df.select("k", routing.odd_even(F.col("k"), 2)).collect()} == keys
    assert one(spark, routing.odd_even(F.lit("3"), 1)) == 0


def routing_modulo(key):
    return sum(ord(c) * 31 ** (len(key) - 1 - i) for i, c in enumerate(key)) % 2


def test_strategy_by_name():
    assert routing.strategy("modulo") is routing.modulo
    assert routing.strategy("anything") is routing.rendezvous and routing.strategy(None) is routing.rendezvous
    c = LedgerConfig(idempotency="lru", engine_name="e", base_dir="/x/")
    assert c.dedup_name() == "LRU" and LedgerConfig().dedup_name() == "BLOOM" and LedgerConfig().strategy() is routing.rendezvous
    assert c.partition_dir(2) == "/x/e/node-0/e-p2"
    for bad in ({"partitions": 0}, {"node_id": 1}, {"total_nodes": 0}):
        with pytest.raises(ValueError):
            LedgerConfig(**bad)


def test_numbering_with_a_hot_group_and_nulls(spark):
    rows = [("hot" if i % 3 else [None, "", "b"][i // 3 % 3], i, "x") for i in range(500)]
    got = number(spark.createDataFrame(rows, "g STRING, o INT, n STRING"), ["g"], ["o"], "no", 10).collect()
    for g in ("hot", None, "", "b"):
        own = sorted((r["o"], r["no"]) for r in got if r["g"] == g)
        assert [n for _, n in own] == list(range(10, 10 + len(own)))
    assert number(spark.createDataFrame([], "g STRING, o INT"), ["g"], ["o"], "no").count() == 0


def test_pages_walk_the_log(spark):
    rows = [(i, f"t{i}", 1 if i % 4 else 2, i) for i in range(53)]
    df = spark.createDataFrame(rows, "wal_index BIGINT, tx_id STRING, user_id BIGINT, amount BIGINT")
    seen, cursor = [], None
    while True:
        p = wal.page(df, 10, cursor, backward=False).head()
        seen += p["records"]
        assert p["has_prev"] == (cursor is not None) and p["prev_cursor"] == cursor
        if not p["has_more"]:
            break
        cursor = p["next_cursor"]
    assert [f'"tx_id":"t{i}"' in r for i, r in enumerate(seen)] == [True] * 53
    back = wal.page(df, 10, None, backward=True).head()
    assert '"t43"' in back["records"][0] and back["prev_cursor"] == "0x2a" and not back["has_more"]
    hits = wal.page(df, 5, "0x10", backward=False, routing_key="2").head()
    assert len(hits["records"]) == 5 and hits["next_cursor"] == "0x21"
    assert wal.page(df, 5, "99").head()["records"] == []
    with pytest.raises(ValueError):
        wal.page(df, 5, "zz")
    assert [wal.decode_cursor(t) for t in ("0x1F", "#a", "-12", "010", "7")] == [31, 10, -12, 8, 7]


def test_recovery_equals_the_whole_fold(spark):
    rows = from_events(spark, DEMO).withColumn("partition", F.pmod("user_id", F.lit(3)).cast("int"))
    log = wal.Wal(spark, fresh_dir(spark, "t"))
    log.append(rows)
    records = log.scan().persist()
    want = {tuple(r) for r in balances(journal(records)).collect()}
    for cut in (1, 400, 999):
        store = snapshot.SnapshotStore(spark, fresh_dir(spark, "t"))
        assert store.load() is None
        snapshot.take(store, records.where(F.col("seq") <= cut))
        assert {tuple(r) for r in snapshot.recover(records, store)[1].collect()} == want
    with pytest.raises(snapshot.RecoveryError):
        snapshot.recover(records.where("wal_index > 5 AND wal_index < 100"), store)
    rerun = snapshot.recover(records.where("seq < 900"), store, missing="replay_all")[1]
    assert rerun.count() == len(want)
    store.log.delete(store.log.current()[1]["at"])
    with pytest.raises(snapshot.RecoveryError):
        store.load()
    assert store.load(corrupt_is_cold=True) is None


def test_appends_continue_the_numbers(spark):
    log = wal.Wal(spark, fresh_dir(spark, "t"))
    assert log.scan().count() == 0
    for k in range(2):
        log.append(spark.createDataFrame([(k * 10 + i, "t", 1, 1, i % 2) for i in range(5)], COMMAND + ", partition INT"))
    got = sorted((r["partition"], r["wal_index"], r["seq"]) for r in log.scan().collect())
    assert got == [(0, 0, 0), (0, 1, 2), (0, 2, 4), (0, 3, 10), (0, 4, 12), (0, 5, 14), (1, 0, 1), (1, 1, 3), (1, 2, 11), (1, 3, 13)]
    assert log.scan(start=2, partition=1).count() == 2


def test_generated_load(spark):
    rows = generated(spark, 103, 10, 4).collect()
    assert len({r["tx_id"] for r in rows}) == 103 and {r["amount"] for r in rows} == {10000}
    per = [sum(r["thread"] == t for r in rows) for t in range(4)]
    assert per == [25, 25, 25, 28]


def test_batches_and_retries(spark):
    df = spark.createDataFrame([(i * 3, "e") for i in range(25)], "seq BIGINT, e STRING")
    got = sink.batches(df, 10).groupBy("batch").count().collect()
    assert sorted(map(tuple, got)) == [(0, 10), (1, 10), (2, 5)]
    calls = []

    def persist(d, i):
        calls.append(i)
        if len(calls) < 3:
            raise OSError("down")

    w = sink.RetryingWriter(persist, pause=0)
    w(df, 0), w(df, 0), w(df, 1)
    assert calls == [0, 0, 0, 1] and w.failures == 2 and len(w.seconds) == 2
    with pytest.raises(OSError):
        sink.RetryingWriter(lambda d, i: persist(calls.clear(), i), pause=0, attempts=2)(df, 5)
