"""The streaming fold equals the batch fold, over several micro-batches, restarts and failing sinks."""

import os
import subprocess
import sys
from datetime import timedelta

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from talliard.config import LedgerConfig
from talliard.operators.fold import Dedup, Outcome, Reject, journal
from talliard.operators.sink import RetryingWriter
from talliard.operators.state import balances
from talliard.sources.commands import COMMAND, from_events, with_retries
from talliard.streaming.engine import LedgerEngine
from talliard.streaming.ledger import LedgerProcessor, Metrics, SnapshotTrigger, start, streaming_journal
from talliard.workspace import fresh_dir


def write_files(df, path, n):
    rows = df.orderBy("seq").collect()
    step = -(-len(rows) // n)
    for i in range(n):
        df.sparkSession.createDataFrame(rows[i * step : (i + 1) * step], COMMAND).coalesce(1).write.mode("append").parquet(path)


def outcome(df):
    return {r["seq"]: (r["status"], r["balance_after"]) for r in df.collect()}


def streamed(spark, rows, schema=COMMAND, batches=1, **options):
    """Journal rows of a stream of ``batches`` files."""
    src, out = fresh_dir(spark, "t"), fresh_dir(spark, "t")
    step = -(-len(rows) // batches)
    for i in range(batches):
        spark.createDataFrame(rows[i * step : (i + 1) * step], schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = start(streaming_journal(stream, **options), lambda df, i: df.write.mode("overwrite").parquet(f"{out}/rows/batch={i}"), f"{out}/c")
    q.awaitTermination()
    return spark.read.parquet(f"{out}/rows").drop("batch")


def same(got, want):
    names = [c for c in want.columns if c in got.columns]
    key = lambda r: str(tuple(r))
    assert sorted(got.select(names).collect(), key=key) == sorted(want.select(names).collect(), key=key)


BIG = 2**53 + 1
ODD = [
    (1, "a", 1, BIG), (2, "b", 1, None), (None, "c", 1, 5), (3, None, 1, 5), (BIG, "d", BIG, BIG), (4, "e", None, 7), (5, "f", None, -9),
    (6, "a", 1, BIG), (7, "", 1, -1), (8, "", 1, -1), (9, "é😀", BIG, -BIG), (9, "é😀", BIG, -BIG),
]


def test_nulls_and_large_numbers_keep_every_digit(spark):
    same(streamed(spark, ODD), journal(spark.createDataFrame(ODD, COMMAND)))


def processors():
    """Defined inside, so that they travel by value."""

    def moody(balance, amount, user, tx):
        if amount == 13:
            return 1 // 0
        if amount == 17:
            return None
        if amount == 19:
            return "much"
        if balance + amount < 0:
            raise Reject("no")
        return balance + amount

    def limited(balance, amount, user, tx, own):
        """At most three commands an account; only every second one tells the sink."""
        n = (own or {"n": 0})["n"] + 1
        if n > 3:
            raise Reject("enough")
        return Outcome(balance + amount, {"n": n}, n % 2 == 0)

    limited.keeps_state = True
    return moody, limited


def test_processors_of_ones_own(spark):
    rows = [(i, f"t{i}", i % 2, a) for i, a in enumerate([5, 13, 17, 19, -3, -99, 4, 4, 2, 2])] + [(20, "t2", 0, 5), (21, "t1", 1, 5)]
    for p in processors():
        want = journal(spark.createDataFrame(rows, COMMAND), processor=p)
        same(streamed(spark, rows, processor=p), want)
        assert {r["status"] for r in want.collect()} >= ({"ERROR", "REJECTED", "DUPLICATE"} if p.__name__ == "moody" else {"REJECTED"})
        assert want.where("status = 'ACCEPTED' AND NOT has_entity").count() > 0


def test_opening_balances_and_earlier_identifiers(spark):
    rows = [(1, "a", 1, -5), (2, "b", 2, -5), (3, "c", None, -5), (4, "d", 3, -1)]
    opening = spark.createDataFrame([(1, 5), (1, 4), (2, 3), (None, 5), (9, None)], "user_id BIGINT, balance BIGINT")
    accepted = spark.createDataFrame([(1, "a"), (None, "x"), (2, None)], "user_id BIGINT, tx_id STRING")
    for known in (None, accepted):
        want = journal(spark.createDataFrame(rows, COMMAND), opening, accepted=known)
        same(streamed(spark, rows, opening=opening, accepted=known), want)


@pytest.mark.parametrize("dedup", [Dedup("FIFO", 100), Dedup("BLOOM", 40, 0.2), Dedup("NONE"), Dedup()])
def test_every_way_of_remembering_in_a_partition(spark, dedup):
    schema = COMMAND + ", partition INT"
    rows = [(i, f"t{i * 7 % 61}", i % 5, (-1) ** i * (i % 11), i % 2) for i in range(300)]
    want = journal(spark.createDataFrame(rows, schema), dedup=dedup, scope="partition")
    got = streamed(spark, rows, schema, 3, dedup=dedup, scope="partition")
    same(got, want)
    assert (got.where("status = 'DUPLICATE'").count() > 0) == (dedup.kind != "NONE")


@pytest.mark.parametrize("dedup", [Dedup("FIFO", 5), Dedup("NONE"), Dedup()])
def test_users_of_one_group_are_scopes_of_their_own(spark, dedup, monkeypatch):
    """The same identifiers for each user, more than a page of the state holds."""
    monkeypatch.setattr("talliard.streaming.ledger.BUCKETS", 1)
    rows = [(i, f"t:{i * 7 % 97}", (None, -1, 1, 11)[i % 4], (-1) ** (i // 4) * (i % 11)) for i in range(600)]
    opening = spark.createDataFrame([(-1, 5), (None, 7)], "user_id BIGINT, balance BIGINT")
    accepted = spark.createDataFrame([(1, "t:7"), (None, "t:0")], "user_id BIGINT, tx_id STRING")
    want = journal(spark.createDataFrame(rows, COMMAND), opening, dedup, accepted=accepted)
    same(streamed(spark, rows, batches=3, dedup=dedup, opening=opening, accepted=accepted), want)


def test_small_accounts_have_no_state_of_their_own(spark):
    """Each entry of the state costs calls between Spark and Python; a log of many small accounts would be nothing but calls."""
    users = 12_000
    rows = [(i, f"t{i % 7}", i % users, (5, -3, -9)[i // users]) for i in range(3 * users)]
    src, out = fresh_dir(spark, "t"), fresh_dir(spark, "t")
    for part in (rows[:users], rows[users:]):
        spark.createDataFrame(part, COMMAND).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(COMMAND).option("maxFilesPerTrigger", 1).parquet(src)
    q = start(streaming_journal(stream), lambda df, i: df.write.mode("overwrite").parquet(f"{out}/rows/batch={i}"), f"{out}/c")
    q.awaitTermination()
    same(spark.read.parquet(f"{out}/rows").drop("batch"), journal(spark.createDataFrame(rows, COMMAND)))
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) < users


def test_the_processor_travels_without_the_package(spark, tmp_path):
    """Beside the driver Spark unpickles it in a process that may not have the package."""
    streaming_journal(spark.readStream.schema(COMMAND).parquet(str(tmp_path)))
    load = "import pickle, sys; pickle.load(sys.stdin.buffer)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", load], input=cloudpickle.dumps(LedgerProcessor()), cwd=tmp_path, env=env, capture_output=True)
    assert run.returncode == 0, run.stderr.decode()


def test_identifiers_are_forgotten_after_a_while(spark):
    rows = [(1, "a", 1, 5), (2, "a", 1, 5)]
    assert sorted(r["status"] for r in streamed(spark, rows, batches=2, remember_ms=3_600_000).collect()) == ["ACCEPTED", "DUPLICATE"]
    assert [r["status"] for r in streamed(spark, rows, batches=2, remember_ms=1).collect()] == ["ACCEPTED"] * 2


def test_equals_batch_over_restarts(spark):
    rows = with_retries(from_events(spark, "/root/testdata/sf0.001").where("user_id < 6"))
    src, out = fresh_dir(spark, "t"), fresh_dir(spark, "t")
    metrics = Metrics(spark, "led.")
    calls = []

    def persist(df, i):
        calls.append(i)
        if len(calls) == 1:
            raise OSError("down")
        df.write.mode("overwrite").parquet(f"{out}/rows/batch={i}")

    half = rows.agg({"seq": "max"}).head()[0] // 2
    for part in (rows.where(f"seq <= {half}"), rows.where(f"seq > {half}")):
        write_files(part, src, 1)
        stream = spark.readStream.schema(COMMAND).option("maxFilesPerTrigger", 1).parquet(src)
        q = start(streaming_journal(stream), RetryingWriter(persist, pause=0), f"{out}/checkpoint")
        q.awaitTermination()
    assert outcome(spark.read.parquet(f"{out}/rows")) == outcome(journal(rows))
    assert calls[:2] == [0, 0] and len(set(calls)) >= 2
    assert metrics.prefix == "led."
    spark.streams.removeListener(metrics)


def test_a_sink_that_gives_up_fails_the_query(spark):
    src = fresh_dir(spark, "t")
    spark.createDataFrame([(1, "a", 1, 5)], COMMAND).write.parquet(src)

    def broken(df, i):
        raise OSError("down")

    q = start(streaming_journal(spark.readStream.schema(COMMAND).parquet(src)), RetryingWriter(broken, 0, 2), fresh_dir(spark, "t"))
    with pytest.raises(Exception):
        q.awaitTermination()


def test_snapshot_trigger():
    now = [0.0]
    t = SnapshotTrigger(100, 600, lambda: now[0])
    assert not t.due(60) and t.due(60)
    t.committed()
    assert not t.due(10)
    now[0] = 700.0
    assert t.due(1) and t.due(0)
    t.committed()
    assert not t.due(0)


def test_engine_from_a_configuration(spark):
    """Submit, fold, sink, snapshots by count, shut-down; a second engine goes on from the snapshot without the checkpoint."""
    config = LedgerConfig(base_dir=fresh_dir(spark, "t"), partitions=2, total_nodes=2, routing="MODULO", snapshot_interval=10, heartbeat=timedelta(seconds=1))
    rows = [(i, f"t{i % 37}", 2 * (i % 4) + (i == 11), 10 if i % 3 else -7) for i in range(60)]
    opening = spark.createDataFrame([(0, 5), (8, 3)], "user_id BIGINT, balance BIGINT")
    got = []
    engine = LedgerEngine(spark, config, lambda df, i: got.extend(df.collect()), opening=opening)
    away = engine.submit(spark.createDataFrame(rows[:40], COMMAND))
    assert [(r["seq"], r["status"]) for r in away.collect()] == [(11, "MISROUTED")]
    engine.start()
    engine.shut_down()
    assert engine.snapshots.log.current()[0] >= 1
    second = LedgerEngine(spark, config, lambda df, i: got.extend(df.collect()), opening=opening)
    second.wal.log.delete(f"{second.base}/checkpoint"), second.wal.log.delete(f"{second.base}/journal")
    second.snapshots.save(*second.snapshots.load())  # the lost journal's batches don't count any more
    second.submit(spark.createDataFrame(rows[40:], COMMAND))
    second.start()
    second.shut_down()
    here = spark.createDataFrame([r for r in rows if r[0] != 11], COMMAND)
    want = journal(here.withColumn("partition", F.lit(0)), opening.withColumn("partition", F.lit(0)), scope="partition")
    final = {tuple(r) for r in balances(want, opening).collect()}
    assert {tuple(r) for r in second.snapshots.load()[1].collect()} == final
    assert len(got) == want.where("has_entity").count()
