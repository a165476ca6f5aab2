"""An engine made from a ``LedgerConfig``: routes commands, logs them, folds the log as a stream, hands entities to a sink, and takes
snapshots by count, by time, and when it is shut down.

Submitting is durable when it returns: the commands are in the log, with positions. The stream follows the log; at most
``LedgerConfig.files_per_trigger`` of its files are taken at a time, so a slow sink holds the fold back and not the
submitters. A heartbeat looks at the clock while no commands come, so an idle log gets its snapshot by time too.

Defined results: a command of another node is given back as MISROUTED and not logged; a record without content is skipped.
A snapshot holds every account, also those that only have an opening balance, and the identifiers accepted so far. An
engine that finds its checkpoint goes on from there; one that doesn't starts from the newest snapshot and takes what the log
has behind it. ``opening`` counts only if there is neither.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from talliard.codes import ACCEPTED
from talliard.config import LedgerConfig
from talliard.functions.routing import route, routing_key
from talliard.operators import sink, state
from talliard.operators.fold import JOURNAL, Dedup, Processor, misrouted, wallet
from talliard.operators.snapshot import SnapshotStore
from talliard.sources.wal import RECORD, Wal, with_content
from talliard.streaming.ledger import SnapshotTrigger, start, streaming_journal
from talliard.workspace import broadcast_if_small


class LedgerEngine:
    def __init__(
        self,
        spark: SparkSession,
        config: LedgerConfig,
        persist: Callable[[DataFrame, int], None] = lambda batch, i: None,
        processor: Processor = wallet,
        opening: DataFrame | None = None,
        now: Callable[[], float] = time.monotonic,
    ):
        self.spark, self.config, self.processor, self.opening = spark, config, processor, opening
        self.base = config.node_dir()
        self.wal, self.snapshots = Wal(spark, f"{self.base}/wal"), SnapshotStore(spark, f"{self.base}/snapshots")
        seconds = config.time_snapshot_interval.total_seconds() if config.time_snapshot else None
        self.trigger = SnapshotTrigger(config.snapshot_interval, seconds, now)
        self.writer = sink.RetryingWriter(persist)
        self.query: StreamingQuery | None = None
        self._lock, self._stop = threading.Lock(), threading.Event()

    def _partition(self, df: DataFrame) -> Column:
        return self.config.strategy()(routing_key("user_id"), self.config.partitions)

    def submit(self, commands: DataFrame) -> DataFrame:
        """Logs the commands (seq, tx_id, user_id, amount) of this node in the order of seq; gives back the others, MISROUTED."""
        routed = route(commands, routing_key("user_id"), self.config.partitions, self.config.total_nodes, self.config.strategy())
        self.wal.append(routed.where(F.col("node") == self.config.node_id).drop("node"))
        return misrouted(routed, self.config.node_id)

    def start(self) -> None:
        """Follows the log from here on; something must have been submitted before."""
        reader = self.spark.readStream.schema(RECORD + ", segment STRING").option("maxFilesPerTrigger", self.config.files_per_trigger())
        rows = with_content(reader.parquet(f"{self.base}/wal/segments"))
        opening, accepted, found = self._opening(), None, self.snapshots.load()
        if found is not None:
            positions, balances, accepted = found
            rows = rows.join(broadcast_if_small(positions), "partition", "left").where("last_wal_index IS NULL OR wal_index > last_wal_index")
            opening = balances.withColumnRenamed("balance_mem", "balance")
            opening, accepted = (d.withColumn("partition", self._partition(d)) for d in (opening, accepted))
        rows = rows.select(F.col("wal_index").alias("seq"), "tx_id", "user_id", "amount", "partition")
        dedup = Dedup("FIFO") if self.config.dedup_name() == "LRU" else Dedup()
        rows = streaming_journal(rows, self.processor, None, opening, accepted, dedup, "partition")
        self.query = start(rows, self._take, f"{self.base}/checkpoint", f"{self.config.heartbeat.total_seconds()} seconds")
        threading.Thread(target=self._beat, daemon=True).start()

    def _opening(self) -> DataFrame | None:
        return None if self.opening is None else self.opening.withColumn("partition", self._partition(self.opening))

    def _take(self, rows: DataFrame, i: int) -> None:
        with self._lock:
            at = f"{self.base}/journal/batch={i}"
            rows.write.mode("overwrite").parquet(at)
            rows = self.spark.read.schema(JOURNAL).parquet(at)
            self.writer(state.entities(rows), i)
            if self.trigger.due(rows.count()):
                self._snapshot()

    def _beat(self) -> None:
        while not self._stop.wait(self.config.heartbeat.total_seconds()):
            with self._lock:
                if not self._stop.is_set() and self.trigger.due(0):
                    self._snapshot()

    def journal(self) -> DataFrame:
        """All journal rows so far, with the ``batch`` they came in."""
        names = self.snapshots.log.names(f"{self.base}/journal")
        if not names:
            return self.spark.createDataFrame([], JOURNAL + ", batch BIGINT")
        return self.spark.read.schema(JOURNAL + ", batch BIGINT").option("basePath", f"{self.base}/journal").parquet(f"{self.base}/journal")

    def _snapshot(self) -> None:
        """Folds the journal behind the newest snapshot onto it; what came before isn't read."""
        found, manifest = self.snapshots.load(), self.snapshots.log.current()[1]
        tail = self.journal().where(F.col("batch") > manifest.get("batch", -1))
        last = tail.agg(F.max("batch")).head()[0]
        if last is None and found is not None:
            return self.trigger.committed()
        order = F.struct("batch", "seq")
        moved = tail.groupBy("user_id").agg(F.max_by("balance_after", order).alias("new"))
        ids = tail.where(F.col("status") == ACCEPTED).select("user_id", "tx_id")
        ends = tail.withColumn("partition", self._partition(tail)).groupBy("partition").agg(F.max("seq").alias("last_wal_index"))
        before = None if self.opening is None else self.opening.groupBy("user_id").agg(F.max("balance").alias("old"))
        if found is not None:
            before = found[1].withColumnRenamed("balance_mem", "old")
            ids = ids.unionByName(found[2])
            ends = ends.unionByName(found[0]).groupBy("partition").agg(F.max("last_wal_index").alias("last_wal_index"))
        if before is None:
            balances = moved.select("user_id", F.col("new").alias("balance_mem"))
        else:
            both = before.withColumnRenamed("user_id", "u").join(moved, F.col("u").eqNullSafe(F.col("user_id")), "full")
            balances = both.select(F.coalesce("u", "user_id").alias("user_id"), F.coalesce("new", "old", F.lit(0).cast("bigint")).alias("balance_mem"))
        self.snapshots.save(ends, balances, ids, batch=manifest.get("batch", -1) if last is None else last)
        self.trigger.committed()

    def shut_down(self) -> None:
        """Takes what has been submitted, stops, and takes a final snapshot."""
        self.query.processAllAvailable()
        self._stop.set()
        self.query.stop()
        with self._lock:
            self._snapshot()
