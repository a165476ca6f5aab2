"""Snapshots: position, balances and accepted identifiers of every log partition, published together; recovery from them.

Recovery folds the records *after* the snapshot's position onto its state, so that recovering equals folding the whole log.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talliard.codes import ACCEPTED
from talliard.operators.fold import journal
from talliard.operators.state import balances
from talliard.sources.wal import with_content
from talliard.workspace import VersionLog, broadcast_if_small, materialize

STATE, ACCEPTED_IDS, POSITIONS = "user_id BIGINT, balance_mem BIGINT", "user_id BIGINT, tx_id STRING", "partition INT, last_wal_index BIGINT"


class RecoveryError(Exception):
    """A snapshot that can't be read, or that doesn't fit the log."""


def _sums(parts) -> list[list]:
    """For each part its rows and a sum over hashes of all columns."""
    total = F.coalesce(F.sum(F.xxhash64(F.struct("*")).cast("decimal(28,0)")), F.lit(0)).cast("string")
    return [list(p.agg(F.count(F.lit(1)), total).head()) for p in parts]


class SnapshotStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.log = spark, path, VersionLog(spark, f"{path}/_versions")

    def save(self, positions: DataFrame, state: DataFrame, accepted: DataFrame, **notes) -> None:
        """Writes a new generation and makes it current by one rename, with ``notes`` in its manifest; a failed save leaves the
        old one in place."""
        version = self.log.current()[0] + 1
        at = f"{self.path}/g{version:010d}-{uuid.uuid4().hex[:8]}"
        positions.select("partition", "last_wal_index").write.parquet(f"{at}/positions")
        state.select("user_id", "balance_mem").write.parquet(f"{at}/state")
        accepted.select("user_id", "tx_id").write.parquet(f"{at}/accepted")
        saved = [self.spark.read.schema(s).parquet(f"{at}/{n}") for n, s in (("positions", POSITIONS), ("state", STATE), ("accepted", ACCEPTED_IDS))]
        self.log.publish(version, notes | {"at": at, "sums": _sums(saved)})

    def load(self, corrupt_is_cold: bool = False) -> tuple[DataFrame, DataFrame, DataFrame] | None:
        """(positions, state, accepted) of the newest snapshot, or None before the first. One that can't be read raises
        RecoveryError, unless it is to count as none."""
        at = self.log.current()[1].get("at")
        if at is None:
            return None
        try:
            found = tuple(
                self.spark.read.schema(s).parquet(f"{at}/{n}") for n, s in (("positions", POSITIONS), ("state", STATE), ("accepted", ACCEPTED_IDS))
            )
            # Every page is read: the manifest has a sum over all columns of each part.
            if _sums(found) != self.log.current()[1]["sums"]:
                raise RecoveryError(f"the snapshot at {at} isn't what was saved")
            return found
        except Exception as e:
            if corrupt_is_cold:
                return None
            raise RecoveryError(f"the snapshot at {at} can't be read") from e


def take(store: SnapshotStore, wal: DataFrame, opening: DataFrame | None = None) -> None:
    """Folds what the log (with partition, wal_index) has beyond the newest snapshot onto that snapshot, and saves the result.
    The first one folds the whole log onto ``opening``."""
    found = store.load()
    positions = wal.groupBy("partition").agg(F.max("wal_index").alias("last_wal_index"))
    rows, start, known = _replayed(wal, store, opening, None, "error")
    rows = materialize(rows, "journal")
    accepted = rows.where(F.col("status") == ACCEPTED).select("user_id", "tx_id")
    if found is not None:
        accepted = accepted.unionByName(known)
        positions = positions.unionByName(found[0]).groupBy("partition").agg(F.max("last_wal_index").alias("last_wal_index"))
    store.save(positions, balances(rows, start), accepted)


def recover(
    wal: DataFrame, store: SnapshotStore, opening: DataFrame | None = None, missing: str = "error", as_of: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(journal of the replayed records, state after them). Without a snapshot the whole log is folded onto ``opening``; if that
    state already contains a part of the log, ``as_of`` (partition, last_wal_index) says which, and only what follows is
    folded. A snapshot position that the log doesn't have raises RecoveryError; ``missing='replay_all'`` folds everything onto
    the snapshot instead, which may accept commands that were rejected when they came. Records without any content are
    skipped."""
    rows, start, _ = _replayed(wal, store, opening, as_of, missing)
    return rows, balances(rows, start)


def _replayed(wal: DataFrame, store: SnapshotStore, opening: DataFrame | None, as_of: DataFrame | None, missing: str):
    """(journal, the balances it starts from, the identifiers it starts from)."""
    wal, found = with_content(wal), store.load()
    if found is None:
        return journal(wal if as_of is None else _behind(wal, as_of), opening), opening, None
    positions, state, accepted = found
    start = state.withColumnRenamed("balance_mem", "balance")
    lost = positions.join(wal.select("partition", F.col("wal_index").alias("last_wal_index")), ["partition", "last_wal_index"], "left_anti")
    tail = _behind(wal, positions)
    if not lost.isEmpty():
        if missing != "replay_all":
            raise RecoveryError("the log has no record at the snapshot's position")
        tail = wal
    return journal(tail, start, accepted=accepted), start, accepted


def _behind(wal: DataFrame, positions: DataFrame) -> DataFrame:
    known = wal.join(broadcast_if_small(positions), "partition", "left")
    return known.where("last_wal_index IS NULL OR wal_index > last_wal_index").drop("last_wal_index")


def boundaries(wal: DataFrame, interval: int) -> DataFrame:
    """(partition, snapshot, wal_index): positions at which a snapshot by count is due, every ``interval`` records."""
    return wal.where((F.col("wal_index") + 1) % interval == 0).select(
        "partition", F.floor((F.col("wal_index") + 1) / interval).cast("bigint").alias("snapshot"), "wal_index"
    )


def dump(positions: DataFrame, state: DataFrame, buckets: int = 64) -> DataFrame:
    """Text of a snapshot: a row of positions for each partition, and the balances in ``buckets`` rows of JSON pairs, so that
    no row has to hold all of them."""
    head = positions.select(F.lit("position").alias("part"), F.to_json(F.struct("partition", "last_wal_index")).alias("json"))
    bucket = F.pmod(F.coalesce("user_id", F.lit(0)), F.lit(buckets))
    pairs = F.sort_array(F.collect_list(F.struct("user_id", "balance_mem")))
    body = state.groupBy(bucket.alias("b")).agg(F.to_json(pairs).alias("json")).select(F.lit("state").alias("part"), "json")
    return head.unionByName(body)


def dump_of(store: SnapshotStore, buckets: int = 64) -> DataFrame:
    """``dump`` of the newest snapshot; one row with the error if it can't be read, none before the first."""
    try:
        found = store.load()
    except RecoveryError as e:
        return store.spark.createDataFrame([("error", json.dumps({"error": str(e)}))], "part STRING, json STRING")
    return store.spark.createDataFrame([], "part STRING, json STRING") if found is None else dump(found[0], found[1], buckets)


def view(store: SnapshotStore, dedup: str = "EXACT") -> DataFrame:
    """What a viewer lists: (partition, last_wal_index, n_accounts, n_accepted, dedup) of the newest snapshot; accounts and
    identifiers are those of the whole snapshot."""
    found = store.load()
    if found is None:
        return store.spark.createDataFrame([], f"{POSITIONS}, n_accounts BIGINT, n_accepted BIGINT, dedup STRING")
    positions, state, accepted = found
    n = state.agg(F.count(F.lit(1)).alias("n_accounts")).join(accepted.agg(F.count(F.lit(1)).alias("n_accepted")))
    return positions.join(F.broadcast(n)).select("*", F.lit(dedup).alias("dedup"))
