"""The fold as a streaming query: the same decisions as ``operators.fold``, one micro-batch after the other.

Spark calls the processor once for each group of a micro-batch, and each look at the state is a message between Python and
Spark; an account by itself would cost more in calls than in work. So accounts come in ``BUCKETS`` groups by a hash of the
user (a number that checkpoints depend on), each account still a scope of its own; log partitions and the engine are groups
themselves. Inside a micro-batch commands are taken in the order of ``seq``; across batches the order of arrival holds, as in
the log. A group's rows of one micro-batch are held in memory, as Arrow columns.

State of a group, in the state store (RocksDB), committed with the query's offsets: balances, what processors keep, and the
accepted identifiers. Accounts and exact identifiers lie in hashed pages of about ``PER_PAGE`` (their number doubles as entries
come in), a filter in blocks, a bounded window as a whole; a micro-batch reads and writes only those that it needs, once. A
checkpoint of the earlier layout, by account, isn't continued: start without one, from balances and identifiers.

Numbers travel as text between Spark and Python, because a column with a null in it would come as floating point and lose
digits.

Defined results: as in ``operators.fold``; a command whose identifier is remembered for ``remember_ms`` only is a DUPLICATE
until that time has passed since its acceptance. The state drops such identifiers when it next meets their page.
"""

from __future__ import annotations

import json
import sys
import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from talliard.operators import fold
from talliard.operators.fold import JOURNAL, Dedup, Processor, Scope, answered, identifier, plain, wallet

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups that accounts come in; entries in a page of the state, on average at most; bytes in a block of a filter.
BUCKETS, PER_PAGE, BLOCK = 2048, 128, 1 << 14
#: Journal rows that are handed to Spark at a time.
ROWS = 1 << 14


class _Pages:
    """A dictionary with text keys and JSON values in hashed pages; a page is fetched when one of its keys is asked for."""

    def __init__(self, state, size):
        self.state, self.size = state, size
        self.level, self.n = map(int, size.get()) if size.exists() else (0, 0)
        self.kept = self.n > 0  # then all pages of the level are in the state
        self.pages: dict[int, dict] = {}
        self.changed: set[int] = set()

    def _number(self, key: str) -> int:
        return zlib.crc32(key.encode()) & ((1 << self.level) - 1)

    def _read(self, value) -> dict:
        return json.loads(bytes(value[0]))

    def _page(self, p: int) -> dict:
        if p not in self.pages:
            self.pages[p] = self._read(self.state.getValue((p,))) if self.kept else {}
        return self.pages[p]

    def get(self, key: str):
        return self._page(self._number(key)).get(key)

    def put(self, key: str, value) -> None:
        p = self._number(key)
        page = self._page(p)
        self.n += key not in page
        page[key] = value
        self.changed.add(p)

    def store(self) -> None:
        """Writes what has changed; the pages must be fetched again afterwards."""
        if not self.changed:
            return
        if self.n > PER_PAGE << self.level:
            self._store_more_pages()
        else:
            for p in sorted(self.changed):
                self._write(p, self.pages[p])
        self.size.update((self.level, self.n))
        self.kept, self.pages, self.changed = True, {}, set()

    def _write(self, p: int, page: dict) -> None:
        self.state.updateValue((p,), (json.dumps(page, ensure_ascii=False).encode(),))

    def _store_more_pages(self) -> None:
        """A large group's entries aren't held as pages twice: they are listed, and each new page is made when it is written."""
        old = self.pages
        if self.kept:
            old = {p[0]: self._read(v) for p, v in self.state.iterator()} | old
            self.state.clear()
        keys, values = [k for page in old.values() for k in page], [v for page in old.values() for v in page.values()]
        old = self.pages = {}
        self.n = len(keys)
        while self.n > PER_PAGE << self.level:
            self.level += 1
        self.level += 1
        numbers = np.fromiter(map(self._number, keys), np.int64, self.n)
        order = np.argsort(numbers)
        ends = np.searchsorted(numbers[order], np.arange((1 << self.level) + 1))
        for p in range(1 << self.level):
            self._write(p, {keys[i]: values[i] for i in order[ends[p] : ends[p + 1]].tolist()})


class _Exact(_Pages):
    """Accepted identifiers and when they were accepted."""

    def __init__(self, state, size, remember_ms: int | None, now: int):
        super().__init__(state, size)
        self.now, self.since = now, None if remember_ms is None else now - remember_ms

    def _read(self, value) -> dict[str, int]:
        page = super()._read(value)
        return page if self.since is None else {tx: at for tx, at in page.items() if at >= self.since}

    def __contains__(self, tx: str) -> bool:
        return tx in self._page(self._number(tx))

    def add(self, tx: str) -> None:
        self.put(tx, self.now)


class _Windows:
    """The last accepted identifiers of each scope, as a whole; ``by_user``: of each user."""

    def __init__(self, of: Dedup, state, by_user: bool):
        self.of, self.state, self.by_user = of, state, by_user
        self.held: dict = {}
        self.changed: set[str] = set()

    def _split(self, known: str) -> tuple[str, str]:
        user, _, tx = known.partition(":") if self.by_user else ("", "", known)
        return user, tx

    def _window(self, user: str):
        if user not in self.held:
            self.held[user] = self.of.memory()
            if self.state.containsKey((user,)):
                self.held[user].held.update(dict.fromkeys(self.state.getValue((user,))[0]))
        return self.held[user]

    def __contains__(self, known: str) -> bool:
        user, tx = self._split(known)
        return tx in self._window(user)

    def add(self, known: str) -> None:
        user, tx = self._split(known)
        self._window(user).add(tx)
        self.changed.add(user)

    def store(self) -> None:
        for user in sorted(self.changed):
            self.state.updateValue((user,), (list(self.held[user].held),))


class _Filter(fold._Bloom):
    """The membership filter by blocks, fetched when a bit of theirs is asked for."""

    def __init__(self, of: Dedup, state):
        super().__init__(of, empty=False)
        self.state, self.blocks, self.changed = state, {}, set()

    def _block(self, b: int) -> bytearray:
        if b not in self.blocks:
            self.blocks[b] = bytearray(self.state.getValue((b,))[0]) if self.state.containsKey((b,)) else bytearray(BLOCK)
        return self.blocks[b]

    def __contains__(self, tx: str) -> bool:
        return all(self._block(p >> 3 >> 14)[p >> 3 & BLOCK - 1] >> (p & 7) & 1 for p in self._places(tx))

    def add(self, tx: str) -> None:
        for p in self._places(tx):
            self._block(p >> 3 >> 14)[p >> 3 & BLOCK - 1] |= 1 << (p & 7)
            self.changed.add(p >> 3 >> 14)

    def store(self) -> None:
        for b in sorted(self.changed):
            self.state.updateValue((b,), (bytes(self.blocks[b]),))


class LedgerProcessor(StatefulProcessor):
    """``remember_ms``: exact identifiers are forgotten so long after they were accepted; None keeps them for good.
    ``by_user``: each user of a group is a scope."""

    def __init__(self, processor: Processor = wallet, remember_ms: int | None = None, dedup: Dedup = Dedup(), by_user: bool = True):
        self.processor, self.remember_ms, self.dedup, self.by_user = processor, remember_ms, dedup, by_user

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.accounts = handle.getMapState("accounts", "at INT", "page BINARY")
        self.users = handle.getValueState("users", "level INT, n BIGINT")
        kind = self.dedup.kind
        if kind == "EXACT":
            self.ids = handle.getMapState("ids", "at INT", "page BINARY")
            self.size = handle.getValueState("size", "level INT, n BIGINT")
        elif kind == "FIFO":
            self.ids = handle.getMapState("ids", "user STRING", "tx ARRAY<STRING>")
        elif kind == "BLOOM":
            self.ids = handle.getMapState("ids", "at INT", "bits BINARY")

    def _memory(self):
        now = int(time.time() * 1000)
        if self.dedup.kind == "EXACT":
            return _Exact(self.ids, self.size, self.remember_ms, now)
        if self.dedup.kind == "FIFO":
            return _Windows(self.dedup, self.ids, self.by_user)
        return _Filter(self.dedup, self.ids) if self.dedup.kind == "BLOOM" else self.dedup.memory()

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Rows (user, balance, tx): an opening balance, or an identifier accepted before."""
        memory, accounts = self._memory(), _Pages(self.accounts, self.users)
        for user, balance, tx in zip(*map(plain, _texts(initialState, "user", "balance", "tx"))):
            if tx is not None:
                memory.add(identifier(user, tx) if self.by_user else tx)
            elif balance is not None:
                accounts.put(str(user), [int(balance), None])
        accounts.store()
        if self.dedup.kind != "NONE":
            memory.store()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pa.concat_tables(_commands(frame) for frame in rows)
        order = [(c, "ascending") for c in ("seq", "tx_id", "amount")]
        batch = batch.take(pc.sort_indices(batch, sort_keys=order, null_placement="at_start"))
        scope, accounts = Scope(self._memory(), self.processor, self.by_user), _Pages(self.accounts, self.users)
        users = pc.unique(batch["user_id"]).to_pylist()
        for u in users:
            if (account := accounts.get(str(u))) is not None:
                scope.balances[u] = account[0]
                if account[1] is not None:
                    scope.own[u] = account[1]
        before = dict(scope.balances)
        for at in range(0, batch.num_rows, ROWS):
            part = [c.combine_chunks() for c in batch.slice(at, ROWS).columns]
            out = [
                scope.take(tx, user, amount, None not in (seq, tx, amount), True) for seq, tx, user, amount in zip(*map(plain, part))
            ]
            yield answered(part, out).to_pandas(types_mapper=pd.ArrowDtype)
        for u in users:
            if u in scope.balances and (scope.keeps or scope.balances[u] != before.get(u)):
                accounts.put(str(u), [scope.balances[u], scope.own.get(u)])
        accounts.store()
        if self.dedup.kind != "NONE":
            scope.seen.store()

    def close(self) -> None:
        pass


def _texts(frame: pd.DataFrame, *names: str) -> list[pa.Array]:
    """Text columns, with null for all that pandas takes for it."""
    return [pa.array(frame[n], pa.large_string(), from_pandas=True) for n in names]


def _commands(frame: pd.DataFrame) -> pa.Table:
    seq, tx, user, amount = _texts(frame, "seq", "tx_id", "user", "amount")
    return pa.table([seq.cast(pa.int64()), tx, user.cast(pa.int64()), amount.cast(pa.int64())], ["seq", "tx_id", "user_id", "amount"])


def streaming_journal(
    commands: DataFrame,
    processor: Processor = wallet,
    remember_ms: int | None = None,
    opening: DataFrame | None = None,
    accepted: DataFrame | None = None,
    dedup: Dedup = Dedup(),
    scope: str = "key",
) -> DataFrame:
    """The journal of a stream of commands (seq, tx_id, user_id, amount). ``opening``, ``accepted``, ``dedup`` and ``scope`` as in
    ``operators.fold.journal``; they take effect when the query starts without a checkpoint."""
    if dedup.kind == "BLOOM" and scope == "key":
        raise ValueError("a filter for every user would not be small; use scope 'partition' or 'engine'")
    commands.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    # Spark starts this processor once beside the driver, without the files sent to Python workers: send it by value.
    for module in {fold, sys.modules[__name__], sys.modules.get(getattr(processor, "__module__", None), fold)}:
        if module.__name__ != "__main__":
            cloudpickle.register_pickle_by_value(module)
    bucket = F.pmod(F.xxhash64(F.col("user_id").cast("string")), F.lit(BUCKETS)).cast("int")
    by = {"key": bucket, "partition": F.col("partition").cast("string"), "engine": F.lit("engine")}[scope]
    none = F.lit(None).cast("string")
    text = lambda c: F.col(c).cast("string")
    rows = commands.select(by.alias("scope"), text("seq").alias("seq"), "tx_id", text("user_id").alias("user"), text("amount").alias("amount"))
    start = None
    if opening is not None:
        same = ["partition"] if scope == "partition" else []
        start = opening.groupBy("user_id", *same).agg(F.max("balance").alias("balance"))
        start = start.select(by.alias("scope"), text("user_id").alias("user"), text("balance").alias("balance"), none.alias("tx"))
    if accepted is not None:
        known = accepted.where("tx_id IS NOT NULL").select(by.alias("scope"), text("user_id").alias("user"), none.alias("balance"), F.col("tx_id").alias("tx"))
        start = known if start is None else start.unionByName(known)
    return rows.groupBy("scope").transformWithStateInPandas(
        statefulProcessor=LedgerProcessor(processor, remember_ms, dedup, scope == "key"),
        outputStructType=JOURNAL,
        outputMode="append",
        timeMode="None",
        initialState=None if start is None else start.groupBy("scope"),
    )


def start(journal: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, heartbeat: str | None = None) -> StreamingQuery:
    """Starts the query. Without ``heartbeat`` it takes what is there and ends; with one it wakes at that interval.
    The sink isn't called while no data arrive."""
    writer = journal.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if heartbeat is None else writer.trigger(processingTime=heartbeat)).start()


def shut_down(query: StreamingQuery) -> None:
    """Drains what has arrived, then stops; takes no final snapshot."""
    query.processAllAvailable()
    query.stop()


class SnapshotTrigger:
    """For use inside a batch sink: whether a snapshot is due, by records since the last one or by time. ``committed`` must be
    called after a snapshot was published; a failed one doesn't move the clock."""

    def __init__(self, interval: int, seconds: float | None, now: Callable[[], float]):
        self.interval, self.seconds, self.now = interval, seconds, now
        self.count, self.last = 0, now()

    def due(self, records: int) -> bool:
        self.count += records
        return self.count >= self.interval or (self.seconds is not None and self.now() - self.last >= self.seconds)

    def committed(self) -> None:
        self.count, self.last = 0, self.now()


class Metrics(StreamingQueryListener):
    """The last progress of each query under names that start with ``prefix``."""

    def __init__(self, spark: SparkSession, prefix: str = "ledger"):
        self.prefix = prefix.rstrip(".") + "."
        self.values: dict[str, float] = {}
        spark.streams.addListener(self)

    def onQueryStarted(self, event) -> None:
        self.values[f"{self.prefix}started"] = self.values.get(f"{self.prefix}started", 0) + 1

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.values |= {
            f"{self.prefix}batch.id": p.batchId,
            f"{self.prefix}batch.rows": p.numInputRows,
            f"{self.prefix}batch.time": p.batchDuration,
        }

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.values[f"{self.prefix}ended"] = self.values.get(f"{self.prefix}ended", 0) + 1
