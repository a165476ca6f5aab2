"""The ordered, keyed, conditional fold of a command log: one journal row for every command.

In the order of ``seq``, a command whose identifier was accepted before is a DUPLICATE; a debit that would leave the balance
below zero is REJECTED and its identifier is *not* remembered, so a later copy is judged afresh; everything else is ACCEPTED.
Credits, amounts of 0 and debits down to exactly zero are always accepted, even if the balance stays negative.

Skipping one debit changes every later decision of its account, so the fold isn't an associative aggregate. It runs as one
shuffle by scope, a sort, and a pass that carries the state across Arrow batches; only identifiers that occur more than once
in their scope are remembered, which a window over the same exchange finds beforehand. Accounts without any rejection need no
pass at all: if no debit leaves the running sum of first copies below zero, that sum *is* the balance. ``fast=True`` takes
them out in Spark's own expressions, which is also the way for an account that holds a large part of the log.

Defined results
  * A null identifier, amount or seq makes a command INVALID (4001); it changes nothing. A null user is an account like any other.
  * ``seq`` should be unique; among equals the order is that of identifier, then amount.
  * A processor that returns None accepts the command and its identifier, leaves the balance and sends nothing to the sink
    (``has_entity`` false). Any error but Reject makes the command an ERROR, changes nothing, and the log goes on.
  * A command's ``partition`` outside its scope's routing isn't judged here (see ``misrouted``).
  * Sums beyond a bigint raise. An empty log gives an empty journal. Further columns aren't read.
"""

from __future__ import annotations

import hashlib
import math
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talliard.codes import ACCEPTED, DUPLICATE, ERROR, INVALID, MISROUTED, REJECTED, STATUS_CODE
from talliard.functions.money import to_db

SHORT_OF_FUNDS = "INSUFFICIENT_BALANCE"
JOURNAL = (
    "seq BIGINT, tx_id STRING, user_id BIGINT, amount BIGINT, status STRING, code INT, reason STRING, "
    "balance_before BIGINT, balance_after BIGINT, has_entity BOOLEAN"
)
NAMES = [c.split()[0] for c in JOURNAL.split(", ")]


@dataclass(frozen=True)
class Dedup:
    """How accepted identifiers are remembered: EXACT; FIFO, the last ``size`` of a scope; BLOOM, a filter made for ``size``
    identifiers whose false positives refuse new commands at the rate ``fpp``; NONE."""

    kind: str = "EXACT"
    size: int = 500_000
    fpp: float = 1e-5

    def memory(self):
        return {"EXACT": _Exact, "FIFO": _Fifo, "BLOOM": _Bloom, "NONE": _Nothing}[self.kind](self)


class _Exact(set):
    def __init__(self, _: Dedup):
        super().__init__()


class _Nothing(_Exact):
    def add(self, _: str) -> None:
        pass


class _Fifo:
    def __init__(self, of: Dedup):
        self.size, self.held = of.size, OrderedDict()

    def __contains__(self, tx: str) -> bool:
        return tx in self.held

    def add(self, tx: str) -> None:
        self.held[tx] = None
        if len(self.held) > self.size:
            self.held.popitem(last=False)


class _Bloom:
    def __init__(self, of: Dedup, empty: bool = True):
        self.bits = max(64, math.ceil(-of.size * math.log(of.fpp) / math.log(2) ** 2))
        self.probes = max(1, round(self.bits / of.size * math.log(2)))
        self.held = bytearray(self.bits // 8 + 1) if empty else None

    def _places(self, tx: str):
        d = hashlib.blake2b(tx.encode(), digest_size=16).digest()
        a, b = int.from_bytes(d[:8], "little"), int.from_bytes(d[8:], "little") | 1
        return [(a + i * b) % self.bits for i in range(self.probes)]

    def __contains__(self, tx: str) -> bool:
        return all(self.held[p >> 3] >> (p & 7) & 1 for p in self._places(tx))

    def add(self, tx: str) -> None:
        for p in self._places(tx):
            self.held[p >> 3] |= 1 << (p & 7)


class Reject(Exception):
    """Raised by a processor to refuse a command; the text becomes the journal's reason."""


@dataclass(frozen=True)
class Outcome:
    """What a processor may return instead of the new balance: ``own`` is the account's further state, any JSON value, which
    it gets back with the next command; ``entity``: whether the sink gets the balance."""

    balance: int
    own: object = None
    entity: bool = True


#: (balance, amount, user, tx) -> the new balance, an Outcome or None. A processor with a true attribute ``keeps_state`` gets
#: the account's own state as a fifth argument, None at first.
Processor = Callable[..., "int | Outcome | None"]


def wallet(balance: int, amount: int, user: int | None, tx: str) -> int:
    """The standard processor: the new balance, or Reject."""
    if amount < 0 and balance + amount < 0:
        raise Reject(SHORT_OF_FUNDS)
    return balance + amount


class Scope:
    """The state of one scope while its commands are taken in order; batch and stream decide by it. ``by_user``: it stands for
    many scopes, one for each user; the memory then gets identifiers with the user before them."""

    def __init__(self, memory, processor: Processor, by_user: bool = False):
        self.seen, self.processor, self.standard, self.by_user = memory, processor, processor is wallet, by_user
        self.keeps = getattr(processor, "keeps_state", False)
        self.balances: dict = {}
        self.own: dict = {}

    def take(self, tx: str | None, user: int | None, amount: int | None, valid: bool, many: bool) -> tuple:
        """(status, reason, balance before, balance after, whether there is an entity) of the next command. ``many``: whether
        its identifier can come again."""
        before = self.balances.get(user, 0)
        if not valid:
            return INVALID, None, before, before, False
        known = identifier(user, tx) if self.by_user else tx
        if many and known in self.seen:
            return DUPLICATE, None, before, before, False
        after, entity = before, True
        if self.standard:
            after = before + amount
            if amount < 0 and after < 0:
                return REJECTED, SHORT_OF_FUNDS, before, before, False
        else:
            try:
                given = (before, amount, user, tx, self.own.get(user)) if self.keeps else (before, amount, user, tx)
                out = self.processor(*given)
                if isinstance(out, Outcome):
                    after, entity = _money(out.balance), out.entity
                    self.own[user] = out.own
                elif out is None:
                    entity = False
                else:
                    after = _money(out)
            except Reject as e:
                return REJECTED, str(e), before, before, False
            except Exception as e:  # one command's failure must not stop the log
                return ERROR, f"{type(e).__name__}: {e}", before, before, False
        self.balances[user] = after
        if many:
            self.seen.add(known)
        return ACCEPTED, None, before, after, entity


def identifier(user: int | str | None, tx: str) -> str:
    """An identifier with its user before it; a user, a number or null, has no colon."""
    return f"{user}:{tx}"


def _money(balance) -> int:
    """A processor's balance as units; what isn't one is the processor's error."""
    if isinstance(balance, bool) or int(balance) != balance or not -(2**63) <= balance < 2**63:
        raise ValueError(f"not a balance: {balance!r}")
    return int(balance)


def journal(
    commands: DataFrame,
    opening: DataFrame | None = None,
    dedup: Dedup = Dedup(),
    scope: str = "key",
    accepted: DataFrame | None = None,
    processor: Processor = wallet,
    fast: bool = False,
) -> DataFrame:
    """JOURNAL rows plus ``balance`` DECIMAL(19,4). ``opening``: (user_id, balance) to start from, 0 where absent; ``accepted``:
    (user_id, tx_id) accepted before. ``scope`` of identifiers and order: 'key' (the user), 'partition' (the column of that
    name, which all inputs then need), or 'engine' (everything, in one task). ``fast`` needs scope 'key', exact dedup and the
    standard processor."""
    if scope not in ("key", "partition", "engine"):
        raise ValueError(f"no such scope: {scope}")
    if dedup.kind == "BLOOM" and scope == "key":
        raise ValueError("a filter for every user would not be small; use scope 'partition' or 'engine'")
    group = {"key": ["user_id"], "partition": ["partition"], "engine": []}[scope]
    extra = [c for c in group if c != "user_id"]
    null = lambda kind: F.lit(None).cast(kind)
    rows = commands.select(F.lit(2).alias("kind"), "seq", "tx_id", "user_id", "amount", *extra)
    if opening is not None:
        start = opening.groupBy("user_id", *extra).agg(F.max("balance").alias("amount"))
        start = start.select(F.lit(0).alias("kind"), null("bigint").alias("seq"), null("string").alias("tx_id"), "user_id", "amount", *extra)
        rows = rows.unionByName(start)
    if accepted is not None:
        known = accepted.select(
            F.lit(1).alias("kind"), null("bigint").alias("seq"), "tx_id", "user_id", null("bigint").alias("amount"), *extra
        )
        rows = rows.unionByName(known)
    tasks = int(commands.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, *group) if group else rows.repartition(1)
    valid = "(kind < 2 OR (tx_id IS NOT NULL AND amount IS NOT NULL AND seq IS NOT NULL))"
    rows = rows.withColumn("valid", F.expr(valid))
    if dedup.kind == "EXACT":
        copies = Window.partitionBy(*(group or [F.lit(0)]), "tx_id")
        rows = rows.withColumn("many", (F.count(F.lit(1)).over(copies) > 1) & F.col("tx_id").isNotNull())
    else:
        rows = rows.withColumn("many", F.lit(True))
    order = ["kind", "seq", "tx_id", "amount"]
    if fast:
        if scope != "key" or dedup.kind != "EXACT" or processor is not wallet or accepted is not None:
            raise ValueError("fast needs scope 'key', exact dedup, the standard processor and no earlier identifiers")
        rows, quick = _without_rejections(rows, order)
    rows = rows.sortWithinPartitions(*group, *order)
    folded = rows.select(*dict.fromkeys(["kind", "seq", "tx_id", "user_id", "amount", "valid", "many", *group])).mapInArrow(
        _folder(group[0] if group else None, dedup, processor), JOURNAL
    )
    if fast:
        folded = folded.unionByName(quick)
    return folded.withColumn("balance", to_db("balance_after"))


def _without_rejections(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of users that need the fold, journal of the others). All windows sit on the exchange by user."""
    by_user, by_tx = Window.partitionBy("user_id"), Window.partitionBy("user_id", "tx_id")
    counts = (F.col("kind") == 2) & F.col("valid")
    nth = F.sum(counts.cast("int")).over(by_tx.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("first", counts & (nth == 1))
    part = F.when((F.col("kind") == 0) | F.col("first"), F.coalesce("amount", F.lit(0))).otherwise(0)
    running = F.sum(part).over(by_user.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("part", part).withColumn("after", running)
    bad = F.col("first") & (F.col("amount") < 0) & (F.col("after") < 0)
    rows = rows.withColumn("hurt", F.max(bad).over(by_user))
    status = F.when(~F.col("valid"), INVALID).when(F.col("first"), ACCEPTED).otherwise(DUPLICATE)
    code = F.when(~F.col("valid"), STATUS_CODE[INVALID]).when(F.col("first"), STATUS_CODE[ACCEPTED]).otherwise(STATUS_CODE[DUPLICATE])
    quick = rows.where("NOT hurt AND kind = 2").select(
        "seq", "tx_id", "user_id", "amount", status.alias("status"), code.cast("int").alias("code"),
        F.lit(None).cast("string").alias("reason"), (F.col("after") - F.col("part")).alias("balance_before"), F.col("after").alias("balance_after"),
        (F.col("valid") & F.col("first")).alias("has_entity"),
    )
    return rows.where("hurt"), quick


#: In the order of the codes that the pass counts them by.
_STATUSES = (ACCEPTED, REJECTED, DUPLICATE, INVALID, ERROR)


def plain(column: pa.Array) -> list:
    return column.to_numpy(zero_copy_only=False).tolist() if not column.null_count else column.to_pylist()


def answered(commands: list[pa.Array], out: list[tuple]) -> pa.RecordBatch:
    """JOURNAL rows of commands (seq, tx_id, user_id, amount) and what ``Scope.take`` said of each."""
    codes = {s: i for i, s in enumerate(_STATUSES)}
    texts, numbers = pa.array(_STATUSES, pa.string()), pa.array([STATUS_CODE.get(s) for s in _STATUSES], pa.int32())
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_())
    status, *rest = zip(*out) if out else [()] * 5
    code = pa.array([codes[s] for s in status], pa.int8())
    return pa.RecordBatch.from_arrays([*commands, texts.take(code), numbers.take(code), *map(pa.array, rest, kinds)], NAMES)


def _folder(group: str | None, dedup: Dedup, processor: Processor):
    def fold(batches):
        at, scope = object(), None
        for b in batches:
            columns = [plain(b.column(c)) for c in ("kind", "tx_id", "user_id", "amount", "valid", "many")]
            out = []
            for g, kind, tx, user, amount, valid, many in zip(plain(b.column(group)) if group else [None] * b.num_rows, *columns):
                if g != at:
                    at, scope = g, Scope(dedup.memory(), processor)
                if kind == 2:
                    out.append(scope.take(tx, user, amount, valid, many))
                elif kind == 0:
                    scope.balances[user] = amount or 0
                elif tx is not None and many:
                    scope.seen.add(tx)
            b = b.filter(pc.equal(b.column("kind"), 2))
            yield answered([b.column(c) for c in ("seq", "tx_id", "user_id", "amount")], out)

    return fold


def misrouted(commands: DataFrame, node: int) -> DataFrame:
    """Journal rows of commands (with ``node``) that belong to another node; they are refused before the fold."""
    return commands.where(F.col("node") != node).select(
        "seq", "tx_id", "user_id", "amount", F.lit(MISROUTED).alias("status"), F.lit(STATUS_CODE[MISROUTED]).alias("code")
    )
