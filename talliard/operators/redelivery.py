"""Exactly one copy of each message from an at-least-once log (problem 1).

``MessageStore`` keeps the surviving messages in historical partitions (a period of time each) beside an identifier
index of (64-bit hash of the identifier, the partitions it came in). An ingest

1. meets the index with the incoming identifiers, bucket by bucket, which names the affected partitions,
2. combines those partitions' copies with the incoming ones and recomputes a single winner per identifier: the copy
   with the smallest order value,
3. writes new files for the incoming survivors and for those affected partitions that lose a row or hold a repeat of an
   incoming row, and for no others,
4. publishes the new list of files by one atomic rename.

Readers see the old or the new version, never a mixture; an ingest that dies before step 4 has no effect.

Defined results
  * null and '' are no identifiers: every such message is kept.
  * Identifiers are compared character by character, without trimming or case folding.
  * Rows that agree in identifier and order value are repeats of one row: one of them stays (the one whose other
    columns hash lowest), whether they come in one ingest or in several, and the log of removed rows doesn't name that
    order value. A delivery that was not kept is named once, however often it comes.
  * ``order`` must differ between deliveries of different identifiers. A message with an identifier but without an
    order value can't be ranked: it is set aside, whole, in ``unranked()`` and takes no part in the choice.
  * A null timestamp goes to the partition 'none'.
  * Empty input publishes a version without rows. Other columns pass through unchanged, whatever their names; names
    that start with ``__t_`` are refused, because the operator uses them.

Scale: what is shuffled is the partially aggregated hashes of the incoming identifiers (an identifier that holds a third of
all rows sends one row per task), once, into the buckets of the index; and the narrow rows of identifiers that came more
than once, whose losers are found by an anti-join on the unique order value, so that no key is hot. Full rows stay in their
tasks: losers are packed into bits by order value, and only if those outgrow what may be broadcast do rows move, in chunks
of consecutive order values. Index segments of like length merge, so there are few, and a row is rewritten a logarithmic
number of times.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from talliard.operators.bitmaps import Bits, Hashes
from talliard.sources.tables import is_id
from talliard.workspace import Bucketed, VersionLog, materialize, spread

#: The index: how often a hash came, and the first and last partition (as a number) and whether the one without a time.
INDEX = "h BIGINT, n BIGINT, first BIGINT, last BIGINT, timeless BOOLEAN"


class MessageStore:
    """Messages without repeats, below ``path``. ``key``: the identifier; ``order``: a bigint, unique per delivery, whose
    smallest value wins; ``time``: the timestamp that places a message in a historical partition of ``period``
    (any unit of date_trunc)."""

    def __init__(self, spark: SparkSession, path: str, key: str, order: str, time: str, period: str = "day"):
        self.spark, self.path, self.key, self.order, self.time, self.period = spark, path, key, order, time, period
        self.log = VersionLog(spark, f"{path}/_versions")

    def _partition(self) -> Column:
        return F.coalesce(F.date_format(F.date_trunc(self.period, self.time), "yyyy-MM-dd-HH"), F.lit("none"))

    def _state(self) -> dict:
        return {"parts": {}, "index": [], "removed": [], "unranked": [], "schema": None} | self.log.current()[1]

    def _paths(self, state: dict, parts) -> list[str]:
        return [f"{self.path}/{p}" for part in parts for p in state["parts"].get(part, [])]

    def _read(self, paths: list[str], ddl) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet(*paths)

    def messages(self) -> DataFrame:
        """The surviving messages of the newest version."""
        state = self._state()
        if not state["schema"]:
            raise ValueError("nothing was ingested yet")
        return self._read(self._paths(state, state["parts"]), _schema(state["schema"]))

    def removed(self) -> DataFrame:
        """(order, key) of every delivery that was not kept, over all ingests."""
        state = self._state()
        if not state["schema"]:
            raise ValueError("nothing was ingested yet")
        kinds = _schema(state["schema"])
        return self._read([f"{self.path}/{p}" for p in state["removed"]], _pick(kinds, [self.order, self.key])).distinct()

    def unranked(self) -> DataFrame:
        """Messages with an identifier but a null order value, as they came."""
        state = self._state()
        if not state["schema"]:
            raise ValueError("nothing was ingested yet")
        return self._read([f"{self.path}/{p}" for p in state["unranked"]], _schema(state["schema"]))

    def ingest(self, incoming: DataFrame) -> None:
        """Adds deliveries and publishes the result; see the module's text."""
        if bad := [c for c in incoming.columns if c.startswith("__t_")]:
            raise ValueError(f"reserved column names: {bad}")
        number = self.log.current()[0] + 1
        state = self._state()
        segment = f"v{number:010d}-{uuid.uuid4().hex[:8]}"
        key, order = F.col(self.key), F.col(self.order)
        lame = is_id(key) & order.isNull()
        unranked = state["unranked"]
        if not incoming.where(lame).isEmpty():
            incoming.where(lame).write.parquet(f"{self.path}/unranked/{segment}")
            unranked = unranked + [f"unranked/{segment}"]
        flat = incoming.where(~lame).withColumn("__t_part", self._partition())
        with Bucketed(self.spark) as tables:
            index, suspects, affected = self._index(flat, state["index"], segment, tables)
        removed, hurt, tied = state["removed"], [], None
        rows = flat
        if (n := suspects.count()) > 0:
            suspects = Hashes(suspects, "h", n)
            lost, tied, hurt = self._decide(flat, self._paths(state, affected), suspects, f"{self.path}/removed/{segment}")
            removed = removed + [f"removed/{segment}"]
            if hurt:
                old = self._read(self._paths(state, hurt), incoming.schema)
                rows = rows.unionByName(old.withColumn("__t_part", self._partition()))
            rows = self._survivors(rows, Bits(lost, order, name="lost"), tied)
        spread(rows).write.partitionBy("__t_part").option("compression", "zstd").parquet(f"{self.path}/data/{segment}")
        parts = {p: v for p, v in state["parts"].items() if p not in hurt}
        for p, at in self._written(f"data/{segment}").items():
            parts[p] = parts.get(p, []) + [at]
        self.log.publish(
            number, {"parts": parts, "index": index, "removed": removed, "unranked": unranked, "schema": incoming.schema.json()}
        )

    def vacuum(self) -> int:
        """Deletes what the newest version doesn't name: files of rewritten partitions, and what failed ingests left. For
        quiet times only: older readers and a running ingest lose their files. Returns how many folders went."""
        state = self._state()
        live = {p for paths in state["parts"].values() for p in paths}
        live |= {*(s["at"] for s in state["index"]), *state["removed"], *state["unranked"]}
        gone = 0
        for kind in ("data", "index", "removed", "unranked"):
            for segment in self._folders(kind):
                inner = [f"{segment}/{n}" for n in self.log.names(f"{self.path}/{segment}")] if kind == "data" else [segment]
                for dead in (p for p in inner if p not in live):
                    self.log.delete(f"{self.path}/{dead}")
                    gone += 1
        return gone

    def _folders(self, kind: str) -> list[str]:
        return [f"{kind}/{n}" for n in self.log.names(f"{self.path}/{kind}")]

    def _index(self, flat: DataFrame, segments: list[dict], segment: str, tables: Bucketed) -> tuple[list[dict], DataFrame, list[str]]:
        """(the index with a segment for the incoming rows, hashes that came more than once, partitions that may hold a copy)."""
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        ordinal = F.when(F.col("__t_part") != "none", F.replace("__t_part", F.lit("-"), F.lit("")).cast("bigint"))
        came = flat.where(is_id(F.col(self.key))).select(F.xxhash64(self.key).alias("h"), ordinal.alias("o"))
        came = came.groupBy("h").agg(
            F.count(F.lit(1)).alias("n"), F.min("o").alias("first"), F.max("o").alias("last"), F.max(F.col("o").isNull()).alias("timeless")
        )
        at = f"index/{segment}"
        came = tables.save(came, "h", f"{self.path}/{at}", buckets)
        again = came.where("n > 1").select("h")
        held = None
        for s in segments:
            found = tables.open(INDEX, "h", f"{self.path}/{s['at']}", s["buckets"]).join(came.select("h"), "h", "left_semi")
            held = found if held is None else held.unionByName(found)
        affected: list[str] = []
        if held is not None:
            held = materialize(held, "held")
            affected = self._affected(held)
            again = again.unionByName(held.select("h"))
        again = materialize(again.distinct(), "suspects")
        n, kept, merge = came.count(), list(segments), []
        while kept and kept[-1]["rows"] < 2 * (n + sum(s["rows"] for s in merge)):
            merge.append(kept.pop())
        if merge:
            rows = came
            for s in merge:
                rows = rows.unionByName(tables.open(INDEX, "h", f"{self.path}/{s['at']}", s["buckets"]))
            rows = rows.groupBy("h").agg(*[f(c).alias(c) for f, c in ((F.sum, "n"), (F.min, "first"), (F.max, "last"), (F.max, "timeless"))])
            at = f"index/{segment}-merged"
            n = tables.save(rows, "h", f"{self.path}/{at}", buckets).count()
        return [*kept, {"at": at, "rows": n, "buckets": buckets}], again, affected

    def _affected(self, held: DataFrame) -> list[str]:
        """Stored partitions between the first and the last one of any entry; what comes here is at most a number per partition."""
        opened = dict(map(tuple, held.where("first IS NOT NULL").groupBy("first").count().collect()))
        closed = dict(map(tuple, held.where("last IS NOT NULL").groupBy("last").count().collect()))
        names = {int(p.replace("-", "")): p for p in self._state()["parts"] if p != "none"}
        found, open_ = [], 0
        for o in sorted({*names, *opened, *closed}):
            open_ += opened.get(o, 0)
            if open_ and o in names:
                found.append(names[o])
            open_ -= closed.get(o, 0)
        return found + ["none"] * (not held.where("timeless").isEmpty())

    def _decide(self, flat: DataFrame, stored: list[str], suspects: Hashes, at: str) -> tuple[DataFrame, DataFrame | None, list[str]]:
        """Writes the removed rows to ``at``. (order and key of the losers, order values that several copies of one row have,
        stored partitions that lose a row)."""
        key, order = F.col(self.key), F.col(self.order)
        new = flat.where(is_id(key)).select(self.key, order.alias("__t_rank"), F.lit(None).cast("string").alias("__t_old"))
        both = suspects.thin(new, F.xxhash64(self.key))
        if stored:
            held = self._read(stored, _pick(flat.schema, [self.key, self.order, self.time])).where(is_id(key))
            held = held.select(self.key, order.alias("__t_rank"), self._partition().alias("__t_old"))
            both = both.unionByName(suspects.thin(held, F.xxhash64(self.key)))
        both = materialize(both, "suspected")
        copies = both.groupBy(self.key, "__t_rank").agg(F.count(F.lit(1)).alias("n"))
        winners = materialize(both.groupBy(self.key).agg(F.min("__t_rank").alias("__t_rank")), "winners").select("__t_rank")
        losers = both.select(self.key, "__t_rank").join(winners, "__t_rank", "left_anti")
        losers.distinct().select(F.col("__t_rank").alias(self.order), self.key).write.parquet(at)
        lost = self.spark.read.schema(_pick(flat.schema, [self.order, self.key])).parquet(at)
        tied = materialize(copies.where("n > 1").select("__t_rank").join(winners, "__t_rank", "left_semi"), "tied")
        tied = None if tied.isEmpty() else tied
        touched = lost.select(order.alias("__t_rank"))
        touched = touched if tied is None else touched.unionByName(tied)
        hurt = both.where("__t_old IS NOT NULL").join(touched, "__t_rank", "left_semi").select("__t_old").distinct()
        return lost, tied, [r[0] for r in hurt.collect()]  # partition names: as many as the manifest lists

    def _survivors(self, rows: DataFrame, lost: Bits, tied: DataFrame | None) -> DataFrame:
        """rows without lost ones, and one of each repeated row."""
        names = rows.columns
        rank = F.when(is_id(F.col(self.key)), F.col(self.order))
        spread = F.xxhash64(*[c for c in names if c != "__t_part"])
        rows = lost.outside(rows, rank, spread)
        if tied is None:
            return rows
        rows = Bits(tied, F.col("__t_rank"), name="tied").split(rows, rank, spread)
        n = F.row_number().over(Window.partitionBy(self.order, self.key).orderBy("__t_spread"))
        repeated = rows.where("__t_in").withColumn("__t_spread", spread).withColumn("__t_n", n).where("__t_n = 1")
        return rows.where("NOT __t_in").select(names).unionByName(repeated.select(names))

    def _written(self, at: str) -> dict[str, str]:
        return {n.partition("=")[2]: f"{at}/{n}" for n in self.log.names(f"{self.path}/{at}") if "=" in n}


def _schema(text: str):
    return StructType.fromJson(json.loads(text))


def _pick(schema, names: list[str]):
    return StructType([schema[n] for n in dict.fromkeys(names)])
