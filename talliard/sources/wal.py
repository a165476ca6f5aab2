"""The write-ahead log as a table: append with positions, scans, pages.

A log is a folder with one sub-folder per log partition in every segment, and manifests that list the segments and the next
free position of each partition. A command is appended before it is processed, so the log also has the duplicates and the
rejected ones.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talliard.operators.numbering import number
from talliard.workspace import VersionLog, broadcast_if_small

RECORD = "wal_index BIGINT, seq BIGINT, tx_id STRING, user_id BIGINT, amount BIGINT, partition INT"


def with_content(records: DataFrame) -> DataFrame:
    """records without empty ones: no tx_id, user_id and amount."""
    return records.where("tx_id IS NOT NULL OR user_id IS NOT NULL OR amount IS NOT NULL")


def empty_records(records: DataFrame) -> DataFrame:
    """One row: how many records have no content."""
    return records.agg(F.count(F.when(F.expr("tx_id IS NULL AND user_id IS NULL AND amount IS NULL"), 1)).alias("n_empty"))


def indexed(commands: DataFrame, base: int = 0) -> DataFrame:
    """commands (with ``partition`` and ``seq``) with ``wal_index``, consecutive from ``base`` in each partition."""
    return number(commands, ["partition"], ["seq"], "wal_index", first=base)


class Wal:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.log = spark, path, VersionLog(spark, f"{path}/_versions")

    def append(self, commands: DataFrame) -> None:
        """Adds commands (seq, tx_id, user_id, amount, partition) in the order of seq; all of them become visible at once."""
        version, state = self.log.current()
        following = {int(k): v for k, v in state.get("next", {}).items()}
        rows = indexed(commands.select("seq", "tx_id", "user_id", "amount", "partition"))
        if following:
            starts = self.spark.createDataFrame(list(following.items()), "partition INT, start BIGINT")
            rows = rows.join(broadcast_if_small(starts), "partition", "left")
            rows = rows.withColumn("wal_index", F.col("wal_index") + F.coalesce("start", F.lit(0))).drop("start")
        name = f"segment={version + 1:010d}-{uuid.uuid4().hex[:8]}"
        at, staged = f"{self.path}/segments/{name}", f"{self.path}/staging/{name}"
        self._settle(state)
        rows.select("wal_index", "seq", "tx_id", "user_id", "amount", "partition").write.partitionBy("partition").parquet(staged)
        ends = self.spark.read.schema(RECORD).parquet(staged).groupBy("partition").agg(F.max("wal_index") + 1).collect()  # one per log
        self.log.publish(version + 1, {"segments": [*state.get("segments", []), at], "next": {**following, **dict(map(tuple, ends))}})
        self._settle(self.log.current()[1])

    def _settle(self, state: dict) -> None:
        """Moves the published last segment to where streams look for it; an append that died in between is completed here, and
        one that died before publishing never gets there."""
        for at in state.get("segments", [])[-1:]:
            final, staged = (self.log._fs.Path(at.replace("/segments/", f"/{k}/")) for k in ("segments", "staging"))
            fs = final.getFileSystem(self.log._conf)
            if not fs.exists(final) and fs.exists(staged):
                fs.mkdirs(final.getParent())
                fs.rename(staged, final)

    def exists(self) -> bool:
        return self.log.current()[0] > 0

    def scan(self, start: int | None = None, partition: int | None = None) -> DataFrame:
        """All records from position ``start`` on (inclusive); partition and position reach the files as filters."""
        state = self.log.current()[1]
        self._settle(state)
        segments = state.get("segments", [])
        if segments:
            reader = self.spark.read.schema(RECORD).option("basePath", f"{self.path}/segments")
            rows = reader.parquet(*segments).select(*self.spark.createDataFrame([], RECORD).columns)
        else:
            rows = self.spark.createDataFrame([], RECORD)
        if partition is not None:
            rows = rows.where(F.col("partition") == partition)
        return rows if start is None else rows.where(F.col("wal_index") >= start)


def cursor_of(index: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(index)))


def decode_cursor(text: str) -> int:
    """A position from '0x...', '#...' or decimal text, with an optional sign; anything else raises ValueError."""
    sign, body = (-1, text[1:]) if text[:1] == "-" else (1, text.removeprefix("+"))
    if body[:1] == "#":
        return sign * int(body[1:], 16)
    if body[:2] in ("0x", "0X"):
        return sign * int(body[2:], 16)
    if len(body) > 1 and body[0] == "0":
        return sign * int(body, 8)
    return sign * int(body)


def page(
    records: DataFrame, size: int, cursor: str | None = None, backward: bool = True, routing_key: str | None = None, tx_id: str | None = None
) -> DataFrame:
    """One row (records, next_cursor, prev_cursor, has_more, has_prev) of one log partition's records (wal_index, tx_id,
    user_id, amount).

    ``size`` counts matches; the page starts at the cursor, that record included, and reads towards newer ones or, backward,
    towards older ones, but always lists oldest first. The cursor for going on is there only if the page is full and another
    record, matching or not, follows. An unknown cursor gives an empty page without cursors. A record without any content
    (no tx_id, user_id, amount) is skipped. The page is a top-k: only size + 1 positions ever come together."""
    empty = records.sparkSession.createDataFrame(
        [([], None, None, False, False)],
        "records ARRAY<STRING>, next_cursor STRING, prev_cursor STRING, has_more BOOLEAN, has_prev BOOLEAN",
    )
    start = None if cursor is None else decode_cursor(cursor)
    if start is not None and records.where(F.col("wal_index") == start).isEmpty():
        return empty
    ahead = records
    if start is not None:
        ahead = records.where(F.col("wal_index") <= start if backward else F.col("wal_index") >= start)
    matches = with_content(ahead)
    if routing_key is not None:
        same = F.col("user_id").isNull() if routing_key == "null" else F.col("user_id").cast("string") == routing_key
        matches = matches.where(same)
    if tx_id is not None:
        matches = matches.where(F.col("tx_id") == tx_id)
    by = F.desc("wal_index") if backward else F.asc("wal_index")
    found = matches.orderBy(by).limit(size)
    json = F.to_json(F.struct("tx_id", "amount", "user_id"))
    listed = F.sort_array(F.collect_list(F.struct("wal_index", json.alias("j"))))
    last = F.min("wal_index") if backward else F.max("wal_index")
    one = found.agg(F.transform(listed, lambda r: r["j"]).alias("records"), last.alias("last"))
    edge, n = one.select("last", F.size("records")).head()
    follows = None
    if n == size and edge is not None:
        beyond = ahead.where(F.col("wal_index") < edge if backward else F.col("wal_index") > edge)
        follows = beyond.agg(F.max("wal_index") if backward else F.min("wal_index")).head()[0]
    on = F.lit(None).cast("string") if follows is None else cursor_of(F.lit(follows).cast("bigint"))
    back = F.lit(None).cast("string") if start is None else cursor_of(F.lit(start).cast("bigint"))
    ahead_, behind = F.lit(follows is not None), F.lit(start is not None)
    return one.select(
        "records",
        (back if backward else on).alias("next_cursor"),
        (on if backward else back).alias("prev_cursor"),
        (behind if backward else ahead_).alias("has_more"),
        (ahead_ if backward else behind).alias("has_prev"),
    )


def page_of(log: Wal, partition: int, size: int, **options) -> DataFrame:
    """``page`` of a stored log; a log that doesn't exist raises FileNotFoundError."""
    if not log.exists():
        raise FileNotFoundError(f"there is no log at {log.path}")
    return page(log.scan(partition=partition), size, **options)


def view(records: DataFrame) -> DataFrame:
    """Every record as text beside its position, as a viewer lists them."""
    return records.select("partition", "wal_index", F.to_json(F.struct("tx_id", "amount", "user_id")).alias("record"))
