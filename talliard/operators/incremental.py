"""Runs that take up only what was added or changed since the last successful one (problem 2).

A run fixes the upper end of the commit sequence when it starts and reads the log above the last watermark only, up to that
end. It takes up the positions that are new or changed there, writes its output to a folder of its own, and publishes output
and watermark together by one atomic rename. A run that dies before the rename leaves the old watermark and no visible
output, so the next run takes up the same positions; one that dies after it has committed both. Two runs that overlap can't
both publish.

What a position held before is in a state table beside the watermark: for each position that a run has met its newest row,
in files sorted by position. A run reads those files into whose range a chunk of its new rows falls, and adds a segment;
segments merge as they come to be of like length. Nothing else of the past is read.

The first run may start from a log of earlier runs instead (``marks``). Then the rows that came after those runs, or lie
beyond their ends, are taken first, and older rows are looked up for their positions only. What such a run didn't meet isn't
in the state; a later run that meets a position below a mark for the first time looks it up in the log, and only it.

Defined results
  * A position is (partition, position); its newest row (largest sequence value) is the valid one. Rows that lack
    partition, position or sequence are no log positions and are not taken up.
  * Contents are compared null-safely: null equals null, null and '' differ. Rows tied in sequence count in the order
    of their contents, so the result never depends on the order of reading.
  * The first run may start from a log of earlier runs (``last_successful``). Partitions without a successful run, and
    marks without a start time, count everything as new; a mark without a position has no such lower end.
  * An empty log gives an empty output and commits nothing but the attempt.
"""

from __future__ import annotations

import bisect
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talliard.operators.bitmaps import Bits
from talliard.workspace import VersionLog, broadcast_if_small, materialize

#: Positions are looked up by chunks of 2**20 consecutive ones.
CHUNK_BITS = 20
#: Rows in a file of the state: some MB.
FILE_ROWS = 1 << 18


def last_successful(runs: DataFrame) -> DataFrame:
    """(partition_id, mark, began) of each partition's successful run (outcome 'SAVED', finished) that finished last;
    runs that finished at the same time are ordered by run_id. Lines logged twice don't matter."""
    good = runs.where("outcome = 'SAVED' AND finished_at IS NOT NULL AND partition_id IS NOT NULL")
    last = F.max(F.struct("finished_at", "run_id", "last_wal_index", "started_at")).alias("r")
    return good.groupBy("partition_id").agg(last).select(
        "partition_id", F.col("r.last_wal_index").alias("mark"), F.col("r.started_at").alias("began")
    )


class IncrementalJob:
    """A repeated job over a growing log; its watermark, state and outputs are below ``path``. ``position``: the columns of a log
    position, the last one a bigint that grows along the log."""

    def __init__(self, spark: SparkSession, path: str, position: list[str], sequence: str, content: list[str], received: str):
        self.spark, self.path = spark, path
        self.position, self.sequence, self.content, self.received = position, sequence, content, received
        self.log = VersionLog(spark, f"{path}/_versions")

    def watermark(self) -> int | None:
        """The largest sequence value that a successful run has covered."""
        return self.log.current()[1].get("upper")

    def run(self, log: DataFrame, process: Callable[[DataFrame], DataFrame] | None = None, marks: DataFrame | None = None) -> DataFrame:
        """Processes what is due and returns the committed output. ``process`` maps the due positions to the output;
        ``marks`` (as of ``last_successful``) stand for the watermark before the first run. After that run only rows above the
        watermark need to be in ``log``, but for the positions below a mark."""
        number, state = self.log.current()
        lower, first = state.get("upper"), state.get("upper") is None
        for c in (*self.position, self.sequence):
            log = log.where(F.col(c).isNotNull())
        fresh = log if first else log.where(F.col(self.sequence) > F.lit(lower))
        upper = fresh.agg(F.max(self.sequence)).head()[0]
        at = f"{self.path}/runs/{number + 1:010d}-{uuid.uuid4().hex[:8]}"
        fresh = fresh.where(F.col(self.sequence) <= F.lit(upper))
        if first and marks is not None:
            marks = marks.select(F.col(marks.columns[0]).alias(self.position[0]), F.col("mark").cast("bigint"), F.col("began").cast("timestamp"))
            marks.write.parquet(f"{at}-marks")
            state = state | {"marks": f"{at}-marks"}
            met = self._since_marks(fresh, self._marks(state))
        elif first:
            met = self._newest(fresh).withColumn("due", F.lit(True))
        else:
            met = self._since(fresh, log.where(F.col(self.sequence) <= F.lit(lower)), state)
        met = materialize(met, "met")
        due = met.where("due").select(*self.position, self._flat("s", self.sequence), *[self._flat(f"c{i}", c) for i, c in enumerate(self.content)])
        out = due if process is None else process(due)
        out.write.parquet(f"{at}-output")
        committed = {"upper": lower if upper is None else upper, "outputs": state.get("outputs", []) + [f"{at}-output"]}
        committed["state"] = self._remembered(met, state.get("state", []), f"{at}-state")
        self.log.publish(number + 1, committed | ({"marks": state["marks"]} if "marks" in state else {}))
        return self.spark.read.schema(out.schema).parquet(f"{at}-output")

    def outputs(self, schema) -> DataFrame:
        """All committed outputs together."""
        paths = self.log.current()[1].get("outputs", [])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # ---- what is due

    def _row(self) -> Column:
        return F.struct(F.col(self.sequence).cast("bigint").alias("s"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(self.content)])

    def _newest(self, rows: DataFrame) -> DataFrame:
        """(position, row) of each position's newest row. Partially aggregated: a position delivered any number of times is
        no hot key."""
        return rows.groupBy(*self.position).agg(F.max(self._row()).alias("row"))

    def _flat(self, field: str, name: str) -> Column:
        return F.col(f"row.{field}").alias(name)

    def _changed(self, new: str, old: str) -> Column:
        same = F.lit(True)
        for i in range(len(self.content)):
            same &= F.col(f"{new}.c{i}").eqNullSafe(F.col(f"{old}.c{i}"))
        return F.col(old).isNull() | ~same

    def _marks(self, state: dict) -> DataFrame:
        stored = self.spark.read.parquet(state["marks"])
        return broadcast_if_small(stored)

    def _marked(self, rows: DataFrame, marks: DataFrame) -> DataFrame:
        """rows with ``__t_seen``: there at the last run; ``__t_beyond``: past its end."""
        return rows.join(marks, self.position[0], "left").select(
            *rows.columns,
            F.coalesce(F.col(self.received) <= F.col("began"), F.lit(False)).alias("__t_seen"),
            F.coalesce(F.col(self.position[-1]) > F.col("mark"), F.lit(False)).alias("__t_beyond"),
        )

    def _since_marks(self, log: DataFrame, marks: DataFrame) -> DataFrame:
        """(position, row, due): rows that came after the last run or lie beyond its end name the candidates; what a candidate
        held at that run is looked up among the older rows, which stay where they are."""
        rows = self._marked(log.select(*dict.fromkeys([*self.position, self.sequence, *self.content, self.received])), marks)
        fresh = rows.where("NOT __t_seen OR __t_beyond").groupBy(*self.position).agg(
            F.max(self._row()).alias("row"), F.max("__t_beyond").alias("beyond")
        )
        fresh = materialize(fresh, "candidates")
        return fresh.where("beyond").select(*self.position, "row", F.lit(True).alias("due")).unionByName(
            self._compared(fresh.where("NOT beyond"), rows.where("__t_seen AND NOT __t_beyond"))
        )

    def _compared(self, fresh: DataFrame, older: DataFrame) -> DataFrame:
        """(position, row, due) of fresh positions against the rows they had before."""
        known = Bits(fresh, F.col(self.position[-1]), self.position[:-1], "positions")
        had = self._newest(known.inside(older, F.col(self.position[-1]))).withColumnRenamed("row", "old")
        both = fresh.join(had, self.position, "left").withColumn("row", F.greatest("row", "old"))
        return both.select(*self.position, "row", self._changed("row", "old").alias("due"))

    def _since(self, fresh: DataFrame, log: DataFrame, state: dict) -> DataFrame:
        """(position, row, due): the newest rows above the watermark against the state."""
        columns = [*self.position, "row"]
        new = materialize(self._newest(fresh), "fresh")
        paths = self._files(new, state.get("state", []))
        held = self.spark.read.schema(self._kinds(new)).parquet(*paths) if paths else new.select(columns).limit(0)
        known = Bits(new, F.col(self.position[-1]), self.position[:-1], "positions")
        held = known.inside(held, F.col(self.position[-1])).groupBy(*self.position).agg(F.max("row").alias("old"))
        both, found = new.join(held, self.position, "left"), []
        if "marks" in state:  # what the first run left out
            both = materialize(both.join(self._marks(state), self.position[0], "left"), "known")
            early = F.col("mark").isNull() | (F.col(self.position[-1]) <= F.col("mark"))
            left_out = F.col("old").isNull() & F.col("began").isNotNull() & early
            asked = both.where(left_out).select(columns)
            if not asked.isEmpty():
                found.append(self._compared(asked, log))
            both = both.where(~left_out)
        met = both.select(*columns, self._changed("row", "old").alias("due"))
        for f in found:
            met = met.unionByName(f)
        return met

    # ---- the state: segments of files sorted by position, with each file's first and last position in the manifest

    def _kinds(self, df: DataFrame) -> str:
        kinds = {f.name: f.dataType.simpleString() for f in df.schema}
        return ", ".join(f"`{c}` {kinds[c]}" for c in [*self.position, "row"])

    def _files(self, new: DataFrame, segments: list[dict]) -> list[str]:
        """Paths of the state's files that may hold a position of ``new``, by chunks of consecutive positions."""
        if not segments:
            return []
        chunk = F.shiftright(self.position[-1], CHUNK_BITS).alias("c")
        asked = sorted(tuple(r) for r in new.select(*self.position[:-1], chunk).distinct().collect())  # chunks, not positions
        firsts = [(*c[:-1], c[-1] << CHUNK_BITS) for c in asked]
        lasts = [(*c[:-1], (c[-1] + 1 << CHUNK_BITS) - 1) for c in asked]
        paths = []
        for f in (f for s in segments for f in s["files"]):
            at = bisect.bisect_left(lasts, tuple(f["first"]))  # the first chunk that ends at or behind the file's begin
            if at < len(asked) and firsts[at] <= tuple(f["last"]):
                paths.append(f["path"])
        return paths

    def _segment(self, rows: DataFrame, n: int, at: str) -> dict:
        """Writes stored ``rows`` as a segment."""
        order = self.position
        sorted_ = rows.select(*order, "row").repartitionByRange(max(1, -(-n // FILE_ROWS)), *order).sortWithinPartitions(*order)
        sorted_.write.option("compression", "zstd").parquet(at)
        stored = self.spark.read.schema(self._kinds(rows)).parquet(at)
        ends = stored.groupBy(F.input_file_name().alias("p")).agg(F.min(F.struct(*order)).alias("a"), F.max(F.struct(*order)).alias("b"))
        return {"rows": n, "files": [{"path": r["p"], "first": list(r["a"]), "last": list(r["b"])} for r in ends.collect()]}

    def _remembered(self, met: DataFrame, segments: list[dict], at: str) -> list[dict]:
        """segments with one more for ``met``; it takes in older ones that aren't at least twice as long, so that there are
        few segments and a row is rewritten a logarithmic number of times."""
        rows, n, kept = met.select(*self.position, "row"), met.count(), list(segments)
        if not n:
            return kept
        merge = []
        while kept and kept[-1]["rows"] < 2 * (n + sum(s["rows"] for s in merge)):
            merge.append(kept.pop())
        if merge:
            older = self.spark.read.schema(self._kinds(met)).parquet(*[f["path"] for s in merge for f in s["files"]])
            rows = rows.unionByName(older).groupBy(*self.position).agg(F.max("row").alias("row"))
            rows = materialize(rows, "merged-state")
            n = rows.count()
        return [*kept, self._segment(rows, n, at)]
