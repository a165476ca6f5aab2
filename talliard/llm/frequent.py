"""The most frequent values of a column in bounded memory (problem 3).

Each partition is reduced to a Misra-Gries summary of at most ``counters`` values: batches are counted exactly, added to
the summary, and when more counters remain than allowed, the largest one that has no place is subtracted from all and
those that reach zero go. Summaries merge by the same step: first into as many as there are shuffle partitions, then in a tree
of fan-in ``FAN``. A task holds a few times ``counters`` values at any moment, and the driver none. The decrement step loses at most (N - sum of counters) / (counters + 1) rows of any value;
hence every value with more rows than that is among the counters.

Defined results
  * Nulls aren't counted; '' and the text 'null' are values. Values are compared as strings, character by character.
  * ``at_least`` <= true count <= ``at_most`` for every value returned, and every value with at least support * N rows is
    returned (counters >= 1 / support is required). Ties at the border can't be lost: all tied values are kept or the
    bounds say otherwise.
  * An empty or all-null column gives no rows. Only the one column is read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talliard.workspace import materialize

#: Summaries merged by one task of the tree.
FAN = 64
_SCHEMA = "node BIGINT, value STRING, n BIGINT, total BIGINT"


def shrink(values: pa.Array, counts: np.ndarray, counters: int) -> tuple[pa.Array, np.ndarray]:
    """Adds up equal values; if more than ``counters`` remain, subtracts the next-largest count and drops what is spent."""
    coded = values.dictionary_encode()
    values = coded.dictionary
    sums = np.zeros(len(values), np.int64)
    np.add.at(sums, coded.indices.to_numpy(zero_copy_only=False), counts)
    if len(sums) > counters:
        sums = sums - np.partition(sums, len(sums) - counters - 1)[len(sums) - counters - 1]
        keep = np.flatnonzero(sums > 0)
        values, sums = values.take(pa.array(keep)), sums[keep]
    return values, sums


def _merge(batches, counters: int, raw: bool):
    """One summary of a task's input: raw values, or summaries of one level below. The row without a value has the total."""
    total, values, counts = 0, [], []
    held = 0
    for b in batches:
        if raw:
            seen = pc.value_counts(b.column(0).drop_null())
            v, n = seen.field("values"), seen.field("counts").to_numpy()
            total += int(n.sum())
        else:
            b = b.filter(pc.is_valid(b.column("value"))), b
            total += pc.sum(b[1].column("total")).as_py() or 0
            v, n = b[0].column("value"), b[0].column("n").to_numpy()
        values.append(v.cast(pa.string()))
        counts.append(n)
        held += len(n)
        if held > 16 * counters:
            v, n = shrink(pa.concat_arrays(values), np.concatenate(counts), counters)
            values, counts, held = [v], [n], len(n)
    node = TaskContext.get().partitionId()
    v, n = shrink(pa.concat_arrays(values), np.concatenate(counts), counters) if values else (pa.array([], pa.string()), np.empty(0, np.int64))
    size = len(v) + 1
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(size, node)),
            pa.concat_arrays([v, pa.array([None], pa.string())]),
            pa.array(np.append(n, 0)),
            pa.array(np.append(np.zeros(len(v), np.int64), total)),
        ],
        ["node", "value", "n", "total"],
    )


def summary(df: DataFrame, column: str, counters: int) -> DataFrame:
    """(value, n, total): at most ``counters`` values with their counts, and a row without a value that has the number of
    non-null rows."""
    values = df.select(F.col(column).cast("string").alias("value"))
    level = values.mapInArrow(lambda it: _merge(it, counters, True), _SCHEMA)
    # A task merges any number of summaries in the memory of a few; the tree is there to keep the merging parallel.
    nodes = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        level = level.repartition(nodes, F.pmod("node", F.lit(nodes))).mapInArrow(lambda it: _merge(it, counters, False), _SCHEMA)
        if nodes == 1:
            break
        nodes = math.ceil(nodes / FAN)
    return level.select("value", "n", "total")


def frequent_items(df: DataFrame, column: str, support: float, counters: int) -> DataFrame:
    """(value, at_least, at_most, n_rows) of every value that may hold at least ``support`` of the non-null rows."""
    if not 0 < support <= 1 or counters * support < 1:
        raise ValueError("support must be in (0, 1] and counters at least 1 / support")
    found = materialize(summary(df, column, counters), "frequent")
    total, held = found.agg(F.sum("total"), F.sum("n")).head()
    lost = ((total or 0) - (held or 0)) // (counters + 1)
    return (
        found.where("value IS NOT NULL")
        .select("value", F.col("n").alias("at_least"), (F.col("n") + lost).alias("at_most"), F.lit(total or 0).cast("bigint").alias("n_rows"))
        .where(F.col("at_most") >= support * F.col("n_rows"))
    )


def exact_counts(df: DataFrame, column: str, items: DataFrame) -> DataFrame:
    """``items`` with ``n``, the exact count of each; the summary's bound on their number is what allows the broadcast."""
    rows = df.select(F.col(column).cast("string").alias("value"))
    counts = rows.join(F.broadcast(items.select("value")), "value", "left_semi").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return items.join(F.broadcast(counts), "value")
