"""Consecutive numbers in a given order, without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talliard.workspace import broadcast_if_small, materialize


def number(df: DataFrame, groups: list[str], order: list[str], name: str, first: int = 0, stored: bool = False) -> DataFrame:
    """df with ``name``: first, first + 1, ... within each combination of ``groups``, in the order of ``order`` (which must be
    unique in it). Rows are cut into ranges of the order over all groups and sorted there by group and order, so that a row's
    place in its range is its place in the group but for where the group begins; what is counted per range and group, at
    most ranges x groups of them, gives each part its start. A group with a third of all rows is spread over as many ranges as
    any other rows. Cutting looks at the input twice, so it is written first unless it is ``stored``, i.e. cheap to read again."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    source = df if stored else materialize(df, "unnumbered")
    ranged = source.repartitionByRange(n, *order).sortWithinPartitions(*groups, *order).withColumn("__t_place", F.monotonically_increasing_id())
    ranged = materialize(ranged, "ranges").withColumn("__t_range", F.shiftright("__t_place", 33))
    keys = [F.coalesce(F.col(g).cast("string"), F.lit("")).alias(f"__t_g{i}") for i, g in enumerate(groups)]
    nulls = [F.col(g).isNull().alias(f"__t_n{i}") for i, g in enumerate(groups)]
    names = [f"__t_{k}{i}" for i in range(len(groups)) for k in "gn"]
    ranged = ranged.select("*", *keys, *nulls)
    counts = ranged.groupBy("__t_range", *names).agg(F.count(F.lit(1)).alias("__t_count"), F.min("__t_place").alias("__t_begin"))
    before = Window.partitionBy(*names).orderBy("__t_range").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("__t_count").over(before), F.lit(0)) - F.col("__t_begin") + first
    starts = materialize(counts.select("__t_range", *names, start.alias("__t_start")), "starts")
    out = ranged.join(broadcast_if_small(starts), ["__t_range", *names])
    return out.select(*df.columns, (F.col("__t_start") + F.col("__t_place")).cast("bigint").alias(name))
