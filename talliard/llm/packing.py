"""Documents in containers of fixed capacity (problem 6), by shortest-pack-first over the length histogram.

Only the histogram of lengths, at most ``capacity`` + 1 numbers whatever the corpus, comes to the driver. There, lengths are
placed longest first; each goes into the open packs with most room left, and packs are counted, not listed: a pattern is a
combination of lengths with the number of packs that have it. When no open pack has room, new ones are opened, and the
copies of the length at hand fill them in turn (the next copy would find its own new pack the emptiest). Patterns get
consecutive container numbers, and every document finds its place by its rank among the documents of its length.

Ranks are taken in salted parts of about ``PART_ROWS`` documents of one length each, so a length that a third of all
documents have is no hot group.

Defined results
  * A document larger than a container, and no other, is split: full containers of its own, and the rest is packed.
  * A document without tokens (null or '' text too) takes no room: these are dealt round to the containers in turn, behind
    the other items; if nothing else exists there is one container.
  * Every row of the input is placed, repeated rows and rows with a null id too; among equals the choice doesn't matter.
  * An empty table gives no rows. Columns other than id and size aren't read.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talliard.workspace import materialize

CAPACITY = 4096
#: Documents of one length that are ranked in one group.
PART_ROWS = 1 << 20


def pack_histogram(sizes: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (packs, [(length, copies), ...]) that hold sizes[length] items of every length from 1 to capacity."""
    open_: dict[int, list[tuple[int, tuple]]] = defaultdict(list)  # by room left: (packs, items as a linked list)
    for length in sorted((n for n in sizes if n > 0), reverse=True):
        left = sizes[length]
        rooms = [-r for r in open_ if r >= length]
        heapq.heapify(rooms)
        while left and rooms:
            room = -heapq.heappop(rooms)
            if room not in open_:
                continue
            left = _fill(open_, room, length, left)
            if room - length >= length:  # a pack that got a copy comes up again, with less room
                heapq.heappush(rooms, length - room)
        if left:
            fit = capacity // length
            if left >= fit:
                open_[capacity - fit * length].append((left // fit, (length, fit, None)))
            if left % fit:
                open_[capacity - left % fit * length].append((1, (length, left % fit, None)))
    patterns: dict[tuple, int] = defaultdict(int)
    for packs in open_.values():
        for n, items in packs:
            copies: dict[int, int] = defaultdict(int)
            while items:
                copies[items[0]] += items[1]
                items = items[2]
            patterns[tuple(sorted(copies.items(), reverse=True))] += n
    return [(n, list(p)) for p, n in sorted(patterns.items(), reverse=True)]


def _fill(open_: dict, room: int, length: int, left: int) -> int:
    """One copy into each pack with this room, as long as copies are left; how many remain."""
    packs, rest = open_.pop(room, []), []
    for n, items in packs:
        put = min(n, left)
        left -= put
        if put:
            more = (length, items[1] + 1, items[2]) if items[0] == length else (length, 1, items)
            open_[room - length].append((put, more))
        if n > put:
            rest.append((n - put, items))
    if rest:
        open_[room].extend(rest)
    return left


class Places:
    """Where the item of a length and a rank goes. Its size depends on the patterns, not on the number of documents."""

    def __init__(self, patterns: list[tuple[int, list[tuple[int, int]]]]):
        base, slots = 0, defaultdict(list)
        self.bases, self.items, seen = [], [], defaultdict(int)
        for n, items in patterns:
            self.bases.append(base)
            self.items.append(sum(k for _, k in items))
            at = 0
            for length, k in items:
                slots[length].append((seen[length], base, n, at))
                seen[length] += n * k
                at += k
            base += n
        self.containers = base
        self.slots = {k: np.array(v, np.int64) for k, v in slots.items()}
        self.bases, self.items = np.array(self.bases, np.int64), np.array(self.items, np.int64)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        container, position = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        order = np.argsort(length, kind="stable")
        kinds, begin = np.unique(length[order], return_index=True)
        for kind, rows in zip(kinds, np.split(order, begin[1:])):
            r = rank[rows]
            if kind == 0:
                if self.containers:
                    container[rows] = r % self.containers
                    first = self.items[np.searchsorted(self.bases, container[rows], "right") - 1]
                    position[rows] = first + r // self.containers
                else:
                    position[rows] = r
                continue
            s = self.slots[int(kind)]
            s = s[np.searchsorted(s[:, 0], r, "right") - 1]
            container[rows] = s[:, 1] + (r - s[:, 0]) % s[:, 2]
            position[rows] = s[:, 3] + (r - s[:, 0]) // s[:, 2]
        return container, position


def pack(docs: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, n_tokens, token_start, container, position): each document, or each piece of a larger one."""
    whole = F.floor(F.col("s") / capacity).cast("bigint")
    n_pieces = F.greatest(F.ceil(F.col("s") / capacity), F.lit(1)).cast("bigint")
    items = (
        docs.select(F.col(key).alias("k"), F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias("s"))
        .select("k", "s", F.explode(F.sequence(F.lit(0).cast("bigint"), n_pieces - 1)).alias("piece"))
        .select("k", "piece", F.when(F.col("piece") < whole, F.lit(capacity)).otherwise(F.col("s") % capacity).cast("int").alias("length"))
    )
    sizes = {r[0]: r[1] for r in items.groupBy("length").count().collect()}  # at most capacity + 1 rows
    places = Places(pack_histogram(sizes, capacity))
    parts = docs.sparkSession.createDataFrame(
        [(n, math.ceil(c / PART_ROWS)) for n, c in sizes.items()], "length INT, parts INT"
    )
    salted = items.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64("k", "piece"), F.col("parts")))
    count = salted.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = count.select("length", "part", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy("k", "piece")) - 1
    ranked = salted.withColumn("r", rank).join(offsets, ["length", "part"])

    @F.arrow_udf("container bigint, position bigint")
    def place(length: pa.Array, r: pa.Array) -> pa.Array:
        c, p = places.find(length.to_numpy(), r.to_numpy())
        return pa.StructArray.from_arrays([pa.array(c), pa.array(p)], ["container", "position"])

    placed = ranked.withColumn("at", place("length", F.col("r") + F.col("before")))
    placed = placed.select(
        F.col("k").alias(key),
        F.col("piece").cast("int").alias("piece"),
        F.col("length").alias("n_tokens"),
        (F.col("piece") * capacity).alias("token_start"),
        "at.container",
        "at.position",
    )
    return materialize(placed, "packing")


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: items, containers, tokens, the least number of containers any packing needs, and the share of space used."""
    return packed.agg(
        F.count(F.lit(1)).alias("n_items"),
        (F.coalesce(F.max("container"), F.lit(-1)) + 1).alias("n_containers"),
        F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"),
    ).select(
        "*",
        F.ceil(F.col("n_tokens") / capacity).alias("least_containers"),
        F.when(F.col("n_containers") > 0, F.col("n_tokens") / (F.col("n_containers") * capacity)).alias("used"),
    )
