"""Mixing sources to target weights (problem 7), by pivotal dependent rounding.

The mixture is as large as all documents of the listed sources together. A source with T target tokens and A tokens at hand
needs each document T / A times on average, but no more often than a document may be used. Each document is used the whole
part of that number of times, and once more with the remaining probability p. These p are rounded by pairs: probability moves
from one document of a pair to the other, in inverse proportion to their sizes, so that their expected tokens together stay
what they were, until one of the two is certain; which way is drawn so that neither's expectation changes. Every partition does
so by halving rounds over whole batches, leaves at most one undecided document per source, and those meet in a tree of fan-in
``FAN``. The last one is drawn by its own probability.

That draw misses the target by a part of one document, which matters if the document is large. Hence documents are rounded in
bands of size relative to their source's target, largest first, and what a band has missed is asked of the smaller documents
that are still undecided: their T / A is computed anew from what the larger ones left. The last band holds documents of at
most ``FINE`` of the target, so a source that has enough of them misses its target by no more than that share. Larger ones are
few, unless a target is tiny beside its source: up to ``FEW`` of them are rounded source by source, doubling of size by doubling
of size, each source in one task; more go band by band through the tree.

Draws are hashes of the seed and the pair's ids, documents are placed and sorted by content first, and every level is written
before it is read: the same documents give the same mixture, and a task that runs again after a loss can't decide differently.

Defined results
  * Source names agree without case and surrounding blanks; the output has the spelling of the target table. Documents of
    no listed source, or without a source, take no part.
  * Targets that agree in name are one target: shares add up, the smallest max_uses holds. A null or negative share counts as
    0, a null max_uses as 1. Null names are ignored.
  * A source is short if every one of its documents is used as often as allowed and its target isn't reached.
  * A document without tokens is used as often as its source's whole part demands. Repeated rows are documents of their own.
  * Empty tables give an empty mixture, and a report with a row for each target.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talliard.workspace import broadcast_if_small, materialize

#: Undecided documents that meet in one task of the tree come from so many tasks.
FAN = 64
#: Largest documents of the last band, as a share of their source's target, and the ratio of one band to the next.
FINE, STEP, BANDS = 0.004, 16, 4
#: Documents above the last band that are rounded at a time without the tree: some tens of MB.
FEW = 500_000
_SCHEMA = "doc_id BIGINT, source STRING, tokens BIGINT, copies INT, p DOUBLE, node BIGINT"


def source_name(c: Column | str) -> Column:
    """The form in which source names are compared."""
    return F.lower(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"^\s+|\s+$", ""))


def _draw(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) for each pair of ids: the finalizer of a published 64-bit mixing function, twice."""
    with np.errstate(over="ignore"):
        x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(seed & (2**64 - 1))
        for other in (b.astype(np.uint64), np.uint64(0)):
            x = (x ^ other) + np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def pivot(ids: np.ndarray, sizes: np.ndarray, p: np.ndarray, seed: int) -> np.ndarray:
    """p rounded by pairs until at most one is neither 0 nor 1. Sizes must be positive. The sum of size * p stays."""
    p, live, level = p.astype(float), np.flatnonzero((p > 0) & (p < 1)), 0
    while len(live) > 1:
        half = len(live) // 2
        i, j = live[:half], live[half : 2 * half]
        si, sj, pi, pj = sizes[i], sizes[j], p[i], p[j]
        up_i, up_j = (1 - pi) * si, pj * sj  # tokens that may move to i: until i is 1 or j is 0
        dn_i, dn_j = pi * si, (1 - pj) * sj  # and to j
        a, b = np.minimum(up_i, up_j), np.minimum(dn_i, dn_j)
        up = _draw(ids[i], ids[j], seed + level) * (a + b) < b
        p[i] = np.where(up, np.where(up_i <= up_j, 1.0, pi + a / si), np.where(dn_i <= dn_j, 0.0, pi - b / si))
        p[j] = np.where(up, np.where(up_j <= up_i, 0.0, pj - a / sj), np.where(dn_j <= dn_i, 1.0, pj + b / sj))
        p[live] = np.clip(p[live], 0.0, 1.0)
        live = live[(p[live] > 0) & (p[live] < 1)]
        level += 1
    return p


def _round(batches, seed: int, final: bool):
    """Decides the documents of a task, sorted by source, but one per source; copies grow by the outcome. Undecided rows have a
    p."""
    rest: dict[str, tuple] = {}  # of the source at hand
    node = TaskContext.get().partitionId()

    def batch(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
        n = len(rows["doc_id"])
        open_ = (rows["p"] > 0) & (rows["p"] < 1)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(rows["doc_id"], pa.int64(), mask=rows["null"]),
                pa.array(rows["source"], pa.string()),
                pa.array(rows["tokens"], pa.int64()),
                pa.array(rows["copies"] + (rows["p"] == 1), pa.int32()),
                pa.array(rows["p"], pa.float64(), mask=~open_),
                pa.array(np.full(n, node), pa.int64()),
            ],
            ["doc_id", "source", "tokens", "copies", "p", "node"],
        )

    names = ("doc_id", "null", "source", "tokens", "copies", "p")
    def leave() -> pa.RecordBatch:
        own = {c: np.array([r[m] for r in rest.values()], object if c == "source" else None) for m, c in enumerate(names)}
        if final:
            zero = np.zeros(len(own["p"]), np.int64)
            own["p"] = (_draw(own["doc_id"], zero, seed - 1) < own["p"]).astype(float)
        rest.clear()
        return batch(own)

    for b in batches:
        ids = b.column("doc_id")
        rows = {
            "doc_id": ids.fill_null(0).to_numpy(),
            "null": np.asarray(ids.is_null()),
            "source": np.array(b.column("source").to_pylist(), object),
            "tokens": b.column("tokens").to_numpy(),
            "copies": b.column("copies").to_numpy(),
            "p": b.column("p").to_numpy().copy(),
        }
        of, inverse = np.unique(rows["source"].astype(str), return_inverse=True)
        for k, source in enumerate(of):
            if rest and source not in rest:
                yield leave()
            at = np.flatnonzero(inverse == k)
            own = {c: rows[c][at] for c in names}
            if source in rest:
                own = {c: np.concatenate([np.asarray([rest[source][m]], own[c].dtype), own[c]]) for m, c in enumerate(names)}
                del rest[source]
            own["p"] = pivot(own["doc_id"], own["tokens"].astype(float), own["p"], seed)
            left = np.flatnonzero((own["p"] > 0) & (own["p"] < 1))
            if len(left):
                rest[source] = tuple(own[c][left[0]] for c in names)
                own = {c: np.delete(own[c], left[0]) for c in names}
            yield batch(own)
    if rest:
        yield leave()


def _targets(targets: DataFrame) -> DataFrame:
    """(name, source, target_share, max_uses), one row per name."""
    share = F.greatest(F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)), F.lit(0.0))
    return targets.where("source IS NOT NULL").groupBy(source_name("source").alias("name")).agg(
        F.min("source").alias("source"),
        F.sum(share).alias("target_share"),
        F.greatest(F.min(F.coalesce(F.col("max_uses").cast("int"), F.lit(1))), F.lit(0)).alias("max_uses"),
    )


def _large(rows: pa.Table, seed: int) -> pa.Table:
    """A source's documents above the last band with their copies, the largest first."""
    ids, tokens = rows["doc_id"].fill_null(0).to_numpy(), rows["tokens"].to_numpy()
    target, most, smaller = (rows[c][0].as_py() for c in ("target", "max_uses", "smaller"))
    order = np.lexsort((ids, -tokens))
    rows, ids, tokens = rows.take(pa.array(order)), ids[order], tokens[order]
    copies, kind = np.zeros(len(ids)), np.floor(np.log2(tokens)).astype(int)
    got, left = 0.0, float(tokens.sum() + smaller)
    for k in np.unique(kind)[::-1]:
        at = np.flatnonzero(kind == k)
        each = min(max((target - got) / left, 0.0), float(most))
        p = pivot(ids[at], tokens[at].astype(float), np.full(len(at), each - math.floor(each)), seed + 64 * int(k))
        open_ = (p > 0) & (p < 1)
        p[open_] = _draw(ids[at][open_], np.zeros(open_.sum(), np.int64), seed - 1 - int(k)) < p[open_]
        copies[at] = math.floor(each) + p
        got += float((tokens[at] * copies[at]).sum())
        left -= float(tokens[at].sum())
    return rows.select(["doc_id", "source", "tokens"]).append_column("copies", pa.array(copies.astype(np.int32)))


def _rounded(open_: DataFrame, seed: int) -> list[DataFrame]:
    """(doc_id, source, tokens, copies) of documents with 0 < p < 1, decided through the tree."""
    spark = open_.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    nodes, level, done = tasks, 0, []
    order = ["source", "doc_id", "tokens", "p"]
    # A placement by content, so that the same documents give the same mixture however the files lie.
    placed = open_.repartition(tasks, "doc_id", "tokens")
    while True:
        shift, last = seed + 64 * level, nodes == 1
        out = placed.sortWithinPartitions(*order).select("doc_id", "source", "tokens", "copies", "p")
        out = materialize(out.mapInArrow(lambda it, s=shift, f=last: _round(it, s, f), _SCHEMA), f"mix-level{level}")
        done.append(out.where("p IS NULL").select("doc_id", "source", "tokens", "copies"))
        if last:
            return done
        # The sources' residuals meet apart from each other, so that no task gets those of all sources.
        placed = out.where("p IS NOT NULL").repartition(tasks, "source", F.floor(F.col("node") / FAN ** (level + 1)))
        nodes, level = math.ceil(nodes / FAN), level + 1


def mix(docs: DataFrame, targets: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(mixture, report). ``docs``: doc_id, source, tokens; ``targets``: source, target_share, max_uses.
    The mixture is (doc_id, source, tokens, copies), copies >= 1; the report has a row for each target: source, target_share,
    max_uses, n_docs, tokens at hand, target_tokens, reached_tokens, share of the intended and of the actual mixture,
    most_copies, and whether the source is short."""
    wanted = materialize(_targets(targets), "mix-targets")
    rows = docs.select("doc_id", source_name("source").alias("name"), F.coalesce(F.col("tokens").cast("bigint"), F.lit(0)).alias("tokens"))
    rows = rows.join(broadcast_if_small(wanted), "name").select("doc_id", "source", "tokens")
    rows = materialize(rows, "mix-input")
    size = rows.agg(F.coalesce(F.sum("tokens"), F.lit(0))).head()[0]
    plan = wanted.select("source", "target_share", "max_uses", (F.col("target_share") * float(size)).alias("target"))
    steps = F.floor(F.log(F.col("tokens") / (FINE * F.col("target"))) / math.log(STEP)).cast("int") + 1
    band = F.when((F.col("tokens") > 0) & (F.col("target") > 0), F.greatest(F.least(steps, F.lit(BANDS - 1)), F.lit(0))).otherwise(0)
    rows = rows.join(broadcast_if_small(plan), "source").withColumn("band", band)
    held = materialize(rows.groupBy("source", "band").agg(F.sum("tokens").alias("at_hand"), F.count(F.lit(1)).alias("n")), "mix-held")
    counts = dict(map(tuple, held.groupBy("band").agg(F.sum("n")).collect()))  # at most BANDS rows
    done: list[DataFrame] = []
    if 0 < sum(n for b, n in counts.items() if b) <= FEW:
        smaller = held.where("band = 0").select("source", F.col("at_hand").alias("smaller"))
        large = rows.where("band > 0").select("doc_id", "source", "tokens").join(broadcast_if_small(plan.join(smaller, "source", "left")), "source")
        large = large.select("doc_id", "source", "tokens", "target", "max_uses", F.coalesce("smaller", F.lit(0)).alias("smaller"))
        shift = seed * 1_000_003 + 104_729
        large = large.groupBy("source").applyInArrow(lambda t: _large(t, shift), "doc_id BIGINT, source STRING, tokens BIGINT, copies INT")
        done.append(materialize(large, "mix-large"))
        counts = {b: n for b, n in counts.items() if b == 0}
    for b in sorted(counts, reverse=True):
        # What the larger documents left, over the tokens of this band and the smaller ones.
        left = held.where(F.col("band") <= b).groupBy("source").agg(F.sum("at_hand").alias("at_hand"))
        had = None
        for d in done:
            had = d if had is None else had.unionByName(d)
        if had is not None:
            had = had.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("got"))
            left = left.join(had, "source", "left")
        got = F.coalesce("got", F.lit(0)) if had is not None else F.lit(0)
        each = plan.join(left, "source").select(
            "source",
            F.least(
                F.greatest(F.when(F.col("at_hand") > 0, (F.col("target") - got) / F.col("at_hand")).otherwise(0.0), F.lit(0.0)),
                F.col("max_uses").cast("double"),
            ).alias("each"),
        )
        each = broadcast_if_small(materialize(each, "mix-each"))
        now = rows.where(F.col("band") == b).select("doc_id", "source", "tokens").join(each, "source")
        whole = F.floor("each").cast("int")
        now = now.select("doc_id", "source", "tokens", whole.alias("copies"), (F.col("each") - whole).alias("p"))
        settled = (F.col("p") <= 0) | (F.col("tokens") <= 0)
        done.append(now.where(settled).select("doc_id", "source", "tokens", "copies"))
        done += _rounded(now.where(~settled), seed * 1_000_003 + 7_919 * b)
    everything = docs.sparkSession.createDataFrame([], "doc_id BIGINT, source STRING, tokens BIGINT, copies INT")
    for d in done:
        everything = everything.unionByName(d)
    return everything.where("copies > 0"), _report(everything, plan, size)


def _report(everything: DataFrame, plan: DataFrame, size: int) -> DataFrame:
    reached = everything.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("at_hand"), F.sum(F.col("tokens") * F.col("copies")).alias("got"),
        F.min("copies").alias("least"), F.max("copies").alias("most"),
    )
    zero = lambda c, kind="bigint": F.coalesce(F.col(c), F.lit(0)).cast(kind)
    rows = materialize(plan.join(reached, "source", "left"), "mix-reached")
    total = rows.agg(F.coalesce(F.sum("got"), F.lit(0))).head()[0]
    share = lambda of: (zero("got") / F.lit(float(of)) if of else F.lit(0.0)).cast("double")
    full = F.coalesce(F.col("least") >= F.col("max_uses"), F.lit(True))
    return rows.select(
        "source", "target_share", "max_uses", zero("n").alias("n_docs"), zero("at_hand").alias("tokens"), F.col("target").alias("target_tokens"),
        zero("got").alias("reached_tokens"), share(size).alias("reached_share"), share(total).alias("share_of_mixture"),
        zero("most", "int").alias("most_copies"), (full & (zero("got") < F.col("target"))).alias("short"),
    )
