"""Has this key been seen before? Filter, then verify (problem 4).

``SeenKeys`` keeps all earlier keys on disk, hashed into sorted buckets, beside a membership filter: one 64-bit word for
every four keys, in which each key sets up to six bits. Keys and filter are kept in segments, one for each admitted batch;
segments of like length merge, so there are few of them.

A probe takes a batch in the order of its order column. First occurrences are found by a partially aggregated minimum.
Their hashes meet the filters where they are: a filter of up to 48 MB (some 25 million keys) is sent to all executors, a larger
one meets the hashes, and only them, in a shuffle by chunk of the filter. A missing bit proves the key new, at once. Only the
others (the positives) are shuffled, to the bucket that has their key in full, which decides. Each positive that is disproved
there is logged; their share among all keys that are really new is the filter's measured rate of wrong answers.

Defined results
  * null and '' are no keys: such rows are never seen (``how`` 'no key').
  * Keys are compared character by character.
  * Rows that agree in key and order value are both first or both not. Order values must differ between different keys;
    a row with a null order value has no place in the order: its ``seen`` is null (``how`` 'no order').
  * An empty history or batch gives the natural result. Further columns of the batch aren't read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talliard.operators.bitmaps import Bits
from talliard.sources.tables import is_id
from talliard.workspace import Bucketed, VersionLog, materialize

#: Bits a key sets in its word, and keys per word on average: 16 bits a key.
PROBES, PER_WORD = 6, 4


def _mask(key: str) -> Column:
    """Up to PROBES bits of a 64-bit word, six bits of a second hash for each."""
    h = f"xxhash64(`{key}`, 'mask')"
    return F.expr(" | ".join(f"shiftleft(1L, cast(shiftrightunsigned({h}, {6 * i}) & 63 as int))" for i in range(PROBES)))


class SeenKeys:
    """Earlier keys, in segments below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.log = VersionLog(spark, f"{path}/_versions")

    def _keys(self, tables: Bucketed, segment: dict) -> DataFrame:
        return tables.open("key STRING", "key", f"{self.path}/{segment['at']}/keys", segment["buckets"])

    def admit(self, df: DataFrame, key: str) -> None:
        """Adds the keys of df; publishes keys and filter together."""
        number, state = self.log.current()
        buckets, at = int(self.spark.conf.get("spark.sql.shuffle.partitions")), f"s{number + 1:06d}-{uuid.uuid4().hex[:8]}"
        kept = list(state.get("segments", []))
        with Bucketed(self.spark) as tables:
            keys = df.where(is_id(F.col(key))).select(F.col(key).cast("string").alias("key")).distinct()
            keys = tables.save(keys, "key", f"{self.path}/{at}/keys", buckets)
            n, merge = keys.count(), []
            while kept and kept[-1]["rows"] < 2 * (n + sum(s["rows"] for s in merge)):
                merge.append(kept.pop())
            if merge:
                for s in merge:
                    keys = keys.unionByName(self._keys(tables, s))
                at += "-merged"
                keys = tables.save(keys.distinct(), "key", f"{self.path}/{at}/keys", buckets)
                n = keys.count()
            words = max(1, -(-n // PER_WORD))
            filter_ = Bits(keys.select("key"), _place(words), mask=_mask("key"), name="filter")
            chunks = filter_.save(f"{self.path}/{at}/filter")
        segment = {"at": at, "buckets": buckets, "rows": n, "words": words, "chunks": chunks}
        self.log.publish(number + 1, {"segments": [*kept, segment]})

    def probe(self, batch: DataFrame, key: str, order: str) -> DataFrame:
        """(order, key, seen, how) of each row of the batch. ``how``: 'filter' (proved new at once), 'disproved' (positive,
        but new), 'verified' (found in full), 'repeat' (a smaller order value in the batch has the key), 'no key', 'no order'."""
        rows = batch.select(F.col(order).alias("o"), F.col(key).cast("string").alias("key"))
        firsts = rows.where(is_id(F.col("key")) & F.col("o").isNotNull()).groupBy("key").agg(F.min("o").alias("o"))
        # Joined on the unique order value: a key that fills the batch is no hot key here.
        out = rows.join(self._decided(firsts).withColumnRenamed("how", "found"), "o", "left")
        how = (
            F.when(~is_id(F.col("key")), "no key")
            .when(F.col("o").isNull(), "no order")
            .otherwise(F.coalesce("found", F.lit("repeat")))
        )
        seen = F.when(how == "no order", F.lit(None)).otherwise(how.isin("verified", "repeat"))
        return out.select(F.col("o").alias(order), F.col("key").alias(key), seen.alias("seen"), how.alias("how"))

    def _decided(self, firsts: DataFrame) -> DataFrame:
        """(o, how) of first occurrences."""
        segments = self.log.current()[1].get("segments", [])
        tested, passed = firsts, []
        for i, s in enumerate(segments):
            filter_ = Bits.stored(self.spark, f"{self.path}/{s['at']}/filter", s["chunks"])
            tested = filter_.split(tested, _place(s["words"]), mask=_mask("key")).withColumnRenamed("__t_in", f"in{i}")
            passed.append(F.col(f"in{i}"))
        at = f"{self.path}/probes/{uuid.uuid4().hex}"
        any_ = F.greatest(F.lit(False), F.lit(False), *passed)
        tested.withColumn("positive", any_).write.partitionBy("positive").parquet(at)
        ins = "".join(f", in{i} BOOLEAN" for i in range(len(segments)))
        tested = self.spark.read.schema(f"key STRING, o BIGINT{ins}, positive BOOLEAN").parquet(at)
        positive = tested.where("positive")
        found = self.spark.createDataFrame([], "o BIGINT")
        with Bucketed(self.spark) as tables:
            for i, s in enumerate(segments):
                asked = positive.where(F.col(f"in{i}")).select("key", "o")
                found = found.unionByName(asked.join(self._keys(tables, s), "key", "left_semi").select("o"))
            found = materialize(found.distinct(), "verified")
        how = F.when(F.col("held"), "verified").otherwise("disproved")
        checked = positive.join(found.withColumn("held", F.lit(True)), "o", "left").select("o", how.alias("how"))
        return tested.where("NOT positive").select("o", F.lit("filter").alias("how")).unionByName(checked)


def _place(words: int) -> Column:
    """The key's word, as the number of its first bit."""
    return F.pmod(F.xxhash64("key"), F.lit(words)) * 64


def error_report(probed: DataFrame) -> DataFrame:
    """One row: rows by outcome, and the filter's rate of wrong answers (disproved positives among keys that are new)."""
    n = {h: F.count(F.when(F.col("how") == h, 1)) for h in ("filter", "disproved", "verified", "repeat", "no key", "no order")}
    new = n["filter"] + n["disproved"]
    return probed.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[v.alias("n_" + h.replace(" ", "_")) for h, v in n.items()],
        F.when(new > 0, n["disproved"] / new).otherwise(0.0).alias("filter_error_rate"),
    )
