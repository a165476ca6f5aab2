"""Sets of whole numbers as bits: a set that is known once is met by rows where they lie, without a shuffle of the rows.

A set is a table of chunks of 2**12 numbers, 64 words of 64 bits each. Its size is counted: up to ``MOST_CHUNKS`` chunks
(half a KB each) it is sent to all executors; a larger one meets the rows in a shuffle by chunk. Both give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talliard.workspace import materialize

#: Chunks that are broadcast at most: 48 MB of bits.
MOST_CHUNKS = 98_304
CHUNK_BITS = 12
_WORDS = 1 << (CHUNK_BITS - 6)


def _chunk(value: Column) -> Column:
    return F.shiftright(value, CHUNK_BITS)


def _word(value: Column) -> Column:
    return F.shiftright(value, 6).bitwiseAND(F.lit(_WORDS - 1)).cast("int")


def _bit(value: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), value.bitwiseAND(F.lit(63)).cast("int"))


class Bits:
    """The set of ``value`` (bigint) for every combination of the columns ``lead``; nulls aren't in it. With ``mask``, a word's
    bits are those of all masks whose value falls into it, and a value is in the set if all bits of its mask are."""

    def __init__(self, df: DataFrame, value: Column, lead: list[str] | None = None, name: str = "bits", mask: Column | None = None):
        self.lead = lead or []
        bits = _bit(F.col("__t_v")) if mask is None else F.col("__t_mask")
        own = [] if mask is None else [mask.alias("__t_mask")]
        rows = df.select(*self.lead, value.alias("__t_v"), *own).where("__t_v IS NOT NULL")
        v = F.col("__t_v")
        words = rows.groupBy(*self.lead, _chunk(v).alias("__t_chunk"), _word(v).alias("__t_w")).agg(F.bit_or(bits).alias("__t_b"))
        held = F.map_from_entries(F.collect_list(F.struct("__t_w", "__t_b")))
        dense = F.transform(F.sequence(F.lit(0), F.lit(_WORDS - 1)), lambda i: F.coalesce(F.element_at("__t_m", i), F.lit(0).cast("bigint")))
        table = words.groupBy(*self.lead, "__t_chunk").agg(held.alias("__t_m")).select(*self.lead, "__t_chunk", dense.alias("__t_bits"))
        self._set(materialize(table, name))

    def _set(self, table: DataFrame, chunks: int | None = None) -> None:
        self.table, self.chunks = table, table.count() if chunks is None else chunks
        self.small = self.chunks <= MOST_CHUNKS

    def save(self, path: str) -> int:
        """Keeps the set at ``path``; how many chunks it has."""
        self.table.write.parquet(path)
        return self.chunks

    @classmethod
    def stored(cls, spark: SparkSession, path: str, chunks: int) -> "Bits":
        """A set without leading columns, as it was saved."""
        out = cls.__new__(cls)
        out.lead = []
        out._set(spark.read.schema("__t_chunk BIGINT, __t_bits ARRAY<BIGINT>").parquet(path), chunks)
        return out

    def split(self, rows: DataFrame, value: Column, spread: Column | None = None, mask: Column | None = None) -> DataFrame:
        """rows with ``__t_in``: whether their value is in the set. ``spread`` (bigint) places rows whose value is null, if
        the rows must move."""
        if not self.chunks:
            return rows.withColumn("__t_in", F.lit(False))
        chunk = _chunk(value)
        if spread is not None and not self.small:
            chunk = F.coalesce(chunk, F.lit(-(1 << 50)) - F.pmod(spread, F.lit(4096)))
        keyed = rows.withColumn("__t_chunk", chunk)
        table = F.broadcast(self.table) if self.small else self.table
        bits = _bit(value) if mask is None else mask
        hit = F.get("__t_bits", _word(value)).bitwiseAND(bits) == bits
        joined = keyed.join(table, [*self.lead, "__t_chunk"], "left")
        return joined.select(*rows.columns, F.coalesce(hit, F.lit(False)).alias("__t_in"))

    def inside(self, rows: DataFrame, value: Column) -> DataFrame:
        return self.split(rows, value).where("__t_in").drop("__t_in")

    def outside(self, rows: DataFrame, value: Column, spread: Column | None = None) -> DataFrame:
        return self.split(rows, value, spread).where("NOT __t_in").drop("__t_in")


class Hashes:
    """A set of 64-bit hashes that lets through few others: about 16 bits each, so that one in sixteen others passes. For
    thinning rows out before they are compared in full."""

    def __init__(self, df: DataFrame, hash: str, count: int, name: str = "hashes"):
        self.keys, self.hash, self.size = df, hash, max(1 << CHUNK_BITS, 16 * count)
        self.bits = Bits(df, self._place(F.col(hash)), name=name)

    def _place(self, h: Column) -> Column:
        return F.pmod(h, F.lit(self.size).cast("bigint"))

    def thin(self, rows: DataFrame, hash: Column) -> DataFrame:
        """Rows whose hash is in the set, and few others; none of the others where the set is too large to be sent."""
        if self.bits.small:
            return self.bits.inside(rows, self._place(hash))
        keys = self.keys.select(F.col(self.hash).alias("__t_k")).distinct()
        return rows.withColumn("__t_k", hash).join(keys, "__t_k", "left_semi").drop("__t_k")
