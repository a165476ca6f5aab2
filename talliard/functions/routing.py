"""Routing keys to partitions and nodes. A strategy is a function (key column, number of partitions) -> int column.

Defined results: a null key goes to 0. Less than one partition: ``rendezvous`` and ``rendezvous_md5`` give -1, the others raise.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Strategy = Callable[[Column, int], Column]


def routing_key(user: Column | str) -> Column:
    """A user id as text; null is the text 'null'."""
    return F.coalesce((F.col(user) if isinstance(user, str) else user).cast("string"), F.lit("null"))


def string_hash(key: Column) -> Column:
    """The JVM's 32-bit string hash as an unsigned bigint: base 31 over UTF-16 units, in Spark's own expressions."""
    step = lambda acc, unit: (acc * 31 + unit).bitwiseAND(F.lit(0xFFFFFFFF))

    def char(acc: Column, i: Column) -> Column:
        c = F.ascii(F.substring(key, i, F.lit(1))).cast("bigint")
        high, low = F.floor((c - 0x10000) / 1024) + 0xD800, (c - 0x10000).bitwiseAND(F.lit(1023)) + 0xDC00
        return F.when(c < 0x10000, step(acc, c)).otherwise(step(step(acc, high.cast("bigint")), low))

    places = F.when(F.length(key) > 0, F.sequence(F.lit(1), F.length(key))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(0).cast("bigint"), char)


def modulo(key: Column, n: int) -> Column:
    """The string hash without its sign, modulo n."""
    if n < 1:
        raise ValueError("at least one partition is needed")
    return F.coalesce((string_hash(key).bitwiseAND(F.lit(0x7FFFFFFF)) % n).cast("int"), F.lit(0))


_U = np.uint64
_C1, _C2 = _U(0x87C37B91114253D5), _U(0x4CF5AD432745937F)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << _U(r)) | (x >> _U(64 - r))


def _fmix(k: np.ndarray) -> np.ndarray:
    k = (k ^ (k >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    k = (k ^ (k >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return k ^ (k >> _U(33))


def murmur3_low(data: np.ndarray) -> np.ndarray:
    """The published 128-bit murmur3 (x64, seed 0) of every row of a byte matrix: its low 64 bits, signed."""
    n, size = data.shape
    padded = np.zeros((n, -(-size // 16) * 16 or 16), np.uint8)
    padded[:, :size] = data
    words = padded.view("<u8").astype(_U)
    h1, h2 = np.zeros(n, _U), np.zeros(n, _U)
    with np.errstate(over="ignore"):
        for b in range(0, size // 16 * 2, 2):
            h1 ^= _rotl(words[:, b] * _C1, 31) * _C2
            h1 = (_rotl(h1, 27) + h2) * _U(5) + _U(0x52DCE729)
            h2 ^= _rotl(words[:, b + 1] * _C2, 33) * _C1
            h2 = (_rotl(h2, 31) + h1) * _U(5) + _U(0x38495AB5)
        if size % 16:
            b = size // 16 * 2
            h2 ^= _rotl(words[:, b + 1] * _C2, 33) * _C1
            h1 ^= _rotl(words[:, b] * _C1, 31) * _C2
        h1, h2 = h1 ^ _U(size), h2 ^ _U(size)
        h1 = h1 + h2
        h2 = h2 + h1
        h1, h2 = _fmix(h1), _fmix(h2)
        return (h1 + h2).view(np.int64)


def highest_weight(keys: list[str | None], n: int) -> np.ndarray:
    """For each key the i in [0, n) whose murmur3 of key and i (4 bytes, little-endian) is largest as a signed number; the
    lowest such i. Null: 0."""
    out = np.zeros(len(keys), np.int32)
    raw = [None if k is None else k.encode() for k in keys]
    sizes = np.array([-1 if r is None else len(r) for r in raw])
    for size in np.unique(sizes[sizes >= 0]):
        at = np.flatnonzero(sizes == size)
        block = np.zeros((len(at), size + 4), np.uint8)
        if size:
            block[:, :size] = np.frombuffer(b"".join(raw[i] for i in at), np.uint8).reshape(len(at), size)
        best = np.full(len(at), np.iinfo(np.int64).min)
        for i in range(n):
            block[:, size:] = np.frombuffer(np.array([i], "<i4").tobytes(), np.uint8)
            weight = murmur3_low(block)
            better = weight > best
            out[at[better]], best[better] = i, weight[better]
    return out


def rendezvous(key: Column, n: int) -> Column:
    """Highest random weight over murmur3, a column at a time."""
    if n < 1:
        return F.lit(-1)

    @F.arrow_udf("int")
    def pick(a: pa.Array) -> pa.Array:
        coded = a.dictionary_encode()
        best = highest_weight(coded.dictionary.to_pylist(), n)
        return pa.array(best).take(coded.indices).fill_null(0)

    return pick(key)


def rendezvous_md5(key: Column, n: int) -> Column:
    """Highest random weight over md5(key # i), in Spark's own expressions."""
    if n < 1:
        return F.lit(-1)
    weights = [F.struct(F.md5(F.concat(key, F.lit(f"#{i}"))).alias("w"), F.lit(-i).alias("i")) for i in range(n)]
    return F.coalesce((-F.array_max(F.array(*weights))["i"]).cast("int"), F.lit(0)) if n > 1 else F.lit(0)


def odd_even(key: Column, n: int) -> Column:
    """Numeric keys by parity (0 or 1, negative ones too), others by ``modulo``; 0 if there is one partition."""
    if n < 2:
        return F.lit(0)
    return F.coalesce(F.pmod(key.try_cast("bigint"), F.lit(2)).cast("int"), modulo(key, n))


def strategy(name: str | None) -> Strategy:
    """By its configured name: MODULO, anything else is RENDEZVOUS."""
    return modulo if (name or "").strip().upper() == "MODULO" else rendezvous


def route(df: DataFrame, key: Column, partitions: int, nodes: int = 1, how: Strategy = rendezvous) -> DataFrame:
    """df with ``node`` and ``partition``."""
    return df.withColumn("node", how(key, nodes)).withColumn("partition", how(key, partitions))


def salted(how: Strategy, salt: str) -> Strategy:
    """A second level that doesn't follow the first: the same strategy over another key."""
    return lambda key, n: how(F.concat(F.lit(salt), key), n)
