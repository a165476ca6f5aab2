"""Fixed-point money: bigint units of 1e-4 inside, DECIMAL(19,4) at the edges. Overflow raises (ANSI), it never wraps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decimal places, and units in one.
SCALE, UNITS = 4, 10_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_mem(amount: Column | str) -> Column:
    """A decimal amount in units, cut toward zero; null is 0."""
    return F.coalesce((_col(amount) * UNITS).cast("bigint"), F.lit(0).cast("bigint"))


def to_db(units: Column | str) -> Column:
    """Units as DECIMAL(19,4); exact for every bigint."""
    return (_col(units).cast("decimal(19,0)") * F.lit("0.0001").cast("decimal(5,4)")).cast("decimal(19,4)")


def format_mem(units: Column | str) -> Column:
    """Units as plain text with four places: 0 is '0.0000'."""
    return to_db(units).cast("string")
