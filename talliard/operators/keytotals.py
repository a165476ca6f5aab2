"""Per-key totals where a few keys hold most rows (problem 5).

Every aggregate here is algebraic, so Spark combines rows in a bounded hash table per task before the shuffle (spilling
it as sorted runs when there are more keys than fit): a key with a third of all rows sends one small row per task, and
the reduce side merges compact states only. The narrow scan reads two columns. Neither salt nor repartitioning is needed.

Defined results
  * A null key is a group of its own; keys are compared character by character.
  * ``n_rows`` counts every row, ``n_values`` those with a value; sum, lowest and highest value are null if none has one.
  * The sum is exact: it is carried as DECIMAL(38,0), which 10**19 of the largest values don't overflow (a sum of DECIMAL(28,0) is one).
  * An empty table gives no rows. Columns other than key and value aren't read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_totals(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n_rows, n_values, total, lowest, highest) of each key."""
    v = F.col(value)
    return (
        df.groupBy(F.col(key).alias(key))
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count(v).alias("n_values"),
            F.sum(v.cast("decimal(28,0)")).alias("total"),
            F.min(v).alias("lowest"),
            F.max(v).alias("highest"),
        )
    )


def concentration(totals: DataFrame) -> DataFrame:
    """How many keys hold rows of which order of magnitude: (magnitude, n_keys, n_rows), magnitude being the number of
    binary digits of the key's row count. At most 64 rows."""
    size = F.length(F.bin("n_rows"))
    return totals.groupBy(size.alias("magnitude")).agg(
        F.count(F.lit(1)).alias("n_keys"), F.sum("n_rows").alias("n_rows")
    )
