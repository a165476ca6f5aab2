"""Reading the named tables of a data directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name``; column pruning and pushdown are left to the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_id(c: Column) -> Column:
    """Whether c is an identifier: null and '' are not. Never null itself."""
    return F.coalesce(c != F.lit(""), F.lit(False))
