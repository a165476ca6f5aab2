"""What follows from a journal: balances, look-ups, totals, entities, reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talliard.codes import ACCEPTED
from talliard.functions.money import to_db
from talliard.workspace import materialize


def balances(journal: DataFrame, opening: DataFrame | None = None) -> DataFrame:
    """(user_id, balance_mem) after the last command; users without commands keep their opening balance."""
    last = F.max_by("balance_after", "seq").alias("balance_mem")
    found = journal.groupBy("user_id").agg(last)
    if opening is None:
        return found
    start = opening.groupBy("user_id").agg(F.max("balance").alias("balance"))
    joined = start.withColumnRenamed("user_id", "u").join(found, F.col("u").eqNullSafe(F.col("user_id")), "full")
    return joined.select(
        F.coalesce("u", "user_id").alias("user_id"), F.coalesce("balance_mem", "balance", F.lit(0).cast("bigint")).alias("balance_mem")
    )


def lookup(state: DataFrame, user_id: int) -> DataFrame:
    """One user's balance; an unknown user has 0."""
    return state.where(F.col("user_id") == user_id).agg(
        F.lit(user_id).cast("bigint").alias("user_id"), F.coalesce(F.max("balance_mem"), F.lit(0).cast("bigint")).alias("balance_mem")
    )


def total(state: DataFrame) -> DataFrame:
    """One row: number of accounts and the sum of their balances."""
    return state.agg(
        F.count(F.lit(1)).alias("n_accounts"),
        F.coalesce(F.sum(F.col("balance_mem").cast("decimal(28,0)")), F.lit(0)).cast("decimal(38,0)").alias("total_mem"),
    )


def entities(journal: DataFrame) -> DataFrame:
    """What the sink gets: the new absolute balance of every accepted command that has an entity. ``version`` is never set."""
    return journal.where("has_entity").select(
        "seq", "user_id", to_db("balance_after").alias("balance"), F.lit(None).cast("bigint").alias("version")
    )


def latest(entity: DataFrame) -> DataFrame:
    """Each user's last entity: sending entities again in order changes nothing."""
    return entity.groupBy("user_id").agg(F.max_by("balance", "seq").alias("balance"), F.max("seq").alias("seq"))


def read_view(entity: DataFrame) -> DataFrame:
    """Key-value pairs for a cache of balances (an extension)."""
    return latest(entity).select(
        F.concat(F.lit("wallet:balance:"), F.col("user_id").cast("string")).alias("key"), F.col("balance").cast("string").alias("value")
    )


def reconciliation(journal: DataFrame, opening: DataFrame | None = None) -> DataFrame:
    """One row: opening total, accepted amounts, final total, and their difference, which is 0 if nothing was lost."""
    journal = materialize(journal, "journal")  # used twice below
    wide = lambda c: F.coalesce(F.sum(F.col(c).cast("decimal(28,0)")), F.lit(0)).cast("decimal(38,0)")
    final = balances(journal, opening).agg(wide("balance_mem").alias("v")).select(F.lit("f").alias("k"), "v")
    moved = journal.where(F.col("status") == ACCEPTED).agg(wide("amount").alias("v")).select(F.lit("m").alias("k"), "v")
    parts = final.unionByName(moved)
    if opening is not None:
        start = opening.groupBy("user_id").agg(F.max("balance").alias("balance"))
        parts = parts.unionByName(start.agg(wide("balance").alias("v")).select(F.lit("s").alias("k"), "v"))
    value = lambda k: F.coalesce(F.max(F.when(F.col("k") == k, F.col("v"))), F.lit(0)).cast("decimal(38,0)")
    return parts.agg(value("s").alias("opening"), value("m").alias("accepted"), value("f").alias("final")).select(
        "*", (F.col("opening") + F.col("accepted") - F.col("final")).cast("decimal(38,0)").alias("difference")
    )


def status_summary(journal: DataFrame) -> DataFrame:
    return journal.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("amount").cast("decimal(28,0)")).cast("decimal(38,0)").alias("amount"))
