"""Commands (seq, tx_id, user_id, amount in units) drawn from the test tables, and generated load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talliard.functions.money import to_mem
from talliard.functions.routing import Strategy, rendezvous_md5, routing_key
from talliard.sources.tables import table
from talliard.workspace import spread

COMMAND = "seq BIGINT, tx_id STRING, user_id BIGINT, amount BIGINT"


def _units(c: str):
    return to_mem(F.col(c).cast("decimal(18,4)"))


def event_commands(events: DataFrame) -> DataFrame:
    """Purchases debit five times their value, everything else credits it."""
    sign = F.when(F.col("event_type") == "purchase", -5).otherwise(1)
    return events.select(
        F.col("event_id").alias("seq"), F.concat(F.lit("E-"), "event_id").alias("tx_id"), "user_id", (sign * _units("value")).alias("amount")
    )


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_commands(table(spark, sf_dir, "events"))


def with_retries(commands: DataFrame) -> DataFrame:
    """Every fifth command once more at the end, under the same identifier."""
    last = commands.agg(F.max("seq")).head()[0] or 0
    again = commands.where("seq % 5 = 0").select((F.col("seq") + last + 1).alias("seq"), "tx_id", "user_id", "amount")
    return commands.unionByName(again)


def from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as commands of their customer; returned ones debit three times their price. Identifiers repeat."""
    lines = spread(table(spark, sf_dir, "lineitem")).join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    order = (
        "l_shipdate l_orderkey l_linenumber l_partkey l_suppkey l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus"
    ).split()
    sign = F.when(F.col("l_returnflag") == "R", -3).otherwise(1)
    rows = lines.select(
        F.struct(*order).alias("at"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("tx_id"),
        F.col("o_custkey").alias("user_id"),
        (sign * _units("l_extendedprice")).alias("amount"),
    )
    from talliard.operators.numbering import number

    return number(rows, [], ["at"], "seq", first=1).select("seq", "tx_id", "user_id", "amount")


def opening_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), _units("c_acctbal").alias("balance"))


def from_wal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delivered log as it is, in the order of arrival, with its nulls and very large amounts."""
    return table(spark, sf_dir, "wal").select(F.col("delivery_id").alias("seq"), "tx_id", "user_id", "amount")


def generated(spark: SparkSession, count: int, users: int, threads: int = 1) -> DataFrame:
    """Credits of 1.0000: id in [0, count) for user id % users, each thread a run of ids, the last one also what is left."""
    thread = F.least(F.floor(F.col("id") / max(1, count // threads)), F.lit(threads - 1))
    return spark.range(count).select(
        F.col("id").alias("seq"),
        F.concat(F.lit("B-"), "id").alias("tx_id"),
        F.pmod("id", F.lit(users)).alias("user_id"),
        F.lit(10_000).cast("bigint").alias("amount"),
        thread.cast("int").alias("thread"),
    )


def generated_for_cluster(spark: SparkSession, count: int, users: int, nodes: int, seed: int = 0, how: Strategy = rendezvous_md5) -> DataFrame:
    """Credits with an identifier of 32 random hexadecimal digits (random by seed) and the ``node`` that owns their user."""
    tx = F.md5(F.concat(F.lit(f"{seed}:"), F.col("seq").cast("string")))
    rows = generated(spark, count, users).drop("thread").withColumn("tx_id", tx)
    return rows.withColumn("node", how(routing_key("user_id"), nodes))
