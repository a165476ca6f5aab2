"""Queries p1, p2 and p5 over the ledger tables, with the SQL they must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talliard.operators.incremental import IncrementalJob, last_successful
from talliard.operators.keytotals import concentration, key_totals
from talliard.operators.redelivery import MessageStore
from talliard.sources.tables import table
from talliard.workspace import broadcast_if_small, fresh_dir


def _store(spark: SparkSession, sf_dir: str) -> MessageStore:
    """The log ingested in two steps: what the last successful run of each log partition had covered, then the rest."""
    wal = table(spark, sf_dir, "wal")
    marks = last_successful(table(spark, sf_dir, "snapshot_run")).select("partition_id", "mark")
    split = wal.join(broadcast_if_small(marks), "partition_id", "left").withColumn("done", F.expr("coalesce(wal_index <= mark, false)"))
    store = MessageStore(spark, fresh_dir(spark, "messages"), "tx_id", "delivery_id", "received_at", "week")
    store.ingest(split.where("done").select(wal.columns))
    store.ingest(split.where("NOT done").select(wal.columns))
    return store


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).removed().select("delivery_id")


def p1_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).messages().select("delivery_id", "partition_id", "wal_index", "tx_id", "user_id", "amount")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = IncrementalJob(
        spark, fresh_dir(spark, "increments"), ["partition_id", "wal_index"], "delivery_id", ["tx_id", "user_id", "amount"], "received_at"
    )
    out = job.run(table(spark, sf_dir, "wal"), marks=last_successful(table(spark, sf_dir, "snapshot_run")))
    return out.select("partition_id", "wal_index")


def p2_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_successful(table(spark, sf_dir, "snapshot_run"))


def p5_key_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_totals(table(spark, sf_dir, "wal"), "routing_key", "amount")


def p5_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concentration(key_totals(table(spark, sf_dir, "wal"), "routing_key", "amount"))


_MARKS = """
  select partition_id, last_wal_index as mark, started_at as began from (
    select *, row_number() over (partition by partition_id order by finished_at desc, run_id desc) as rn
    from snapshot_run where outcome = 'SAVED' and finished_at is not null and partition_id is not null) where rn = 1
"""

QUERIES = {
    "p1_found": p1_found,
    "p1_kept": p1_kept,
    "p2_found": p2_found,
    "p2_marks": p2_marks,
    "p5_key_totals": p5_key_totals,
    "p5_concentration": p5_concentration,
}

SQL = {
    "p1_found": """
      select delivery_id from (
        select delivery_id, min(delivery_id) over (partition by tx_id) as first
        from wal where tx_id is not null and tx_id <> '') where delivery_id > first
    """,
    "p1_kept": """
      select delivery_id, partition_id, wal_index, tx_id, user_id, amount from (
        select *, min(delivery_id) over (partition by tx_id) as first from wal)
      where tx_id is null or tx_id = '' or delivery_id = first
    """,
    "p2_found": f"""
      with marks as ({_MARKS}),
      rows as (select w.*, m.mark, m.began, coalesce(w.received_at <= m.began, false) as seen
               from wal w left join marks m on w.partition_id = m.partition_id),
      newest as (select * from (select *, row_number() over (partition by partition_id, wal_index order by delivery_id desc) as rn
                 from rows) where rn = 1),
      before as (select * from (select *, row_number() over (partition by partition_id, wal_index order by delivery_id desc) as rn
                 from rows where seen) where rn = 1)
      select n.partition_id, n.wal_index from newest n
      left join before b on n.partition_id = b.partition_id and n.wal_index = b.wal_index
      where coalesce(n.wal_index > n.mark, false) or b.delivery_id is null
         or n.tx_id is distinct from b.tx_id or n.user_id is distinct from b.user_id or n.amount is distinct from b.amount
    """,
    "p2_marks": _MARKS,
    "p5_key_totals": """
      select routing_key, count(*) as n_rows, count(amount) as n_values, cast(sum(amount) as decimal(38,0)) as total,
             min(amount) as lowest, max(amount) as highest
      from wal group by routing_key
    """,
    "p5_concentration": """
      select cast(length(bin(n)) as integer) as magnitude, count(*) as n_keys, cast(sum(n) as bigint) as n_rows
      from (select count(*) as n from wal group by routing_key) group by 1
    """,
}
