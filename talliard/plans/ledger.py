"""Queries over the command views of the test tables, with the SQL they must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talliard.codes import ACCEPTED, REJECTED
from talliard.functions.money import format_mem, to_db, to_mem
from talliard.functions.routing import modulo, odd_even, rendezvous, rendezvous_md5, route, routing_key, salted
from talliard.operators import sink, snapshot, state
from talliard.operators.fold import Dedup, Outcome, journal, misrouted, wallet
from talliard.sources import commands, wal
from talliard.sources.tables import table
from talliard.workspace import fresh_dir, materialize

PARTITIONS, NODES = 4, 3
PAGE = 20


# ---- money and routing


def money_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = to_mem(F.col("l_extendedprice").cast("decimal(18,4)"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", units.alias("units"), to_db(units).alias("amount"))


def money_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "wal").select("delivery_id", format_mem("amount").alias("text"))


def money_null_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "wal").select("delivery_id", to_mem(F.col("amount").cast("decimal(19,0)")).alias("units"))


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(routing_key("user_id").alias("key")).distinct()


def route_modulo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "wal").select("delivery_id", modulo(F.col("routing_key"), PARTITIONS).alias("partition"))


def route_rendezvous_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "wal").select("delivery_id", rendezvous_md5(F.col("routing_key"), PARTITIONS).alias("partition"))


def route_rendezvous_murmur3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "wal").select("delivery_id", rendezvous(F.col("routing_key"), PARTITIONS).alias("partition"))


def route_odd_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "wal").select("delivery_id", odd_even(F.col("routing_key"), 2).alias("partition"))


def route_load_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route_modulo(spark, sf_dir).groupBy("partition").agg(F.count(F.lit(1)).alias("n"))


def route_node_partition_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both levels hash the same key, so nodes leave partitions empty; the salted second level doesn't."""
    key = F.col("key")
    routed = route(_users(spark, sf_dir), key, PARTITIONS, NODES, rendezvous_md5)
    routed = routed.withColumn("salted", salted(rendezvous_md5, "p:")(key, PARTITIONS))
    return routed.groupBy("node", "partition", "salted").agg(F.count(F.lit(1)).alias("n_keys"))


def route_misrouted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = commands.from_events(spark, sf_dir)
    return misrouted(rows.withColumn("node", rendezvous_md5(routing_key("user_id"), NODES)), 0)


def route_resize_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that change their partition when one is added (an extension)."""
    key = F.col("key")
    both = _users(spark, sf_dir).select("key", rendezvous_md5(key, PARTITIONS).alias("old"), rendezvous_md5(key, PARTITIONS + 1).alias("new"))
    return both.where("old <> new")


# ---- the log


def _routed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("partition", modulo(routing_key("user_id"), PARTITIONS))


def _wal(spark: SparkSession, sf_dir: str) -> wal.Wal:
    """The event commands, appended in two steps."""
    log = wal.Wal(spark, fresh_dir(spark, "wal"))
    rows = _routed(commands.from_events(spark, sf_dir))
    half = (rows.agg(F.max("seq")).head()[0] or 0) // 2
    log.append(rows.where(F.col("seq") <= half))
    log.append(rows.where(F.col("seq") > half))
    return log


_WAL_COLUMNS = ["partition", "wal_index", "seq", "tx_id", "user_id", "amount"]


def wal_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wal(spark, sf_dir).scan().select(_WAL_COLUMNS)


def wal_scan_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wal(spark, sf_dir).scan(start=100, partition=2).select(_WAL_COLUMNS)


def wal_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wal(spark, sf_dir).scan().groupBy("partition").agg(F.count(F.lit(1)).alias("n"), F.max("wal_index").alias("last"))


def wal_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wal.view(_wal(spark, sf_dir).scan())


def _page(**options):
    return lambda spark, sf_dir: wal.page_of(_wal(spark, sf_dir), 1, PAGE, **options)


# ---- the fold


def fold_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal(commands.from_lineitem(spark, sf_dir))


def fold_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal(commands.from_lineitem(spark, sf_dir), fast=True)


def fold_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.balances(journal(commands.from_events(spark, sf_dir)))


def _opened(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    opening = commands.opening_balances(spark, sf_dir)
    return journal(commands.from_events(spark, sf_dir), opening), opening


def fold_with_initial_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.balances(*_opened(spark, sf_dir))


def fold_credit_negative_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted credits that leave a balance below zero."""
    return _opened(spark, sf_dir)[0].where((F.col("status") == ACCEPTED) & (F.col("balance_after") < 0)).select("seq", "user_id", "balance_after")


def fold_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = journal(commands.from_events(spark, sf_dir)).where(F.col("status") == REJECTED)
    return rows.select("seq", "user_id", "amount", "balance_before", "reason")


def _retry(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return journal(commands.with_retries(commands.from_events(spark, sf_dir)), **options)


def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retry(spark, sf_dir).select("seq", "tx_id", "status", "code", "balance_after")


def dedup_retry_after_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = journal(commands.from_lineitem(spark, sf_dir))
    per = rows.groupBy("tx_id").agg(
        F.min(F.when(F.col("status") == REJECTED, F.col("seq"))).alias("first_reject"),
        F.min(F.when(F.col("status") == ACCEPTED, F.col("seq"))).alias("accepted"),
    )
    return per.where("accepted > first_reject")


def dedup_fifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retry(spark, sf_dir, dedup=Dedup("FIFO", 20)).select("seq", "tx_id", "status", "balance_after")


def dedup_fifo_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retry(spark, sf_dir, dedup=Dedup("FIFO", 500), scope="engine").select("seq", "tx_id", "status", "balance_after")


def dedup_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retry(spark, sf_dir, dedup=Dedup("BLOOM", 10_000_000, 1e-5), scope="engine").select("seq", "tx_id", "status", "balance_after")


def dedup_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retry(spark, sf_dir, dedup=Dedup("NONE")).select("seq", "tx_id", "status", "balance_after")


def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.status_summary(journal(commands.from_lineitem(spark, sf_dir)))


# ---- state and sink


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.entities(_retry(spark, sf_dir))


def entities_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.latest(entities(spark, sf_dir))


def read_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.read_view(entities(spark, sf_dir))


def sink_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sink.batches(entities(spark, sf_dir), 1000)
    return rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"))


def state_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.lookup(fold_balances(spark, sf_dir), 7)


def state_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.total(fold_with_initial_state(spark, sf_dir))


def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, opening = _opened(spark, sf_dir)
    return state.reconciliation(rows, opening)


def bench_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A million generated credits for 16 users by 50 threads, reconciled by user."""
    rows = journal(commands.generated(spark, 1_000_000, 16, 50), fast=True)
    accepted = F.count(F.when(F.col("status") == ACCEPTED, 1)).alias("accepted")
    return rows.groupBy("user_id").agg(F.max_by("balance_after", "seq").alias("balance_mem"), accepted)


# ---- snapshots


def _cut(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, snapshot.SnapshotStore, int]:
    rows = materialize(_wal(spark, sf_dir).scan(), "wal-rows")
    half = (rows.agg(F.max("seq")).head()[0] or 0) // 2
    store = snapshot.SnapshotStore(spark, fresh_dir(spark, "snapshot"))
    snapshot.take(store, rows.where(F.col("seq") <= half))
    return rows, store, half


def snapshot_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut(spark, sf_dir)[1].load()[1]


def snapshot_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut(spark, sf_dir)[1].load()[0]


def snapshot_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.boundaries(_wal(spark, sf_dir).scan(), 50)


def snapshot_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    positions, balances, _ = _cut(spark, sf_dir)[1].load()
    return snapshot.dump(positions, balances)


def recover_from_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, store, _ = _cut(spark, sf_dir)
    return snapshot.recover(rows, store)[1]


def recover_cold(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = snapshot.SnapshotStore(spark, fresh_dir(spark, "snapshot"))
    return snapshot.recover(_wal(spark, sf_dir).scan(), store)[1]


def _streamed(spark: SparkSession, sf_dir: str, name: str, to_commands, **options) -> DataFrame:
    """A table's commands as a stream, run until all of it is taken."""
    from talliard.streaming.ledger import start, streaming_journal

    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        source = spark.readStream.schema(schema).parquet(path)
    else:
        source = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    out = fresh_dir(spark, "stream")
    rows = streaming_journal(to_commands(source), **options)
    query = start(rows, lambda df, i: df.write.mode("overwrite").parquet(f"{out}/rows/batch={i}"), f"{out}/checkpoint")
    query.awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("seq", "tx_id", "user_id", "amount", "status", "balance_after")


def stream_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, "events", commands.event_commands)


def stream_journal_opening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From opening balances on."""
    return _streamed(spark, sf_dir, "events", commands.event_commands, opening=commands.opening_balances(spark, sf_dir))


def stream_journal_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delivered log, with null and very large amounts, null users and null identifiers."""
    return _streamed(spark, sf_dir, "wal", lambda w: w.select(F.col("delivery_id").alias("seq"), "tx_id", "user_id", "amount"))


def fold_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal(commands.from_wal(spark, sf_dir)).select("seq", "tx_id", "user_id", "amount", "status", "balance_after")


def entities_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A processor that tells the sink of debits only; credits are accepted and remembered without an entity."""

    def quiet(balance: int, amount: int, user: int | None, tx: str) -> Outcome:
        return Outcome(wallet(balance, amount, user, tx), entity=amount < 0)

    return state.entities(_retry(spark, sf_dir, processor=quiet))


def cluster_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated load of 10,000 credits for 16 users over three nodes: credits by user and node."""
    rows = commands.generated_for_cluster(spark, 10_000, 16, NODES)
    return rows.groupBy("user_id", "node").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("tx_id").alias("n_tx"))


def snapshot_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.view(_cut(spark, sf_dir)[1])


QUERIES = {
    f.__name__: f
    for f in (
        money_roundtrip, money_format, money_null_zero, route_modulo, route_rendezvous_md5, route_rendezvous_murmur3, route_odd_even,
        route_load_balance, route_node_partition_skew, route_misrouted, route_resize_moved, wal_index, wal_scan_from, wal_count, wal_view,
        fold_journal, fold_fast, fold_balances, fold_with_initial_state, fold_credit_negative_start, fold_rejections, dedup_exact,
        dedup_retry_after_reject, dedup_fifo, dedup_fifo_engine, dedup_bloom, dedup_none, status_summary, entities, entities_latest, read_view, sink_batches,
        state_lookup, state_total, reconciliation, bench_credits, snapshot_cut, snapshot_positions, snapshot_boundaries, snapshot_dump,
        recover_from_snapshot, recover_cold, stream_journal, stream_journal_opening, stream_journal_dirty, fold_dirty, entities_suppressed,
        cluster_load, snapshot_view,
    )
}
QUERIES |= {
    "wal_page_forward": _page(backward=False, cursor="0x32"),
    "wal_page_forward_start": _page(backward=False),
    "wal_page_backward": _page(),
    "wal_page_backward_cursor": _page(cursor="0x32"),
    "wal_page_filter_user": _page(routing_key="20", backward=False),
    "wal_page_filter_tx": _page(tx_id="E-77"),
    "wal_page_bad_cursor": _page(cursor="0x7fffffff"),
}


# ---- SQL


def _mem(c: str) -> str:
    return f"cast(trunc(cast({c} as decimal(18,4)) * 10000) as bigint)"


_EVENTS = f"""select event_id as seq, 'E-' || event_id as tx_id, user_id,
  (case when event_type = 'purchase' then -5 else 1 end) * {_mem("value")} as amount from events"""
_RETRY = f"""select * from ({_EVENTS}) union all
  select seq + (select max(event_id) + 1 from events), tx_id, user_id, amount from ({_EVENTS}) where seq % 5 = 0"""
_LINES = f"""select row_number() over (order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
  l_discount, l_tax, l_returnflag, l_linestatus) as seq, l_orderkey || '-' || l_linenumber as tx_id, o_custkey as user_id,
  (case when l_returnflag = 'R' then -3 else 1 end) * {_mem("l_extendedprice")} as amount
  from lineitem join orders on l_orderkey = o_orderkey"""
_OPENING = f"select c_custkey as user_id, {_mem('c_acctbal')} as balance from customer"


def _fold(cmds: str, opening: str | None = None, dedup: bool = True, last: int | None = None) -> str:
    """CTEs up to ``journal``: an account at a time, one command per step of the recursion. Only identifiers that occur again are
    remembered, unless just the ``last`` ones are."""
    start = "coalesce(o.balance, 0)" if opening else "0"
    join = f"left join ({opening}) o on o.user_id is not distinct from u.user_id" if opening else ""
    bad = "c.tx_id is null or c.amount is null"
    seen = "list_contains(f.seen, c.tx_id)" if dedup else "false"
    lacks = "c.amount < 0 and f.balance_after + c.amount < 0"
    cut = f"[-{last}:]" if last else ""
    kept = "" if last else "or not c.many"
    return f"""with recursive cmds as ({cmds}),
    c as (select *, row_number() over (partition by user_id order by seq) as rn, count(*) over (partition by user_id, tx_id) > 1 as many from cmds),
    f as (
      select u.user_id, cast(0 as bigint) as rn, cast(null as bigint) as seq, cast(null as varchar) as tx_id, cast(null as bigint) as amount,
             cast(null as varchar) as status, cast(0 as bigint) as balance_before, cast({start} as bigint) as balance_after,
             cast([] as varchar[]) as seen
      from (select distinct user_id from cmds) u {join}
      union all
      select c.user_id, c.rn, c.seq, c.tx_id, c.amount,
             case when {bad} then 'INVALID' when {seen} then 'DUPLICATE' when {lacks} then 'REJECTED' else 'ACCEPTED' end,
             f.balance_after,
             case when {bad} or {seen} or ({lacks}) then f.balance_after else f.balance_after + c.amount end,
             case when {bad} or {seen} or ({lacks}) {kept} then f.seen else list_append(f.seen, c.tx_id){cut} end
      from f join c on c.user_id is not distinct from f.user_id and c.rn = f.rn + 1),
    journal as (select seq, tx_id, user_id, amount, status,
      cast(case status when 'ACCEPTED' then 200 when 'DUPLICATE' then 2001 when 'INVALID' then 4001 end as integer) as code,
      case when status = 'REJECTED' then 'INSUFFICIENT_BALANCE' end as reason, balance_before, balance_after, status = 'ACCEPTED' as has_entity,
      {_to_db("balance_after")} as balance from f where rn > 0),
    final as (select user_id, arg_max(balance_after, rn) as balance_mem from f group by user_id)
    """


def _to_db(c: str) -> str:
    return f"cast(cast({c} as decimal(19,0)) * cast('0.0001' as decimal(5,4)) as decimal(19,4))"


def _hash(key: str) -> str:
    return (
        f"list_reduce(list_prepend(cast(0 as bigint), list_transform(string_split({key}, ''), lambda c: cast(unicode(c) as bigint))), "
        "lambda a, c: (a * 31 + c) & 4294967295)"
    )


def _modulo(key: str, n: int) -> str:
    return f"cast(case when {key} is null then 0 when {key} = '' then 0 else ({_hash(key)} & 2147483647) % {n} end as integer)"


def _hrw(key: str, n: int, salt: str = "") -> str:
    weights = ", ".join(f"{{'w': md5('{salt}' || {key} || '#{i}'), 'i': {-i}}}" for i in range(n))
    return f"cast(coalesce(-(list_max([{weights}]).i), 0) as integer)"


_KEY = "coalesce(cast(user_id as varchar), 'null')"
_USERS = f"(select distinct {_KEY} as key from events)"
# A count: with row_number() here, the SQL engine gave a wrong page for a filter with a descending limit.
_WAL = f"""(select partition, count(*) over (partition by partition order by seq rows unbounded preceding) - 1 as wal_index, seq, tx_id, user_id, amount
  from (select *, {_modulo(_KEY, PARTITIONS)} as partition from ({_EVENTS})))"""
_JSON = """'{"tx_id":"' || tx_id || '","amount":' || amount || ',"user_id":' || user_id || '}'"""


def _page_sql(cursor: int | None, backward: bool, where: str = "true") -> str:
    op, end, nxt = ("<=", "min", "max") if backward else (">=", "max", "min")
    follow = "<" if backward else ">"
    at = "null" if cursor is None else f"'0x' || printf('%x', {cursor})"
    ahead = "true" if cursor is None else f"wal_index {op} {cursor}"
    on = f"(select case when (select count(*) from hit) = {PAGE} then '0x' || printf('%x', {nxt}(wal_index)) end from w where {ahead} and wal_index {follow} (select {end}(wal_index) from hit))"
    back, there = f"cast({at} as varchar)", "false" if cursor is None else "true"
    a, b = (back, on) if backward else (on, back)
    more, prev = (there, f"{on} is not null") if backward else (f"{on} is not null", there)
    order = "desc" if backward else "asc"
    return f"""with w as (select * from {_WAL} where partition = 1),
      hit as (select * from w where {ahead} and {where} order by wal_index {order} limit {PAGE})
      select coalesce((select list({_JSON} order by wal_index) from hit), []) as records, {a} as next_cursor, {b} as prev_cursor,
             {more} as has_more, {prev} as has_prev"""


_JOURNAL = "seq, tx_id, user_id, amount, status, code, reason, balance_before, balance_after, has_entity, balance"
_HALF = "(select max(event_id) // 2 from events)"
_FIRST_HALF = f"select * from ({_EVENTS}) where seq <= {_HALF}"

SQL = {
    "money_roundtrip": f"select l_orderkey, l_linenumber, {_mem('l_extendedprice')} as units, {_to_db(_mem('l_extendedprice'))} as amount from lineitem",
    "money_format": f"select delivery_id, cast({_to_db('amount')} as varchar) as text from wal",
    "money_null_zero": "select delivery_id, coalesce(amount, 0) * 10000 as units from wal",
    "route_modulo": f"select delivery_id, {_modulo('routing_key', PARTITIONS)} as partition from wal",
    "route_rendezvous_md5": f"select delivery_id, {_hrw('routing_key', PARTITIONS)} as partition from wal",
    "route_odd_even": f"""select delivery_id, cast(coalesce(((try_cast(routing_key as bigint) % 2) + 2) % 2, {_modulo('routing_key', 2)}) as integer)
      as partition from wal""",
    "route_load_balance": f"select {_modulo('routing_key', PARTITIONS)} as partition, count(*) as n from wal group by 1",
    "route_node_partition_skew": f"""select {_hrw('key', NODES)} as node, {_hrw('key', PARTITIONS)} as partition,
      {_hrw('key', PARTITIONS, 'p:')} as salted, count(*) as n_keys from {_USERS} group by 1, 2, 3""",
    "route_misrouted": f"""select seq, tx_id, user_id, amount, 'MISROUTED' as status, cast(1010 as integer) as code from ({_EVENTS})
      where {_hrw(_KEY, NODES)} <> 0""",
    "route_resize_moved": f"""select * from (select key, {_hrw('key', PARTITIONS)} as old, {_hrw('key', PARTITIONS + 1)} as new from {_USERS})
      where old <> new""",
    "wal_index": f"select * from {_WAL}",
    "wal_scan_from": f"select * from {_WAL} where wal_index >= 100 and partition = 2",
    "wal_count": f"select partition, count(*) as n, max(wal_index) as last from {_WAL} group by 1",
    "wal_view": f"select partition, wal_index, {_JSON} as record from {_WAL}",
    "wal_page_forward": _page_sql(50, False),
    "wal_page_forward_start": _page_sql(None, False),
    "wal_page_backward": _page_sql(None, True),
    "wal_page_backward_cursor": _page_sql(50, True),
    "wal_page_filter_user": _page_sql(None, False, "user_id = 20"),
    "wal_page_filter_tx": _page_sql(None, True, "tx_id = 'E-77'"),
    "wal_page_bad_cursor": """select cast([] as varchar[]) as records, cast(null as varchar) as next_cursor, cast(null as varchar) as prev_cursor,
      false as has_more, false as has_prev""",
    "fold_journal": f"{_fold(_LINES)} select {_JOURNAL} from journal",
    "fold_fast": f"{_fold(_LINES)} select {_JOURNAL} from journal",
    "fold_balances": f"{_fold(_EVENTS)} select user_id, balance_mem from final",
    "fold_with_initial_state": f"""{_fold(_EVENTS, _OPENING)} select coalesce(o.user_id, f.user_id) as user_id,
      coalesce(f.balance_mem, o.balance) as balance_mem from ({_OPENING}) o full join final f on o.user_id = f.user_id""",
    "fold_credit_negative_start": f"""{_fold(_EVENTS, _OPENING)} select seq, user_id, balance_after from journal
      where status = 'ACCEPTED' and balance_after < 0""",
    "fold_rejections": f"{_fold(_EVENTS)} select seq, user_id, amount, balance_before, reason from journal where status = 'REJECTED'",
    "dedup_exact": f"{_fold(_RETRY)} select seq, tx_id, status, code, balance_after from journal",
    "dedup_retry_after_reject": f"""{_fold(_LINES)} select tx_id, min(seq) filter (status = 'REJECTED') as first_reject,
      min(seq) filter (status = 'ACCEPTED') as accepted from journal group by tx_id
      having min(seq) filter (status = 'ACCEPTED') > min(seq) filter (status = 'REJECTED')""",
    "dedup_fifo": f"{_fold(_RETRY, last=20)} select seq, tx_id, status, balance_after from journal",
    # A filter made for ten million identifiers has no false positive among these few.
    "dedup_bloom": f"{_fold(_RETRY)} select seq, tx_id, status, balance_after from journal",
    "dedup_none": f"{_fold(_RETRY, dedup=False)} select seq, tx_id, status, balance_after from journal",
    "status_summary": f"""{_fold(_LINES)} select status, count(*) as n, cast(sum(amount) as decimal(38,0)) as amount from journal group by 1""",
    "entities": f"""{_fold(_RETRY)} select seq, user_id, balance, cast(null as bigint) as version from journal where status = 'ACCEPTED'""",
    "entities_latest": f"""{_fold(_RETRY)} select user_id, arg_max(balance, seq) as balance, max(seq) as seq from journal
      where status = 'ACCEPTED' group by user_id""",
    "read_view": f"""{_fold(_RETRY)} select 'wallet:balance:' || user_id as key, cast(arg_max(balance, seq) as varchar) as value from journal
      where status = 'ACCEPTED' group by user_id""",
    "sink_batches": f"""{_fold(_RETRY)} select batch, count(*) as n, min(seq) as first, max(seq) as last from (
      select seq, cast((row_number() over (order by seq) - 1) // 1000 as bigint) as batch from journal where status = 'ACCEPTED') group by batch""",
    "state_lookup": f"""{_fold(_EVENTS)} select cast(7 as bigint) as user_id,
      cast(coalesce(max(balance_mem), 0) as bigint) as balance_mem from final where user_id = 7""",
    "state_total": f"""{_fold(_EVENTS, _OPENING)} select count(*) as n_accounts, cast(sum(coalesce(f.balance_mem, o.balance)) as decimal(38,0)) as total_mem
      from ({_OPENING}) o full join final f on o.user_id = f.user_id""",
    "reconciliation": f"""{_fold(_EVENTS, _OPENING)},
      s as (select cast(sum(balance) as decimal(38,0)) as v from ({_OPENING})),
      m as (select cast(sum(amount) as decimal(38,0)) as v from journal where status = 'ACCEPTED'),
      e as (select cast(sum(coalesce(f.balance_mem, o.balance)) as decimal(38,0)) as v from ({_OPENING}) o full join final f on o.user_id = f.user_id)
      select s.v as opening, m.v as accepted, e.v as final, cast(s.v + m.v - e.v as decimal(38,0)) as difference from s, m, e""",
    "bench_credits": """select i % 16 as user_id, count(*) * 10000 as balance_mem, count(*) as accepted from range(1000000) t(i) group by 1""",
    "snapshot_cut": f"{_fold(_FIRST_HALF)} select user_id, balance_mem from final",
    "snapshot_positions": f"select partition, max(wal_index) as last_wal_index from {_WAL} where seq <= {_HALF} group by 1",
    "snapshot_boundaries": f"""select partition, cast((wal_index + 1) // 50 as bigint) as snapshot, wal_index from {_WAL}
      where (wal_index + 1) % 50 = 0""",
    "snapshot_dump": f"""{_fold(_FIRST_HALF)} select 'position' as part, '{{"partition":' || partition || ',"last_wal_index":' || max(wal_index) || '}}' as json
      from {_WAL} where seq <= {_HALF} group by partition union all
      select 'state', '[' || string_agg('{{"user_id":' || user_id || ',"balance_mem":' || balance_mem || '}}', ',' order by user_id) || ']'
      from final group by user_id % 64""",
    "recover_from_snapshot": f"{_fold(_EVENTS)} select user_id, balance_mem from final",
    "recover_cold": f"{_fold(_EVENTS)} select user_id, balance_mem from final",
    "stream_journal_opening": f"{_fold(_EVENTS, _OPENING)} select seq, tx_id, user_id, amount, status, balance_after from journal",
    "entities_suppressed": f"""{_fold(_RETRY)} select seq, user_id, balance, cast(null as bigint) as version from journal
      where status = 'ACCEPTED' and amount < 0""",
    "cluster_load": f"""select i % 16 as user_id, {_hrw("cast(i % 16 as varchar)", NODES)} as node, count(*) as n, count(*) as n_tx
      from range(10000) t(i) group by 1, 2""",
    "snapshot_view": f"""{_fold(_FIRST_HALF)} select partition, max(wal_index) as last_wal_index, (select count(*) from final) as n_accounts,
      (select count(*) from journal where status = 'ACCEPTED') as n_accepted, 'EXACT' as dedup from {_WAL} where seq <= {_HALF} group by partition""",
    "stream_journal": f"{_fold(_EVENTS)} select seq, tx_id, user_id, amount, status, balance_after from journal",
}
