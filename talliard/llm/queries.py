"""Queries of the subpackage, with SQL where SQL can say what they must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talliard.llm.frequent import exact_counts, frequent_items
from talliard.llm.mixing import mix
from talliard.llm.packing import pack, packing_report
from talliard.llm.reading import profile, reading_levels
from talliard.llm.seen import SeenKeys, error_report
from talliard.llm.tokens import token_count
from talliard.sources.tables import table
from talliard.workspace import fresh_dir, materialize, spread

#: Share of rows that makes a routing key frequent, and counters kept: the error is at most a fifth of that share.
SUPPORT, COUNTERS = 0.004, 1250


def _frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent_items(table(spark, sf_dir, "wal"), "routing_key", SUPPORT, COUNTERS)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = exact_counts(table(spark, sf_dir, "wal"), "routing_key", _frequent(spark, sf_dir))
    return items.where(F.col("n") >= SUPPORT * F.col("n_rows")).select(F.col("value").alias("routing_key"))


def p3_frequent_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frequent(spark, sf_dir).withColumnRenamed("value", "routing_key")


def _probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = SeenKeys(spark, fresh_dir(spark, "seen"))
    seen.admit(table(spark, sf_dir, "wal"), "tx_id")
    return seen.probe(table(spark, sf_dir, "command"), "tx_id", "command_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probed(spark, sf_dir).where("seen").select("command_id")


def p4_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probed(spark, sf_dir).select("command_id", "tx_id", "seen")


def p4_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return error_report(materialize(_probed(spark, sf_dir), "probed"))


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return materialize(docs.select("doc_id", "source", token_count("text").alias("tokens")), "sizes")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_sized(spark, sf_dir), "doc_id", "tokens")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).where("piece = 1").select("doc_id")


def p6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_report(_packed(spark, sf_dir))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mix(_sized(spark, sf_dir), table(spark, sf_dir, "mix_target"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1].where("short").select("source")


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_label"))


#: School grade from which a document counts as demanding.
DEMANDING = 10.0


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir).where((F.col("lang") == "en") & (F.col("grade") >= DEMANDING)).select("doc_id")


def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir)


def p8_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(_levels(spark, sf_dir))


# ---- what must hold of results that SQL can't compute, beside what SQL can say of it


def p3_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each frequent key whether its true count lies between the summary's bounds."""
    items = exact_counts(table(spark, sf_dir, "wal"), "routing_key", materialize(_frequent(spark, sf_dir), "bounds"))
    within = (F.col("at_least") <= F.col("n")) & (F.col("n") <= F.col("at_most"))
    return items.where(F.col("n") >= SUPPORT * F.col("n_rows")).select(F.col("value").alias("routing_key"), "n", "n_rows", within.alias("within"))


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: outcomes, without the share of them that the filter settled, and whether its error is below 2 %."""
    r = p4_error_rate(spark, sf_dir)
    return r.select(
        "n_rows", "n_verified", "n_repeat", (F.col("n_filter") + F.col("n_disproved")).alias("n_new"), "n_no_key",
        (F.col("filter_error_rate") < 0.02).alias("few_errors"),
    )


def p6_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: documents placed, containers over capacity, places taken twice, documents that don't come in full, and whether
    less than 1 % more containers are used than any packing needs."""
    sized = _sized(spark, sf_dir)
    packed = pack(sized, "doc_id", "tokens")
    boxes = packed.groupBy("container").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.countDistinct("position").alias("p"))
    full = boxes.agg(F.count(F.when(F.col("t") > 4096, 1)).alias("n_overfull"), F.coalesce(F.sum(F.col("n") - F.col("p")), F.lit(0)).alias("n_twice"))
    whole = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("t")).join(sized.select("doc_id", "tokens"), "doc_id", "full")
    parts = whole.agg(F.count(F.col("t")).alias("n_docs"), F.count(F.when(~F.col("t").eqNullSafe(F.col("tokens")), 1)).alias("n_cut"))
    tight = packing_report(packed).select((F.col("n_containers") <= F.ceil(F.col("least_containers") * 1.01) + 1).alias("tight"))
    return parts.crossJoin(F.broadcast(full)).crossJoin(F.broadcast(tight))  # one row each


def p7_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source whether it is short or within 1 % (or 1,000 tokens) of its target, and whether no document is used more
    often than allowed."""
    report = _mixed(spark, sf_dir)[1]
    near = F.abs(F.col("reached_tokens") - F.col("target_tokens")) <= F.greatest(F.col("target_tokens") * 0.01, F.lit(1000.0))
    return report.select("source", (F.col("short") | near).alias("reached"), (F.col("most_copies") <= F.col("max_uses")).alias("allowed"), "n_docs")


def p8_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: documents, and those with a grade but without words, or the other way round."""
    levels = _levels(spark, sf_dir)
    odd = (F.col("n_words") > 0) != (F.col("grade").isNotNull() & F.col("coverage_rank").isNotNull())
    return levels.agg(F.count(F.lit(1)).alias("n_docs"), F.count(F.when(odd, 1)).alias("n_odd"))


QUERIES = {
    "p3_bounds": p3_bounds,
    "p4_counts": p4_counts,
    "p6_invariants": p6_invariants,
    "p7_invariants": p7_invariants,
    "p8_invariants": p8_invariants,
    "p3_found": p3_found,
    "p3_frequent_keys": p3_frequent_keys,
    "p4_found": p4_found,
    "p4_seen": p4_seen,
    "p4_error_rate": p4_error_rate,
    "p6_found": p6_found,
    "p6_packing": p6_packing,
    "p6_report": p6_report,
    "p7_found": p7_found,
    "p7_mixture": p7_mixture,
    "p7_report": p7_report,
    "p8_found": p8_found,
    "p8_levels": p8_levels,
    "p8_profile": p8_profile,
}

_SEEN = """
  with known as (select distinct tx_id from wal where tx_id <> ''),
  firsts as (select tx_id, min(command_id) as first from command where tx_id <> '' group by tx_id)
  select c.command_id, c.tx_id,
         coalesce(c.tx_id <> '', false) and (k.tx_id is not null or c.command_id > f.first) as seen
  from command c left join known k on c.tx_id = k.tx_id left join firsts f on c.tx_id = f.tx_id
"""

SQL = {
    "p3_found": """
      select routing_key from wal where routing_key is not null group by routing_key
      having count(*) >= 0.004 * (select count(routing_key) from wal)
    """,
    "p3_bounds": """
      select routing_key, count(*) as n, (select count(routing_key) from wal) as n_rows, true as within
      from wal where routing_key is not null group by routing_key having count(*) >= 0.004 * (select count(routing_key) from wal)
    """,
    "p4_counts": """
      with known as (select distinct tx_id from wal where tx_id <> ''),
      c as (select c.tx_id, coalesce(c.tx_id <> '', false) as id, k.tx_id is not null as held,
                   row_number() over (partition by c.tx_id order by command_id) = 1 as first
            from command c left join known k on c.tx_id = k.tx_id)
      select count(*) as n_rows, count(*) filter (id and first and held) as n_verified, count(*) filter (id and not first) as n_repeat,
             count(*) filter (id and first and not held) as n_new, count(*) filter (not id) as n_no_key, true as few_errors from c
    """,
    "p6_invariants": "select count(*) as n_docs, cast(0 as bigint) as n_cut, cast(0 as bigint) as n_overfull, cast(0 as bigint) as n_twice, true as tight from documents",
    "p7_invariants": """
      select t.source, true as reached, true as allowed, count(d.doc_id) as n_docs from mix_target t
      left join documents d on lower(regexp_replace(d.source, '^\\s+|\\s+$', '', 'g')) = lower(regexp_replace(t.source, '^\\s+|\\s+$', '', 'g'))
      group by t.source
    """,
    "p8_invariants": "select count(*) as n_docs, cast(0 as bigint) as n_odd from documents",
    "p4_found": f"select command_id from ({_SEEN}) where seen",
    "p4_seen": _SEEN,
}
