from decimal import Decimal

from talliard.operators.keytotals import concentration, key_totals


def test_nulls_extremes_and_clashing_names(spark):
    big = 2**63 - 1
    rows = [("a", big, 1), ("a", big, 2), ("a", None, 3), (None, -big, 4), ("", None, 5), ("A", 0, 6), ("x" * 10000, 1, 7)]
    df = spark.createDataFrame(rows, "k STRING, v BIGINT, n_rows INT")
    got = {r["k"]: tuple(r)[1:] for r in key_totals(df, "k", "v").collect()}
    assert got["a"] == (3, 2, Decimal(2 * big), big, big)
    assert got[None] == (1, 1, Decimal(-big), -big, -big)
    assert got[""] == (1, 0, None, None, None)
    assert got["A"] == (1, 1, Decimal(0), 0, 0)
    assert len(got) == 5
    assert sorted(tuple(r) for r in concentration(key_totals(df, "k", "v")).collect()) == [(1, 4, 4), (2, 1, 3)]


def test_empty(spark):
    df = spark.createDataFrame([], "k STRING, v BIGINT")
    assert key_totals(df, "k", "v").count() == 0 and concentration(key_totals(df, "k", "v")).count() == 0


def test_rows_are_combined_before_the_shuffle(spark, sf_dir):
    from talliard.sources.tables import table

    plan = key_totals(table(spark, sf_dir, "wal"), "routing_key", "amount")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and plan.count("Exchange hashpartitioning") == 1
    assert "ReadSchema: struct<routing_key:string,amount:bigint>" in plan
