"""The fold against a plain model, its fixed expectations, and its properties."""

import random
from collections import OrderedDict, defaultdict

import pytest

from talliard.operators import state
from talliard.operators.fold import Dedup, Reject, _Bloom, journal
from talliard.sources import commands
from talliard.sources.commands import COMMAND


def model(rows, opening=(), fifo=None, dedup=True, scope=lambda r: r[2]):
    balance, seen, out = defaultdict(int, dict(opening)), defaultdict(OrderedDict), {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        seq, tx, user, amount = r[:4]
        held = seen[scope(r)]
        if tx is None or amount is None or seq is None:
            status = "INVALID"
        elif dedup and tx in held:
            status = "DUPLICATE"
        elif amount < 0 and balance[user] + amount < 0:
            status = "REJECTED"
        else:
            status = "ACCEPTED"
            balance[user] += amount
            held[tx] = None
            if fifo and len(held) > fifo:
                held.popitem(last=False)
        out[seq] = (status, balance[user])
    return out, dict(balance)


def outcome(df):
    return {r["seq"]: (r["status"], r["balance_after"]) for r in df.collect()}


def random_rows(seed, n=400):
    rnd = random.Random(seed)
    return [
        (i, rnd.choice([None, "", *(f"t{k}" for k in range(60))]), rnd.choice([None, 1, 1, 1, 2, 3]), rnd.choice([None, 0, rnd.randint(-90, 60)]))
        for i in rnd.sample(range(10_000), n)
    ]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("fast", [False, True])
def test_equals_the_model(spark, seed, fast):
    rows, opening = random_rows(seed), [(1, -20), (2, 50), (None, 7), (9, 3)]
    df = spark.createDataFrame(rows, COMMAND)
    start = spark.createDataFrame(opening, "user_id BIGINT, balance BIGINT")
    j = journal(df, start, fast=fast)
    want, balances = model(rows, opening)
    assert outcome(j) == want
    assert dict(map(tuple, state.balances(j, start).collect())) == balances
    assert state.reconciliation(j, start).head()["difference"] == 0


@pytest.mark.parametrize(
    "start, steps, want",
    [
        (0, [("a", 10), ("b", -10)], "A A"),
        (0, [("a", -1)], "R"),
        (-5, [("a", 2)], "A"),
        (-5, [("a", 0)], "A"),
        (0, [("a", -5), ("b", 9), ("a", -5)], "R A A"),
        (0, [("a", 5), ("a", 5)], "A D"),
        (0, [(None, 5)], "I"),
    ],
)
@pytest.mark.parametrize("fast", [False, True])
def test_small_cases(spark, start, steps, want, fast):
    df = spark.createDataFrame([(i, tx, 1, a) for i, (tx, a) in enumerate(steps)], COMMAND)
    j = journal(df, spark.createDataFrame([(1, start)], "user_id BIGINT, balance BIGINT"), fast=fast)
    assert " ".join(r["status"][0] for r in j.orderBy("seq").collect()) == want


@pytest.mark.parametrize(
    "view, options, want",
    [
        ("events", {}, (945, 0, 55, 121429000)),
        ("opened", {}, (978, 0, 22, 6483835700)),
        ("retry", {}, (953, 188, 59, 99817500)),
        ("retry", {"dedup": Dedup("FIFO", 500), "scope": "engine"}, (1062, 77, 61, 121870600)),
        ("retry", {"dedup": Dedup("BLOOM", 100_000), "scope": "engine"}, (953, 188, 59, 99817500)),
        ("lineitem", {}, (4115, 1227, 658, 511393326500)),
        ("lineitem", {"fast": True}, (4115, 1227, 658, 511393326500)),
    ],
)
def test_known_totals(spark, view, options, want):
    at = "/root/testdata/sf0.001"
    opening = commands.opening_balances(spark, at) if view == "opened" else None
    df = commands.from_lineitem(spark, at) if view == "lineitem" else commands.from_events(spark, at)
    j = journal(commands.with_retries(df) if view == "retry" else df, opening, **options)
    n = {r["status"]: r["n"] for r in state.status_summary(j).collect()}
    total = state.total(state.balances(j, opening)).head()["total_mem"]
    assert (n.get("ACCEPTED", 0), n.get("DUPLICATE", 0), n.get("REJECTED", 0), int(total)) == want


@pytest.mark.parametrize("size", [1, 3, 20])
def test_bounded_memory_is_first_in_first_out(spark, size):
    rows = random_rows(5)
    df = spark.createDataFrame(rows, COMMAND)
    j = journal(df, dedup=Dedup("FIFO", size), scope="engine")
    assert outcome(j) == model(rows, fifo=size, scope=lambda r: 0)[0]


def test_partition_scope(spark):
    rows = [(*r, (r[2] or 0) % 2) for r in random_rows(6)]
    df = spark.createDataFrame(rows, COMMAND + ", partition INT")
    assert outcome(journal(df, scope="partition")) == model(rows, scope=lambda r: r[4])[0]
    with pytest.raises(ValueError):
        journal(df, scope="node")


def test_own_processor_and_errors(spark):
    def at_most_100(balance, amount, user, tx):
        if tx == "boom":
            raise ZeroDivisionError("x")
        if abs(amount) > 100:
            raise Reject("LIMIT")
        return balance + amount

    df = spark.createDataFrame([(1, "a", 1, 50), (2, "b", 1, 500), (3, "boom", 1, 1), (4, "c", 1, -80)], COMMAND)
    got = [(r["status"], r["reason"], r["balance_after"]) for r in journal(df, processor=at_most_100).orderBy("seq").collect()]
    assert got == [("ACCEPTED", None, 50), ("REJECTED", "LIMIT", 50), ("ERROR", "ZeroDivisionError: x", 50), ("ACCEPTED", None, -30)]


def test_replays_of_accepted_commands_change_nothing(spark):
    df = commands.from_events(spark, "/root/testdata/sf0.001")
    j = journal(df)
    again = j.where("status = 'ACCEPTED'").selectExpr("seq + 1000000 AS seq", "tx_id", "user_id", "amount")
    twice = journal(df.unionByName(again))
    assert {tuple(r) for r in state.balances(twice).collect()} == {tuple(r) for r in state.balances(j).collect()}
    assert j.where("status = 'ACCEPTED' AND amount < 0 AND balance_after < 0").count() == 0


def test_overflow_raises_and_empty_log(spark):
    df = spark.createDataFrame([(1, "a", 1, 2**63 - 1), (2, "b", 1, 1)], COMMAND)
    with pytest.raises(Exception):
        journal(df).collect()
    empty = journal(spark.createDataFrame([], COMMAND))
    assert empty.count() == 0 and state.reconciliation(empty).head()["difference"] == 0


def test_filter_has_no_false_negatives_and_few_positives():
    f = _Bloom(Dedup("BLOOM", 2000, 0.01))
    for i in range(2000):
        f.add(f"k{i}")
    assert all(f"k{i}" in f for i in range(2000))
    assert sum(f"other{i}" in f for i in range(5000)) < 150
