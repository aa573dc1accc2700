"""Admission against a budget and settlement of exits."""

import random

import pytest
from pyspark.sql import functions as F

from tickloom.plans.account import (
    budget_after,
    capital_admission,
    exit_settlement,
    fill_from_status,
    ledger_after,
    order_status_snapshot,
    within_budget,
)

ORDERS = "account_id string, symbol string, type string, position_type string, price double, seq long"
LEDGER = (
    "account_id string, symbol string, instrument_token long, margin double, position boolean, "
    "position_type string, quantity double, filled_quantity double"
)


def orders(spark, *rows):
    return spark.createDataFrame([("a", *r) for r in rows], ORDERS)


def ledger(spark, *rows):
    return spark.createDataFrame([("a", s, i, m, p, t, q, f) for i, (s, m, p, t, q, f) in enumerate(rows)], LEDGER)


def flat(symbol, margin):
    return (symbol, margin, False, None, 0.0, 0.0)


def test_budget_must_not_be_used_up(spark):
    """Two positions of 100,000 fill a budget of 200,000 exactly: the second is refused."""
    book = ledger(spark, flat("A", 1.0), flat("B", 1.0))
    wanted = orders(spark, ("A", "entry", "long", 40.0, 1), ("B", "entry", "short", 40.0, 2))
    assert [r.symbol for r in capital_admission(wanted, book, "account_id").collect()] == ["A"]
    more = capital_admission(wanted, book, "account_id", budget=200_000.01)
    assert sorted((r.symbol, r.side) for r in more.collect()) == [("A", "BUY"), ("B", "SELL")]


def test_cheapest_first_and_half_even_quantity(spark):
    book = ledger(spark, flat("A", 2.0), flat("B", 5.0), flat("C", 4.0))
    wanted = orders(
        spark,
        ("A", "entry", "long", 40_000.0, 1),
        ("B", "entry", "long", 40_000.0, 2),
        ("C", "entry", "long", 100_000 / 3.5, 3),
    )
    rows = capital_admission(wanted, book, "account_id", budget=50_000).collect()
    assert [(r.symbol, r.quantity) for r in sorted(rows, key=lambda r: r.symbol)] == [
        ("B", 2.0), ("C", 4.0),
    ]


def test_first_order_of_a_symbol_counts(spark):
    book = ledger(spark, flat("A", 5.0), ("B", 5.0, True, "long", 10.0, 10.0))
    wanted = orders(
        spark,
        ("A", "exit", None, None, 1),
        ("A", "entry", "long", 10.0, 2),
        ("B", "exit", None, None, 3),
        ("B", "entry", "long", 10.0, 4),
    )
    assert capital_admission(wanted, book, "account_id").count() == 0
    assert [r.symbol for r in exit_settlement(wanted, book, "account_id").collect()] == ["B"]


@pytest.mark.parametrize("salts", [1, 3, 50])
@pytest.mark.parametrize("seed", range(4))
def test_parts_change_nothing(spark, salts, seed):
    rng = random.Random(seed)
    rows = [
        (group, f"S{i}", float(rng.choice([3, 5, 5, 8, 13])))
        for i in range(200)
        for group in ("hot" if rng.random() < 0.7 else "cold",)
    ]
    budget = 100.0 + seed * 37
    got = within_budget(
        spark.createDataFrame(rows, "batch string, symbol string, value double"), "batch", F.lit(budget), salts
    )
    want = set()
    for group in ("hot", "cold"):
        total = 0.0
        for _, symbol, value in sorted((r for r in rows if r[0] == group), key=lambda r: (r[2], r[1])):
            total += value
            if total < budget:
                want.add((group, symbol, total))
    assert {(r.batch, r.symbol, r.running_value) for r in got.collect()} == want


def test_settlement_actions(spark):
    book = ledger(
        spark,
        ("P", 5.0, True, "short", 10.0, 4.0),
        ("N", 4.0, True, "long", 10.0, 0.0),
        ("F", 2.0, True, "long", 10.0, 10.0),
        flat("X", 1.0),
    )
    leaving = orders(spark, *[(s, "exit", None, None, i) for i, s in enumerate("PNFXZ")])

    def told(**options):
        rows = exit_settlement(leaving, book, "account_id", **options).collect()
        return sorted((r.symbol, r.step, r.action, r.side, r.quantity) for r in rows)

    partly = [("P", 0, "modify", None, 4.0), ("P", 1, "place", "BUY", 4.0)]
    assert told() == [("F", 0, "place", "SELL", 10.0), ("N", 0, "cancel", None, None), *partly]
    assert told(close_filled=False) == [
        ("F", 0, "none", None, None), ("N", 0, "cancel", None, None), *partly
    ]


def test_budget_and_ledger_move(spark):
    book = ledger(spark, flat("A", 4.0), ("P", 5.0, True, "short", 10.0, 4.0))
    told = orders(spark, ("A", "entry", "long", 25.0, 1), ("P", "exit", None, None, 2))
    admitted = capital_admission(told, book, "account_id")
    settled = exit_settlement(told, book, "account_id")
    budgets = spark.createDataFrame([("a", 200_000.0), ("b", 1.0)], "account_id string, budget double")
    after = {r.account_id: r.budget for r in budget_after(budgets, admitted, settled).collect()}
    assert after == {"a": 200_000.0 - 25_000 + 20_000, "b": 1.0}
    rows = {r.symbol: r for r in ledger_after(book, admitted, settled, ["account_id", "symbol"]).collect()}
    assert (rows["A"].position, rows["A"].position_type, rows["A"].quantity) == (True, "long", 4000.0)
    assert (rows["P"].position, rows["P"].position_type, rows["P"].quantity) == (False, None, 0.0)


def test_status_snapshot_and_fill(spark):
    statuses = spark.createDataFrame(
        [("7", "2024-01-01 10:00:00", "OPEN", "X&Y", 0), ("7", "2024-01-01 10:00:05", "COMPLETE", "X&Y", 3)],
        "order_id string, order_timestamp string, status string, tradingsymbol string, filled_quantity long",
    )
    columns = ["order_id", "order_timestamp", "status", "symbol", "filled_quantity"]
    snapshot = order_status_snapshot(statuses, columns=columns)
    assert [tuple(r) for r in snapshot.collect()] == [(7, "2024-01-01 10:00:05", "COMPLETE", "X&Y", 3)]
    book = spark.createDataFrame([(7, 10.0, 10.0), (8, 5.0, 5.0)], "order_id long, quantity double, filled_quantity double")
    filled = {r.order_id: r.filled_quantity for r in fill_from_status(book, snapshot).collect()}
    assert filled == {7: 3.0, 8: 5.0}
