"""The trailing stop and the position lifecycle, worked out by hand."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickloom.operators.stop import Bar, StopRule
from tickloom.plans.positions import (
    apply_orders,
    entry_signal,
    exit_signal,
    lifecycle_orders,
    position_lifecycle,
    trailing_stop,
)

RULE = StopRule()
T0 = datetime(2024, 1, 1, 10, 0)


def bar(minute, high, low, close, trigger=False, kind="long", stop=None, controller=None, sd=1.0):
    return Bar(T0 + timedelta(minutes=minute), high, low, close, trigger, kind, stop, controller, sd)


def test_first_bar_holds_the_initial_values():
    p = RULE.open("short", bar(0, 12.0, 10.0, 11.0, True, "short", 13.0, 11.5))
    assert (p.stop_loss, p.controller, RULE.lag_number(p)) == (13.0, 11.5, 9)
    assert p.constant == (10.0 - 11.5) ** 2
    assert RULE.controller_sd(p) == pytest.approx(1.5)  # nine constants and the bar's own square


def test_second_bar_of_a_short():
    p = RULE.open("short", bar(0, 12.0, 10.0, 11.0, True, "short", 13.0, 11.5))
    q = RULE.follow(p, bar(1, 12.5, 10.5, 11.0))
    controller = 11.5 + 2 / 11 * (12.5 - 11.5)
    square = (controller - 10.5) ** 2
    sd = math.sqrt((8 * 2.25 + 2.25 + square) / 10)
    assert q.controller == pytest.approx(controller)
    assert RULE.controller_sd(q) == pytest.approx(sd)
    assert q.stop_loss == pytest.approx(13.0 + 2 / (round(10 / sd) + 1) * (12.5 - 13.0))


def test_always_ten_terms():
    p = RULE.open("long", bar(0, 10.0, 9.0, 9.5, True, "long", 8.0, 9.0))
    squares = [p.constant]
    for i in range(1, 14):
        p = RULE.follow(p, bar(i, 10.0 + i, 9.0 + i, 9.5 + i))
        squares.append((p.controller - (10.0 + i)) ** 2)
        lag = max(9 - i, 0)
        assert RULE.lag_number(p) == lag
        assert RULE.controller_sd(p) == pytest.approx(
            math.sqrt((lag * squares[0] + sum(squares[-10:])) / 10)
        )


@pytest.mark.parametrize(
    "sd, avg, rate",
    [
        (4.0, 1.0, 2 / 3),  # 10 / 4 = 2.5, half goes to the even 2
        (10 / 3.5, 1.0, 2 / 5),  # 3.5 goes to 4
        (9.0, 1.0, 0.9),
        (8.999, 1.0, 1.0),  # 10 / 8.999 rounds to 1: the stop jumps to the pull
        (0.0, 1.0, 0.0),
        (0.0, 0.0, 0.9),
        (1.0, 0.0, 0.9),
        (1.0, None, 0.9),
        (1.0, float("nan"), 0.9),
    ],
)
def test_follow_rate(sd, avg, rate):
    assert RULE.rate(sd, avg) == pytest.approx(rate)


def test_exit_is_strict_and_looks_at_the_last_stop():
    p = RULE.open("long", bar(0, 10.0, 9.0, 9.5, True, "long", 8.0, 9.0))
    assert not RULE.next_bar(p, bar(1, 10.0, 7.0, 8.0)).exited
    assert RULE.next_bar(p, bar(1, 10.0, 7.0, 7.99)).exited


def test_exit_and_entry_on_one_bar():
    p = RULE.open("long", bar(0, 10.0, 9.0, 9.5, True, "long", 8.0, 9.0))
    outcome = RULE.next_bar(p, bar(1, 8.0, 7.0, 7.5, True, "short", 9.0, 8.5))
    assert outcome.exited and outcome.entered
    assert outcome.position.position_type == "short"
    assert outcome.position.stop_loss == 9.0


SIGNALS = (
    "symbol string, start timestamp_ntz, high double, low double, close double, trigger boolean, "
    "position_type string, price double, initial_stop_loss double, initial_controller double, "
    "avg_sd double"
)


def signal_rows():
    def at(i):
        return T0 + timedelta(minutes=i)

    return [
        ("X&Y", at(0), 10.0, 9.0, 9.5, False, "long", 9.4, 8.0, 9.0, 1.0),
        ("X&Y", at(1), 10.0, 9.0, 9.6, True, "long", 9.5, 8.0, 9.0, 1.0),
        ("X&Y", at(2), 11.0, 9.5, 10.5, True, "short", 9.5, 12.0, 9.0, 1.0),  # held: ignored
        ("X&Y", at(3), 9.0, 7.0, 7.5, True, "short", 8.0, 9.5, 8.5, 1.0),  # out and in
        ("X&Y", at(4), 12.0, 7.0, 11.5, False, "long", 8.0, 9.5, 8.5, 1.0),  # out
        ("B-A", at(1), 10.0, 9.0, 9.6, False, "long", 9.5, 8.0, 9.0, 1.0),
    ]


def test_lifecycle(spark):
    signals = spark.createDataFrame(signal_rows()[::-1], SIGNALS)
    life = position_lifecycle(signals)
    rows = {r.start.minute: r for r in life.collect()}
    assert set(rows) == {1, 2, 3, 4}
    assert [(m, rows[m].exited, rows[m].entered) for m in sorted(rows)] == [
        (1, False, True), (2, False, False), (3, True, True), (4, True, False),
    ]
    assert rows[2].position_type == "long"
    assert rows[3].position_type == "short" and rows[3].stop_loss == 9.5
    assert rows[4].position_type is None and rows[4].lag_number is None
    orders = lifecycle_orders(life).orderBy("start", "step").collect()
    assert [(o.type, o.position_type, o.price) for o in orders] == [
        ("entry", "long", 9.5), ("exit", None, None), ("entry", "short", 8.0), ("exit", None, None),
    ]


def test_positions_do_not_touch_each_other(spark):
    signals = spark.createDataFrame(signal_rows(), SIGNALS)
    rows = signals.filter("symbol = 'X&Y'")
    held = rows.unionByName(rows.withColumn("symbol", F.lit("twin"))).withColumns(
        {"position_type": F.lit("long"), "position_time": F.lit(T0).cast("timestamp_ntz")}
    )
    both = trailing_stop(held)
    one = both.filter("symbol = 'X&Y'").drop("symbol").orderBy("start").collect()
    assert one == both.filter("symbol = 'twin'").drop("symbol").orderBy("start").collect()
    assert [r.lag_number for r in one] == [9, 8, 7, 6, 5]


def test_exit_signal_and_entry_signal(spark):
    positions = spark.createDataFrame(
        [("A", T0, "long", 9.0), ("A", T0 + timedelta(minutes=1), "long", 9.5),
         ("B", T0, "short", 9.0), ("C", T0, "long", 9.0)],
        "symbol string, start timestamp_ntz, position_type string, stop_loss double",
    )
    closes = spark.createDataFrame(
        [("A", T0, 20.0), ("A", T0 + timedelta(minutes=1), 9.4), ("B", T0, 9.0), ("D", T0, 1.0)],
        "symbol string, start timestamp_ntz, close double",
    )
    exits = exit_signal(positions, closes)
    assert [(r.symbol, r.type, r.price) for r in exits.collect()] == [("A", "exit", None)]

    signals = spark.createDataFrame(signal_rows(), SIGNALS).filter("close > 8 or symbol = 'B-A'")
    ledger = spark.createDataFrame(
        [("X&Y", False), ("B-A", False), ("A", True)], "symbol string, position boolean"
    )
    last_is_no_trigger = entry_signal(signals, ledger)
    assert last_is_no_trigger.count() == 0
    entries = entry_signal(signals.filter("minute(start) < 4"), ledger)
    assert [(r.symbol, r.position_type) for r in entries.collect()] == [("X&Y", "short")]
    after = {r.symbol: r for r in apply_orders(ledger, entries.drop("start").unionByName(exits)).collect()}
    assert after["X&Y"].position and after["X&Y"].position_type == "short"
    assert not after["A"].position and after["A"].position_type is None
    assert not after["B-A"].position
