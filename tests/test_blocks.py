"""Series cut into blocks give what uncut series give."""

from dataclasses import replace
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from helpers import assert_same, random_bars
from tickloom.operators import windows
from tickloom.operators.affine import affine_scan
from tickloom.operators.blocks import Blocks, RowBlocks, fold_blocks, with_lookback
from tickloom.operators.stop import Bar, StopRule
from tickloom.plans.positions import position_lifecycle, trailing_stop
from tickloom.plans.signals import (
    baseline_volatility,
    breakout_scan,
    first_day_needed,
    indicator_panel,
    live_signals,
    signal_history,
    signals_bar_by_bar,
    swing_segments,
)

DAYS = [12]


@pytest.fixture(scope="module")
def bars(spark):
    return random_bars(spark, bars=80).persist()


def cut(bars, days):
    blocks = Blocks.spanning(bars, "start", days)
    assert blocks.count > 1
    return blocks


def test_span(bars):
    whole = Blocks.spanning(bars, "start", 100_000)
    assert whole.is_single
    assert replace(whole, days=1).count == 1
    assert Blocks.spanning(bars.limit(0)).is_single
    first, last = bars.select(F.to_date(F.min("start")), F.to_date(F.max("start"))).first()
    busiest = bars.groupBy("symbol", F.to_date("start")).count().agg(F.max("count")).first()[0]
    measured = Blocks.spanning(bars, rows=3 * busiest)
    assert measured.days == 3 and not measured.is_single
    sizes = measured.mark(bars, "start").groupBy("symbol", "_block").count()
    assert sizes.agg(F.max("count")).first()[0] <= 3 * busiest
    assert Blocks.spanning(bars, rows=1).days == 1
    assert Blocks.spanning(bars).is_single
    assert Blocks.between(first, last, 7) == Blocks.spanning(bars, "start", 7)


@pytest.mark.parametrize("days", [1, 30, *DAYS])
def test_lookback_copies_exactly_the_rows_before(bars, days):
    wide = with_lookback(bars, 5, cut(bars, days))
    own = wide.filter("not _halo")
    assert own.count() == bars.count()
    starts = {}
    for row in own.collect():
        starts.setdefault(row.symbol, []).append((row.start, row._block))
    wanted = set()
    for symbol, rows in starts.items():
        rows.sort()
        for block in {b for _, b in rows}:
            before = [s for s, b in rows if b < block][-5:]
            wanted |= {(symbol, block, s) for s in before}
    got = [(r.symbol, r._block, r.start) for r in wide.filter("_halo").collect()]
    assert len(got) == len(set(got))
    assert set(got) == wanted


@pytest.mark.parametrize("days", DAYS)
@pytest.mark.parametrize(
    "build",
    [
        lambda b, x: windows.rolling_std(b, {"sd": "high"}, 10, blocks=x),
        lambda b, x: windows.rolling_mean(b, {"m": ("close", 5), "n": ("close", 16)}, blocks=x),
        lambda b, x: windows.rolling_sum(b, "s", "close", blocks=x),
        lambda b, x: windows.lag_prev(b, {"p": "close"}, blocks=x),
        lambda b, x: windows.countdown(b, blocks=x),
        lambda b, x: windows.running_sum(b, "t", "close", blocks=x),
        lambda b, x: windows.forward_fill(
            b.withColumn("part", F.when(F.col("close") > 101, F.col("close"))), {"f": "part"}, blocks=x
        ),
        lambda b, x: windows.ema_fold(b, "e", "close", blocks=x),
        lambda b, x: indicator_panel(b, None, x),
        lambda b, x: swing_segments(indicator_panel(b, None, x), x),
        lambda b, x: signal_history(b, x, sd_factor=1.0),
        lambda b, x: signals_bar_by_bar(b, blocks=x, sd_factor=1.0),
        lambda b, x: position_lifecycle(signal_history(b, x, sd_factor=1.0, natr_min=0), x),
    ],
    ids="std mean sum lag countdown running fill ema panel swings signals bar_by_bar lifecycle".split(),
)
def test_blocks_change_nothing(bars, days, build):
    assert_same(build(bars, cut(bars, days)), build(bars, Blocks.single()))


@pytest.mark.parametrize("days", DAYS)
def test_trailing_stop_over_blocks(bars, days):
    first = bars.groupBy("symbol").agg(F.min("start").alias("position_time"))
    held = bars.join(first, "symbol").withColumns(
        {
            "position_type": F.when(F.col("instrument_token") == 0, "short").otherwise("long"),
            "initial_stop_loss": F.lit(90.0),
            "initial_controller": F.lit(95.0),
        }
    )
    assert_same(trailing_stop(held, cut(bars, days)), trailing_stop(held, Blocks.single()))


@pytest.mark.parametrize("limit", [7, 40, 100_000])
def test_row_blocks_bound_every_group(spark, limit):
    """One key with most rows, all within one day; a key and an order that are null; few rows elsewhere."""
    at = datetime(2024, 1, 1)
    rows = [("hot", at + timedelta(seconds=7 * i % 5000 + i), float(i)) for i in range(600)]
    rows += [("cold", at + timedelta(minutes=i), float(i)) for i in range(5)]
    rows += [(None, at + timedelta(hours=i), float(i)) for i in range(9)] + [("hot", None, 0.0)]
    series = spark.createDataFrame(rows, "symbol string, start timestamp_ntz, close double").dropDuplicates(["symbol", "start"])
    blocks = RowBlocks.of(series, "start", rows=limit)
    assert blocks.is_single == (limit > 600)
    sizes = blocks.mark(series, "start").groupBy("symbol", "_block").count()
    assert sizes.agg(F.max("count")).first()[0] <= limit
    assert sizes.filter("symbol = 'cold'").count() == 1
    for build in (
        lambda b: windows.rolling_sum(series, "x", "close", 4, blocks=b),
        lambda b: windows.running_sum(series, "x", "close", blocks=b),
        lambda b: windows.lag_prev(series, {"x": "close"}, blocks=b),
        lambda b: windows.ema_fold(series, "x", "close", blocks=b),
    ):
        one, many = ({(r.symbol, r.start): r.x for r in build(b).collect()} for b in (Blocks.single(), blocks))
        assert many == pytest.approx(one)


def plain_stops(rows, rule):
    """The stop bar by bar, one position after the other."""
    out = {}
    for key in sorted({(r.symbol, r.position_time) for r in rows}):
        position = None
        for r in sorted((r for r in rows if (r.symbol, r.position_time) == key), key=lambda r: r.start):
            bar = Bar(r.start, r.high, r.low, r.close, False, r.position_type, r.initial_stop_loss, r.initial_controller, r.avg_sd)
            position = rule.follow(position, bar) if position else rule.open(r.position_type, bar)
            out[(r.symbol, r.start)] = (
                position.controller, position.constant, rule.lag_number(position),
                rule.controller_sd(position), position.stop_loss, position.position_type,
            )
    return out


@pytest.mark.parametrize("cut_at", [None, 12, 1])
@pytest.mark.parametrize("batch", [3, 10_000])
def test_trailing_stop_is_the_loop_over_its_bars(spark, bars, cut_at, batch):
    """In one block and in many, with batches that end inside positions, other directions later, odd avg_sd."""
    first = bars.groupBy("symbol").agg(F.min("start").alias("position_time"))
    odd = F.array(F.lit(1.0), F.lit(0.0), F.lit(None).cast("double"), F.lit(0.05), F.lit(2.0))
    held = bars.join(first, "symbol").withColumns(
        {
            "position_type": F.when(F.col("instrument_token") == F.minute("start") % 3, "short").otherwise("long"),
            "initial_stop_loss": F.lit(90.0) + F.col("instrument_token"),
            "initial_controller": F.lit(95.0),
            "avg_sd": F.element_at(odd, (F.minute("start") % 5 + 1).cast("int")),
        }
    )
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = trailing_stop(held, cut(bars, cut_at) if cut_at else Blocks.single()).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = plain_stops(held.collect(), StopRule())
    assert len(got) == len(want)
    for r in got:
        *numbers, kind = want[(r.symbol, r.start)]
        values = [r.controller, r.controller_constant, r.lag_number, r.controller_sd, r.stop_loss]
        assert values == pytest.approx(numbers, rel=1e-9) and r.position_type == kind


def test_trailing_stop_writes_no_table_and_stays_lazy(bars, monkeypatch):
    from tickloom import session

    first = bars.groupBy("symbol").agg(F.min("start").alias("position_time"))
    held = bars.join(first, "symbol").withColumns(
        {"position_type": F.lit("long"), "initial_stop_loss": F.lit(90.0), "initial_controller": F.lit(95.0)}
    )
    blocks, before = cut(bars, 12), len(session._written)
    trailing_stop(held, blocks)
    assert len(session._written) == before


@pytest.mark.parametrize("cut_at", [None, 9])
def test_affine_scan(spark, bars, cut_at):
    """Steps that forget, and one that is not a number, against a loop."""
    place = F.row_number().over(Window.partitionBy("symbol").orderBy("start"))
    steps = bars.withColumn("n", place).withColumns(
        {
            "a": F.when(F.col("n") % 17 == 1, 0.0).otherwise(F.col("close") / 110),
            "b": F.when(F.col("n") == 5, F.lit(float("nan"))).otherwise(F.col("open") - 100),
        }
    )
    got = affine_scan(steps, "x", F.col("a"), F.col("b"), blocks=cut(bars, cut_at) if cut_at else Blocks.single())
    x = {}
    for r in sorted(got.collect(), key=lambda r: (r.symbol, r.n)):
        x[r.symbol] = r.b if r.a == 0 else r.a * x[r.symbol] + r.b
        assert r.x == pytest.approx(x[r.symbol], rel=1e-9, nan_ok=True)


@pytest.mark.parametrize("hold", [0, 3, 1000])
def test_states_that_last_over_blocks(spark, hold):
    """A recurrence that forgets after `hold` rows, or never: few runs of a block in any case."""
    rows = [(s, datetime(2024, 1, 1) + timedelta(days=d, minutes=s), s + d) for s in range(2) for d in range(12)]
    series = spark.createDataFrame(rows, "symbol long, start timestamp_ntz, value long")
    state = StructType().add("total", "long").add("seen", "long")
    output = StructType().add("symbol", "long").add("start", "timestamp_ntz").add("total", "long")
    runs = spark.sparkContext.accumulator(0)

    def step(before, rows):
        runs.add(1)
        now, totals = before, []
        for value in rows["value"].to_pylist():
            now = {"total": value, "seen": 0} if now is None else {"total": now["total"] * 2 + value, "seen": now["seen"] + 1}
            totals.append(now["total"])
            now = None if now["seen"] >= hold else now
        return now, pa.table([rows["symbol"], rows["start"], totals], names=output.names)

    got = fold_blocks(series, step, output, state, "symbol", "start", Blocks.spanning(series, "start", 1))
    result = {(r.symbol, r.start): r.total for r in got.collect()}
    for s in range(2):
        total, seen = None, 0
        for symbol, at, value in sorted(rows):
            if symbol == s:
                total, seen = (value, 0) if total is None else (total * 2 + value, seen + 1)
                assert result[(s, at)] == total
                total = None if seen >= hold else total
    assert runs.value <= {0: 24, 3: 72, 1000: 72}[hold]


@pytest.mark.parametrize("days", DAYS)
def test_reports_over_blocks(bars, days):
    blocks = cut(bars, days)
    one = Blocks.single()
    assert_same(baseline_volatility(bars, blocks=blocks), baseline_volatility(bars, blocks=one), ["symbol"])
    history = bars.withColumnRenamed("start", "date").drop("avg_sd")
    for (day,) in history.select(F.to_date("date")).distinct().limit(5).collect():
        assert_same(
            breakout_scan(history, day, 0.5, 0, blocks),
            breakout_scan(history, day, 0.5, 0, one),
            ["symbol", "date"],
        )


def test_breakouts_from_kept_statistics(bars, tmp_path):
    """Day by day or in leaps, and again: what the scan of the whole history gives, from one day of bars."""
    from tickloom.plans import days
    from tickloom.sources.files import write_history

    history = bars.withColumnRenamed("start", "date").drop("avg_sd")
    write_history(history, str(tmp_path / "history"))
    stored = bars.sparkSession.read.parquet(str(tmp_path / "history"))
    present = sorted(r[0] for r in history.select(F.to_date("date")).distinct().collect())
    found = 0
    for as_of in (present[3], present[4], present[len(present) // 2]):
        once = sorted(map(str, days.keep_day(stored, as_of - timedelta(days=1), str(tmp_path / "kept")).collect()))
        before = days.keep_day(stored, as_of - timedelta(days=1), str(tmp_path / "kept"))
        assert once == sorted(map(str, before.collect()))
        day = stored.filter(F.col("day") == F.lit(as_of))
        got = days.breakouts_of_day(day, before, 0.2, 0)
        assert_same(got, breakout_scan(history, as_of, 0.2, 0, Blocks.single()), ["symbol", "date"])
        found += got.count()
        assert before.agg(F.max(F.size("last"))).first()[0] <= 9
    assert found


def test_first_day_needed_is_enough_and_no_more(bars):
    history = bars.withColumnRenamed("start", "date").drop("avg_sd")
    day, one = F.to_date("date"), Blocks.single()
    checked = 0
    for (as_of,) in history.select(day).distinct().orderBy(day).collect()[::9]:
        whole = breakout_scan(history, as_of, 0, -1, one)
        first = first_day_needed(history, as_of)
        part = breakout_scan(history.filter(day >= F.lit(first)), as_of, 0, -1, one)
        assert_same(whole, part, ["symbol", "date"])
        checked += whole.count()
    assert checked > 0
    assert first_day_needed(history, "2023-01-01") is None


@pytest.mark.parametrize("tail", [20, 25, 40])
def test_bar_by_bar_is_what_the_last_bar_was(bars, tail):
    one = bars.filter("symbol = 'S0'").persist()
    every = {r.start: r for r in signals_bar_by_bar(one, tail, Blocks.single(), sd_factor=1.0).collect()}
    starts = sorted(every)
    for n in (1, 12, 19, 20, 22, 24, 25, 26, 33, 41, len(starts)):
        seen = one.filter(F.col("start") <= F.lit(starts[n - 1]))
        last = live_signals(seen, tail, sd_factor=1.0).first()
        got, want = every[last.start].asDict(), last.asDict()
        assert got.keys() == want.keys()
        for name, value in want.items():
            assert got[name] == (pytest.approx(value) if isinstance(value, float) else value)


@pytest.mark.parametrize("parts", [1, 7])
def test_partitions_and_row_order_change_nothing(bars, parts):
    mixed = bars.orderBy(F.rand(3)).repartition(parts)
    one = Blocks.single()
    assert_same(signal_history(mixed, one, sd_factor=1.0), signal_history(bars, one, sd_factor=1.0))


def test_skewed_series_equal_lone_series(spark, bars):
    """A symbol's result does not depend on how many rows other symbols have."""
    lone = bars.filter("symbol = 'S1'")
    blocks = cut(bars, 7)
    assert_same(
        signal_history(bars, blocks, sd_factor=1.0).filter("symbol = 'S1'"),
        signal_history(lone, blocks, sd_factor=1.0),
    )


def test_null_keys_times_and_prices_are_the_same_in_one_block_and_many(spark):
    from datetime import datetime

    rows = [(s, None if k == 0 else datetime(2024, 1, 10 * k), None if k == 2 else float(k), 1)
            for s in ("A", None) for k in range(4)]
    series = spark.createDataFrame(rows, "symbol string, start timestamp_ntz, close double, one long")
    parts = Blocks.spanning(series, "start", 5)
    assert parts.count > 1
    runs = {
        "rolling_sum": lambda b: windows.rolling_sum(series, "out", "close", 3, blocks=b),
        "running_sum": lambda b: windows.running_sum(series, "out", "one", blocks=b),
        "lag_prev": lambda b: windows.lag_prev(series, {"out": "close"}, blocks=b),
        "forward_fill": lambda b: windows.forward_fill(series, {"out": "close"}, blocks=b),
        "ema_fold": lambda b: windows.ema_fold(series, "out", "close", 0.5, blocks=b),
    }
    want = {
        "rolling_sum": [0, 1, 1, 4], "running_sum": [1, 2, 3, 4], "lag_prev": [None, 0, 1, None],
        "forward_fill": [0, 1, 1, 3], "ema_fold": [0, 0.5, 0.5, 1.75],
    }
    for name, run in runs.items():
        for blocks in (Blocks.single(), parts):
            got = {(r.symbol, r.start): r.out for r in run(blocks).collect()}
            assert len(got) == len(rows)
            for symbol in ("A", None):
                in_order = [got[(symbol, start)] for s, start, *_ in rows if s == symbol]
                assert in_order == want[name], (name, symbol, blocks)


def test_nan_bar_makes_no_trigger(spark, bars):
    hole = F.when(F.col("start") == F.lit(bars.agg(F.min("start")).first()[0]), F.lit(float("nan")))
    broken = bars.withColumns({c: F.coalesce(hole, F.col(c)) for c in ("high", "low", "close")})
    first = bars.agg(F.min("start")).first()[0]
    for blocks in (Blocks.single(), cut(bars, 12)):
        rows = signal_history(broken, blocks).collect()
        assert not any(r.trigger for r in rows if r.price is None or r.price != r.price)
        assert not [r for r in rows if r.start == first and r.trigger]
