"""Messages, clock, keyed joins and files on hand-made input."""

from datetime import date, datetime, timedelta

import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tickloom import schemas
from tickloom.functions import clock, codec
from tickloom.operators import keyed
from tickloom.plans.bars import backfill_ticks, enrich_ticks, merge_bars, minute_bars, ohlc_bars
from tickloom.plans.signals import breakout_scan, indicator_panel, live_signals, swing_segments
from tickloom.plans.universe import load_history, universe_join, universe_screen
from tickloom.sources import files

GOOD = (
    '{"instrument_token": 11, "symbol": "X&Y", "last_price": 5.5, "mode": "ltp", '
    '"tradable": true, "avg(sd)": %s, "date": "2024-01-01 09:15:00"}'
)


def messages(spark, *texts):
    return spark.createDataFrame([(t.encode(), i) for i, t in enumerate(texts)], "value binary, seq long")


def test_decode_edges(spark):
    df = messages(
        spark, GOOD % "0.5", GOOD % "NaN", GOOD % "null", "not json",
        GOOD.replace("instrument_token", "instrument_tok") % "1.0", "{}",
    )
    rows = codec.json_decode(df, schemas.TICK, keep=("seq",)).orderBy("seq").collect()
    assert [r.avg_sd for r in rows] == [0.5, None, None, None, 1.0, None]
    assert rows[0].tradable == "true"
    assert rows[0].date == datetime(2024, 1, 1, 9, 15)
    assert rows[4].instrument_token is None and rows[4].symbol == "X&Y"
    assert [r.seq for r in codec.json_rejects(df, schemas.TICK).orderBy("seq").collect()] == [3, 5]


def test_array_messages(spark):
    df = messages(spark, f"[{GOOD % '0.5'}, {GOOD % 'null'}]", "[]")
    rows = codec.json_array_explode(df, schemas.TICK, keep=("seq",)).collect()
    assert [(r.seq, r.position, r.avg_sd) for r in rows] == [(0, 0, 0.5), (0, 1, None)]


def test_encode_writes_nulls(spark):
    order = spark.createDataFrame([("A", None, "exit", None, None)], schemas.ORDER)
    text = order.select(codec.json_encode(order).alias("value")).first().value
    assert text == '{"symbol":"A","position_type":null,"type":"exit","price":null,"start":null}'


def test_empty_series(spark):
    keys = spark.createDataFrame([("A",), ("B",)], "symbol string")
    rows = spark.createDataFrame([("A", 2, 1.5), ("A", 1, 2.5)], "symbol string, start int, close double")
    got = codec.series_json(keys, rows, "symbol", "start", ["close"])  # every row of a key
    assert dict(map(tuple, got.collect())) == {"A": '[{"close":2.5},{"close":1.5}]', "B": "[]"}


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_round_minute_halves_go_to_even(spark, kind):
    texts = {
        "06:33:30": "06:34:00", "06:32:30": "06:32:00", "06:32:30.000001": "06:33:00",
        "06:32:29.999999": "06:32:00", "06:59:30": "07:00:00", "06:59:59": "07:00:00", "06:01:00": "06:01:00",
    }
    df = spark.createDataFrame([(f"2024-03-01 {t}",) for t in texts], "t string")
    rounded = df.select("t", clock.round_minute(F.col("t").cast(kind)).alias("m"))
    assert rounded.schema["m"].dataType.simpleString() == kind
    got = {r.t[11:]: r.m.strftime("%H:%M:%S") for r in rounded.collect()}
    assert got == texts


def test_business_days_match_pandas(spark):
    days = [date(2024, 1, 1) + timedelta(i) for i in range(30)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    ns = range(1, 13)
    rows = df.select("d", *[clock.business_days_back(F.col("d"), n).alias(str(n)) for n in ns]).collect()
    for row in rows:
        for n in ns:
            assert row[str(n)] == (pd.Timestamp(row.d) - pd.offsets.BDay(n)).date()


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_epoch_nanos(spark, kind):
    text = "2024-02-29 23:59:58.123456"
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(clock.epoch_nanos(F.col("t").cast(kind)).alias("n")).first().n
    assert got == pd.Timestamp(text).value


def test_upserts_keep_known_values(spark):
    schema = "k string, a int, b int"
    old = spark.createDataFrame([("x", 1, None), ("y", 2, 3)], schema)
    new = spark.createDataFrame([("x", None, 5), ("z", 6, None)], schema)
    upserted = sorted(map(tuple, keyed.coalescing_upsert(new, old, "k").collect()))
    assert upserted == [("x", 1, 5), ("y", 2, 3), ("z", 6, None)]
    updated = sorted(map(tuple, keyed.masked_update(old, new, "k").collect()))
    assert updated == [("x", 1, 5), ("y", 2, 3)]
    assert [r.k for r in keyed.drop_closed(old, new, "k").collect()] == ["y"]


def test_unique_keys_are_required(spark):
    inst = spark.createDataFrame([("A", 1, "NSE"), ("A", 2, "NSE")], schemas.INSTRUMENT)
    margins = spark.createDataFrame([("A", 5.0)], schemas.MARGIN)
    with pytest.raises(PySparkException, match="key occurs twice: A"):
        universe_join(inst, margins).collect()
    assert universe_join(inst.filter("instrument_token = 1"), margins).count() == 1


def test_screen_is_strict_and_needs_history(spark):
    universe = spark.createDataFrame([("A", 1, 5.0), ("B", 2, 6.0), ("C", 3, 7.0)], schemas.UNIVERSE)
    daily = spark.createDataFrame(
        [(1, 30.0, 100.0), (1, 50.0, 300.0), (2, 10.0, 1.0)], "instrument_token long, close double, volume double"
    )
    # values: A 40 * 200 = 8000, B 10; mean 4005
    assert [tuple(r) for r in universe_screen(universe, daily).collect()] == [(1, "A", 5.0)]
    assert universe_screen(universe, daily, value_factor=8000 / 4005).count() == 0
    assert universe_screen(universe, daily, min_price=40).count() == 0


TICK = "instrument_token long, symbol string, last_price double, date timestamp_ntz, seq long"


def test_four_ticks_of_one_moment_make_their_bar(spark):
    at = datetime(2024, 1, 1, 9, 15)
    history = spark.createDataFrame(
        [(1, "A", at + timedelta(minutes=i), 10.0 + i, 12.0 + i, 9.0 + i, 11.0 + i, 0.5) for i in range(40)],
        "instrument_token long, symbol string, start timestamp_ntz, open double, high double, low double, close double, avg_sd double",
    )
    ticks = backfill_ticks(history)
    assert ticks.count() == 120
    assert ticks.agg(F.max("seq")).first()[0] < 0
    bars = ohlc_bars(ticks)
    left = bars.select("start", "open", "high", "low", "close", "avg_sd").orderBy("start").collect()
    assert left == history.select("start", "open", "high", "low", "close", "avg_sd").orderBy("start").collect()[10:]


def test_zero_prices_go_and_missing_ones_stay(spark):
    at = datetime(2024, 1, 1)
    ticks = spark.createDataFrame([(1, "", 0.0, at, 1), (1, "", None, at, 2), (9, "", 3.0, at, 3)], TICK)
    known = spark.createDataFrame([(1, "A", 0.5)], "instrument_token long, symbol string, avg_sd double")
    rows = enrich_ticks(ticks, known).orderBy("seq").collect()
    assert [(r.seq, r.symbol) for r in rows] == [(2, "A"), (3, None)]


def test_merging_halves_equals_merging_all(spark):
    at = datetime(2024, 1, 1, 9, 15)
    ticks = spark.createDataFrame(
        [(1, "A", float((i * 37) % 50), at + timedelta(seconds=7 * i), i) for i in range(60)], TICK
    )
    none = spark.createDataFrame([], "symbol string, date timestamp_ntz, open double, high double, low double, close double, key string")
    whole = merge_bars(none, minute_bars(ticks))
    halves = merge_bars(merge_bars(none, minute_bars(ticks.filter("seq < 31"))), minute_bars(ticks.filter("seq >= 31")))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, halves.collect()))
    assert whole.filter("key is null").count() == 0


def flat_bars(spark, closes):
    at = datetime(2024, 1, 1, 9, 15)
    return spark.createDataFrame(
        [("A", 1, at + timedelta(minutes=i), c, c + 1, c - 1, c, 0.1) for i, c in enumerate(map(float, closes))],
        "symbol string, instrument_token long, start timestamp_ntz, open double, high double, low double, close double, avg_sd double",
    )


def test_warm_up_is_null_and_long(spark):
    panel = indicator_panel(flat_bars(spark, range(30, 60)), tail=None)
    rows = panel.orderBy("start").collect()
    assert [r.sd is None for r in rows].index(False) == 9
    assert [r.atr is None for r in rows].index(False) == 2
    assert [r.macd is None for r in rows].index(False) == 19
    swings = swing_segments(panel).orderBy("start").collect()
    assert {r.position_type for r in swings[:19]} == {"long"}
    assert swings[0].group_id == 1


def test_tail_cuts_windows(spark):
    rows = indicator_panel(flat_bars(spark, range(30, 80))).orderBy("start").collect()
    assert len(rows) == 25
    assert [r.sd is None for r in rows].index(False) == 9
    last = live_signals(flat_bars(spark, range(30, 80))).collect()
    assert [r.start.minute for r in last] == [(15 + 49) % 60]


def test_quiet_market_gives_an_empty_report(spark):
    history = flat_bars(spark, [50.0] * 30).withColumnRenamed("start", "date").drop("avg_sd")
    assert breakout_scan(history, "2024-01-01").count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "list.csv").write_text(",symbol,instrument_token,margin\n0,X&Y,7,12.5\n1,B-A,8,3.0\n")
    rows = files.read_csv(spark, str(tmp_path / "list.csv"), schemas.TRADABLE)
    assert rows.columns == ["instrument_token", "symbol", "margin"]
    assert sorted(map(tuple, rows.collect())) == [(7, "X&Y", 12.5), (8, "B-A", 3.0)]
    text = spark.createDataFrame([("a, \"b\"", 1)], "status_message string, order_id long")
    files.write_csv(text, str(tmp_path / "out"))
    back = files.read_csv(spark, str(tmp_path / "out"), text.schema)
    assert back.collect() == text.collect()
    (tmp_path / "m.json").write_text('[{"tradingsymbol": "A", "mis_multiplier": 5, "x": 1},\n {"tradingsymbol": "B"}]')
    got = files.read_json_document(spark, str(tmp_path / "m.json"), schemas.MARGIN)
    assert sorted(map(tuple, got.collect())) == [("A", 5.0), ("B", None)]


def test_history_is_pruned_by_day(spark, tmp_path):
    path = str(tmp_path / "history")
    rows = [(datetime(2024, 1, d, 10), float(d), 1) for d in range(1, 11)]
    history = spark.createDataFrame(rows, "date timestamp, close double, instrument_token long")
    files.write_history(history, path)
    universe = spark.createDataFrame([(1, "A")], "instrument_token long, symbol string")
    loaded = load_history(universe, files.read_table(spark, path), "2024-01-03", "2024-01-05")
    assert sorted(r.close for r in loaded.collect()) == [3.0, 4.0, 5.0]
    plan = loaded._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    files.write_history(history.filter("close = 4").withColumn("close", F.lit(40.0)), path)
    assert files.read_table(spark, path).agg(F.sum("close")).first()[0] == 55 - 4 + 40
