"""Streams give what the batch jobs give, however the input is split."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from helpers import assert_same, random_bars
from tickloom import schemas
from tickloom.operators.blocks import Blocks
from tickloom.plans.account import capital_admission
from tickloom.plans.bars import bar_messages, merge_bars, minute_bars, ohlc_bars
from tickloom.plans.positions import lifecycle_orders, position_lifecycle
from tickloom.plans.signals import signals_bar_by_bar
from tickloom.sources.topics import MESSAGE, read_records, write_records
from tickloom.streaming import jobs
from tickloom.streaming.late import LateSplit, late_job, newest_table
from tickloom.streaming.store import BarLog, VersionedTable

BAR_TABLE = (
    "instrument_token long, symbol string, start timestamp, `end` timestamp, open double, "
    "high double, low double, close double, avg_sd double"
)
THRESHOLDS = {"sd_factor": 0.5, "natr_min": 0.0}


def folder(path, per_trigger=1):
    return {"format": "parquet", "path": str(path), "maxFilesPerTrigger": str(per_trigger)}


def out(path):
    return {"format": "parquet", "path": str(path)}


def messages_of(spark, path, schema):
    from tickloom.functions.codec import json_decode

    raw = spark.read.schema(MESSAGE).option("recursiveFileLookup", "true").parquet(str(path))
    return json_decode(raw, schema, keep=("seq",))


def ticks(spark, minutes=70):
    start, rows, seq = datetime(2024, 1, 1, 9, 15), [], 0
    for minute in range(minutes):
        for second in (1, 20, 59):
            for token, symbol in enumerate(["A", "X&Y"]):
                price = 100 + (minute * 7 + second * 3 + token * 11) % 23 + minute % 5 / 4
                rows.append((token, symbol, price, "ltp", "true", 0.3, start + timedelta(minutes=minute, seconds=second), seq))
                seq += 1
    return spark.createDataFrame(rows, StructType([*schemas.TICK, StructField("seq", LongType())]))


def send_ticks(df, path, cuts):
    """One file per cut of the sequence, in order."""
    from tickloom.functions.codec import json_encode

    encoded = df.select(json_encode(df, schemas.TICK.names).alias("value"), "seq")
    for i, (low, high) in enumerate(zip(cuts, cuts[1:])):
        part = encoded.filter((F.col("seq") >= low) & (F.col("seq") < high)).coalesce(1)
        part.write.parquet(f"{path}/part={i}")


def run_signals(spark, base, mode="append", cuts=(0, 50, 51, 200, 300, 420, 421)):
    df = ticks(spark).persist()
    send_ticks(df, base / "trigger", cuts)
    stage = jobs.SignalStage(out(base / "position"), thresholds=THRESHOLDS)
    stream = read_records(spark, folder(base / "trigger"), schemas.TICK)
    jobs.bar_job(stream, out(base / "bars"), str(base / "cp-bars"), mode=mode).awaitTermination()
    jobs.signal_job(spark, folder(base / "bars"), stage, str(base / "cp-signals")).awaitTermination()
    return df


def test_signals_of_a_stream_equal_batch(spark, tmp_path):
    df = run_signals(spark, tmp_path)
    got = messages_of(spark, tmp_path / "position", schemas.SIGNAL).drop("seq")
    bars = ohlc_bars(df)
    closed = bars.filter("end <= timestamp'2024-01-01 10:24:57'")
    want = signals_bar_by_bar(closed, blocks=Blocks.single(), **THRESHOLDS)
    assert closed.count() == 138
    assert got.filter("trigger").count() > 0
    assert_same(got, want.select(*got.columns))


def test_growing_bars_end_as_the_closed_ones(spark, tmp_path):
    df = run_signals(spark, tmp_path, mode="update", cuts=(0, 5, 11, 200, 301, 421))
    got = messages_of(spark, tmp_path / "position", schemas.SIGNAL)
    last = got.groupBy("symbol", "start").agg(F.max_by(F.struct(*schemas.SIGNAL.names), "seq").alias("s")).select("s.*")
    want = signals_bar_by_bar(ohlc_bars(df), blocks=Blocks.single(), **THRESHOLDS)
    same = ["symbol", "start", "open", "high", "low", "close", "avg_sd"]
    assert_same(last.select(*same), want.select(*same))


def tail_state(query):
    return [p["stateOperators"][-1] for p in query.recentProgress if p["stateOperators"]]


def test_a_batch_writes_the_state_of_its_own_symbols(spark, tmp_path):
    """One row of state per symbol, however many bars; a batch of one symbol updates one of them."""
    bars = ohlc_bars(ticks(spark)).persist()
    halves = [bars.filter("minute(start) < 40 and hour(start) = 9"), bars.filter("symbol = 'A' and hour(start) = 10")]
    for i, part in enumerate(halves):
        write_records(part.withColumn("fresh", F.lit(True)).coalesce(1), out(tmp_path / "bars"), jobs.BAR_MESSAGE, i)
    stage = jobs.SignalStage(out(tmp_path / "position"), thresholds=THRESHOLDS)
    query = jobs.signal_job(spark, folder(tmp_path / "bars"), stage, str(tmp_path / "cp"))
    query.awaitTermination()
    states = [(s["numRowsTotal"], s["numRowsUpdated"]) for s in tail_state(query) if s["numRowsUpdated"]]
    assert states == [(2, 2), (2, 1)]
    told = messages_of(spark, tmp_path / "position", schemas.SIGNAL)
    assert told.count() == sum(part.count() for part in halves)


def test_warm_start(spark, tmp_path):
    """Bars stored before the stream began count in its first signals."""
    df = ticks(spark).persist()
    early = F.col("date") < F.lit("2024-01-01 09:50:00").cast("timestamp")
    usual = spark.createDataFrame([("A", 0.3), ("X&Y", 0.3)], "symbol string, avg_sd double")
    stored = jobs.warm_tails(ohlc_bars(df.filter(early)), usual)
    jobs.stored_to_topic(stored.coalesce(1), out(tmp_path / "bars"))
    stage = jobs.SignalStage(out(tmp_path / "position"), thresholds=THRESHOLDS)
    send_ticks(df.filter(~early), tmp_path / "trigger", (0, 300, 421))
    stream = read_records(spark, folder(tmp_path / "trigger"), schemas.TICK)
    jobs.bar_job(stream, out(tmp_path / "bars"), str(tmp_path / "cp-bars")).awaitTermination()
    jobs.signal_job(spark, folder(tmp_path / "bars"), stage, str(tmp_path / "cp")).awaitTermination()
    got = messages_of(spark, tmp_path / "position", schemas.SIGNAL).drop("seq")
    closed = ohlc_bars(df).filter("end <= timestamp'2024-01-01 10:24:57'")
    want = signals_bar_by_bar(closed, blocks=Blocks.single(), **THRESHOLDS)
    late = want.filter(F.col("start") >= F.lit("2024-01-01 09:50:00").cast("timestamp"))
    assert late.count() == 68
    assert_same(got, late.select(*got.columns))


def signal_topic(spark, base, parts):
    signals = signals_bar_by_bar(
        random_bars(spark, symbols=2, bars=160, gap_days=0.01, avg_sd=0.2),
        blocks=Blocks.single(), sd_factor=1.0, natr_min=0.0,
    ).withColumn("start", F.col("start").cast("timestamp")).persist()
    ranks = signals.select("start").distinct().toPandas()["start"].sort_values().tolist()
    edges = [ranks[len(ranks) * i // parts] for i in range(parts)] + [ranks[-1] + timedelta(days=1)]
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        part = signals.filter((F.col("start") >= F.lit(low)) & (F.col("start") < F.lit(high)))
        write_records(part.coalesce(1), out(base / "position"), schemas.SIGNAL.names, i)
    return signals


@pytest.mark.parametrize("parts", [1, 4])
def test_orders_of_a_stream_equal_batch(spark, tmp_path, parts):
    signals = signal_topic(spark, tmp_path, parts)
    query = jobs.position_job(spark, folder(tmp_path / "position"), out(tmp_path / "orders"), str(tmp_path / "cp"))
    query.awaitTermination()
    got = messages_of(spark, tmp_path / "orders", schemas.ORDER)
    want = lifecycle_orders(position_lifecycle(signals, Blocks.single()))
    key = ["symbol", "start", "type"]
    assert want.filter("type = 'exit'").count() > 0
    assert_same(got.drop("seq"), want.drop("step"), key)


def test_positions_restart_from_the_checkpoint(spark, tmp_path):
    signals = signal_topic(spark, tmp_path, 4)
    whole = tmp_path / "position"
    for i in range(4):
        # the folder grows between runs of the same query
        target = tmp_path / "arriving" / f"batch={i}"
        spark.read.parquet(str(whole / f"batch={i}")).coalesce(1).write.parquet(str(target))
        jobs.position_job(
            spark, folder(tmp_path / "arriving"), out(tmp_path / "orders"), str(tmp_path / "cp")
        ).awaitTermination()
    got = messages_of(spark, tmp_path / "orders", schemas.ORDER)
    want = lifecycle_orders(position_lifecycle(signals, Blocks.single()))
    assert_same(got.drop("seq"), want.drop("step"), ["symbol", "start", "type"])


def test_growing_bar_is_taken_anew():
    from tickloom.operators.stop import Bar
    from tickloom.streaming.jobs import SymbolState

    at = datetime(2024, 1, 1, 9, 15)

    def bar(minute, high, low, close, trigger=False):
        return Bar(at + timedelta(minutes=minute), high, low, close, trigger, "long", 8.0, 9.0, 1.0)

    once, twice = SymbolState(), SymbolState()
    for b in [bar(0, 10, 9, 9.5, True), bar(1, 11, 9.5, 10), bar(2, 12, 9.9, 11)]:
        once.take(b)
        twice.take(Bar(*b[:1], b.high, b.low + 0.05, *b[3:]))
        twice = SymbolState(twice.text())
        again = twice.take(b)
        assert not again.entered
    assert twice.position == once.position
    assert twice.take(bar(1, 1, 1, 1)) is None
    left = twice.take(bar(3, 12, 1.0, 1.0))
    assert left.exited and twice.position is None


def one_signal(symbol, minute, close, trigger=False):
    at = datetime(2024, 1, 1, 9, 15) + timedelta(minutes=minute)
    return {
        "open": close, "high": close + 1, "low": close - 1, "close": close, "start": at, "trigger": trigger,
        "price": close, "instrument_token": 1, "symbol": symbol, "source": "entry", "position_type": "long",
        "initial_stop_loss": 8.0, "initial_controller": 9.0, "avg_sd": 1.0,
    }


def send_signals(spark, base, batches):
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([tuple(r[c] for c in schemas.SIGNAL.names) for r in rows], schemas.SIGNAL)
        write_records(df.coalesce(1), out(base / "position"), schemas.SIGNAL.names, i)


def test_a_late_bar_is_told(spark, tmp_path):
    send_signals(spark, tmp_path, [
        [one_signal("A", 0, 10.0, True), one_signal("A", 2, 11.0)],
        [one_signal("A", 1, 1.0), one_signal("B", 1, 10.0)],  # A's would have hit the stop
        [one_signal("A", 3, 12.0)],
    ])
    jobs.position_job(
        spark, folder(tmp_path / "position"), out(tmp_path / "orders"), str(tmp_path / "cp"), late=out(tmp_path / "late")
    ).awaitTermination()
    orders = messages_of(spark, tmp_path / "orders", schemas.ORDER).collect()
    assert [(r.symbol, r.type) for r in orders] == [("A", "entry")]
    late = messages_of(spark, tmp_path / "late", schemas.ORDER).collect()
    assert [(r.symbol, r.start.minute) for r in late] == [("A", 16)]


def test_state_of_a_quiet_symbol_without_position_goes(spark, tmp_path):
    send_signals(spark, tmp_path, [
        [one_signal("A", 0, 10.0, True), one_signal("B", 0, 10.0), one_signal("C", 0, 10.0)],
        [one_signal("A", 1, 11.0)],
        [one_signal("A", 2, 1.0)],  # left
        [one_signal("D", 60, 10.0, True)],
        [one_signal("D", 61, 10.0)],
    ])
    query = jobs.position_job(
        spark, folder(tmp_path / "position"), out(tmp_path / "orders"), str(tmp_path / "cp"),
        quiet=timedelta(minutes=10),
    )
    query.awaitTermination(120)
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert rows[0] == 3 and rows[-1] == 1  # D, which is held
    orders = messages_of(spark, tmp_path / "orders", schemas.ORDER).collect()
    assert sorted((r.symbol, r.type) for r in orders) == [("A", "entry"), ("A", "exit"), ("D", "entry")]


def test_late_rows_go_to_a_topic_of_their_own(spark, tmp_path):
    """None lost, none twice, whatever repeats; the query behind drops none."""
    at = datetime(2024, 1, 1, 9, 15)
    seconds = [[0, 30, 61], [3600, 1], [2, 3500, 3601, 7200], [3, 7201, None], [20000], [6000, 19990, 20001]]
    columns = ["symbol", "last_price", "date"]
    for i, batch in enumerate(seconds):
        rows = [("A", float(i * 10 + k), s if s is None else at + timedelta(seconds=s), i * 10 + k) for k, s in enumerate(batch)]
        df = spark.createDataFrame(rows, "symbol string, last_price double, date timestamp, seq long")
        write_records(df.coalesce(1), out(tmp_path / "in"), columns, i)
    schema = StructType([schemas.TICK[c] for c in columns])
    stage = LateSplit(newest_table(spark, str(tmp_path / "newest")), out(tmp_path / "live"), out(tmp_path / "late"), columns)
    late_job(read_records(spark, folder(tmp_path / "in"), schema), stage, str(tmp_path / "cp")).awaitTermination()
    last = spark.createDataFrame(rows, "symbol string, last_price double, date timestamp, seq long")
    stage(last, len(seconds) - 1)  # a repeated batch changes nothing
    late = {r.seq for r in messages_of(spark, tmp_path / "late", schema).collect()}
    live = {r.seq for r in messages_of(spark, tmp_path / "live", schema).collect()}
    newest, want = None, set()
    for i, batch in enumerate(seconds):
        for k, s in enumerate(batch):
            if s is not None and newest is not None and (s + 900) // 60 * 60 + 60 - 900 <= newest - 2:
                want.add(i * 10 + k)
        newest = max([s for s in batch if s is not None] + ([newest] if newest is not None else []))
    assert late == want and want
    assert live | late == {i * 10 + k for i, b in enumerate(seconds) for k in range(len(b))} and not live & late


def test_orders_go_by_the_intent_that_opened_the_position(spark, tmp_path):
    """Two accounts on one symbol; the answer comes a batch late; an old order's answer changes nothing."""
    columns = (
        "account_id string, symbol string, instrument_token long, margin double, position boolean, "
        "position_type string, order_id long, filled_quantity double, quantity double, intent_id string"
    )
    ledger = spark.createDataFrame(
        [(a, "A", 1, 5.0, False, None, None, 0.0, 0.0, None) for a in ("x", "y")], columns
    )
    books = VersionedTable(spark, str(tmp_path / "ledger"), ledger)
    budgets = VersionedTable(spark, str(tmp_path / "budget"), jobs.initial_budgets(ledger))
    known = []

    def statuses():
        return spark.createDataFrame(known, "intent_id string, order_id long, filled_quantity double")

    stage = jobs.AccountStage(books, budgets, str(tmp_path / "intents"), statuses=statuses)

    def run(batch_id, kind):
        row = ("A", "long", kind, 10.0, None, batch_id)
        stage(spark.createDataFrame([row], "symbol string, position_type string, type string, price double, start timestamp, seq long"), batch_id)
        told = spark.read.parquet(str(tmp_path / f"intents/batch={batch_id}")).collect()
        return sorted((r.account_id, r.action, r.side or "", r.quantity or 0.0, r.order_id or 0, r.intent_id) for r in told)

    assert run(0, "entry") == [(a, "place", "BUY", 10_000.0, 0, f"{a}:A:0") for a in ("x", "y")]
    known += [("x:A:0", 70, 4_000.0), ("y:A:0", 71, 0.0)]
    assert run(1, "exit") == [
        ("x", "modify", "", 4_000.0, 70, "x:A:0"), ("x", "place", "SELL", 4_000.0, 0, "x:A:1:close"),
        ("y", "cancel", "", 0.0, 71, "y:A:0"),
    ]
    run(2, "entry")  # known are the orders of batch 0 only: the new position is not theirs
    after = {r.account_id: r for r in books.version(2).collect()}
    assert {(r.order_id, r.filled_quantity, r.intent_id) for r in after.values()} == {
        (None, 10_000.0, "x:A:2"), (None, 10_000.0, "y:A:2")
    }
    known.append(("x:A:2", 80, 10_000.0))
    assert run(3, "exit") == [(a, "place", "SELL", 10_000.0, 0, f"{a}:A:3:close") for a in ("x", "y")]
    assert {r.intent_id for r in books.version(3).collect()} == {None}


def test_account_over_batches(spark, tmp_path):
    ledger = spark.createDataFrame(
        [("a", s, i, m, False, None, None, 0.0, 0.0) for i, (s, m) in enumerate([("A", 1.0), ("B", 1.0), ("C", 2.0)])],
        "account_id string, symbol string, instrument_token long, margin double, position boolean, "
        "position_type string, order_id long, filled_quantity double, quantity double",
    )
    books = VersionedTable(spark, str(tmp_path / "ledger"), ledger)
    budgets = VersionedTable(spark, str(tmp_path / "budget"), jobs.initial_budgets(ledger))
    batches = [
        [("A", "long", "entry", 40.0, None), ("B", "long", "entry", 40.0, None), ("Z", "long", "entry", 1.0, None)],
        [("A", None, "exit", None, None), ("B", "short", "entry", 50.0, None)],
        [("C", "short", "entry", 50.0, None)],
    ]
    for i, rows in enumerate(batches):
        write_records(spark.createDataFrame(rows, schemas.ORDER).coalesce(1), out(tmp_path / "orders"), schemas.ORDER.names, i)
    stage = jobs.AccountStage(books, budgets, str(tmp_path / "intents"))
    jobs.account_job(spark, folder(tmp_path / "orders"), stage, str(tmp_path / "cp")).awaitTermination()
    told = spark.read.parquet(str(tmp_path / "intents")).collect()
    assert sorted((r.batch, r.symbol, r.action, r.side, r.quantity) for r in told) == [
        (0, "A", "place", "BUY", 2500.0),  # B would use up the budget
        (1, "A", "place", "SELL", 2500.0),  # released after the batch's entries
        (2, "C", "place", "SELL", 2000.0),
    ]
    assert budgets.version(2).first().budget == 150_000.0
    stage(spark.createDataFrame(batches[2], schemas.ORDER).withColumn("seq", F.lit(2)), 2)
    assert budgets.version(2).first().budget == 150_000.0  # a repeated batch changes nothing


def test_enriched_ticks_and_status(spark, tmp_path):
    live = ticks(spark, 3).withColumn("last_price", F.when(F.col("seq") > 0, F.col("last_price")).otherwise(0.0))
    send_ticks(live, tmp_path / "live", (0, 9, 18))
    reference = spark.createDataFrame([(0, "A", 0.7)], "instrument_token long, symbol string, avg_sd double")
    stream = read_records(spark, folder(tmp_path / "live"), schemas.TICK)
    jobs.enrich_job(stream, reference, out(tmp_path / "trigger"), str(tmp_path / "cp")).awaitTermination()
    got = messages_of(spark, tmp_path / "trigger", schemas.TICK)
    assert got.count() == 17
    assert {(r.symbol, r.avg_sd) for r in got.collect()} == {("A", 0.7), (None, None)}

    columns = ["order_id", "order_timestamp", "status"]
    empty = spark.createDataFrame([], "order_id long, order_timestamp string, status string")
    table = VersionedTable(spark, str(tmp_path / "status"), empty)
    for i, state in enumerate(["OPEN", "COMPLETE"]):
        text = json.dumps({"order_id": 7, "order_timestamp": f"2024-01-01 10:00:0{i}", "status": state})
        spark.createDataFrame([(text, i)], MESSAGE).coalesce(1).write.parquet(str(tmp_path / f"statuses/batch={i}"))
    records = read_records(spark, folder(tmp_path / "statuses"), schemas.ORDER_STATUS).select(*columns)
    jobs.status_job(records, table, str(tmp_path / "cp2")).awaitTermination()
    assert [tuple(r) for r in table.version(1).collect()] == [(7, "2024-01-01 10:00:01", "COMPLETE")]


def test_ingest_stamp(spark, tmp_path):
    """A live tick is dated when it is taken in, whatever time it brings."""
    send_ticks(ticks(spark, 1), tmp_path / "live", (0, 6))
    reference = spark.createDataFrame([(0, "A", 0.7)], "instrument_token long, symbol string, avg_sd double")
    before = spark.sql("SELECT date_trunc('second', current_timestamp()) AS t").first().t
    stream = read_records(spark, folder(tmp_path / "live"), schemas.TICK)
    jobs.enrich_job(stream, reference, out(tmp_path / "trigger"), str(tmp_path / "cp"), stamp=True).awaitTermination()
    dates = {r.date for r in messages_of(spark, tmp_path / "trigger", schemas.TICK).collect()}
    after = spark.sql("SELECT current_timestamp() AS t").first().t
    assert dates and all(before <= d <= after and d.microsecond == 0 for d in dates)


def test_array_messages_on_the_live_path(spark, tmp_path):
    """Single objects, arrays, empty ones and broken text in one topic; records keep their order."""
    def tick(price):
        return {"instrument_token": 1, "symbol": "A", "last_price": price, "date": "2024-01-01 09:15:00"}

    texts = [tick(1.0), [tick(2.0), tick(3.0)], [], "broken", [tick(4.0)], {"symbol": "A", "last_price": 5.0}]
    rows = [(t if isinstance(t, str) else json.dumps(t), i) for i, t in enumerate(texts)]
    rows[4] = ("  " + rows[4][0], 4)
    spark.createDataFrame(rows, MESSAGE).coalesce(1).write.parquet(str(tmp_path / "in/batch=0"))
    seen = []
    records = read_records(spark, folder(tmp_path / "in"), schemas.TICK, arrays=True)
    writer = records.writeStream.foreachBatch(lambda df, _: seen.extend(df.collect()))
    jobs.start(writer, str(tmp_path / "cp")).awaitTermination()
    assert [r.last_price for r in sorted(seen, key=lambda r: r.seq)] == [1.0, 2.0, 3.0, 4.0, 5.0]


def test_merged_bars_and_their_messages(spark, tmp_path):
    df = ticks(spark, 10).persist()
    send_ticks(df, tmp_path / "trigger", (0, 7, 8, 31, 60))
    at = datetime(2024, 1, 1, 9, 15)
    stored = spark.createDataFrame(
        [("A", at, 1.0, 500.0, 99.0, 2.0, "kept"), ("B", at, 1.0, 2.0, 0.5, 1.5, "other")],
        "symbol string, date timestamp, open double, high double, low double, close double, key string",
    )
    log = BarLog(spark, str(tmp_path / "log"), stored)
    stream = read_records(spark, folder(tmp_path / "trigger"), schemas.TICK)
    jobs.merge_job(stream, log, str(tmp_path / "messages"), str(tmp_path / "cp")).awaitTermination()
    want = merge_bars(stored, minute_bars(df))
    assert_same(log.bars(), want, ["symbol", "date"])
    first = {r.symbol: r for r in log.bars().collect() if r.date == at}
    assert (first["A"].open, first["A"].high, first["A"].key) == (1.0, 500.0, "kept")
    assert first["B"].close == 1.5
    told = spark.read.parquet(str(tmp_path / "messages"))
    last = told.groupBy("key").agg(F.max_by("message", "batch").alias("message"))
    assert_same(last, bar_messages(want.filter("symbol <> 'B'"), "date"), ["key"])
    before = log.bars().collect()
    touched = minute_bars(df.filter("seq >= 31")).select("symbol", "date")
    last = minute_bars(df).join(touched, ["symbol", "date"], "left_semi")
    log.record(last, 3)  # a repeated batch changes nothing
    assert sorted(map(str, log.bars().collect())) == sorted(map(str, before))
    compact = log.compacted(str(tmp_path / "compact"))
    assert sorted(map(str, compact.bars().collect())) == sorted(map(str, before))
    compact.record(last, 3)
    assert sorted(map(str, compact.bars().collect())) == sorted(map(str, before))


def test_a_batch_of_bars_does_not_look_at_earlier_ones(spark, tmp_path):
    """Each batch tells its own bars though the folders of all others are gone."""
    df = ticks(spark, 6).persist()
    send_ticks(df, tmp_path / "trigger", (0, 9, 18, 36))
    stored = spark.createDataFrame([], BarLog.COLUMNS)
    log = BarLog(spark, str(tmp_path / "log"), stored)
    tell = log.changed_by

    def tell_and_forget(batch_id):
        for k in range(batch_id):
            (tmp_path / f"log/batch={k}").rename(tmp_path / f"gone-{batch_id}-{k}") if (tmp_path / f"log/batch={k}").exists() else None
        return tell(batch_id)

    log.changed_by = tell_and_forget
    stream = read_records(spark, folder(tmp_path / "trigger"), schemas.TICK)
    query = jobs.merge_job(stream, log, str(tmp_path / "messages"), str(tmp_path / "cp"))
    query.awaitTermination()
    told = spark.read.parquet(str(tmp_path / "messages"))
    last = told.groupBy("key").agg(F.max_by("message", "batch").alias("message"))
    assert_same(last, bar_messages(merge_bars(stored, minute_bars(df)), "date"), ["key"])


def test_state_of_bars_that_can_no_longer_grow_goes(spark, tmp_path):
    df = ticks(spark, 70).persist()
    send_ticks(df, tmp_path / "trigger", (0, 200, 400, 421))
    log = BarLog(spark, str(tmp_path / "log"), spark.createDataFrame([], BarLog.COLUMNS))
    stream = read_records(spark, folder(tmp_path / "trigger"), schemas.TICK)
    query = jobs.merge_job(stream, log, str(tmp_path / "messages"), str(tmp_path / "cp"), delay="5 minutes")
    query.awaitTermination()
    rows = [s["numRowsTotal"] for s in tail_state(query)]
    assert 0 < rows[-1] <= 20 < max(rows)
    assert_same(log.bars(), merge_bars(spark.createDataFrame([], BarLog.COLUMNS), minute_bars(df)), ["symbol", "date"])


def test_rejects_are_kept(spark, tmp_path):
    texts = ['{"symbol": "A", "type": "exit"}', "no json", "{}"]
    rows = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], MESSAGE)
    rows.write.parquet(str(tmp_path / "orders"))
    topic = folder(tmp_path / "orders")
    jobs.reject_job(spark, topic, schemas.ORDER, str(tmp_path / "bad"), str(tmp_path / "cp")).awaitTermination()
    assert {r.value for r in spark.read.parquet(str(tmp_path / "bad")).collect()} == set(texts[1:])


def test_late_ticks(spark, tmp_path):
    """A tick behind the watermark is lost once the watermark has moved, and not before."""
    at = datetime(2024, 1, 1, 9, 15)
    rows = [(0, 10.0, 0), (3600, 11.0, 1), (1, 12.0, 2), (7200, 13.0, 3), (2, 14.0, 4), (9000, 15.0, 5)]
    for i, (second, price, seq) in enumerate(rows):
        text = json.dumps({"instrument_token": 1, "symbol": "A", "last_price": price, "date": str(at + timedelta(seconds=second))})
        spark.createDataFrame([(text, seq)], MESSAGE).coalesce(1).write.parquet(str(tmp_path / f"in/batch={i}"))
    seen = []
    bars = ohlc_bars(read_records(spark, folder(tmp_path / "in"), schemas.TICK))
    query = jobs.start(
        bars.writeStream.outputMode("append").foreachBatch(lambda df, _: seen.extend(df.collect())), str(tmp_path / "cp")
    )
    query.awaitTermination()
    closes = {r.start.hour * 60 + r.start.minute: r.close for r in seen}
    assert closes[9 * 60 + 15] in (10.0, 12.0)
    assert 14.0 not in closes.values()
    assert closes[10 * 60 + 15] == 11.0


def test_admission_takes_a_budget_column(spark):
    orders = spark.createDataFrame(
        [("a", "A", "entry", "long", 10.0, 1, 50_000.0), ("b", "A", "entry", "long", 10.0, 1, 10_000.0)],
        "account_id string, symbol string, type string, position_type string, price double, seq long, budget double",
    )
    book = spark.createDataFrame(
        [("a", "A", 1, 5.0, False), ("b", "A", 1, 5.0, False)],
        "account_id string, symbol string, instrument_token long, margin double, position boolean",
    )
    rows = capital_admission(orders, book, "account_id", F.col("budget")).collect()
    assert [r.account_id for r in rows] == ["a"]
