"""The stream stages over the given tables, drained to the end and read back."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom import schemas
from tickloom.functions.codec import json_decode
from tickloom.operators.blocks import Blocks
from tickloom.plans import signals as signal_plans
from tickloom.plans.bars import enrich_ticks, ohlc_bars
from tickloom.session import cut_lineage, shared_path
from tickloom.sources.topics import MESSAGE, read_records, write_records
from tickloom.streaming import jobs
from tickloom.streaming.late import LateSplit, late_job, newest_table
from tickloom.streaming.store import BarLog, VersionedTable
from tickloom.testbed import oracle as o
from tickloom.testbed import tables as t
from tickloom.testbed.batch_queries import _SIGNAL_OUT, SD_FACTOR, signals_of
from tickloom.testbed.registry import query, rounded

# The events span thirty days: three runs.
BATCH_DAYS = 12


def _scratch(spark: SparkSession) -> str:
    return shared_path(spark, "stream")


def _tick_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as a stream. Watermarks need zoned time."""
    events = t.table(spark, folder, "events")
    source = spark.readStream.schema(events.schema).parquet(f"{folder}/events.parquet*")
    return source.select(
        F.col("user_id").alias("instrument_token"),
        F.col("event_type"),
        F.col("value").alias("last_price"),
        F.col("ts").cast("timestamp").alias("date"),
        F.col("event_id").alias("seq"),
    )


def _plain_time(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            F.col(f.name).cast("timestamp_ntz").alias(f.name)
            if f.dataType.typeName() == "timestamp"
            else F.col(f.name)
            for f in df.schema
        ]
    )


def _topic(path: str) -> dict:
    return {"format": "parquet", "path": path}


def _messages(spark: SparkSession, path: str, schema) -> DataFrame:
    raw = spark.read.schema(MESSAGE).option("recursiveFileLookup", "true").parquet(path)
    return _plain_time(json_decode(raw, schema))


_CLOSED = 'start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 SECOND FROM events)'


@query(
    "ohlc_bars_stream",
    f"""WITH {o.BARS['type']} SELECT symbol, start, open, high, low, close FROM bars
        WHERE {_CLOSED}""",
)
def ohlc_bars_stream(spark, folder):
    """Closed bars, as append mode sends them."""
    base = _scratch(spark)
    ticks = _tick_stream(spark, folder).withColumnRenamed("event_type", "symbol")
    bars = ohlc_bars(ticks.withColumn("instrument_token", F.lit(None).cast("long")), "1 hour")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/bars/batch={batch_id}")

    jobs.start(bars.writeStream.outputMode("append").foreachBatch(keep), f"{base}/cp").awaitTermination()
    return _plain_time(
        spark.read.parquet(f"{base}/bars").select("symbol", "start", "open", "high", "low", "close")
    )


def _tails(source: str) -> str:
    return f"""numbered AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY start) AS place FROM {source}),
tails AS (
  SELECT b.* REPLACE (b.symbol || '#' || a.place AS symbol), a.symbol AS name, a.start AS last
  FROM numbered a JOIN numbered b
    ON b.symbol = a.symbol AND b.place BETWEEN a.place - 24 AND a.place)"""


_BY_BAR = f"{o.panel('tails')}, {o.SEGMENTS}"
_BY_BAR_SIGNALS = o.signals().replace("'entry' AS source", "'entry' AS source, name, last")
_BY_BAR_OUT = _SIGNAL_OUT.replace("symbol, start", "name AS symbol, start")


@query(
    "signals_bar_by_bar",
    f"""WITH {o.BARS['user']}, {o.VOLATILITY}, {o.BASELINE}, {o.BARS_SD}, {_tails('bars_sd')},
        {_BY_BAR}, {_BY_BAR_SIGNALS}
        SELECT {_BY_BAR_OUT} FROM signals WHERE start = last""",
)
def signals_bar_by_bar(spark, folder):
    span = t.blocks(spark, folder)
    bars = t.with_baseline(t.bars_user(spark, folder), span)
    return rounded(signal_plans.signals_bar_by_bar(bars, blocks=span, sd_factor=SD_FACTOR))


@query(
    "signals_stream",
    f"""WITH {o.TICKS_USER}, {o._bars('hour')}, {o.VOLATILITY}, {o.BASELINE}, {o.BARS_SD},
        closed AS (SELECT * FROM bars_sd WHERE {_CLOSED}), {_tails('closed')},
        {_BY_BAR}, {_BY_BAR_SIGNALS}
        SELECT {_BY_BAR_OUT} FROM signals WHERE start = last""",
)
def signals_stream(spark, folder):
    """Ticks enriched from a table, made bars, judged with the bars kept in state, sent as messages."""
    base = _scratch(spark)
    hourly = ohlc_bars(t.ticks_user(spark, folder), "1 hour")
    reference = cut_lineage(
        signal_plans.baseline_volatility(hourly, blocks=t.blocks(spark, folder))
    )
    ticks = enrich_ticks(_tick_stream(spark, folder).drop("event_type"), reference)
    stage = jobs.SignalStage(_topic(f"{base}/position"), thresholds={"sd_factor": SD_FACTOR})
    bars = _topic(f"{base}/bars")
    jobs.bar_job(ticks, bars, f"{base}/cp-bars", width="1 hour").awaitTermination()
    jobs.signal_job(spark, bars, stage, f"{base}/cp-signals").awaitTermination()
    return rounded(_messages(spark, f"{base}/position", schemas.SIGNAL))


def _lifecycle_orders_sql() -> str:
    return f"""WITH RECURSIVE {o.signal_chain('user')}, {o.lifecycle()}
        SELECT symbol, CAST(NULL AS VARCHAR) AS position_type, 'exit' AS type,
          CAST(NULL AS DOUBLE) AS price, start FROM lifecycle WHERE exited
        UNION ALL
        SELECT symbol, position_type, 'entry', {o.fixed('price')}, start
        FROM lifecycle WHERE entered"""


@query("positions_stream", _lifecycle_orders_sql())
def positions_stream(spark, folder):
    """Signal messages through keyed state and out as order messages.

    They arrive in several runs of the job, each going on from the checkpoint of the last.
    """
    base = _scratch(spark)
    signals = signals_of(t.bars_user(spark, folder), t.blocks(spark, folder))
    stored = cut_lineage(signals.withColumn("start", F.col("start").cast("timestamp")))
    batches = Blocks.spanning(stored, "start", BATCH_DAYS)
    marked = batches.mark(stored, "start")
    for number in range(batches.count):
        part = marked.filter(F.col("_block") == number)
        write_records(part, _topic(f"{base}/position"), schemas.SIGNAL.names, number)
        jobs.position_job(
            spark, _topic(f"{base}/position"), _topic(f"{base}/orders"), f"{base}/cp"
        ).awaitTermination()
    return rounded(_messages(spark, f"{base}/orders", schemas.ORDER))


@query(
    "merge_bars_stream",
    f"""WITH {o.TICKS_TYPE},
        near AS (SELECT *, date_trunc('minute', date)::TIMESTAMP + to_minutes(CASE
            WHEN second(date) > 30 THEN 1
            WHEN second(date) = 30 THEN minute(date) % 2 ELSE 0 END) AS minute FROM ticks)
        SELECT symbol, minute AS date, symbol || ':' || (epoch_us(minute) * 1000) AS key,
          arg_min(last_price, seq) AS open, max(last_price) AS high, min(last_price) AS low,
          arg_max(last_price, seq) AS close
        FROM near GROUP BY ALL""",
)
def merge_bars_stream(spark, folder):
    """Ticks in several runs, merged into minute bars as they come.

    Messages carry whole seconds.
    """
    base = _scratch(spark)
    ticks = t.ticks_type(spark, folder).withColumn("date", F.col("date").cast("timestamp"))
    batches = Blocks.spanning(ticks, "date", BATCH_DAYS)
    marked = batches.mark(ticks, "date")
    stored = spark.createDataFrame(
        [], "symbol string, date timestamp, open double, high double, low double, close double, key string"
    )
    log = BarLog(spark, f"{base}/log", stored)
    columns = ["symbol", "last_price", "date"]
    schema = ticks.select(*columns).schema
    for number in range(batches.count):
        part = marked.filter(F.col("_block") == number)
        write_records(part, _topic(f"{base}/trigger"), columns, number)
        live = read_records(spark, _topic(f"{base}/trigger"), schema)
        jobs.merge_job(live, log, f"{base}/messages", f"{base}/cp").awaitTermination()
    return _plain_time(log.bars())


def _runs(count: int) -> str:
    """Admission and settlement of `count` runs, each on the ledger and budget of the one before."""
    steps = [
        f"""ledger0 AS (SELECT symbol, margin FROM ledger),
        numbered AS (SELECT *, (batch - (SELECT min(batch) FROM orders_in)) // {BATCH_DAYS} AS run
          FROM orders_in),
        firsts AS (SELECT * FROM numbered
          QUALIFY row_number() OVER (PARTITION BY run, symbol ORDER BY seq) = 1),
        open0 AS (SELECT symbol, NULL::VARCHAR AS position_type, 0.0::DOUBLE AS quantity,
          0.0::DOUBLE AS value FROM ledger0 WHERE false),
        budget0 AS (SELECT 200000.0::DOUBLE AS budget)"""
    ]
    for k in range(count):
        steps.append(
            f"""summed{k} AS (
          SELECT f.symbol, f.position_type, round_even(100000 / f.price, 0) AS quantity,
            100000 / l.margin AS value, sum(100000 / l.margin) OVER (
              ORDER BY 100000 / l.margin, f.symbol
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running
          FROM firsts f JOIN ledger0 l ON l.symbol = f.symbol
          WHERE f.run = {k} AND f.type = 'entry'
            AND f.symbol NOT IN (SELECT symbol FROM open{k})),
        admitted{k} AS (SELECT symbol, position_type, quantity, value FROM summed{k}
          WHERE running < (SELECT budget FROM budget{k})),
        settled{k} AS (SELECT o.* FROM open{k} o JOIN firsts f ON f.symbol = o.symbol
          WHERE f.run = {k} AND f.type = 'exit'),
        budget{k + 1} AS (SELECT budget - coalesce((SELECT sum(value) FROM admitted{k}), 0)
          + coalesce((SELECT sum(value) FROM settled{k}), 0) AS budget FROM budget{k}),
        open{k + 1} AS (
          SELECT * FROM open{k} WHERE symbol NOT IN (SELECT symbol FROM settled{k})
          UNION ALL SELECT * FROM admitted{k})"""
        )
    told = " UNION ALL ".join(
        f"""SELECT symbol, CASE position_type WHEN 'long' THEN 'BUY' ELSE 'SELL' END AS side,
            quantity, {k} AS batch FROM admitted{k}
          UNION ALL
          SELECT symbol, CASE position_type WHEN 'long' THEN 'SELL' ELSE 'BUY' END,
            quantity, {k} FROM settled{k}"""
        for k in range(count)
    )
    return f"""WITH {o.ORDERS_IN}, {o.LEDGER}, {", ".join(steps)}
        SELECT 'main' AS account_id, 'place' AS action, CAST(NULL AS BIGINT) AS order_id, *
        FROM ({told})"""


@query("account_stream", _runs(3))
def account_stream(spark, folder):
    """Orders in several runs against a ledger that starts flat; the intents told."""
    base = _scratch(spark)
    orders = t.orders_in(spark, folder).withColumn("start", F.lit(None).cast("timestamp"))
    batches = Blocks.spanning(orders, "batch", BATCH_DAYS)
    marked = batches.mark(orders, "batch")
    book = t.ledger(spark, folder)
    nothing = {
        "account_id": F.lit("main"), "position": F.lit(False), "order_id": F.lit(None).cast("long"),
        "position_type": F.lit(None).cast("string"), "intent_id": F.lit(None).cast("string"),
        "quantity": F.lit(0.0), "filled_quantity": F.lit(0.0),
    }
    ledger = cut_lineage(book.withColumns(nothing).select(*schemas.LEDGER.names))
    stage = jobs.AccountStage(
        VersionedTable(spark, f"{base}/ledger", ledger),
        VersionedTable(spark, f"{base}/budgets", cut_lineage(jobs.initial_budgets(ledger))),
        f"{base}/intents",
    )
    for number in range(batches.count):
        part = marked.filter(F.col("_block") == number)
        write_records(part, _topic(f"{base}/orders"), schemas.ORDER.names, number)
        jobs.account_job(spark, _topic(f"{base}/orders"), stage, f"{base}/cp").awaitTermination()
    return rounded(spark.read.parquet(f"{base}/intents").drop("intent_id"))


RUNS = 4  # SQL has as many; it fails if the events need more


def _account_runs() -> str:
    """Two accounts over RUNS runs; an order's state is known from the second run after it on."""
    steps = [
        f"""listed AS (
          SELECT account_id, no, budget, symbol, instrument_token, margin FROM ledger
          JOIN (VALUES ('main', 1, 200000.0::DOUBLE), ('second', 2, 150000.0::DOUBLE)) a(account_id, no, budget)
            ON no = 1 OR instrument_token % 2 = 0),
        numbered AS (SELECT *, (batch - (SELECT min(batch) FROM orders_in)) // {BATCH_DAYS} AS run
          FROM orders_in),
        firsts AS (SELECT l.*, run, type, position_type, price FROM numbered n JOIN listed l ON l.symbol = n.symbol
          QUALIFY row_number() OVER (PARTITION BY run, account_id, n.symbol ORDER BY seq) = 1),
        budget0 AS (SELECT DISTINCT account_id, budget FROM listed),
        open0 AS (SELECT account_id, symbol, no, instrument_token, margin, position_type,
            0.0::DOUBLE AS quantity, 0 AS opened FROM firsts WHERE false)"""
    ]
    for k in range(RUNS):
        steps.append(
            f"""known{k} AS (SELECT *, CASE WHEN opened <= {k} - 2
                THEN floor(quantity * (instrument_token % 3) / 2) ELSE quantity END AS filled,
              CASE WHEN opened <= {k} - 2 THEN (opened * 1000000 + instrument_token) * 10 + no END AS order_id
            FROM open{k}),
        wanted{k} AS (SELECT f.*, 100000 / margin AS value, sum(100000 / margin) OVER (
              PARTITION BY account_id ORDER BY 100000 / margin, symbol
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running
          FROM firsts f WHERE run = {k} AND type = 'entry'
            AND NOT EXISTS (FROM open{k} o WHERE o.account_id = f.account_id AND o.symbol = f.symbol)),
        admitted{k} AS (SELECT w.*, round_even(100000 / price, 0) AS quantity FROM wanted{k} w
          JOIN budget{k} b ON b.account_id = w.account_id WHERE running < b.budget),
        settled{k} AS (SELECT o.* FROM known{k} o JOIN firsts f
          ON f.account_id = o.account_id AND f.symbol = o.symbol WHERE f.run = {k} AND f.type = 'exit'),
        budget{k + 1} AS (SELECT account_id, budget
            - coalesce((SELECT sum(value) FROM admitted{k} x WHERE x.account_id = b.account_id), 0)
            + coalesce((SELECT sum(100000 / margin) FROM settled{k} x WHERE x.account_id = b.account_id), 0)
            AS budget FROM budget{k} b),
        open{k + 1} AS (
          SELECT * FROM open{k} o WHERE NOT EXISTS
            (FROM settled{k} s WHERE s.account_id = o.account_id AND s.symbol = o.symbol)
          UNION ALL SELECT account_id, symbol, no, instrument_token, margin, position_type, quantity, {k}
            FROM admitted{k})"""
        )
    opening = "CASE position_type WHEN 'long' THEN 'BUY' ELSE 'SELL' END"
    closing = "CASE position_type WHEN 'long' THEN 'SELL' ELSE 'BUY' END"
    none = "CAST(NULL AS BIGINT)"
    told = " UNION ALL ".join(
        f"""SELECT account_id, symbol, 'place' AS action, {opening} AS side, quantity, {none} AS order_id,
            account_id || ':' || symbol || ':{k}' AS intent_id, {k} AS batch FROM admitted{k}
          UNION ALL
          SELECT account_id, symbol, 'modify', NULL, filled, order_id,
            account_id || ':' || symbol || ':' || opened, {k} FROM settled{k}
          WHERE filled < quantity AND filled <> 0
          UNION ALL
          SELECT account_id, symbol, 'cancel', NULL, NULL, order_id,
            account_id || ':' || symbol || ':' || opened, {k} FROM settled{k}
          WHERE filled < quantity AND filled = 0
          UNION ALL
          SELECT account_id, symbol, 'place', {closing}, filled, {none},
            account_id || ':' || symbol || ':{k}:close', {k} FROM settled{k} WHERE filled <> 0"""
        for k in range(RUNS)
    )
    return f"""WITH {o.ORDERS_IN}, {o.LEDGER}, {", ".join(steps)}
        SELECT * FROM ({told})
        WHERE CASE WHEN (SELECT max(run) FROM numbered) >= {RUNS} THEN error('more runs than the SQL has') ELSE true END"""


@query("account_stream_status", _account_runs())
def account_stream_status(spark, folder):
    """Two accounts that share symbols, and a broker whose answers come a run late.

    It fills none, half or all of an order. What it says decides, once it is known, whether leaving
    a position cancels its order, cuts it down, or trades it back.
    """
    base = _scratch(spark)
    orders = t.orders_in(spark, folder).withColumn("start", F.lit(None).cast("timestamp"))
    batches = Blocks.spanning(orders, "batch", BATCH_DAYS)
    marked = batches.mark(orders, "batch")
    accounts = spark.createDataFrame(
        [("main", 1, 200_000.0), ("second", 2, 150_000.0)], "account_id string, no long, budget double"
    )
    listed = (F.col("no") == 1) | (F.col("instrument_token") % 2 == 0)
    book = t.ledger(spark, folder).join(accounts, listed)
    nothing = {
        "position": F.lit(False), "order_id": F.lit(None).cast("long"),
        "position_type": F.lit(None).cast("string"), "quantity": F.lit(0.0), "filled_quantity": F.lit(0.0),
        "intent_id": F.lit(None).cast("string"),
    }
    ledger = cut_lineage(book.withColumns(nothing).select(*schemas.LEDGER.names))
    answered: list[DataFrame] = []

    def statuses() -> DataFrame:
        empty = spark.createDataFrame([], "intent_id string, order_id long, filled_quantity double")
        return reduce(DataFrame.unionByName, answered[:-1], empty)  # not the last run's yet

    def answer(number: int) -> DataFrame:
        sent = spark.read.parquet(f"{base}/intents/batch={number}").filter("action = 'place'")
        numbers = ledger.join(accounts, "account_id").select("account_id", "symbol", "instrument_token", "no")
        token = F.col("instrument_token")
        return sent.join(numbers, ["account_id", "symbol"]).select(
            "intent_id", ((F.lit(number) * 1_000_000 + token) * 10 + F.col("no")).alias("order_id"),
            F.floor(F.col("quantity") * (token % 3) / 2).cast("double").alias("filled_quantity"),
        )

    stage = jobs.AccountStage(
        VersionedTable(spark, f"{base}/ledger", ledger),
        VersionedTable(spark, f"{base}/budgets", cut_lineage(accounts.select("account_id", "budget"))),
        f"{base}/intents", statuses=statuses,
    )
    for number in range(batches.count):
        part = marked.filter(F.col("_block") == number)
        write_records(part, _topic(f"{base}/orders"), schemas.ORDER.names, number)
        jobs.account_job(spark, _topic(f"{base}/orders"), stage, f"{base}/cp").awaitTermination()
        answered.append(answer(number))
    return rounded(spark.read.parquet(f"{base}/intents"))


LATE = 50  # one tick in so many arrives a run late


@query(
    "late_ticks_stream",
    f"""WITH {o.TICKS_TYPE},
        arriving AS (SELECT *, (date::DATE - (SELECT min(date)::DATE FROM ticks)) // {BATCH_DAYS}
            + CASE WHEN seq % {LATE} = 7 THEN 1 ELSE 0 END AS run FROM ticks),
        newest AS (SELECT r.run, max(date) AS newest FROM (SELECT DISTINCT run FROM arriving) r
          LEFT JOIN arriving a ON a.run < r.run GROUP BY r.run),
        judged AS (SELECT a.*, date_trunc('hour', date)::TIMESTAMP AS hour,
            coalesce(date_trunc('hour', date) + INTERVAL 1 HOUR <= newest - INTERVAL 2 SECOND, false) AS late
          FROM arriving a JOIN newest n ON n.run = a.run),
        bars AS (SELECT symbol, hour AS start, arg_min(last_price, seq) AS open, max(last_price) AS high,
            min(last_price) AS low, arg_max(last_price, seq) AS close
          FROM judged WHERE NOT late GROUP BY ALL)
        SELECT 'late' AS kind, symbol, date_trunc('second', date)::TIMESTAMP AS start, last_price AS open,
          last_price AS high, last_price AS low, last_price AS close FROM judged WHERE late
        UNION ALL
        SELECT 'bar', symbol, start, open, high, low, close FROM bars
        WHERE start + INTERVAL 1 HOUR <= (SELECT date_trunc('second', max(date)) FROM judged WHERE NOT late) - INTERVAL 2 SECOND""",
)
def late_ticks_stream(spark, folder):
    """Ticks of which some arrive a run late: hourly bars of those in time, and the late ones, all of them.

    The late ones' windows have closed before they come.
    """
    base = _scratch(spark)
    ticks = t.ticks_type(spark, folder).withColumn("date", F.col("date").cast("timestamp"))
    batches = Blocks.spanning(ticks, "date", BATCH_DAYS)
    late = (F.col("seq") % LATE == 7).cast("long")
    marked = batches.mark(ticks, "date").withColumn("_run", F.col("_block") + late)
    columns = ["symbol", "last_price", "date"]
    schema = ticks.select(*columns).schema
    stage = LateSplit(
        newest_table(spark, f"{base}/newest"), _topic(f"{base}/live"), _topic(f"{base}/late"), columns, "1 hour"
    )

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("append").parquet(f"{base}/bars/batch={batch_id}")

    for number in range(batches.count + 1):
        write_records(marked.filter(F.col("_run") == number), _topic(f"{base}/in"), columns, number)
        arriving = read_records(spark, _topic(f"{base}/in"), schema)
        late_job(arriving, stage, f"{base}/cp-split").awaitTermination()
        live = read_records(spark, _topic(f"{base}/live"), schema)
        bars = ohlc_bars(live.withColumn("instrument_token", F.lit(None).cast("long")), "1 hour")
        jobs.start(bars.writeStream.outputMode("append").foreachBatch(keep), f"{base}/cp-bars").awaitTermination()
    told = spark.read.parquet(f"{base}/bars").select(
        F.lit("bar").alias("kind"), "symbol", "start", "open", "high", "low", "close"
    )
    price = F.col("last_price")
    missed = _messages(spark, f"{base}/late", schema).select(
        F.lit("late").alias("kind"), "symbol", F.col("date").alias("start"),
        *[price.alias(c) for c in ("open", "high", "low", "close")],
    )
    return _plain_time(told).unionByName(missed)
