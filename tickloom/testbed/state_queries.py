"""Positions, account, messages and clock."""

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructType

from tickloom.functions import clock, codec, numbers
from tickloom.operators.keyed import tail_rows
from tickloom.plans import account as account_plans
from tickloom.plans import positions as position_plans
from tickloom.session import cut_lineage
from tickloom.testbed import oracle as o
from tickloom.testbed import tables as t
from tickloom.testbed.batch_queries import _r, signals_of
from tickloom.testbed.registry import query, rounded

# --- positions ----------------------------------------------------------------------------

_STOP = _r("controller controller_constant controller_sd stop_loss")
_LIFE_OUT = (
    f"symbol, start, exited, entered, {_r('price')}, position_type, position_time, "
    f"lag_number, {_STOP}"
)


def lifecycle_of(bars, span):
    return position_plans.position_lifecycle(signals_of(bars, span), span)


def _recursive(kind: str) -> str:
    return f"WITH RECURSIVE {o.signal_chain(kind)}, {o.lifecycle()}"


@query("position_lifecycle", f"{_recursive('user')} SELECT {_LIFE_OUT} FROM lifecycle")
def position_lifecycle(spark, folder):
    return rounded(lifecycle_of(t.bars_user(spark, folder), t.blocks(spark, folder)))


@query("position_lifecycle_type", f"{_recursive('type')} SELECT {_LIFE_OUT} FROM lifecycle")
def position_lifecycle_type(spark, folder):
    return rounded(lifecycle_of(t.bars_type(spark, folder), t.blocks(spark, folder)))


@query(
    "lifecycle_orders",
    f"""{_recursive('user')}
        SELECT symbol, CAST(NULL AS VARCHAR) AS position_type, 'exit' AS type,
          CAST(NULL AS DOUBLE) AS price, start, 0 AS step FROM lifecycle WHERE exited
        UNION ALL
        SELECT symbol, position_type, 'entry', {o.fixed('price')}, start, 1
        FROM lifecycle WHERE entered""",
)
def lifecycle_orders(spark, folder):
    return rounded(position_plans.lifecycle_orders(lifecycle_of(t.bars_user(spark, folder), t.blocks(spark, folder))))


@query(
    "trailing_stop",
    f"""WITH RECURSIVE {o.signal_chain('user')},
        firsts AS (SELECT symbol, min(start) AS since FROM signals WHERE "trigger" GROUP BY ALL),
        position_bars AS (SELECT signals.* FROM signals JOIN firsts USING (symbol)
          WHERE start >= since),
        {o.held_positions()}
        SELECT symbol, since AS position_time, start, kind AS position_type,
          greatest(10 - bars, 0)::BIGINT AS lag_number, {o.fixed('controller')} AS controller,
          {o.fixed('constant')} AS controller_constant,
          {o.fixed('controller_sd')} AS controller_sd, {o.fixed('stop_loss')} AS stop_loss
        FROM life""",
)
def trailing_stop(spark, folder):
    """Every symbol's position from its first trigger on, never left."""
    span = t.blocks(spark, folder)
    signals = signals_of(t.bars_user(spark, folder), span)
    return rounded(position_plans.trailing_stop(_from_first_trigger(signals, span), span))


def _from_first_trigger(signals, span):
    """Rows from a symbol's first trigger on, with its time; a symbol fits a task if it fits a block."""
    triggered = F.when(F.col("trigger"), F.col("start"))
    if span.is_single:
        since = F.min(triggered).over(Window.partitionBy("symbol"))
        held = signals.withColumn("position_time", since)
    else:
        signals = cut_lineage(signals)
        first = signals.groupBy("symbol").agg(F.min(triggered).alias("position_time"))
        held = signals.join(first, "symbol")
    return held.filter(F.col("start") >= F.col("position_time"))


CUT = "2024-01-26"


@query(
    "exit_signal",
    f"""{_recursive('user')},
        held AS (SELECT * FROM lifecycle WHERE kind_open AND start < DATE '{CUT}'
          QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY start DESC) = 1),
        last AS (SELECT symbol, close FROM bars
          QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY start DESC) = 1)
        SELECT symbol, CAST(NULL AS VARCHAR) AS position_type, 'exit' AS type,
          CAST(NULL AS DOUBLE) AS price
        FROM held JOIN last USING (symbol)
        WHERE CASE WHEN position_type = 'short' THEN close > stop_loss
          ELSE close < stop_loss END""".replace("kind_open", "position_type IS NOT NULL"),
)
def exit_signal(spark, folder):
    bars = t.bars_user(spark, folder)
    held = lifecycle_of(bars, t.blocks(spark, folder)).filter(
        F.col("position_type").isNotNull() & (F.col("start") < F.lit(CUT).cast("date"))
    )
    return position_plans.exit_signal(held, bars)


@query(
    "entry_signal",
    f"""WITH {o.signal_chain('user')}, {o.LEDGER},
        last AS (SELECT * FROM signals
          QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY start DESC) = 1)
        SELECT last.symbol, last.position_type, 'entry' AS type, {o.fixed('price')} AS price,
          start
        FROM last JOIN ledger ON ledger.symbol = last.symbol
        WHERE NOT ledger.position AND last."trigger" """,
)
def entry_signal(spark, folder):
    signals = signals_of(t.bars_user(spark, folder), t.blocks(spark, folder))
    return rounded(position_plans.entry_signal(signals, t.ledger(spark, folder)))


@query(
    "apply_orders",
    f"""WITH {o.ORDERS_IN}, {o.LEDGER},
        told AS (SELECT * FROM orders_in
          QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY seq) = 1)
        SELECT ledger.symbol, instrument_token, margin, quantity, filled_quantity,
          CASE type WHEN 'entry' THEN true WHEN 'exit' THEN false ELSE position END AS position,
          CASE type WHEN 'entry' THEN told.position_type WHEN 'exit' THEN NULL
            ELSE ledger.position_type END AS position_type
        FROM ledger LEFT JOIN told ON told.symbol = ledger.symbol""",
)
def apply_orders(spark, folder):
    told = account_plans.first_orders(t.orders_in(spark, folder), [])
    return position_plans.apply_orders(t.ledger(spark, folder), told).drop("position_time")


# --- account ------------------------------------------------------------------------------


@query(
    "capital_admission",
    f"""WITH {o.ORDERS_IN}, {o.LEDGER}, {o.FIRST_ORDERS},
        wanted AS (SELECT f.batch, f.symbol, l.instrument_token, l.margin, f.position_type,
            f.price, 100000 / l.margin AS value
          FROM firsts f JOIN ledger l ON l.symbol = f.symbol
          WHERE f.type = 'entry' AND NOT l.position),
        summed AS (SELECT *, sum(value) OVER (PARTITION BY batch ORDER BY value, symbol
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_value FROM wanted)
        SELECT batch, symbol, instrument_token, margin, position_type, price, {_r('value')},
          {_r('running_value', 4)},
          CASE position_type WHEN 'short' THEN 'SELL' WHEN 'long' THEN 'BUY' END AS side,
          round_even(100000 / price, 0) AS quantity,
          round_even(100000 / price, 0) AS filled_quantity
        FROM summed WHERE running_value < 200000""",
)
def capital_admission(spark, folder):
    admitted = account_plans.capital_admission(
        t.orders_in(spark, folder), t.ledger(spark, folder), "batch"
    )
    return rounded(admitted, running_value=4)


def _settlement_sql(whole: str) -> str:
    return f"""WITH {o.ORDERS_IN}, {o.LEDGER}, {o.FIRST_ORDERS},
        leaving AS (SELECT f.batch, l.* FROM firsts f JOIN ledger l ON l.symbol = f.symbol
          WHERE f.type = 'exit' AND l.position),
        told AS (
          SELECT *, 0 AS step, CASE
              WHEN filled_quantity < quantity AND filled_quantity <> 0 THEN 'modify'
              WHEN filled_quantity < quantity THEN 'cancel'
              WHEN filled_quantity <> 0 THEN '{whole}' ELSE 'none' END AS action FROM leaving
          UNION ALL
          SELECT *, 1, 'place' FROM leaving
          WHERE filled_quantity < quantity AND filled_quantity <> 0)
        SELECT batch, symbol, instrument_token, margin, step, action,
          CASE WHEN action = 'place' THEN
            CASE position_type WHEN 'short' THEN 'BUY' ELSE 'SELL' END END AS side,
          CASE WHEN action IN ('modify', 'place') THEN filled_quantity END AS quantity,
          CASE WHEN action IN ('modify', 'cancel') THEN instrument_token * 100 + 7 END AS order_id,
          CASE WHEN step = 0 THEN {o.fixed('100000 / margin')} END AS value FROM told"""


@query("exit_settlement", _settlement_sql("place"))
def exit_settlement(spark, folder):
    return rounded(
        account_plans.exit_settlement(
            t.orders_in(spark, folder), t.ledger_with_orders(spark, folder), "batch"
        )
    )


@query("exit_settlement_unfilled_only", _settlement_sql("none"))
def exit_settlement_unfilled_only(spark, folder):
    return rounded(
        account_plans.exit_settlement(
            t.orders_in(spark, folder), t.ledger_with_orders(spark, folder), "batch", close_filled=False
        )
    )


@query(
    "order_status_snapshot",
    """SELECT order_id, order_timestamp, instrument_token, symbol, status FROM (
          SELECT o_orderkey AS order_id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
            AS order_timestamp, o_custkey AS instrument_token, o_orderpriority AS symbol,
            o_orderstatus AS status FROM orders
          QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY o_orderdate DESC) = 1)""",
)
def order_status_snapshot(spark, folder):
    columns = ["order_id", "order_timestamp", "instrument_token", "symbol", "status"]
    return account_plans.order_status_snapshot(t.status_in(spark, folder), columns=columns)


@query(
    "order_status_latest",
    """SELECT o_orderkey AS order_id, strftime(o_orderdate + INTERVAL 1 SECOND, '%Y-%m-%d %H:%M:%S')
          AS order_timestamp, 'COMPLETE' AS status, o_orderpriority AS symbol FROM orders""",
)
def order_status_latest(spark, folder):
    """Several states of each order, two of them in the same second."""
    return account_plans.order_status_snapshot(
        t.status_steps(spark, folder), ["order_timestamp", "seq"],
        ["order_id", "order_timestamp", "status", "symbol"],
    )


@query(
    "fill_from_status",
    f"""WITH {o.LEDGER},
        book AS (SELECT *, CASE WHEN position AND instrument_token % 10 <> 0
            THEN instrument_token * 100 + 7 END AS known_id FROM ledger),
        filled AS (SELECT *, CASE WHEN position THEN instrument_token * 100 + 7 END AS order_id FROM book)
        SELECT symbol, instrument_token, order_id, CASE WHEN order_id IS NOT NULL THEN quantity / 2
          ELSE filled_quantity END AS filled_quantity FROM filled""",
)
def fill_from_status(spark, folder):
    """Open positions get the broker's order ids, where they are missing, and half of their fills."""
    book = t.ledger_with_orders(spark, folder)
    known = F.col("instrument_token") % 10 != 0
    status = book.select(
        "symbol", (F.col("instrument_token") * 100 + 7).alias("order_id"),
        F.lit("2024-01-01 10:00:00").alias("order_timestamp"), (F.col("quantity") / 2).alias("filled_quantity"),
    )
    told = account_plans.fill_from_status(book.withColumn("order_id", F.when(known, F.col("order_id"))), status)
    return told.select("symbol", "instrument_token", "order_id", "filled_quantity")


# --- messages -----------------------------------------------------------------------------

_PROPS = StructType().add("k", LongType())


@query(
    "json_decode",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
)
def json_decode(spark, folder):
    events = t.table(spark, folder, "events")
    return codec.json_decode(events, _PROPS, "props", ("event_id",))


@query("json_rejects", "SELECT event_id, 'error' AS value FROM events WHERE event_type = 'error'")
def json_rejects(spark, folder):
    """Messages where errors arrive as plain text."""
    kind = F.col("event_type")
    messages = t.table(spark, folder, "events").select(
        "event_id", F.when(kind == "error", kind).otherwise(F.col("props")).alias("value")
    )
    return codec.json_rejects(messages, _PROPS)


@query(
    "json_array_explode",
    """SELECT event_id, position::INTEGER AS position,
          CAST(json_extract(props, '$.k') AS BIGINT) AS k
        FROM events CROSS JOIN (SELECT unnest([0, 1]) AS position)""",
)
def json_array_explode(spark, folder):
    events = t.table(spark, folder, "events").select(
        "event_id", F.concat(F.lit("["), "props", F.lit(","), "props", F.lit("]")).alias("props")
    )
    return codec.json_array_explode(events, _PROPS, "props", ("event_id",))


@query(
    "json_encode",
    """SELECT event_id, to_json({'instrument_token': user_id, 'symbol': event_type,
          'last_price': value, 'avg(sd)': CAST(NULL AS DOUBLE),
          'date': strftime(ts, '%Y-%m-%d %H:%M:%S')})::VARCHAR AS value FROM events""",
)
def json_encode(spark, folder):
    ticks = t.table(spark, folder, "events").select(
        "event_id",
        F.col("user_id").alias("instrument_token"),
        F.col("event_type").alias("symbol"),
        F.col("value").alias("last_price"),
        F.lit(None).cast("double").alias("avg_sd"),
        F.col("ts").alias("date"),
    )
    message = codec.json_encode(ticks, ["instrument_token", "symbol", "last_price", "avg_sd", "date"])
    return ticks.select("event_id", message.alias("value"))


@query(
    "json_round_trip",
    "SELECT user_id AS instrument_token, event_type AS symbol, value AS last_price FROM events",
)
def json_round_trip(spark, folder):
    ticks = t.table(spark, folder, "events").select(
        F.col("user_id").alias("instrument_token"),
        F.col("event_type").alias("symbol"),
        F.col("value").alias("last_price"),
    )
    schema = (
        StructType()
        .add("instrument_token", LongType())
        .add("symbol", StringType())
        .add("last_price", DoubleType())
    )
    messages = ticks.select(codec.json_encode(ticks).cast("binary").alias("value"))
    return codec.json_decode(messages, schema)


@query(
    "series_json",
    f"""WITH {o.BARS['user']},
        near AS (SELECT * FROM bars
          QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY start DESC) <= 25),
        keys AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS symbol FROM events
          UNION ALL SELECT DISTINCT 'new-' || user_id FROM events),
        lists AS (SELECT symbol, to_json(list({{'start': strftime(start, '%Y-%m-%d %H:%M:%S'),
            'close': close}} ORDER BY start))::VARCHAR AS series FROM near GROUP BY symbol)
        SELECT symbol, coalesce(series, '[]') AS series FROM keys LEFT JOIN lists USING (symbol)""",
)
def series_json(spark, folder):
    users = t.table(spark, folder, "events").select(F.col("user_id").cast("string").alias("symbol"))
    unseen = users.select(F.concat(F.lit("new-"), "symbol").alias("symbol"))
    bars = t.bars_user(spark, folder)
    return codec.series_json(
        users.unionByName(unseen), tail_rows(bars, 25), "symbol", "start", ["start", "close"]
    )


# --- clock and numbers --------------------------------------------------------------------


@query(
    "round_minute",
    """SELECT event_id, date_trunc('minute', ts)::TIMESTAMP + to_minutes(CASE
          WHEN microsecond(ts) > 30000000 THEN 1
          WHEN microsecond(ts) = 30000000 THEN minute(ts) % 2 ELSE 0 END) AS minute FROM events""",
)
def round_minute(spark, folder):
    return t.table(spark, folder, "events").select(
        "event_id", clock.round_minute(F.col("ts")).alias("minute")
    )


def _back(n: int) -> str:
    days = "list_transform(range(1, 20), lambda k: day - k::INTEGER)"
    return f"list_filter({days}, lambda d: isodow(d) <= 5)[{n}] AS back_{n}"


@query(
    "business_days_back",
    f"""SELECT day, {_back(1)}, {_back(3)}, {_back(8)}
        FROM (SELECT DISTINCT o_orderdate::DATE AS day FROM orders)""",
)
def business_days_back(spark, folder):
    days = t.table(spark, folder, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.select(
        "day", *[clock.business_days_back(F.col("day"), n).alias(f"back_{n}") for n in (1, 3, 8)]
    )


@query(
    "clock_columns",
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text, ts::DATE AS day,
          ts::DATE - 8 AS week_ago, epoch_us(ts) * 1000 AS nanos,
          date_trunc('second', ts)::TIMESTAMP AS second FROM events""",
)
def clock_columns(spark, folder):
    ts = F.col("ts")
    return t.table(spark, folder, "events").select(
        "event_id",
        clock.timestamp_text(ts).alias("text"),
        clock.day_of(ts).alias("day"),
        clock.days_after(clock.day_of(ts), -8).alias("week_ago"),
        clock.epoch_nanos(ts).alias("nanos"),
        clock.text_timestamp(clock.timestamp_text(ts)).cast("timestamp_ntz").alias("second"),
    )


@query(
    "number_columns",
    """SELECT l_orderkey, l_linenumber, greatest(l_tax, l_discount) AS top,
          least(l_tax, l_discount) AS low, round_even(l_quantity / 2, 0) AS half,
          CASE WHEN l_tax <> 0 THEN round(l_discount / l_tax, 6) END AS ratio,
          CAST(CAST(l_partkey AS VARCHAR) AS BIGINT) AS part FROM lineitem""",
)
def number_columns(spark, folder):
    discount, tax = F.col("l_discount"), F.col("l_tax")
    return t.table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        numbers.row_max(tax, discount).alias("top"),
        numbers.row_min(tax, discount).alias("low"),
        numbers.half_even(F.col("l_quantity") / 2).alias("half"),
        F.round(numbers.quotient(discount, tax), 6).alias("ratio"),
        numbers.text_number(F.col("l_partkey").cast("string")).alias("part"),
    )
