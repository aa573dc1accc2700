"""Universe, bars and signals."""

from datetime import date, timedelta

from pyspark.sql import functions as F

from tickloom.operators import windows
from tickloom.operators.blocks import Blocks, RowBlocks
from tickloom.operators.keyed import (
    coalescing_upsert,
    dedup_keep_first,
    dedup_keep_last,
    drop_closed,
    first_known,
    latest_per_key,
    masked_update,
    tail_rows,
    union_history,
)
from tickloom.plans import bars as bar_plans
from tickloom.plans import days
from tickloom.plans import signals as signal_plans
from tickloom.plans import universe as universe_plans
from tickloom.session import shared_path
from tickloom.sources import files
from tickloom.sources.files import write_history
from tickloom.testbed import oracle as o
from tickloom.testbed import tables as t
from tickloom.testbed.registry import query, rounded

SD_FACTOR = 1.2
AS_OF = "2024-01-20"
STORED_FROM, STORED_TO = "2024-01-08", "2024-01-19"
FROM_DAY, TO_DAY = "1995-01-01", "1995-12-31"


def _r(names: str, digits: int = 6) -> str:
    return ", ".join(f"{o.fixed(n, digits)} AS {n}" for n in names.split())


_BAR_OUT = "instrument_token, symbol, start, open, high, low, close"


# --- universe -----------------------------------------------------------------------------


@query(
    "universe_join",
    f"""SELECT p.p_partkey AS instrument_token, 'P' || p.p_partkey AS tradingsymbol,
          1.0::DOUBLE + m.p_size % 12 AS mis_multiplier
        FROM part p JOIN part m ON m.p_partkey = p.p_partkey
        WHERE p.p_brand = '{t.SEGMENT}' AND m.p_size >= 10""",
)
def universe_join(spark, folder):
    return universe_plans.universe_join(
        t.instruments(spark, folder), t.margins(spark, folder), t.SEGMENT
    )


@query(
    "universe_screen",
    f"""WITH {o.DAILY}, {o.UNIVERSE},
        means AS (SELECT instrument_token, avg(close) AS mean_price,
            avg(close) * avg(volume) AS mean_value FROM daily GROUP BY ALL),
        valued AS (SELECT * FROM listed JOIN means USING (instrument_token))
        SELECT instrument_token, tradingsymbol AS symbol, mis_multiplier AS margin FROM valued
        WHERE mean_value > 1.5 * (SELECT avg(mean_value) FROM valued) AND mean_price > 25""",
)
def universe_screen(spark, folder):
    return universe_plans.universe_screen(t.whole_universe(spark, folder), t.daily(spark, folder))


@query(
    "load_history",
    f"""WITH {o.DAILY}
        SELECT d.instrument_token, d.date, d.close, d.volume, 'P' || p_partkey AS symbol
        FROM daily d JOIN part ON p_partkey = d.instrument_token
        WHERE p_brand = '{t.SEGMENT}' AND p_size >= 10
          AND d.date >= DATE '{FROM_DAY}' AND d.date < DATE '{TO_DAY}' + 1""",
)
def load_history(spark, folder):
    followed = universe_join(spark, folder).withColumnRenamed("tradingsymbol", "symbol")
    return universe_plans.load_history(followed, t.daily(spark, folder), FROM_DAY, TO_DAY)


@query(
    "history_by_day",
    f"""WITH {o.BARS['user']} SELECT {_BAR_OUT} FROM bars
        WHERE start >= DATE '{STORED_FROM}' AND start < DATE '{STORED_TO}' + 1""",
)
def history_by_day(spark, folder):
    """Daily bars stored by day, and a range of days read back."""
    path = shared_path(spark, "history")
    bars = t.bars_user(spark, folder)
    files.write_history(bars.withColumnRenamed("start", "date"), path)
    names = bars.select("instrument_token", "symbol").distinct()
    stored = files.read_table(spark, path)
    loaded = universe_plans.load_history(names, stored, STORED_FROM, STORED_TO)
    return loaded.withColumnRenamed("date", "start").select(*bars.columns)


@query("csv_round_trip", "SELECT * FROM orders")
def csv_round_trip(spark, folder):
    """Orders written with a header and read back by name."""
    path = shared_path(spark, "csv")
    orders = t.table(spark, folder, "orders")
    files.write_csv(orders, path)
    return files.read_csv(spark, path, orders.schema)


# --- bars ---------------------------------------------------------------------------------

@query("ohlc_bars", f"WITH {o.BARS['type']} SELECT {_BAR_OUT} FROM bars")
def ohlc_bars(spark, folder):
    return t.bars_type(spark, folder)


@query(
    "ohlc_bars_with_sd",
    f"""WITH {o.TICKS_USER}
        SELECT instrument_token, symbol, date_trunc('day', date)::TIMESTAMP AS start,
          date_trunc('day', date)::TIMESTAMP + INTERVAL 1 DAY AS "end",
          arg_min(last_price, seq) AS open, max(last_price) AS high, min(last_price) AS low,
          arg_max(last_price, seq) AS close, arg_max(last_price / 100, seq) AS avg_sd
        FROM ticks GROUP BY ALL""",
)
def ohlc_bars_with_sd(spark, folder):
    ticks = t.ticks_user(spark, folder).withColumn("avg_sd", F.col("last_price") / 100)
    return bar_plans.ohlc_bars(ticks, "1 day")


@query(
    "backfill_ticks",
    f"""WITH {o.BARS['type']}, {o.VOLATILITY}, {o.BASELINE},
        last AS (SELECT * FROM bars
          QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY start DESC) <= 30)
        SELECT last.instrument_token, last.symbol, position::INTEGER AS position,
          [open, high, low, close][position + 1] AS last_price, 'ltp' AS mode, true AS tradable,
          {o.fixed('base.avg_sd')} AS avg_sd, start AS date,
          epoch_us(start) * 4 + position - {bar_plans.BEFORE_LIVE} AS seq
        FROM last JOIN base ON base.symbol = last.symbol
        CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS position)""",
)
def backfill_ticks(spark, folder):
    return rounded(bar_plans.backfill_ticks(t.with_baseline(t.bars_type(spark, folder), t.blocks(spark, folder)), 30))


@query(
    "replayed_bars",
    f"""WITH {o.BARS['type']} SELECT {_BAR_OUT} FROM bars
        QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY start DESC) <= 30""",
)
def replayed_bars(spark, folder):
    """Bars made from the ticks that stand for them."""
    bars = t.bars_type(spark, folder).withColumn("avg_sd", F.lit(None).cast("double"))
    again = bar_plans.ohlc_bars(bar_plans.backfill_ticks(bars, 30), "1 hour")
    return again.select(*t.BAR_COLUMNS)


@query(
    "baseline_volatility",
    f"""WITH {o.BARS['user']}, {o.VOLATILITY}, {o.BASELINE}
        SELECT instrument_token, symbol, {o.fixed('avg_sd')} AS avg_sd FROM base""",
)
def baseline_volatility(spark, folder):
    return rounded(signal_plans.baseline_volatility(
        t.bars_user(spark, folder), blocks=t.blocks(spark, folder)
    ))


@query(
    "baseline_volatility_last_30",
    f"""WITH {o.BARS['type']}, {o.VOLATILITY},
        near AS (SELECT * FROM vol
          QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY start DESC) <= 30)
        SELECT instrument_token, symbol, {o.fixed('avg(sd)')} AS avg_sd FROM near GROUP BY ALL""",
)
def baseline_volatility_last_30(spark, folder):
    return rounded(signal_plans.baseline_volatility(t.bars_type(spark, folder), last_n=30))


@query(
    "enrich_ticks",
    f"""WITH {o.BARS['user']}, {o.VOLATILITY}, {o.BASELINE}
        SELECT ticks.instrument_token, last_price, date, seq, base.symbol,
          {o.fixed('base.avg_sd')} AS avg_sd
        FROM ticks LEFT JOIN base ON base.instrument_token = ticks.instrument_token
        WHERE last_price <> 0 OR last_price IS NULL""",
)
def enrich_ticks(spark, folder):
    usual = signal_plans.baseline_volatility(
        t.bars_user(spark, folder), blocks=t.blocks(spark, folder)
    )
    return rounded(bar_plans.enrich_ticks(t.ticks_user(spark, folder), usual))


@query(
    "enrich_ticks_zero_prices",
    f"""WITH {o.TICKS_USER} SELECT instrument_token, date, seq,
          CASE WHEN seq % 5 <> 0 THEN CASE WHEN seq % 3 <> 0 THEN last_price ELSE 0 END END AS last_price,
          symbol, 1.5::DOUBLE AS avg_sd
        FROM ticks WHERE seq % 3 <> 0 OR seq % 5 = 0""",
)
def enrich_ticks_zero_prices(spark, folder):
    """Every third price zero, which drops the tick, and every fifth missing, which does not."""
    ticks = t.ticks_user(spark, folder)
    price = F.when(F.col("seq") % 5 == 0, F.lit(None)).when(F.col("seq") % 3 == 0, 0.0).otherwise(F.col("last_price"))
    reference = ticks.select("instrument_token", "symbol").distinct().withColumn("avg_sd", F.lit(1.5))
    return bar_plans.enrich_ticks(ticks.withColumn("last_price", price), reference)


@query("json_document", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def json_document(spark, folder):
    """Orders written as JSON arrays, an array per file, and read back as documents."""
    path = shared_path(spark, "json")
    orders = t.table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    bucket = F.pmod(F.xxhash64("o_orderkey"), F.lit(64))
    arrays = orders.groupBy(bucket.alias("file"), F.floor(F.col("o_orderkey") / 10_000).alias("run")).agg(
        F.to_json(F.collect_list(F.struct(*orders.columns))).alias("value")
    )
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return files.read_json_document(spark, path, orders.schema)


def _key(symbol: str, start: str) -> str:
    return f"{symbol} || ':' || (epoch_us({start}) * 1000)"


@query(
    "merge_bars",
    f"""WITH {o.TICKS_TYPE},
        half AS (SELECT symbol, date_trunc('hour', date)::TIMESTAMP AS date, seq % 2 AS odd,
            max(last_price) AS high, min(last_price) AS low, arg_min(last_price, seq) AS open,
            arg_max(last_price, seq) AS close FROM ticks GROUP BY ALL),
        a AS (SELECT * FROM half WHERE odd = 0), b AS (SELECT * FROM half WHERE odd = 1)
        SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.date, b.date) AS date,
          coalesce(a.open, b.open) AS open, greatest(a.high, b.high) AS high,
          least(a.low, b.low) AS low, coalesce(b.close, a.close) AS close,
          {_key('coalesce(a.symbol, b.symbol)', 'coalesce(a.date, b.date)')} AS key
        FROM a FULL JOIN b ON a.symbol = b.symbol AND a.date = b.date""",
)
def merge_bars(spark, folder):
    ticks = t.ticks_type(spark, folder)
    even = bar_plans.ohlc_bars(ticks.filter("seq % 2 = 0"), "1 hour")
    odd = bar_plans.ohlc_bars(ticks.filter("seq % 2 = 1"), "1 hour")
    stored = even.withColumn("key", bar_plans.bar_key(even)).withColumnRenamed("start", "date")
    batch = odd.selectExpr(
        "symbol", "start AS date", "high AS max", "low AS min", "open AS first", "close AS last"
    )
    return bar_plans.merge_bars(stored, batch)


@query(
    "minute_bars",
    f"""WITH {o.TICKS_TYPE}
        SELECT symbol, date_trunc('minute', date)::TIMESTAMP + to_minutes(CASE
            WHEN microsecond(date) > 30000000 THEN 1
            WHEN microsecond(date) = 30000000 THEN minute(date) % 2 ELSE 0 END) AS date,
          max(last_price) AS max, min(last_price) AS min, arg_min(last_price, seq) AS first,
          arg_max(last_price, seq) AS last
        FROM ticks GROUP BY ALL""",
)
def minute_bars(spark, folder):
    return bar_plans.minute_bars(t.ticks_type(spark, folder))


@query(
    "bar_messages",
    f"""WITH {o.BARS['type']}
        SELECT {_key('symbol', 'start')} AS key,
          to_json({{'symbol': symbol, 'date': strftime(start, '%Y-%m-%d %H:%M:%S'),
            'open': open, 'high': high, 'low': low, 'close': close}})::VARCHAR AS message
        FROM bars""",
)
def bar_messages(spark, folder):
    return bar_plans.bar_messages(t.bars_type(spark, folder))


# --- signals ------------------------------------------------------------------------------


_BREAKOUT = f"""WITH {o.BARS['type']}, {o.VOLATILITY},
        ranged AS (SELECT *, high - low AS "range", start::DATE AS day FROM vol),
        atrs AS (SELECT *, {o.full('stddev_samp', '"range"', 3)} AS atr FROM ranged),
        days AS (SELECT symbol, day, coalesce(sum(sd), 0) AS sd_sum, count(sd) AS sd_count
          FROM atrs GROUP BY ALL),
        lagged AS (SELECT symbol, day,
            lag(sd_sum) OVER (PARTITION BY symbol ORDER BY day) AS sd_sum,
            lag(sd_count) OVER (PARTITION BY symbol ORDER BY day) AS sd_count FROM days),
        scored AS (SELECT start AS date, symbol, sd, sd_sum / sd_count AS avg_sd,
            atr / close * 100 AS natr
          FROM atrs JOIN lagged USING (symbol, day)
          WHERE day = DATE '{AS_OF}' AND sd_high IS NOT NULL AND sd_low IS NOT NULL
            AND atr IS NOT NULL AND sd_sum IS NOT NULL AND sd_count > 0)
        SELECT date, symbol, {_r('sd avg_sd')}, {_r('natr', 4)} FROM scored
        WHERE sd > {SD_FACTOR} * avg_sd AND natr > 0.3"""


@query("breakout_scan", _BREAKOUT)
def breakout_scan(spark, folder):
    history = t.bars_type(spark, folder).withColumnRenamed("start", "date")
    span = t.blocks(spark, folder)
    return rounded(signal_plans.breakout_scan(history, AS_OF, SD_FACTOR, blocks=span), natr=4)


@query("breakout_scan_recent", _BREAKOUT)
def breakout_scan_recent(spark, folder):
    """The same from only the days it needs."""
    ticks = t.ticks_type(spark, folder)
    by_day = F.to_date("date").alias("date")
    first = signal_plans.first_day_needed(ticks.select("symbol", by_day, F.date_trunc("hour", "date")).distinct(), AS_OF)
    # Ticks are filtered, not bars: the filter reaches the scan.
    near = bar_plans.ohlc_bars(ticks.filter(F.col("date") >= F.lit(first).cast("timestamp_ntz")), "1 hour")
    near = near.select(*t.BAR_COLUMNS).withColumnRenamed("start", "date")
    span = Blocks.between(first, date.fromisoformat(AS_OF))
    return rounded(signal_plans.breakout_scan(near, AS_OF, SD_FACTOR, blocks=span), natr=4)


@query("breakout_scan_from_statistics", _BREAKOUT)
def breakout_scan_from_statistics(spark, folder):
    """Statistics of all days before the last two, then of each of these alone; then one day of bars is read."""
    base = shared_path(spark, "days")
    bars = t.bars_type(spark, folder).withColumnRenamed("start", "date")
    write_history(bars, f"{base}/history")
    history = spark.read.parquet(f"{base}/history")
    scanned = date.fromisoformat(AS_OF)
    span = t.blocks(spark, folder)
    days.keep_day(history, scanned - timedelta(days=3), f"{base}/statistics", span)
    before = days.keep_day(history, scanned - timedelta(days=1), f"{base}/statistics", span)
    day = history.filter(F.col("day") == F.lit(AS_OF).cast("date")).drop("day")
    return rounded(days.breakouts_of_day(day, before, SD_FACTOR), natr=4)


_PANEL_OUT = (
    f"{_BAR_OUT}, {_r('sd_high sd_low sd mave_5 mave_8 mave_16')}, "
    f"{o.fixed('\"range\"')} AS \"range\", {_r('atr')}, {_r('natr', 3)}, "
    f"{_r('macd_line signal macd')}"
)


@query("indicator_panel", f"WITH {o.BARS['type']}, {o.panel()} SELECT {_PANEL_OUT} FROM panel")
def indicator_panel(spark, folder):
    bars = t.bars_type(spark, folder)
    return rounded(signal_plans.indicator_panel(bars, tail=None, blocks=t.blocks(spark, folder)), natr=3)


_LAST_25 = """near AS (SELECT * FROM bars
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY start DESC) <= 25)"""


@query(
    "indicator_panel_tail",
    f"WITH {o.BARS['user']}, {_LAST_25}, {o.panel('near')} SELECT {_PANEL_OUT} FROM panel",
)
def indicator_panel_tail(spark, folder):
    return rounded(signal_plans.indicator_panel(t.bars_user(spark, folder)), natr=3)


@query(
    "swing_segments",
    f"""WITH {o.BARS['type']}, {o.panel()}, {o.SEGMENTS}
        SELECT symbol, start, {_r('macd')}, position_type, group_id, local_maxima, local_minima
        FROM segments""",
)
def swing_segments(spark, folder):
    panel = signal_plans.indicator_panel(t.bars_type(spark, folder), tail=None, blocks=t.blocks(spark, folder))
    return rounded(
        signal_plans.swing_segments(panel, t.blocks(spark, folder)).select(
            "symbol", "start", "macd", "position_type", "group_id", "local_maxima", "local_minima"
        )
    )


@query(
    "swing_extremes",
    f"""WITH {o.BARS['type']}, {o.panel()}, {o.SEGMENTS}
        SELECT symbol, start, group_id,
          max(high) OVER (PARTITION BY symbol, group_id) AS local_maxima,
          min(low) OVER (PARTITION BY symbol, group_id) AS local_minima FROM segments""",
)
def swing_extremes(spark, folder):
    panel = signal_plans.indicator_panel(t.bars_type(spark, folder), tail=None, blocks=t.blocks(spark, folder))
    return signal_plans.swing_extremes(signal_plans.swing_segments(panel, t.blocks(spark, folder))).select(
        "symbol", "start", "group_id", "local_maxima", "local_minima"
    )


_SIGNAL_OUT = (
    'instrument_token, symbol, start, open, high, low, close, "trigger", source, position_type, '
    + _r("price initial_stop_loss initial_controller avg_sd")
)


def signals_of(bars, span):
    return signal_plans.signal_history(t.with_baseline(bars, span), span, sd_factor=SD_FACTOR)


@query("reversal_signal", f"WITH {o.signal_chain('type')} SELECT {_SIGNAL_OUT} FROM signals")
def reversal_signal(spark, folder):
    return rounded(signals_of(t.bars_type(spark, folder), t.blocks(spark, folder)))


@query("reversal_signal_user", f"WITH {o.signal_chain('user')} SELECT {_SIGNAL_OUT} FROM signals")
def reversal_signal_user(spark, folder):
    return rounded(signals_of(t.bars_user(spark, folder), t.blocks(spark, folder)))


_GAPPY = o.BARS["type"].replace("bars AS (", "whole AS (") + """, bars AS (
  SELECT instrument_token, symbol, start, """ + ", ".join(
    f"CASE WHEN day(start) % 7 NOT IN (3, 5) THEN {c} END AS {c}" for c in ("open", "high", "low", "close")
) + " FROM whole)"


@query(
    "reversal_signal_gaps",
    f"WITH {o.signal_chain('type').replace(o.BARS['type'], _GAPPY)} SELECT {_SIGNAL_OUT} FROM signals",
)
def reversal_signal_gaps(spark, folder):
    """Days of NaN and of null prices: no trigger follows from either."""
    return rounded(signals_of(t.gappy_bars(spark, folder), t.blocks(spark, folder)))


_LIVE = f"""near AS (SELECT * FROM bars_sd
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY start DESC) <= 25),
{o.panel('near')}, {o.SEGMENTS}, {o.signals()}"""


@query(
    "live_signals",
    f"""WITH {o.BARS['user']}, {o.VOLATILITY}, {o.BASELINE}, {o.BARS_SD}, {_LIVE}
        SELECT {_SIGNAL_OUT} FROM signals
        QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY start DESC) = 1""",
)
def live_signals(spark, folder):
    bars = t.with_baseline(t.bars_user(spark, folder), t.blocks(spark, folder))
    return rounded(signal_plans.live_signals(bars, sd_factor=SD_FACTOR))


# --- windows ------------------------------------------------------------------------------


def _bars_query(name: str, columns: str, extra: str = ""):
    return query(name, f"WITH {o.BARS['type']}{extra} SELECT symbol, start, {columns} FROM bars")


@_bars_query(
    "rolling_std",
    f"{o.fixed(o.full('stddev_samp', 'high', 10))} AS sd_high, "
    f"{o.fixed(o.full('stddev_samp', 'low', 10))} AS sd_low",
)
def rolling_std(spark, folder):
    bars = t.bars_type(spark, folder).select("symbol", "start", "high", "low")
    out = windows.rolling_std(
        bars, {"sd_high": "high", "sd_low": "low"}, 10, blocks=t.blocks(spark, folder)
    )
    return rounded(out.select("symbol", "start", "sd_high", "sd_low"))


@_bars_query(
    "rolling_mean",
    ", ".join(f"{o.fixed(o.full('avg', 'close', n))} AS mave_{n}" for n in (5, 8, 16)),
)
def rolling_mean(spark, folder):
    bars = t.bars_type(spark, folder).select("symbol", "start", "close")
    means = {f"mave_{n}": ("close", n) for n in (5, 8, 16)}
    return rounded(windows.rolling_mean(bars, means, blocks=t.blocks(spark, folder)).drop("close"))


@_bars_query(
    "true_range",
    f"{o.fixed(o.full('avg', '(high - low)', 3))} AS atr_mean, "
    f"{o.fixed(o.full('stddev_samp', '(high - low)', 3))} AS atr_std",
)
def true_range(spark, folder):
    bars = t.bars_type(spark, folder).select(
        "symbol", "start", (F.col("high") - F.col("low")).alias("range")
    )

    def add(wide, partition):
        return wide.withColumns(
            {
                "atr_mean": windows.rolling_mean_of(F.col("range"), 3, partition),
                "atr_std": windows.rolling_std_of(F.col("range"), 3, partition),
            }
        )

    return rounded(windows.over_lookback(bars, 2, add, blocks=t.blocks(spark, folder)).drop("range"))


@_bars_query("rolling_sum", f"{o.fixed(f'sum(close) OVER {o.series(10)}')} AS total")
def rolling_sum(spark, folder):
    bars = t.bars_type(spark, folder).select("symbol", "start", "close")
    return rounded(windows.rolling_sum(bars, "total", "close", blocks=t.blocks(spark, folder)).drop("close"))


@_bars_query(
    "running_sum",
    "sum(CASE WHEN close > open THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY start "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS risen",
)
def running_sum(spark, folder):
    bars = t.bars_type(spark, folder).select(
        "symbol", "start", (F.col("close") > F.col("open")).cast("bigint").alias("rose")
    )
    return windows.running_sum(bars, "risen", "rose", blocks=t.blocks(spark, folder)).drop("rose")


@_bars_query(
    "lag_prev",
    "lag(close) OVER (PARTITION BY symbol ORDER BY start) AS prev_close",
)
def lag_prev(spark, folder):
    bars = t.bars_type(spark, folder).select("symbol", "start", "close")
    return windows.lag_prev(bars, {"prev_close": "close"}, blocks=t.blocks(spark, folder)).drop("close")


@_bars_query(
    "countdown",
    "greatest(10 - row_number() OVER (PARTITION BY symbol ORDER BY start), 0)::BIGINT "
    "AS lag_number",
)
def countdown(spark, folder):
    bars = t.bars_type(spark, folder).select("symbol", "start")
    return windows.countdown(bars, blocks=t.blocks(spark, folder))


@query(
    "forward_fill",
    f"""WITH {o.BARS['type']},
        holed AS (SELECT symbol, start, CASE WHEN
            row_number() OVER (PARTITION BY symbol ORDER BY start) % 3 <> 0 THEN close END AS part
          FROM bars)
        SELECT symbol, start, part, last_value(part IGNORE NULLS) OVER (PARTITION BY symbol
          ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled
        FROM holed""",
)
def forward_fill(spark, folder):
    span = t.blocks(spark, folder)
    bars = t.bars_type(spark, folder).select("symbol", "start", "close", F.lit(1).alias("one"))
    numbered = windows.running_sum(bars, "place", "one", blocks=span)
    holed = numbered.select(
        "symbol", "start", F.when(F.col("place") % 3 != 0, F.col("close")).alias("part")
    )
    return windows.forward_fill(holed, {"filled": "part"}, blocks=span)


@query(
    "first_known",
    f"""WITH {o.BARS['type']},
        holed AS (SELECT symbol, start, CASE WHEN day(start) > 2 THEN open END AS open,
          CASE WHEN close > open THEN close END AS close FROM bars)
        SELECT symbol, arg_min(open, start) FILTER (open IS NOT NULL) AS open,
          arg_min(close, start) FILTER (close IS NOT NULL) AS close FROM holed GROUP BY symbol""",
)
def first_known_values(spark, folder):
    bars = t.bars_type(spark, folder)
    holed = bars.select(
        "symbol", "start", F.when(F.dayofmonth("start") > 2, F.col("open")).alias("open"),
        F.when(F.col("close") > F.col("open"), F.col("close")).alias("close"),
    )
    return first_known(holed, ["open", "close"])


@query(
    "tail_n",
    f"""WITH {o.BARS['type']} SELECT {_BAR_OUT} FROM bars
        QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY start DESC) <= 25""",
)
def tail_n(spark, folder):
    return tail_rows(t.bars_type(spark, folder), 25)


@query(
    "ema_fold",
    f"""WITH RECURSIVE {o.BARS['type']},
        ordered AS (SELECT symbol, start, close,
            row_number() OVER (PARTITION BY symbol ORDER BY start) AS i FROM bars),
        fold AS (
          SELECT symbol, start, i, close AS ema FROM ordered WHERE i = 1
          UNION ALL
          SELECT n.symbol, n.start, n.i, f.ema + (2.0::DOUBLE / 11) * (n.close - f.ema)
          FROM fold f JOIN ordered n ON n.symbol = f.symbol AND n.i = f.i + 1)
        SELECT symbol, start, {_r('ema')} FROM fold""",
)
def ema_fold(spark, folder):
    bars = t.bars_type(spark, folder).select("symbol", "start", "close")
    return rounded(windows.ema_fold(bars, "ema", "close", blocks=t.blocks(spark, folder)).drop("close"))


ROWS = 2000  # in a block of ticks


@query(
    "tick_series_in_row_blocks",
    f"""WITH {o.TICKS_TYPE},
        looked AS (SELECT symbol, seq,
          CASE WHEN count(last_price) OVER near = 5 THEN avg(last_price) OVER near END AS mean_5,
          count(last_price) OVER (PARTITION BY symbol ORDER BY seq) AS n_so_far,
          lag(last_price) OVER (PARTITION BY symbol ORDER BY seq) AS before,
          last_value(CASE WHEN seq % 7 = 0 THEN last_price END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY seq
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS marked
        FROM ticks WINDOW near AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
        SELECT symbol, seq, n_so_far, {_r('mean_5 before marked')} FROM looked""",
)
def tick_series_in_row_blocks(spark, folder):
    """Raw ticks of a few symbols, each with far more of a day than a block takes: blocks of equal rows."""
    ticks = t.ticks_type(spark, folder).select("symbol", "seq", "last_price")
    blocks = RowBlocks.of(ticks, "seq", rows=ROWS)
    one = F.when(F.col("last_price").isNotNull(), 1).otherwise(0)
    marked = F.when(F.col("seq") % 7 == 0, F.col("last_price"))
    rows = ticks.withColumns({"one": one, "some": marked})
    rows = windows.rolling_mean(rows, {"mean_5": ("last_price", 5)}, order="seq", blocks=blocks)
    rows = windows.running_sum(rows, "n_so_far", "one", order="seq", blocks=blocks)
    rows = windows.lag_prev(rows, {"before": "last_price"}, order="seq", blocks=blocks)
    rows = windows.forward_fill(rows, {"marked": "some"}, order="seq", blocks=blocks)
    return rounded(rows.select("symbol", "seq", "n_so_far", "mean_5", "before", "marked"))


@query(
    "partition_mean",
    f"""WITH {o.BARS['user']}
        SELECT symbol, start, {o.fixed('avg(close) OVER (PARTITION BY symbol)')} AS mean_close
        FROM bars""",
)
def partition_mean(spark, folder):
    bars = t.bars_user(spark, folder).select("symbol", "start", "close")
    return rounded(windows.partition_mean(bars, "mean_close", "close").drop("close"))


# --- rows per key and upserts -------------------------------------------------------------


def _one_per_symbol(direction: str) -> str:
    return f"""WITH {o.TICKS_USER} SELECT * FROM ticks
        QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date {direction},
          seq {direction}) = 1"""


@query("latest_per_key", _one_per_symbol("DESC"))
def latest(spark, folder):
    return latest_per_key(t.ticks_user(spark, folder), "symbol", "date")


@query("dedup_keep_first", _one_per_symbol("ASC"))
def keep_first(spark, folder):
    return dedup_keep_first(t.ticks_user(spark, folder), "symbol", ["date", "seq"])


@query("dedup_keep_last", _one_per_symbol("DESC"))
def keep_last(spark, folder):
    return dedup_keep_last(t.ticks_user(spark, folder), "symbol", ["date", "seq"])


_LEDGER_SQL = """stored AS (
  SELECT symbol, CASE WHEN instrument_token % 4 <> 1 THEN margin END AS margin,
    CASE WHEN instrument_token % 3 <> 0 THEN position_type END AS position_type FROM ledger),
changes AS (
  SELECT CASE WHEN instrument_token % 2 = 0 THEN symbol ELSE 'new-' || symbol END AS symbol,
    CASE WHEN instrument_token % 3 = 0 THEN margin + 1 END AS margin,
    CASE WHEN instrument_token % 5 <> 0 THEN 'long' END AS position_type
  FROM ledger WHERE margin >= 8)"""


def _ledger_versions(spark, folder):
    book, token = t.ledger(spark, folder), F.col("instrument_token")
    stored = book.select(
        "symbol",
        F.when(token % 4 != 1, F.col("margin")).alias("margin"),
        F.when(token % 3 != 0, F.col("position_type")).alias("position_type"),
    )
    changes = book.filter(F.col("margin") >= 8).select(
        F.when(token % 2 == 0, F.col("symbol"))
        .otherwise(F.concat(F.lit("new-"), "symbol"))
        .alias("symbol"),
        F.when(token % 3 == 0, F.col("margin") + 1).alias("margin"),
        F.when(token % 5 != 0, F.lit("long")).alias("position_type"),
    )
    return stored, changes


@query(
    "coalescing_upsert",
    f"""WITH {o.LEDGER}, {_LEDGER_SQL}
        SELECT coalesce(c.symbol, s.symbol) AS symbol, coalesce(c.margin, s.margin) AS margin,
          coalesce(c.position_type, s.position_type) AS position_type
        FROM changes c FULL JOIN stored s ON s.symbol = c.symbol""",
)
def upsert(spark, folder):
    stored, changes = _ledger_versions(spark, folder)
    return coalescing_upsert(changes, stored, "symbol")


@query(
    "masked_update",
    f"""WITH {o.LEDGER}, {_LEDGER_SQL}
        SELECT s.symbol, coalesce(c.margin, s.margin) AS margin,
          coalesce(c.position_type, s.position_type) AS position_type
        FROM stored s LEFT JOIN changes c ON s.symbol = c.symbol""",
)
def update(spark, folder):
    stored, changes = _ledger_versions(spark, folder)
    return masked_update(stored, changes, "symbol")


@query(
    "drop_closed",
    f"""WITH {o.LEDGER}, {_LEDGER_SQL}
        SELECT * FROM stored WHERE symbol NOT IN (SELECT symbol FROM changes)""",
)
def closed(spark, folder):
    stored, changes = _ledger_versions(spark, folder)
    return drop_closed(stored, changes, "symbol")


@query("union_history", f"WITH {o.TICKS_USER} SELECT * FROM ticks")
def union(spark, folder):
    ticks = t.ticks_user(spark, folder)
    return union_history(ticks.filter("seq % 2 = 0"), ticks.filter("seq % 2 = 1"))
