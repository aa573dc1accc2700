"""SQL building blocks for checking the jobs against another engine."""

from tickloom.testbed.registry import NUDGE

TICKS_TYPE = (
    "ticks AS (SELECT CAST(NULL AS BIGINT) AS instrument_token, event_type AS symbol, "
    "value AS last_price, ts AS date, event_id AS seq FROM events)"
)
TICKS_USER = (
    "ticks AS (SELECT user_id AS instrument_token, CAST(user_id AS VARCHAR) AS symbol, "
    "value AS last_price, ts AS date, event_id AS seq FROM events)"
)


def _bars(unit: str) -> str:
    return f"""bars AS (
  SELECT instrument_token, symbol, date_trunc('{unit}', date)::TIMESTAMP AS start,
    arg_min(last_price, seq) AS open, max(last_price) AS high, min(last_price) AS low,
    arg_max(last_price, seq) AS close
  FROM ticks GROUP BY ALL)"""


BARS = {"type": f"{TICKS_TYPE}, {_bars('hour')}", "user": f"{TICKS_USER}, {_bars('day')}"}


def series(n: int, order: str = "start") -> str:
    return (
        f"(PARTITION BY symbol ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    )


def full(function: str, column: str, n: int, order: str = "start") -> str:
    """The function over n rows, null until n values are there."""
    over = series(n, order)
    return f"CASE WHEN count({column}) OVER {over} = {n} THEN {function}({column}) OVER {over} END"


def fixed(expression: str, digits: int = 6) -> str:
    """Rounded as `registry.rounded` does, without a negative zero."""
    return f"(round({expression} + {NUDGE}::DOUBLE, {digits}) + 0.0)::DOUBLE"


VOLATILITY = f"""vol0 AS (
  SELECT *, {full('stddev_samp', 'high', 10)} AS sd_high,
    {full('stddev_samp', 'low', 10)} AS sd_low FROM bars),
vol AS (SELECT *, greatest(sd_high, sd_low) AS sd FROM vol0)"""

BASELINE = """base AS (
  SELECT instrument_token, symbol, avg(sd) AS avg_sd FROM vol GROUP BY ALL)"""


def panel(source: str = "bars") -> str:
    return f"""p1 AS (
  SELECT *, high - low AS "range", {full('stddev_samp', 'high', 10)} AS sd_high,
    {full('stddev_samp', 'low', 10)} AS sd_low, {full('avg', 'close', 5)} AS mave_5,
    {full('avg', 'close', 8)} AS mave_8, {full('avg', 'close', 16)} AS mave_16 FROM {source}),
p2 AS (
  SELECT *, greatest(sd_high, sd_low) AS sd, {full('avg', '"range"', 3)} AS atr,
    mave_8 - mave_16 AS macd_line FROM p1),
p3 AS (
  SELECT *, atr / close * 100 AS natr, {full('avg', 'macd_line', 5)} AS signal FROM p2),
panel AS (SELECT *, macd_line - signal AS macd FROM p3)"""


SEGMENTS = """s1 AS (
  SELECT *, CASE WHEN macd > 0 THEN 'short' ELSE 'long' END AS position_type FROM panel),
s2 AS (
  SELECT *, CASE WHEN position_type IS DISTINCT FROM
      lag(position_type) OVER (PARTITION BY symbol ORDER BY start) THEN 1 ELSE 0 END AS changed
  FROM s1),
s3 AS (
  SELECT *, sum(changed) OVER (PARTITION BY symbol ORDER BY start
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS group_id FROM s2),
segments AS (
  SELECT *, max(high) OVER g AS local_maxima, min(low) OVER g AS local_minima FROM s3
  WINDOW g AS (PARTITION BY symbol, group_id ORDER BY start
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def signals(sd_factor: float = 1.2, natr_min: float = 0.3, source: str = "segments") -> str:
    return f"""g1 AS (
  SELECT *, CASE WHEN position_type = 'short' THEN local_maxima - atr
      ELSE local_minima + atr END AS price FROM {source}),
signals AS (
  SELECT instrument_token, symbol, start, open, high, low, close, avg_sd, position_type, price,
    'entry' AS source,
    coalesce(CASE WHEN position_type = 'short' THEN close < price ELSE close > price END
      AND natr > {natr_min} AND sd > {sd_factor} * avg_sd, false) AS "trigger",
    CASE WHEN position_type = 'short' THEN price + 2 * atr ELSE price - 2 * atr END
      AS initial_stop_loss,
    CASE WHEN position_type = 'short' THEN price + sd_high ELSE price - sd_low END
      AS initial_controller FROM g1)"""


BARS_SD = (
    "bars_sd AS (SELECT bars.*, base.avg_sd FROM bars LEFT JOIN base ON base.symbol = bars.symbol)"
)


def signal_chain(kind: str) -> str:
    return ", ".join(
        [BARS[kind], VOLATILITY, BASELINE, BARS_SD, panel("bars_sd"), SEGMENTS, signals()]
    )


def _step(old: str) -> str:
    """One bar of an open position, as nested selects over `old` (bar columns and state)."""
    return f"""
    SELECT *, sqrt((greatest(10 - bars, 0) * constant + list_sum(squares)) / 10) AS controller_sd
    FROM (
      SELECT * EXCLUDE (squares, constant),
        CASE WHEN held THEN constant WHEN entered THEN square END AS constant,
        CASE WHEN held THEN list_append(squares, square)[-10:]
          WHEN entered THEN [square] END AS squares
      FROM (
        SELECT *, (controller - CASE WHEN kind = 'short' THEN low ELSE high END) ** 2 AS square
        FROM (
          SELECT * EXCLUDE (controller),
            CASE WHEN held THEN controller + (2.0::DOUBLE / 11) * (pull - controller)
              WHEN entered THEN initial_controller END AS controller
          FROM (
            SELECT *, CASE WHEN kind = 'short' THEN high ELSE low END AS pull FROM ({old})))))"""


def _stopped(stepped: str) -> str:
    return f"""
    SELECT * EXCLUDE (stop_loss),
      CASE WHEN entered THEN initial_stop_loss
        WHEN held THEN stop_loss + (CASE
          WHEN avg_sd IS NULL OR avg_sd = 0 OR NOT controller_sd / avg_sd < 9 THEN 0.9::DOUBLE
          WHEN controller_sd = 0 THEN 0::DOUBLE
          ELSE 2 / (round_even(10 / (controller_sd / avg_sd), 0) + 1) END) * (pull - stop_loss)
        END AS stop_loss
    FROM ({stepped})"""


_STATE = (
    "symbol, i, start, exited, entered, price, kind, since, bars, controller, stop_loss, "
    "constant, squares, controller_sd"
)


def lifecycle() -> str:
    """Positions by recursion over each symbol's bars; needs `signals`."""
    first = """
      SELECT * EXCLUDE (price), CASE WHEN "trigger" THEN price END AS price, false AS exited,
        "trigger" AS entered, false AS held,
        CASE WHEN "trigger" THEN position_type END AS kind,
        CASE WHEN "trigger" THEN start END AS since,
        CASE WHEN "trigger" THEN 1 END AS bars,
        CAST(NULL AS DOUBLE) AS controller, CAST(NULL AS DOUBLE) AS stop_loss,
        CAST(NULL AS DOUBLE) AS constant, CAST(NULL AS DOUBLE[]) AS squares
      FROM ordered WHERE i = 1"""
    later = """
      SELECT * EXCLUDE (price, kind, since, bars),
        CASE WHEN entered THEN price END AS price,
        CASE WHEN held THEN kind WHEN entered THEN position_type END AS kind,
        CASE WHEN held THEN since WHEN entered THEN start END AS since,
        CASE WHEN held THEN bars + 1 WHEN entered THEN 1 END AS bars
      FROM (
        SELECT *, kind IS NOT NULL AND NOT exited AS held,
          (kind IS NULL OR exited) AND "trigger" AS entered
        FROM (
          SELECT o.*, l.kind, l.since, l.bars, l.controller, l.stop_loss, l.constant, l.squares,
            l.kind IS NOT NULL AND CASE WHEN l.kind = 'short' THEN o.close > l.stop_loss
              ELSE o.close < l.stop_loss END AS exited
          FROM life l JOIN ordered o ON o.symbol = l.symbol AND o.i = l.i + 1))"""
    return f"""ordered AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY start) AS i FROM signals),
life AS (
  SELECT {_STATE} FROM ({_stopped(_step(first))})
  UNION ALL
  SELECT {_STATE} FROM ({_stopped(_step(later))})),
lifecycle AS (
  SELECT symbol, start, exited, entered, price, kind AS position_type, since AS position_time,
    controller, constant AS controller_constant, 
    CASE WHEN bars IS NOT NULL THEN greatest(10 - bars, 0) END::BIGINT AS lag_number,
    controller_sd, stop_loss FROM life WHERE exited OR kind IS NOT NULL)"""


def held_positions() -> str:
    """Stops of given positions (`position_bars`), by recursion without exits."""
    first = """
      SELECT *, false AS exited, true AS entered, false AS held, position_type AS kind,
        start AS since, 1 AS bars, CAST(NULL AS DOUBLE) AS controller,
        CAST(NULL AS DOUBLE) AS stop_loss, CAST(NULL AS DOUBLE) AS constant,
        CAST(NULL AS DOUBLE[]) AS squares
      FROM ordered WHERE i = 1"""
    later = """
      SELECT o.*, false AS exited, false AS entered, true AS held, l.kind, l.since,
        l.bars + 1 AS bars, l.controller, l.stop_loss, l.constant, l.squares
      FROM life l JOIN ordered o ON o.symbol = l.symbol AND o.i = l.i + 1"""
    return f"""ordered AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY start) AS i FROM position_bars),
life AS (
  SELECT {_STATE} FROM ({_stopped(_step(first))})
  UNION ALL
  SELECT {_STATE} FROM ({_stopped(_step(later))}))"""


ORDERS_IN = """orders_in AS (
  SELECT ts::DATE AS batch, CAST(user_id AS VARCHAR) AS symbol,
    CASE WHEN event_type = 'purchase' THEN 'entry' ELSE 'exit' END AS type,
    CASE WHEN event_id % 2 = 0 THEN 'long' ELSE 'short' END AS position_type,
    value AS price, event_id AS seq
  FROM events WHERE event_type IN ('purchase', 'signup'))"""

LEDGER = """ledger AS (
  SELECT CAST(user_id AS VARCHAR) AS symbol, user_id AS instrument_token,
    ([3.0, 5.0, 8.3, 12.5]::DOUBLE[])[user_id % 4 + 1] AS margin,
    user_id % 5 = 0 AS position,
    CASE WHEN user_id % 2 = 0 THEN 'long' ELSE 'short' END AS position_type,
    (20 + user_id % 7 * 10)::DOUBLE AS quantity,
    floor((20 + user_id % 7 * 10)::DOUBLE * (user_id % 3) / 2) AS filled_quantity
  FROM (SELECT DISTINCT user_id FROM events))"""

DAILY = """daily AS (
  SELECT l_partkey AS instrument_token, l_shipdate AS date,
    l_extendedprice / l_quantity AS close, l_quantity AS volume FROM lineitem)"""

UNIVERSE = """listed AS (
  SELECT 'P' || p_partkey AS tradingsymbol, p_partkey AS instrument_token,
    1.0::DOUBLE + p_size % 12 AS mis_multiplier FROM part)"""

FIRST_ORDERS = """firsts AS (
  SELECT * FROM orders_in
  QUALIFY row_number() OVER (PARTITION BY batch, symbol ORDER BY seq) = 1)"""
