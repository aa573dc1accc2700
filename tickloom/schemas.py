"""Schemas of the tables and topics, written out by hand (nothing is inferred)."""

from pyspark.sql.types import (
    BooleanType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(**columns) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in columns.items()])


_STR, _LONG, _DBL, _BOOL, _TS = StringType(), LongType(), DoubleType(), BooleanType(), TimestampType()

INSTRUMENT = _struct(tradingsymbol=_STR, instrument_token=_LONG, segment=_STR)

MARGIN = _struct(tradingsymbol=_STR, mis_multiplier=_DBL)

UNIVERSE = _struct(tradingsymbol=_STR, instrument_token=_LONG, mis_multiplier=_DBL)

TRADABLE = _struct(instrument_token=_LONG, symbol=_STR, margin=_DBL)

HISTORY = _struct(
    date=_TS, open=_DBL, high=_DBL, low=_DBL, close=_DBL, volume=_LONG,
    symbol=_STR, instrument_token=_LONG,
)

# `tradable` is sent as a JSON boolean and read as text.
TICK = _struct(
    instrument_token=_LONG, symbol=_STR, last_price=_DBL, mode=_STR, tradable=_STR,
    avg_sd=_DBL, date=_TS,
)

BAR = _struct(
    instrument_token=_LONG, symbol=_STR, start=_TS, end=_TS,
    open=_DBL, high=_DBL, low=_DBL, close=_DBL, avg_sd=_DBL,
)

SIGNAL = _struct(
    open=_DBL, high=_DBL, low=_DBL, close=_DBL, start=_TS, trigger=_BOOL, price=_DBL,
    instrument_token=_LONG, symbol=_STR, source=_STR, position_type=_STR,
    initial_stop_loss=_DBL, initial_controller=_DBL, avg_sd=_DBL,
)

ORDER = _struct(symbol=_STR, position_type=_STR, type=_STR, price=_DBL, start=_TS)

LEDGER = _struct(
    account_id=_STR, symbol=_STR, instrument_token=_LONG, margin=_DBL, position_type=_STR,
    position=_BOOL, order_id=_LONG, filled_quantity=_DBL, quantity=_DBL, intent_id=_STR,
)

ORDER_STATUS = _struct(
    average_price=_DBL, cancelled_quantity=_LONG, disclosed_quantity=_LONG,
    filled_quantity=_LONG, instrument_token=_LONG, order_id=_LONG, order_timestamp=_TS,
    pending_quantity=_LONG, quantity=_LONG, status_message=_STR, symbol=_STR,
    transaction_type=_STR, status=_STR,
)

BREAKOUT = _struct(date=_TS, symbol=_STR, sd=_DBL, avg_sd=_DBL, natr=_DBL)

# Columns whose name on the wire differs from the name inside the engine.
WIRE_NAMES = {"avg_sd": "avg(sd)"}
