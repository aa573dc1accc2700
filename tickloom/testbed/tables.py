"""The given tables as ticks, bars, instruments, orders and ledgers.

Plain selects that read alike in SQL (see `oracle`), so that every job has real input.
"""

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.blocks import BLOCK_DAYS, Blocks
from tickloom.plans.bars import ohlc_bars
from tickloom.plans.signals import baseline_volatility

SEGMENT = "Brand#4"
MARGINS = (3.0, 5.0, 8.3, 12.5)
BAR_COLUMNS = ["instrument_token", "symbol", "start", "open", "high", "low", "close"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ticks_type(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.lit(None).cast("bigint").alias("instrument_token"),
        F.col("event_type").alias("symbol"),
        F.col("value").alias("last_price"),
        F.col("ts").alias("date"),
        F.col("event_id").alias("seq"),
    )


def ticks_user(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("user_id").alias("instrument_token"),
        F.col("user_id").cast("string").alias("symbol"),
        F.col("value").alias("last_price"),
        F.col("ts").alias("date"),
        F.col("event_id").alias("seq"),
    )


def bars_type(spark: SparkSession, folder: str) -> DataFrame:
    return ohlc_bars(ticks_type(spark, folder), "1 hour").select(*BAR_COLUMNS)


def bars_user(spark: SparkSession, folder: str) -> DataFrame:
    return ohlc_bars(ticks_user(spark, folder), "1 day").select(*BAR_COLUMNS)


_days = BLOCK_DAYS


@contextmanager
def days_per_block(days: int) -> Iterator[None]:
    """Within, `blocks` are so long."""
    global _days
    before, _days = _days, days
    try:
        yield
    finally:
        _days = before


def blocks(spark: SparkSession, folder: str) -> Blocks:
    """The span of all ticks, and so of all bars."""
    return Blocks.spanning(table(spark, folder, "events"), "ts", _days)


def with_baseline(bars: DataFrame, span: Blocks) -> DataFrame:
    """Bars with the avg_sd of their symbol."""
    usual = baseline_volatility(bars, blocks=span).select("symbol", "avg_sd")
    return bars.join(usual, "symbol", "left")


def instruments(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("tradingsymbol"),
        F.col("p_partkey").alias("instrument_token"),
        F.col("p_brand").alias("segment"),
    )


def margins(spark: SparkSession, folder: str) -> DataFrame:
    """Multiples for the larger parts only: some instruments have none."""
    return (
        table(spark, folder, "part")
        .filter(F.col("p_size") >= 10)
        .select(
            F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("tradingsymbol"),
            (F.lit(1.0) + F.col("p_size") % 12).alias("mis_multiplier"),
        )
    )


def whole_universe(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("tradingsymbol"),
        F.col("p_partkey").alias("instrument_token"),
        (F.lit(1.0) + F.col("p_size") % 12).alias("mis_multiplier"),
    )


def daily(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("instrument_token"),
        F.col("l_shipdate").alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("close"),
        F.col("l_quantity").alias("volume"),
    )


def orders_in(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "events")
        .filter(F.col("event_type").isin("purchase", "signup"))
        .select(
            F.to_date("ts").alias("batch"),
            F.col("user_id").cast("string").alias("symbol"),
            F.when(F.col("event_type") == "purchase", "entry").otherwise("exit").alias("type"),
            F.when(F.col("event_id") % 2 == 0, "long").otherwise("short").alias("position_type"),
            F.col("value").alias("price"),
            F.col("event_id").alias("seq"),
        )
    )


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    user = F.col("user_id")
    margin = F.element_at(F.array(*[F.lit(m) for m in MARGINS]), (user % 4 + 1).cast("int"))
    quantity = (20 + user % 7 * 10).cast("double")
    return (
        table(spark, folder, "events")
        .select("user_id")
        .distinct()
        .select(
            user.cast("string").alias("symbol"),
            user.alias("instrument_token"),
            margin.alias("margin"),
            (user % 5 == 0).alias("position"),
            F.when(user % 2 == 0, "long").otherwise("short").alias("position_type"),
            quantity.alias("quantity"),
            F.floor(quantity * (user % 3) / 2).cast("double").alias("filled_quantity"),
        )
    )


def status_in(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.col("o_orderdate").alias("order_timestamp"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_custkey").alias("instrument_token"),
        F.col("o_orderpriority").alias("tradingsymbol"),
    )


def ledger_with_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger with the broker's order id of each open position."""
    number = F.col("instrument_token") * 100 + 7
    return ledger(spark, folder).withColumn("order_id", F.when(F.col("position"), number))


def status_steps(spark: SparkSession, folder: str) -> DataFrame:
    """Three states of each order, the last two within one second."""
    steps = F.explode(F.array(*[F.lit(k) for k in (0, 1, 2)])).alias("seq")
    words = F.array(F.lit("OPEN"), F.lit("UPDATE"), F.lit("COMPLETE"))
    return table(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority", steps).select(
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.timestamp_add("SECOND", F.least("seq", F.lit(1)), F.col("o_orderdate").cast("timestamp_ntz")).alias(
            "order_timestamp"
        ),
        F.element_at(words, F.col("seq") + 1).alias("status"),
        F.col("o_orderpriority").alias("tradingsymbol"),
        "seq",
    )


def gappy_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly bars of which some days have NaN and some have null prices."""
    day = F.dayofmonth("start") % 7
    nan, none = F.lit(float("nan")), F.lit(None).cast("double")

    def holed(name: str):
        return F.when(day == 3, nan).when(day == 5, none).otherwise(F.col(name)).alias(name)

    return bars_type(spark, folder).select(
        "instrument_token", "symbol", "start", *[holed(c) for c in ("open", "high", "low", "close")]
    )
