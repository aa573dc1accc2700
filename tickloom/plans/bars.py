"""Ticks to bars, bars to ticks, bars merged and turned into messages."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.clock import epoch_micros, epoch_nanos, round_minute, timestamp_text
from tickloom.functions.codec import json_encode
from tickloom.operators.keyed import tail_rows

BEFORE_LIVE = 1 << 62


def ohlc_bars(
    ticks: DataFrame, width: str = "60 seconds", watermark: str = "2 seconds"
) -> DataFrame:
    """Open, high, low, close and the last avg_sd per instrument and window.

    First and last mean order of arrival, given by the long column `seq` (a topic offset). A
    single long keeps the aggregate hash-based, with ticks reduced to bars before the shuffle.
    Streams get the watermark; `seq` must then be unique in a window, as offsets are.
    """
    if ticks.isStreaming:
        ticks = ticks.withWatermark("date", watermark)
    window = F.window("date", width).alias("window")
    known_sd = F.col("avg_sd") if "avg_sd" in ticks.columns else F.lit(None).cast("double")
    bars = ticks.groupBy("instrument_token", "symbol", window).agg(
        F.min_by("last_price", "seq").alias("open"),
        F.max("last_price").alias("high"),
        F.min("last_price").alias("low"),
        F.max_by("last_price", "seq").alias("close"),
        F.max_by(known_sd, F.col("seq")).alias("avg_sd"),
    )
    return bars.select(
        "instrument_token",
        "symbol",
        F.col("window.start").alias("start"),
        F.col("window.end").alias("end"),
        "open", "high", "low", "close", "avg_sd",
    )


def enrich_ticks(ticks: DataFrame, reference: DataFrame) -> DataFrame:
    """Live ticks with symbol and avg_sd of their instrument; zero prices are dropped.

    A tick without a price, or of an unknown instrument, stays. The reference is one row per
    instrument; AQE broadcasts it while it is below the session's threshold.
    """
    added = reference.select("instrument_token", "symbol", "avg_sd")
    live = ticks.drop("symbol", "avg_sd")
    kept = live.filter(F.coalesce(F.col("last_price") != 0, F.lit(True)))
    return kept.join(added, "instrument_token", "left")


def stamp_ingest(ticks: DataFrame) -> DataFrame:
    """Live ticks dated with the second at which they are taken in."""
    return ticks.withColumn("date", F.date_trunc("second", F.current_timestamp()))


def backfill_ticks(bars: DataFrame, n: int = 30) -> DataFrame:
    """The last n bars of each symbol as four ticks each: open, high, low, close.

    All four carry the bar's start; `position` (0 to 3) tells them apart. `seq` orders the ticks
    of a symbol and is negative, so that they precede whatever a topic delivers.
    """
    four = F.posexplode(F.array("open", "high", "low", "close")).alias("position", "last_price")
    ticks = tail_rows(bars, n).select(
        "instrument_token",
        "symbol",
        four,
        F.lit("ltp").alias("mode"),
        F.lit(True).alias("tradable"),
        "avg_sd",
        F.col("start").alias("date"),
    )
    return ticks.withColumn(
        "seq", epoch_micros(F.col("date")) * 4 + F.col("position") - F.lit(BEFORE_LIVE)
    )


def minute_bars(ticks: DataFrame, date: str = "date", watermark: str | None = None) -> DataFrame:
    """Bars by the *nearest* minute (not the window's floor), keyed (symbol, date).

    On a stream, `watermark` says how long a bar stays open behind the newest one.
    """
    rounded = ticks.select("symbol", "last_price", "seq", round_minute(F.col(date)).alias("date"))
    if watermark is not None and ticks.isStreaming:
        rounded = rounded.withWatermark("date", watermark)
    return rounded.groupBy("symbol", "date").agg(
        F.max("last_price").alias("max"),
        F.min("last_price").alias("min"),
        F.min_by("last_price", "seq").alias("first"),
        F.max_by("last_price", "seq").alias("last"),
    )


def merge_bars(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored bars updated with a batch's max/min/first/last; one full outer join.

    The stored open and key stay, high and low widen, the close is the batch's.
    """
    new = batch
    if "new_key" not in batch.columns:
        new = batch.withColumn("new_key", bar_key(batch, "date"))
    joined = stored.select("symbol", "date", "open", "high", "low", "close", "key").join(
        new.select("symbol", "date", "max", "min", "first", "last", "new_key"),
        ["symbol", "date"],
        "full_outer",
    )
    return joined.select(
        "symbol",
        "date",
        F.coalesce("open", "first").alias("open"),
        F.greatest("high", "max").alias("high"),
        F.least("low", "min").alias("low"),
        F.coalesce("last", "close").alias("close"),
        F.coalesce("key", "new_key").alias("key"),
    )


def bar_key(bars: DataFrame, date: str = "start") -> Column:
    """symbol:nanoseconds, the key under which a bar is stored."""
    return F.concat(bars["symbol"], F.lit(":"), epoch_nanos(bars[date]).cast("string"))


def bar_messages(bars: DataFrame, date: str = "start") -> DataFrame:
    """Key and JSON message of each bar, ready for a key-value store."""
    rows = bars.select(
        bar_key(bars, date).alias("key"),
        "symbol",
        timestamp_text(F.col(date)).alias("date"),
        "open", "high", "low", "close",
    )
    message = json_encode(rows, ["symbol", "date", "open", "high", "low", "close"])
    return rows.select("key", message.alias("message"))
