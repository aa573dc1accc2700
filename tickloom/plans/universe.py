"""Which instruments to follow, and their price history."""

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.keyed import require_unique


def universe_join(
    instruments: DataFrame, margins: DataFrame, segment: str = "NSE"
) -> DataFrame:
    """Instruments of one segment that have a margin multiple; names must be unique on both sides."""
    listed = instruments.filter(F.col("segment") == segment).select(
        "tradingsymbol", "instrument_token"
    )
    multiples = margins.select("tradingsymbol", "mis_multiplier")
    joined = require_unique(listed, "tradingsymbol").join(
        require_unique(multiples, "tradingsymbol"), "tradingsymbol"
    )
    return joined.select("tradingsymbol", "instrument_token", "mis_multiplier")


def universe_screen(
    universe: DataFrame, daily: DataFrame, value_factor: float = 1.5, min_price: float = 25
) -> DataFrame:
    """Instruments traded well above the average value and above a minimum price.

    The value of an instrument is mean close times mean volume; the bar to pass is
    `value_factor` times the mean of that over all instruments with history.
    """
    means = daily.groupBy("instrument_token").agg(
        F.avg("volume").alias("mean_volume"), F.avg("close").alias("mean_price")
    )
    valued = universe.join(means, "instrument_token").withColumn(
        "mean_value", F.col("mean_price") * F.col("mean_volume")
    )
    average = valued.agg(F.avg("mean_value")).scalar()
    return valued.filter(
        (F.col("mean_value") > value_factor * average) & (F.col("mean_price") > min_price)
    ).select(
        "instrument_token",
        F.col("tradingsymbol").alias("symbol"),
        F.col("mis_multiplier").alias("margin"),
    )


def load_history(
    universe: DataFrame, history: DataFrame, from_date: date | str, to_date: date | str
) -> DataFrame:
    """History rows of the universe between two days, both included, with the symbol added.

    The bounds compare the stored columns themselves, so they reach the scan; a history stored
    by `day` (see `sources.files.write_history`) opens only the days asked for.
    """
    first, last = (F.lit(str(day)).cast("date") for day in (from_date, to_date))
    kind = history.schema["date"].dataType
    rows = history.filter(
        (F.col("date") >= first.cast(kind)) & (F.col("date") < F.date_add(last, 1).cast(kind))
    )
    if "day" in history.columns:
        rows = rows.filter(F.col("day").between(first, last)).drop("day")
    names = universe.select("instrument_token", "symbol")
    return rows.drop("symbol").join(names, "instrument_token")
