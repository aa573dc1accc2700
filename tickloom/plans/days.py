"""The breakout scan from statistics that are kept day by day.

The scan needs, per symbol, the volatility of the last day it traded on before the scanned one, and the
few bars before the day that its first windows look back on. Both fit one row per symbol. A day's rows
follow from its bars and the rows before it, so a day costs reading that day's bars, however long the
history is.
"""

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickloom.operators.blocks import Blocks, over_lookback
from tickloom.operators.keyed import latest_per_key, tail_rows
from tickloom.plans.signals import LENGTHS, Lengths, add_ranges, known_prices, scored_breakouts

_BAR = ["date", "high", "low", "close"]


def statistics_schema(history: DataFrame) -> StructType:
    """Per symbol: day, sd_sum and sd_count of its last day, and the last bars before the next."""
    bar = ", ".join(f"{c}: {history.schema[c].dataType.simpleString()}" for c in _BAR)
    return StructType.fromDDL(f"symbol string, day date, sd_sum double, sd_count bigint, last array<struct<{bar}>>")


def no_statistics(spark: SparkSession, history: DataFrame) -> DataFrame:
    return spark.createDataFrame([], statistics_schema(history))


def _panel(bars: DataFrame, before: DataFrame, lengths: Lengths) -> DataFrame:
    """The bars with sd, atr and natr, and the kept bars before them (`_kept`) without."""
    new = known_prices(bars.select("symbol", *_BAR)).withColumn("_kept", F.lit(False))
    old = before.select("symbol", F.explode("last").alias("bar")).select(
        "symbol", *[F.col(f"bar.{c}") for c in _BAR], F.lit(True).alias("_kept")
    )
    old = old.join(new.select("symbol").distinct(), "symbol", "left_semi")
    return add_ranges(old.unionByName(new), ["symbol"], lengths)


def _sums() -> list:
    return [F.coalesce(F.sum("sd"), F.lit(0.0)).alias("sd_sum"), F.count("sd").alias("sd_count")]


def _last_bars(bars: DataFrame, lengths: Lengths) -> DataFrame:
    reach = max(lengths.sd, lengths.atr) - 1
    kept = tail_rows(bars, reach, "symbol", "date").groupBy("symbol")
    return kept.agg(F.array_sort(F.collect_list(F.struct(*_BAR))).alias("last"))


def advance(bars: DataFrame, before: DataFrame, lengths: Lengths = LENGTHS) -> DataFrame:
    """The statistics after a day, from its bars (`history` columns) and the statistics before it.

    A symbol without bars on the day keeps its row. Symbols are known by name; a null name has none.
    """
    panel = _panel(bars.filter("symbol is not null"), before, lengths)
    new = panel.filter(~F.col("_kept")).groupBy("symbol")
    day = new.agg(F.max(F.to_date("date")).alias("day"), *_sums())
    names = before.columns
    rest = before.join(day.select("symbol"), "symbol", "left_anti")
    return day.join(_last_bars(panel, lengths), "symbol").select(*names).unionByName(rest.select(*names))


def statistics_of(
    history: DataFrame, as_of: date | str, blocks: Blocks | None = None, lengths: Lengths = LENGTHS
) -> DataFrame:
    """The statistics after a day from the whole history: what `advance` leads to day by day."""
    kind = history.schema["date"].dataType
    until = F.date_add(F.lit(str(as_of)).cast("date"), 1).cast(kind)
    bars = known_prices(history.select("symbol", *_BAR)).filter((F.col("date") < until) & F.col("symbol").isNotNull())

    def add(wide: DataFrame, partition: list[str]) -> DataFrame:
        return add_ranges(wide, partition, lengths)

    panel = over_lookback(bars, max(lengths.sd, lengths.atr) - 1, add, "symbol", "date", blocks)
    daily = panel.groupBy("symbol", F.to_date("date").alias("day")).agg(*_sums())
    last = latest_per_key(daily, "symbol", "day").join(_last_bars(bars, lengths), "symbol")
    return last.select(*statistics_schema(history).names)


def breakouts_of_day(
    bars: DataFrame, before: DataFrame, sd_factor: float = 4, natr_min: float = 0.3, lengths: Lengths = LENGTHS
) -> DataFrame:
    """`breakout_scan` of the day that `bars` are of, from the statistics before it."""
    panel = _panel(bars, before, lengths).filter(~F.col("_kept")).drop("_kept")
    joined = panel.join(before.select("symbol", "sd_sum", "sd_count"), "symbol", "left")
    return scored_breakouts(joined, sd_factor, natr_min)


def read_statistics(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def keep_day(
    history: DataFrame, as_of: date | str, path: str, blocks: Blocks | None = None, lengths: Lengths = LENGTHS
) -> DataFrame:
    """Writes the statistics after a day to `path`/after=`as_of`, from the latest ones before it, and reads them.

    The first call reads the whole history up to `as_of`; a later one the days that came since the last,
    one after the other. Calling it again for a day overwrites what it wrote. `history` may be stored by
    `day`, and only the days needed are opened then.
    """
    spark, schema = history.sparkSession, statistics_schema(history)
    day = F.col("day") if "day" in history.columns else F.to_date("date")
    wanted = F.lit(str(as_of)).cast("date")
    spark.createDataFrame([], schema).write.mode("append").parquet(f"{path}/after=0001-01-01")
    known = spark.read.schema(StructType(schema.fields[:]).add("after", "date")).parquet(path)
    last = known.filter(F.col("after") < wanted).agg(F.max("after")).first()[0]
    if last is None:
        after = statistics_of(history.filter(day <= wanted), as_of, blocks, lengths)
        after.write.mode("overwrite").parquet(f"{path}/after={as_of}")
        return read_statistics(spark, f"{path}/after={as_of}", schema)
    since, folder = F.lit(str(last)).cast("date"), f"{path}/after={last}"
    days = [r[0] for r in history.filter((day > since) & (day <= wanted)).select(day.alias("d")).distinct().collect()]
    for each in sorted(days):
        bars = history.filter(day == F.lit(each)).drop("day")
        after = advance(bars, read_statistics(spark, folder, schema), lengths)
        folder = f"{path}/after={each}"
        after.write.mode("overwrite").parquet(folder)
    return read_statistics(spark, folder, schema)
