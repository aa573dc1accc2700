"""Volatility, indicators, swings and reversal signals from bars."""

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.numbers import known, quotient, row_max
from tickloom.operators.blocks import (
    Blocks,
    blocks_for,
    carry_in,
    least_time,
    over_lookback,
    with_lookback,
)
from tickloom.operators.keyed import join_null_safe, tail_rows
from tickloom.operators.windows import rolling_mean_of, rolling_std_of, so_far, trailing
from tickloom.session import cut_lineage


@dataclass(frozen=True)
class Lengths:
    """Rows in the windows of the panel."""

    # Deviation; plain, fast and slow mean of the close; range; signal line.
    sd: int = 10
    mean: int = 5
    fast: int = 8
    slow: int = 16
    atr: int = 3
    signal: int = 5

    @property
    def macd_lookback(self) -> int:
        """Rows before the first one with a macd: the slow mean's, and the signal line's on it."""
        return max(self.fast, self.slow) - 1 + self.signal - 1

    @property
    def lookback(self) -> int:
        return max(self.macd_lookback, self.sd - 1, self.mean - 1, self.atr - 1)

    @property
    def columns(self) -> list[str]:
        means = [f"mave_{n}" for n in (self.mean, self.fast, self.slow)]
        return [
            "sd_high", "sd_low", "sd", *means, "range", "atr", "natr", "macd_line", "signal",
            "macd",
        ]


LENGTHS = Lengths()


PRICES = ("open", "high", "low", "close", "avg_sd")


def known_prices(bars: DataFrame) -> DataFrame:
    """NaN prices as null: every comparison with a NaN would be true here, and none with a null is."""
    kinds = dict(bars.dtypes)
    return bars.withColumns({c: known(F.col(c)) for c in PRICES if kinds.get(c) in ("double", "float")})


def _add_volatility(
    bars: DataFrame, partition: list[str], order: str, rows: int
) -> DataFrame:
    """The larger of the rolling deviations of high and low."""
    return bars.withColumns(
        {
            "sd_high": rolling_std_of(F.col("high"), rows, partition, order),
            "sd_low": rolling_std_of(F.col("low"), rows, partition, order),
        }
    ).withColumn("sd", row_max(F.col("sd_high"), F.col("sd_low")))


def volatility(
    history: DataFrame,
    order: str = "start",
    blocks: Blocks | None = None,
    lengths: Lengths = LENGTHS,
) -> DataFrame:
    def add(wide: DataFrame, partition: list[str]) -> DataFrame:
        return _add_volatility(wide, partition, order, lengths.sd)

    return over_lookback(known_prices(history), lengths.sd - 1, add, "symbol", order, blocks)


def baseline_volatility(
    history: DataFrame,
    last_n: int | None = None,
    order: str = "start",
    blocks: Blocks | None = None,
    lengths: Lengths = LENGTHS,
) -> DataFrame:
    """Mean volatility of each instrument over its history, or over its last n bars only."""
    columns = history.select("instrument_token", "symbol", order, "high", "low")
    if last_n is None:
        rows = volatility(columns, order, blocks, lengths)
    else:
        near = tail_rows(columns, last_n + lengths.sd - 1, "symbol", order)
        known = volatility(near, order, Blocks.single(), lengths)
        rows = tail_rows(known, last_n, "symbol", order)
    return rows.groupBy("instrument_token", "symbol").agg(F.avg("sd").alias("avg_sd"))


def first_day_needed(
    history: DataFrame, as_of: date | str, lengths: Lengths = LENGTHS
) -> date | None:
    """The day from which `breakout_scan` must read to be exact; None if nothing trades that day.

    Per symbol that is the last day with bars before `as_of`, and as many bars before that day
    as its first windows look back. Only symbol and date are read, and counted per day, of a range
    of days that grows until every symbol has enough; only a symbol with a short history takes
    the search to the beginning.
    """
    for span in (8, 64, 512, None):
        first, short = _first_day(history, as_of, span, lengths)
        if not short:
            break
    return first


def _first_day(
    history: DataFrame, as_of: date | str, span: int | None, lengths: Lengths
) -> tuple[date | None, bool]:
    """The first day needed as far as `span` days tell, and whether some symbol has too few bars in them."""
    day = F.to_date(F.col("date")).alias("day")
    wanted = F.lit(str(as_of)).cast("date")
    kind = history.schema["date"].dataType
    past = history.filter(F.col("date") < F.date_add(wanted, 1).cast(kind))
    if span is not None:
        past = past.filter(F.col("date") >= F.date_sub(wanted, span).cast(kind))
    daily = (
        past.groupBy("symbol", day)
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    back = Window.partitionBy("symbol").orderBy(F.desc("day"))
    later = back.rowsBetween(Window.unboundedPreceding, -1)
    counted = daily.withColumns(
        {"rank": F.row_number().over(back), "last": F.first("day").over(back)}
    )
    counted = counted.withColumn(
        "passed",
        F.coalesce(F.sum(F.when(F.col("rank") > 2, F.col("rows"))).over(later), F.lit(0)),
    )
    reach = max(lengths.sd, lengths.atr) - 1
    needed = counted.filter(
        (F.col("last") == wanted) & ((F.col("rank") <= 2) | (F.col("passed") < reach))
    )
    # All bars behind the second day, seen from a symbol's earliest day.
    behind = F.coalesce(F.sum(F.when(F.col("rank") > 2, F.col("rows"))), F.lit(0))
    enough = (
        counted.filter(F.col("last") == wanted).groupBy("symbol")
        .agg(((F.max("rank") > 1) & (behind >= reach)).alias("enough"))
    )
    short = enough.filter(~F.col("enough"))
    first = needed.agg(F.min("day")).first()[0]
    return first, not short.isEmpty()


def breakout_scan(
    history: DataFrame,
    as_of: date | str,
    sd_factor: float = 4,
    natr_min: float = 0.3,
    blocks: Blocks | None = None,
    lengths: Lengths = LENGTHS,
) -> DataFrame:
    """Bars of one day whose volatility is far above the mean of the last day before it.

    The range measure is here the *deviation* of three ranges (the live panel uses their mean).
    Windows run across days, so the day filter stays above them; what lies after the day is
    cut off at the scan, what lies long before it by the caller's date range (`load_history`
    from `first_day_needed` on).
    """
    day = F.to_date(F.col("date"))
    wanted = F.lit(str(as_of)).cast("date")
    kind = history.schema["date"].dataType
    bars = known_prices(
        history.filter(F.col("date") < F.date_add(wanted, 1).cast(kind)).select(
            "symbol", "date", "open", "high", "low", "close",
            *[c for c in ("volume",) if c in history.columns],
        )
    )

    def add(wide: DataFrame, partition: list[str]) -> DataFrame:
        return add_ranges(wide, partition, lengths)

    reach = max(lengths.sd, lengths.atr) - 1
    panel = over_lookback(bars, reach, add, "symbol", "date", blocks).withColumn("day", day)
    daily = panel.groupBy("symbol", "day").agg(
        F.coalesce(F.sum("sd"), F.lit(0.0)).alias("sd_sum"), F.count("sd").alias("sd_count")
    )
    by_day = Window.partitionBy("symbol").orderBy("day")
    before = daily.select(
        "symbol",
        "day",
        F.lag("sd_sum").over(by_day).alias("sd_sum"),
        F.lag("sd_count").over(by_day).alias("sd_count"),
    )
    joined = panel.filter(F.col("day") == wanted).join(
        before.filter(F.col("day") == wanted), ["symbol", "day"], "left"
    )
    return scored_breakouts(joined, sd_factor, natr_min)


def add_ranges(wide: DataFrame, partition: list[str], lengths: Lengths = LENGTHS) -> DataFrame:
    """Deviations, and the deviation of the last ranges, in percent of the close too."""
    ranged = wide.withColumn("range", F.col("high") - F.col("low"))
    atr = rolling_std_of(F.col("range"), lengths.atr, partition, "date")
    return _add_volatility(ranged, partition, "date", lengths.sd).withColumns(
        {"atr": atr, "natr": quotient(atr, F.col("close")) * 100}
    )


def scored_breakouts(joined: DataFrame, sd_factor: float, natr_min: float) -> DataFrame:
    """Complete rows (with sd_sum and sd_count of the day before) that pass both thresholds."""
    scored = joined.dropna("any").withColumn("avg_sd", quotient(F.col("sd_sum"), F.col("sd_count")))
    return scored.filter(
        (F.col("sd") > sd_factor * F.col("avg_sd")) & (F.col("natr") > natr_min)
    ).select("date", "symbol", "sd", "avg_sd", "natr")


def _add_panel(bars: DataFrame, partition: list[str], lengths: Lengths) -> DataFrame:
    def mean(name: str, n: int) -> Column:
        return rolling_mean_of(F.col(name), n, partition)

    fast, slow = f"mave_{lengths.fast}", f"mave_{lengths.slow}"
    ranged = bars.withColumn("range", F.col("high") - F.col("low"))
    first = _add_volatility(ranged, partition, "start", lengths.sd).withColumns(
        {
            f"mave_{lengths.mean}": mean("close", lengths.mean),
            fast: mean("close", lengths.fast),
            slow: mean("close", lengths.slow),
            "atr": mean("range", lengths.atr),
        }
    )
    second = first.withColumns(
        {
            "natr": quotient(F.col("atr"), F.col("close")) * 100,
            "macd_line": F.col(fast) - F.col(slow),
        }
    )
    third = second.withColumn("signal", mean("macd_line", lengths.signal))
    return third.withColumn("macd", F.col("macd_line") - F.col("signal"))


def indicator_panel(
    bars: DataFrame,
    tail: int | None = 25,
    blocks: Blocks | None = None,
    lengths: Lengths = LENGTHS,
) -> DataFrame:
    """Deviation, moving averages, range and macd of each bar.

    With `tail`, only the last bars of a symbol are looked at, and windows start empty there;
    `tail=None` covers the whole history.
    """
    bars = known_prices(bars)
    if tail is not None:
        bars, blocks = tail_rows(bars, tail), Blocks.single()

    def add(wide: DataFrame, partition: list[str]) -> DataFrame:
        return _add_panel(wide, partition, lengths)

    panel = over_lookback(bars, lengths.lookback, add, blocks=blocks)
    return panel.select(*bars.columns, *lengths.columns)


def _add_direction(panel: DataFrame, partition: list[str]) -> DataFrame:
    """short above the signal line, long below it and while it is unknown."""
    direction = F.when(F.col("macd") > 0, "short").otherwise("long")
    return panel.withColumn("position_type", direction).withColumn(
        "_changed",
        (
            ~F.col("position_type").eqNullSafe(
                F.lag("position_type").over(Window.partitionBy(*partition).orderBy("start"))
            )
        ).cast("long"),
    )


def _add_swings(directed: DataFrame, partition: list[str]) -> DataFrame:
    """Island numbers and running extremes where a series' rows all share one group."""
    island = directed.withColumn("group_id", F.sum("_changed").over(so_far(partition, "start")))
    inside = so_far([*partition, "group_id"], "start")
    return island.withColumns(
        {
            "local_maxima": F.max("high").over(inside),
            "local_minima": F.min("low").over(inside),
        }
    ).drop("_changed")


def _add_swings_by_block(directed: DataFrame) -> DataFrame:
    """The same over blocks: an island may have begun in an earlier one.

    Of each block only its last island can go on in the next. Blocks without a change lengthen
    the island of the block before them, so a running count of blocks with one groups those
    that share an island. The rows are written out before the two passes over them.
    """
    keys = ["symbol", "_block"]
    local = directed.withColumn("_island", F.sum("_changed").over(so_far(keys, "start")))
    inside = so_far([*keys, "_island"], "start")
    local = cut_lineage(
        local.withColumns({"_max": F.max("high").over(inside), "_min": F.min("low").over(inside)})
    )
    last = F.max_by(F.struct("_island", "_max", "_min"), least_time(directed, "start"))
    open_island = Window.partitionBy("symbol", "_chain").orderBy("_block").rowsBetween(
        Window.unboundedPreceding, 0
    )
    before = Window.partitionBy("symbol").orderBy("_block")
    carried = (
        carry_in(
            local,
            "symbol",
            {"_last": last},
            {
                "_islands": lambda _, up_to: F.sum("_last._island").over(up_to),
                "_chain": lambda _, up_to: F.sum(
                    F.when(F.col("_last._island") > 0, 1).otherwise(0)
                ).over(up_to),
                "_top": lambda *_: F.col("_last._max"),
                "_low": lambda *_: F.col("_last._min"),
            },
        )
        .withColumns(
            {"_top": F.max("_top").over(open_island), "_low": F.min("_low").over(open_island)}
        )
        .select(
            *keys,
            F.lag("_islands").over(before).alias("_islands"),
            F.lag("_top").over(before).alias("_top"),
            F.lag("_low").over(before).alias("_low"),
        )
    )
    going_on = F.col("_island") == 0
    return (
        join_null_safe(local, carried, keys, "left")
        .withColumns(
            {
                "group_id": F.col("_island") + F.coalesce("_islands", F.lit(0)),
                "local_maxima": F.greatest("_max", F.when(going_on, F.col("_top"))),
                "local_minima": F.least("_min", F.when(going_on, F.col("_low"))),
            }
        )
        .drop("_block", "_changed", "_island", "_max", "_min", "_islands", "_top", "_low")
    )


def swing_segments(panel: DataFrame, blocks: Blocks | None = None) -> DataFrame:
    """Direction of each bar, number of its swing, and the swing's extremes up to the bar.

    The extremes look at earlier bars only, so that a signal on past bars never knows the
    future; on a symbol's last bar they are those of the whole swing.
    """
    blocks = blocks_for(panel, "start", blocks)
    if blocks.is_single:
        return _add_swings(_add_direction(panel, ["symbol"]), ["symbol"])
    wide = _add_direction(with_lookback(panel, 1, blocks), ["symbol", "_block"])
    return _add_swings_by_block(wide.filter(~F.col("_halo")).drop("_halo"))


def swing_extremes(segments: DataFrame) -> DataFrame:
    """Each bar with the extremes of its whole swing, later bars included."""
    keys = ["symbol", "group_id"]
    whole = segments.groupBy(*keys).agg(
        F.max("high").alias("local_maxima"), F.min("low").alias("local_minima")
    )
    return segments.drop("local_maxima", "local_minima").join(whole, keys)


SIGNAL_COLUMNS = [
    "open", "high", "low", "close", "start", "trigger", "price", "instrument_token", "symbol",
    "source", "position_type", "initial_stop_loss", "initial_controller", "avg_sd",
]


def reversal_signal(
    segments: DataFrame,
    sd_factor: float = 4,
    natr_min: float = 0.3,
    stop_atr: float = 2,
    last_only: bool = False,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Entry signal of each bar: turned by more than its range, on a wide and lively market.

    `keep` names further columns to pass through.
    """
    short = F.col("position_type") == "short"

    def side(if_short: Column, if_long: Column) -> Column:
        return F.when(short, if_short).otherwise(if_long)

    rows = known_prices(tail_rows(segments, 1) if last_only else segments)
    atr = F.col("atr")
    priced = rows.withColumn(
        "price", side(F.col("local_maxima") - atr, F.col("local_minima") + atr)
    )
    price = F.col("price")
    reversal = side(F.col("close") < price, F.col("close") > price)
    lively = (F.col("natr") > natr_min) & (F.col("sd") > sd_factor * F.col("avg_sd"))
    return priced.withColumns(
        {
            "trigger": F.coalesce(reversal & lively, F.lit(False)),
            "source": F.lit("entry"),
            "initial_stop_loss": side(price + stop_atr * atr, price - stop_atr * atr),
            "initial_controller": side(price + F.col("sd_high"), price - F.col("sd_low")),
        }
    ).select(*SIGNAL_COLUMNS, *keep)


def live_signals(
    bars: DataFrame, tail: int = 25, lengths: Lengths = LENGTHS, **thresholds: float
) -> DataFrame:
    """The signal of each symbol's last bar, judged on its last bars alone."""
    panel = indicator_panel(bars, tail, lengths=lengths)
    return reversal_signal(swing_segments(panel, Blocks.single()), last_only=True, **thresholds)


def signal_history(
    bars: DataFrame,
    blocks: Blocks | None = None,
    lengths: Lengths = LENGTHS,
    **thresholds: float,
) -> DataFrame:
    """The signal of every bar, over whole histories.

    Panel, direction and swings share one shuffle, by symbol or by symbol and block.
    """

    def add(wide: DataFrame, partition: list[str]) -> DataFrame:
        return _add_direction(_add_panel(wide, partition, lengths), partition)

    bars, blocks = known_prices(bars), blocks_for(bars, "start", blocks)
    if blocks.is_single:
        return reversal_signal(_add_swings(add(bars, ["symbol"]), ["symbol"]), **thresholds)
    wide = add(with_lookback(bars, lengths.lookback + 1, blocks), ["symbol", "_block"])
    rows = wide.filter(~F.col("_halo")).select(
        *bars.columns, "sd_high", "sd_low", "sd", "atr", "natr", "position_type",
        "_changed", "_block",
    )
    return reversal_signal(_add_swings_by_block(rows), **thresholds)


def _add_tail_swings(
    directed: DataFrame, partition: list[str], tail: int, unknown: int
) -> DataFrame:
    """Each bar's extremes as if its last `tail` bars were all there is.

    Within such a tail only the last bars have a macd, the same as over the whole history; the
    `unknown` first bars count as long. So a swing reaches back over at most those last bars,
    unless it is long over all of them: then it takes in the whole tail.
    """
    known = tail - unknown
    in_order = Window.partitionBy(*partition).orderBy("start")
    island = directed.withColumns(
        {
            "_place": F.row_number().over(in_order),
            "_island": F.sum("_changed").over(so_far(partition, "start")),
            "_tail_max": F.max("high").over(trailing(partition, "start", tail)),
            "_tail_min": F.min("low").over(trailing(partition, "start", tail)),
        }
    )
    swing = trailing([*partition, "_island"], "start", known)
    reach = F.count(F.lit(1)).over(swing)
    all_long = (F.col("position_type") == "long") & (
        reach >= F.least(F.col("_place"), F.lit(tail)) - unknown
    )
    return island.withColumns(
        {
            "local_maxima": F.when(all_long, F.col("_tail_max")).otherwise(F.max("high").over(swing)),
            "local_minima": F.when(all_long, F.col("_tail_min")).otherwise(F.min("low").over(swing)),
        }
    )


def signals_bar_by_bar(
    bars: DataFrame,
    tail: int = 25,
    blocks: Blocks | None = None,
    lengths: Lengths = LENGTHS,
    **thresholds: float,
) -> DataFrame:
    """For each bar the signal that `live_signals` gave when it was the last one."""
    if tail <= lengths.lookback:
        raise ValueError(f"a tail must be longer than {lengths.lookback} bars to fill the panel")

    def add(wide: DataFrame, partition: list[str]) -> DataFrame:
        directed = _add_direction(_add_panel(wide, partition, lengths), partition)
        return _add_tail_swings(directed, partition, tail, lengths.macd_lookback)

    segments = over_lookback(known_prices(bars), tail - 1, add, blocks=blocks)
    return reversal_signal(segments, **thresholds)
