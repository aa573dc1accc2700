"""Rolling, running and recursive columns over each symbol's rows in time order.

`partition` is what the rows are grouped by: the symbol, or the symbol and its block. The
DataFrame functions cut long series into blocks (see `blocks`; without the argument they look
at the span of the data); the column functions leave that to the caller.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from tickloom.operators.blocks import (
    Blocks,
    blocks_for,
    carry_in,
    in_order,
    least_time,
    over_lookback,
)
from tickloom.operators.keyed import Keys, join_null_safe, key_list


def trailing(partition: Keys, order: str, n: int) -> Window:
    """The row and the n-1 rows before it."""
    return Window.partitionBy(*key_list(partition)).orderBy(order).rowsBetween(1 - n, 0)


def so_far(partition: Keys, order: str) -> Window:
    return (
        Window.partitionBy(*key_list(partition))
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )


def _when_full(value: Column, source: Column, n: int, window: Window) -> Column:
    """Null until n known values fill the window; Spark alone would answer from the first row."""
    return F.when(F.count(source).over(window) == n, value)


def rolling_std_of(source: Column, n: int, partition: Keys, order: str = "start") -> Column:
    window = trailing(partition, order, n)
    return _when_full(F.stddev_samp(source).over(window), source, n, window)


def rolling_mean_of(source: Column, n: int, partition: Keys, order: str = "start") -> Column:
    window = trailing(partition, order, n)
    return _when_full(F.avg(source).over(window), source, n, window)


def rolling_std(
    df: DataFrame,
    columns: dict[str, str],
    n: int = 10,
    by: Keys = "symbol",
    order: str = "start",
    blocks: Blocks | None = None,
) -> DataFrame:
    """Adds the sample deviation of the last n rows; `columns` maps new names to sources."""

    def add(wide: DataFrame, partition: list[str]) -> DataFrame:
        return wide.withColumns(
            {name: rolling_std_of(F.col(c), n, partition, order) for name, c in columns.items()}
        )

    return over_lookback(df, n - 1, add, by, order, blocks)


def rolling_mean(
    df: DataFrame,
    columns: dict[str, tuple[str, int]],
    by: Keys = "symbol",
    order: str = "start",
    blocks: Blocks | None = None,
) -> DataFrame:
    """Adds means of the last n rows; `columns` maps new names to (source, n)."""

    def add(wide: DataFrame, partition: list[str]) -> DataFrame:
        return wide.withColumns(
            {
                name: rolling_mean_of(F.col(c), n, partition, order)
                for name, (c, n) in columns.items()
            }
        )

    return over_lookback(df, max(n for _, n in columns.values()) - 1, add, by, order, blocks)


def rolling_sum(
    df: DataFrame,
    name: str,
    column: str,
    n: int = 10,
    by: Keys = "symbol",
    order: str = "start",
    blocks: Blocks | None = None,
) -> DataFrame:
    """Sum of the last n rows, or of all rows while there are fewer."""

    def add(wide: DataFrame, partition: list[str]) -> DataFrame:
        return wide.withColumn(name, F.sum(column).over(trailing(partition, order, n)))

    return over_lookback(df, n - 1, add, by, order, blocks)


def lag_prev(
    df: DataFrame,
    columns: dict[str, str],
    by: Keys = "symbol",
    order: str = "start",
    blocks: Blocks | None = None,
) -> DataFrame:
    """The previous row's values."""

    def add(wide: DataFrame, partition: list[str]) -> DataFrame:
        window = Window.partitionBy(*partition).orderBy(order)
        return wide.withColumns({name: F.lag(c, 1).over(window) for name, c in columns.items()})

    return over_lookback(df, 1, add, by, order, blocks)


def countdown(
    df: DataFrame,
    name: str = "lag_number",
    top: int = 9,
    by: Keys = "symbol",
    order: str = "start",
    blocks: Blocks | None = None,
) -> DataFrame:
    """top, top-1, ... 0, 0 from the first row of a series on."""

    def add(wide: DataFrame, partition: list[str]) -> DataFrame:
        seen = F.count(F.lit(1)).over(trailing(partition, order, top + 1))
        return wide.withColumn(name, F.lit(top + 1) - seen)

    return over_lookback(df, top, add, by, order, blocks)


def _with_carried(blocked: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    return join_null_safe(blocked, carried, [*keys, "_block"], "left")


def running_sum(
    df: DataFrame,
    name: str,
    column: str,
    by: Keys = "symbol",
    order: str = "start",
    blocks: Blocks | None = None,
) -> DataFrame:
    """Sum of the column over the row and all rows before it."""
    keys = key_list(by)
    blocks = blocks_for(df, order, blocks, keys)
    if blocks.is_single:
        return df.withColumn(name, F.sum(column).over(so_far(keys, order)))
    blocked = blocks.mark(df, order)
    carried = carry_in(
        blocked,
        keys,
        {"_total": F.sum(column)},
        {"_carried": lambda earlier, _: F.sum("_total").over(earlier)},
    )
    local = F.sum(column).over(so_far([*keys, "_block"], order))
    return (
        _with_carried(blocked, carried, keys)
        .withColumn(
            name, F.when(local.isNull(), F.col("_carried")).otherwise(
                local + F.coalesce(F.col("_carried"), F.lit(0))
            )
        )
        .drop("_block", "_carried")
    )


def forward_fill(
    df: DataFrame,
    columns: dict[str, str],
    by: Keys = "symbol",
    order: str = "start",
    blocks: Blocks | None = None,
) -> DataFrame:
    """The latest known value at or before each row; `columns` maps new names to sources."""
    keys = key_list(by)
    blocks = blocks_for(df, order, blocks, keys)

    def latest(partition: list[str]) -> dict[str, Column]:
        window = so_far(partition, order)
        return {n: F.last(c, ignorenulls=True).over(window) for n, c in columns.items()}

    if blocks.is_single:
        return df.withColumns(latest(keys))
    blocked = blocks.mark(df, order)
    carried = carry_in(
        blocked,
        keys,
        {
            f"_last_{name}": F.max_by(c, F.when(F.col(c).isNotNull(), least_time(df, order)))
            for name, c in columns.items()
        },
        {
            f"_carried_{name}": lambda earlier, _, name=name: F.last(
                f"_last_{name}", ignorenulls=True
            ).over(earlier)
            for name in columns
        },
    )
    filled = _with_carried(blocked, carried, keys).withColumns(
        {
            name: F.coalesce(value, F.col(f"_carried_{name}"))
            for name, value in latest([*keys, "_block"]).items()
        }
    )
    return filled.drop("_block", *[f"_carried_{name}" for name in columns])


def partition_mean(df: DataFrame, name: str, column: str, by: Keys = "symbol") -> DataFrame:
    """The key's mean put on each of its rows.

    A partial aggregate and a join, not a window: the rows of a key never meet in one task
    when the means are few enough to broadcast, and AQE splits the join when they are not.
    """
    keys = key_list(by)
    return df.join(df.groupBy(*keys).agg(F.avg(column).alias(name)), keys, "left")


def ema_fold(
    df: DataFrame,
    name: str,
    column: str,
    alpha: float = 2 / 11,
    by: Keys = "symbol",
    order: str = "start",
    blocks: Blocks | None = None,
) -> DataFrame:
    """prev + alpha * (x - prev), starting with the series' first known value.

    A null or NaN keeps the value before it; until the first known value the result is null. A block
    changes the value that it gets affinely, so blocks are smoothed on their own, their three
    numbers are composed along the series, and what comes in corrects each row: all in one plan,
    with the rows shuffled once.
    """
    keys = key_list(by)
    blocks = blocks_for(df, order, blocks, keys)
    kept = [c for c in df.columns if c != name]
    output = StructType([df.schema[c] for c in kept]).add(name, DoubleType())

    def smooth(rows: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        rows = in_order(rows.select(own), order)
        values = rows[column].to_pandas().astype(float)
        smoothed = values.ewm(alpha=alpha, adjust=False, ignore_na=True).mean().ffill().to_numpy()
        return rows, values.to_numpy(), smoothed

    def column_of(x: np.ndarray) -> pa.Array:
        return pa.array(x, pa.float64(), from_pandas=True)

    if blocks.is_single:
        own = kept

        def whole(rows: pa.Table) -> pa.Table:
            rows, _, smoothed = smooth(rows)
            return rows.append_column(name, column_of(smoothed))

        return df.select(*kept).groupBy(*keys).applyInArrow(whole, output)

    own = [*kept, "_block"]
    blocked = blocks.mark(df.select(*kept), order)
    local_schema = StructType(blocked.schema.fields[:]).add(name, DoubleType())
    for extra in ("_seen", "_first", "_end", "_known"):
        local_schema = local_schema.add(extra, DoubleType())

    def part(rows: pa.Table) -> pa.Table:
        rows, values, smoothed = smooth(rows)
        there = np.flatnonzero(~np.isnan(values))
        n = rows.num_rows
        first, end = (values[there[0]], smoothed[-1]) if len(there) else (np.nan, np.nan)
        seen = np.cumsum(~np.isnan(values)).astype(float)
        for label, x in (
            (name, smoothed), ("_seen", seen), ("_first", np.full(n, first)),
            ("_end", np.full(n, end)), ("_known", np.full(n, seen[-1])),
        ):
            rows = rows.append_column(label, column_of(x))
        return rows

    local = blocked.groupBy(*keys, "_block").applyInArrow(part, local_schema)

    # Each block as one affine step (_a, _b), and its end if nothing was known before it.
    ends = local.groupBy(*keys, "_block").agg(
        *[F.max(f"_{x}").alias(f"_{x}") for x in ("first", "end", "known")]
    )
    nothing = F.col("_first").isNull()
    decay = F.when(nothing, F.lit(1.0)).otherwise(F.pow(F.lit(1 - alpha), F.col("_known")))
    ends = ends.withColumn("_a", decay).withColumn(
        "_b", F.when(nothing, F.lit(0.0)).otherwise(F.col("_end") - F.col("_a") * F.col("_first"))
    )
    series, back = Window.partitionBy(*keys).orderBy("_block"), 1
    while back <= blocks.count:  # composed by doubling: no window collects the blocks of a key
        a, b, end = (F.lag(c, back).over(series) for c in ("_a", "_b", "_end"))
        ends = ends.withColumns(
            {
                "_a": F.col("_a") * F.coalesce(a, F.lit(1.0)),
                "_b": F.col("_b") + F.col("_a") * F.coalesce(b, F.lit(0.0)),
                "_end": F.coalesce(F.col("_a") * end + F.col("_b"), F.col("_end")),
            }
        )
        back *= 2
    carried = ends.select(*keys, "_block", F.lag("_end", 1).over(series).alias("_carried"))
    shift = F.pow(F.lit(1 - alpha), F.col("_seen")) * (F.col("_carried") - F.col("_first"))
    value = (
        F.when(F.col("_carried").isNull(), F.col(name))
        .when(F.col("_seen") == 0, F.col("_carried"))
        .otherwise(F.col(name) + shift)
    )
    return _with_carried(local, carried, keys).withColumn(name, value).select(*output.names)
