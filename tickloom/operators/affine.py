"""Recurrences x -> a * x + b along a series, as a scan instead of a loop.

Two such steps make one of the same kind, so all steps up to each row are composed at once, by
doubling: with NumPy over whole Arrow batches, however many series a batch holds. Over a series in
blocks, each block's rows are composed on their own, the blocks' own steps are composed by windows
that look 1, 2, 4, ... blocks back, and what comes into a block is applied to its rows.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructType

from tickloom.operators.blocks import Blocks, blocks_for, least_time
from tickloom.operators.keyed import Keys, join_null_safe, key_list

Arrays = dict[str, np.ndarray]
#: What a batch adds to its rows, and what it hands to the task's next batch.
Kernel = Callable[[Arrays, np.ndarray, Arrays | None], tuple[Arrays, Arrays]]


def composed(
    a: np.ndarray, b: np.ndarray, place: np.ndarray, before: tuple[float, float] = (1.0, 0.0)
) -> tuple[np.ndarray, np.ndarray]:
    """The steps (a, b) up to each row as one, within its segment.

    `place` numbers the rows of a segment from 0; the first segment may have begun before the array,
    and `before` is then its steps so far as one.
    """
    a, b = a.astype(float), b.astype(float)
    n, back = len(a), 1
    inside = np.minimum(place, np.arange(n))
    most = int(inside.max(initial=0))
    while back <= most:
        rows = np.flatnonzero(inside >= back)
        earlier = rows - back
        # A step with a = 0 forgets what came before, NaN and infinity too.
        b[rows] += np.where(a[rows] == 0, 0.0, a[rows] * b[earlier])
        a[rows] *= a[earlier]
        back *= 2
    begun = place > np.arange(n)
    b[begun] += np.where(a[begun] == 0, 0.0, a[begun] * before[1])
    a[begun] *= before[0]
    return a, b


def in_series(df: DataFrame, added: StructType, needed: list[str], kernel: Kernel) -> DataFrame:
    """`df`, as `placed` made it, with the columns `added`, which `kernel` computes batch by batch.

    The kernel gets the `needed` columns as doubles (a null is NaN), each row's place in its series, and
    what it handed over with the task's batch before.
    """
    output = StructType([f for f in df.schema if f.name != "_place"] + list(added))
    arrow = to_arrow_schema(output)
    kept = [f.name for f in df.schema if f.name != "_place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handed = None
        for batch in batches:
            if not batch.num_rows:
                continue
            arrays = {
                c: batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in needed
            }
            place = batch.column("_place").to_numpy().astype(np.int64)
            new, handed = kernel(arrays, place, handed)
            columns = [batch.column(c) for c in kept]
            columns += [pa.array(new[f.name]).cast(arrow.field(f.name).type) for f in added]
            yield pa.record_batch([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return df.mapInArrow(run, output)


def placed(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """With each row's place in its series, from 0; a task's rows are then sorted by series and order."""
    window = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_place", F.row_number().over(window) - 1)


def _compose(arrays: Arrays, place: np.ndarray, handed: Arrays | None) -> tuple[Arrays, Arrays]:
    before = (handed["a"], handed["b"]) if handed else (1.0, 0.0)
    a, b = composed(arrays["_a"], arrays["_b"], place, before)
    return {"_steps": a, "_value": b}, {"a": a[-1], "b": b[-1]}


def _within(df: DataFrame, a: Column, b: Column, keys: list[str], order: str) -> DataFrame:
    """With `_steps` and `_value`: the row's value is _steps * x + _value for the x before the series."""
    steps = placed(df, keys, order).withColumns({"_a": a, "_b": b})
    added = StructType().add("_steps", DoubleType()).add("_value", DoubleType())
    return in_series(steps, added, ["_a", "_b"], _compose).drop("_a", "_b")


def affine_scan(
    df: DataFrame,
    name: str,
    a: Column,
    b: Column,
    by: Keys = "symbol",
    order: str = "start",
    blocks: Blocks | None = None,
) -> DataFrame:
    """Adds x = a * (x of the row before) + b; before a series' first row x is 0.

    Give the first row a = 0 and b its value. `a` and `b` are expressions over `df`. a = 0 may occur
    anywhere and forgets what came before. Rows are unique in (key, `order`); a null key is one series
    more. A null or NaN a or b makes the value NaN from there to the next a = 0. One lazy plan, in one
    block and in many.
    """
    keys = key_list(by)
    blocks = blocks_for(df, order, blocks, keys)
    if blocks.is_single:
        return _within(df, a, b, keys, order).withColumnRenamed("_value", name).drop("_steps")
    local = _within(blocks.mark(df, order), a, b, [*keys, "_block"], order)
    # A block's last row has its steps as one.
    last = least_time(df, order)
    ends = local.groupBy(*keys, "_block").agg(
        F.max_by("_steps", last).alias("_a"), F.max_by("_value", last).alias("_b")
    )
    carried = carried_steps(ends, keys, blocks.count)
    joined = join_null_safe(local, carried, [*keys, "_block"], "left")
    moved = F.when(F.col("_steps") == 0, F.lit(0.0)).otherwise(F.col("_steps") * F.col("_carried"))
    return joined.withColumn(name, F.col("_value") + moved).drop("_block", "_steps", "_value", "_carried")


def carried_steps(ends: DataFrame, keys: list[str], count: int) -> DataFrame:
    """Per key and block `_carried`: the value that the key's earlier blocks lead to, from 0.

    `ends` has each block's steps as one (`_a`, `_b`). They are composed by doubling, in as many windows
    over the blocks as `count` has binary digits: none collects the blocks of a key.
    """
    series = Window.partitionBy(*keys).orderBy("_block")
    back = 1
    while back <= count:  # a block more than the data's days: rows without a time
        lagged_a = F.coalesce(F.lag("_a", back).over(series), F.lit(1.0))
        lagged_b = F.coalesce(F.lag("_b", back).over(series), F.lit(0.0))
        forgets = F.col("_a") == 0
        ends = ends.withColumns(
            {
                "_a": F.when(forgets, F.lit(0.0)).otherwise(F.col("_a") * lagged_a),
                "_b": F.col("_b") + F.when(forgets, F.lit(0.0)).otherwise(F.col("_a") * lagged_b),
            }
        )
        back *= 2
    before = F.coalesce(F.lag("_b", 1).over(series), F.lit(0.0))
    return ends.select(*keys, "_block", before.alias("_carried"))
