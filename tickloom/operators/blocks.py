"""Ordered work on long series, cut into time blocks.

A row window partitioned by symbol alone puts a whole series into one task, however long it
is. Here a series is cut into blocks of whole days, whose length is measured so that a (symbol,
block) group stays small, or given: bars are unique in (symbol, start), so the bars that fit
into a block bound the group. What a block needs from the past comes to it in one of three ways:

* `with_lookback`   the last n rows before the block, copied into it (rolling windows, lag)
* `carry_in`        a few numbers per earlier block, scanned over blocks (sums, fills)
* `fold_blocks`     the state of a recurrence: blocks run at once, and again where they began in another
                    state than supposed

Rows with a null key are one series more; a row without a time comes before all others of its series,
in a block of its own. Both hold for one block and for many.

Only per-block summaries are ever grouped by symbol alone: one row per symbol and block, so
their number is bounded by the time span of the data. Data that spans a single block needs none
of this: a group per symbol is then bounded already, and costs one shuffle.
"""

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import NumericType, StructType

from tickloom.operators.keyed import Keys, join_null_safe, key_list
from tickloom.session import cut_lineage

BLOCK_DAYS = 90
BLOCK_ROWS = 200_000
UNTIMED = -(2**31)  # the block of rows without a time


def _day_number(order: Column) -> Column:
    return F.unix_date(F.to_date(order))


@dataclass(frozen=True)
class Blocks:
    """Equal runs of days from the first day of the data on."""

    first_day: int
    days: int
    count: int

    @classmethod
    def spanning(
        cls,
        df: DataFrame,
        order: str = "start",
        days: int | None = None,
        by: Keys = "symbol",
        rows: int = BLOCK_ROWS,
    ) -> "Blocks":
        """Blocks over the rows of `df`, or of any table whose rows lie within the same span.

        With `days` this looks at the least and greatest value of one column. Without, it counts
        the rows per key and day, and makes blocks as long as the busiest day of any key allows:
        no group of a key and a block then has more than `rows` rows, unless one day has.
        """
        day = _day_number(F.col(order)).alias("_day")
        if days is None:
            daily = df.groupBy(*key_list(by), day).agg(F.count(F.lit(1)).alias("_rows"))
            looked = daily.agg(F.min("_day"), F.max("_day"), F.max("_rows"))
        else:
            looked = df.agg(F.min(day), F.max(day), F.lit(None).cast("long"))
        first, last, busiest = looked.first()
        if first is None:
            return cls(0, days or 1, 1)
        length = days or max(rows // busiest, 1)
        return cls(first, length, (last - first) // length + 1)

    @classmethod
    def between(cls, first: date, last: date, days: int = BLOCK_DAYS) -> "Blocks":
        """Blocks over a known range of days, for rows that were loaded by it."""
        return cls((first - date(1970, 1, 1)).days, days, (last - first).days // days + 1)

    @classmethod
    def single(cls) -> "Blocks":
        """For series known to be short."""
        return cls(0, 0, 1)

    @property
    def is_single(self) -> bool:
        return self.count == 1

    def mark(self, df: DataFrame, order: str) -> DataFrame:
        number = F.floor((_day_number(F.col(order)) - self.first_day) / self.days)
        return df.withColumn("_block", F.coalesce(number, F.lit(UNTIMED)))


#: Rows looked up at once by binary search in a key's cuts; a power of two.
_STEPS = 1 << 16


@dataclass(frozen=True)
class RowBlocks:
    """Blocks of about equal numbers of rows, cut for each key where its own rows are.

    For series whose busy stretch is shorter than a day: raw ticks, or one key with a third of all rows
    on one day. Only keys with more than the wanted rows are cut, at approximate quantiles of the order
    column, so that no block has more than `rows` of them unless they share one value.
    """

    cuts: DataFrame  # the key's columns and _cuts, ascending; keys without cuts are left out
    keys: tuple[str, ...]
    count: int

    @classmethod
    def of(cls, df: DataFrame, order: str, by: Keys = "symbol", rows: int = BLOCK_ROWS) -> "RowBlocks":
        """Counts the rows per key, and looks for cuts in the rows of the large ones. Their cuts are written."""
        keys = key_list(by)
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
        large = cut_lineage(sizes.filter(F.col("_rows") > rows))
        most = large.agg(F.max("_rows")).first()[0] or 0
        # Twice as many parts as would do, found to an eighth of a part.
        parts = min(max(2 * -(-most // rows), 1), _STEPS - 1)
        places = [i / parts for i in range(1, parts)] or [0.5]
        found = F.percentile_approx(order, places, 8 * parts)
        wanted = 2 * F.ceil(F.col("_rows") / rows)
        every = F.greatest(F.floor(F.lit(parts) / wanted), F.lit(1))
        thinned = F.array_distinct(F.filter("_cuts", lambda x, i: (i + 1) % every == 0))
        hot = join_null_safe(df.select(*keys, order), large, keys, "inner")
        cuts = hot.groupBy(*keys, "_rows").agg(found.alias("_cuts")).select(*keys, thinned.alias("_cuts"))
        return cls(cut_lineage(cuts), tuple(keys), parts)

    @property
    def is_single(self) -> bool:
        return self.count == 1

    def mark(self, df: DataFrame, order: str) -> DataFrame:
        """The block of a row: how many of its key's cuts lie at or before it."""
        marked = join_null_safe(df, self.cuts, list(self.keys), "left")
        powers = F.array(*[F.lit(1 << k) for k in range(self.count.bit_length(), -1, -1)])

        def search(upto: Column, step: Column) -> Column:
            inside = (upto + step <= F.size("_cuts")) & (F.get("_cuts", upto + step - 1) <= F.col(order))
            return F.when(inside, upto + step).otherwise(upto)

        number = F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(F.aggregate(powers, F.lit(0), search))
        block = F.when(F.col(order).isNull(), F.lit(UNTIMED)).otherwise(number).cast("long")
        return marked.withColumn("_block", block).drop("_cuts")


def blocks_for(df: DataFrame, order: str, blocks: Blocks | None, by: Keys = "symbol") -> Blocks:
    return blocks or Blocks.spanning(df, order, by=by)


def with_lookback(
    df: DataFrame,
    rows: int,
    blocks: Blocks,
    by: Keys = "symbol",
    order: str = "start",
) -> DataFrame:
    """Every row in its `_block`, plus copies (`_halo` true) of the `rows` rows before a block.

    Exact for gaps of any length: how far back a block must look is found from the row counts
    of the blocks, not from the clock. Only the ends of blocks are shuffled for it, thinned out
    on the map side; the rows themselves move once, for the window that follows.
    """
    keys = key_list(by)
    blocked = blocks.mark(df, order)
    series = Window.partitionBy(*keys).orderBy("_block")
    sizes = blocked.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_size"))
    ends = sizes.withColumn("_end", F.sum("_size").over(series)).withColumn(
        "_later",
        F.collect_list(F.struct("_block", (F.col("_end") - F.col("_size")).alias("before"))).over(
            series.rowsBetween(1, rows)
        ),
    )
    reached = ends.select(
        *keys,
        "_block",
        F.filter(
            F.transform(
                "_later",
                lambda x: F.struct(
                    x["_block"].alias("block"), (x["before"] - F.col("_end")).alias("gap")
                ),
            ),
            lambda x: x["gap"] < rows,
        ).alias("_reached"),
    )
    backwards = Window.partitionBy(*keys, "_block").orderBy(F.desc(order))
    tails = blocked.withColumn("_from_end", F.row_number().over(backwards)).filter(
        F.col("_from_end") <= rows
    )
    goals = F.filter("_reached", lambda x: x["gap"] + F.col("_from_end") <= rows)
    copies = join_null_safe(tails, reached, [*keys, "_block"], "inner").select(
        *df.columns, F.explode(F.transform(goals, lambda x: x["block"])).alias("_block")
    )
    return blocked.withColumn("_halo", F.lit(False)).unionByName(
        copies.withColumn("_halo", F.lit(True))
    )


def over_lookback(
    df: DataFrame,
    rows: int,
    add: Callable[[DataFrame, list[str]], DataFrame],
    by: Keys = "symbol",
    order: str = "start",
    blocks: Blocks | None = None,
) -> DataFrame:
    """`add(df, partition keys)` adds window columns that look back at most `rows` rows."""
    keys = key_list(by)
    blocks = blocks_for(df, order, blocks, keys)
    if blocks.is_single:
        return add(df, keys)
    wide = add(with_lookback(df, rows, blocks, keys, order), [*keys, "_block"])
    return wide.filter(~F.col("_halo")).drop("_block", "_halo")


def carry_in(
    blocked: DataFrame,
    by: Keys,
    summary: dict[str, Column],
    scan: dict[str, Callable[[Window, Window], Column]],
) -> DataFrame:
    """Per (key, block): what the earlier blocks hand over.

    `summary` are aggregates of a block; `scan` gets the window over the earlier blocks of the
    key, and the window over all blocks up to this one.
    """
    keys = key_list(by)
    series = Window.partitionBy(*keys).orderBy("_block")
    earlier = series.rowsBetween(Window.unboundedPreceding, -1)
    totals = blocked.groupBy(*keys, "_block").agg(*[c.alias(n) for n, c in summary.items()])
    for name, column in scan.items():
        totals = totals.withColumn(name, column(earlier, series))
    return totals.select(*keys, "_block", *scan)


Step = Callable[[dict | None, pa.Table], tuple[dict | None, pa.Table]]


def fold_blocks(
    df: DataFrame,
    step: Step,
    output: StructType,
    state: StructType,
    by: Keys = "symbol",
    order: str = "start",
    blocks: Blocks | None = None,
) -> DataFrame:
    """A recurrence over each key's rows in `order`.

    `step(state, rows)` gets the state after all earlier rows of the key (None at first) and the
    rows of one block in order; it returns the new state (None: as if nothing had been) and the
    output rows. With a single block nothing is written and the result stays lazy.

    Over many blocks all of them run at once, as if nothing had been before each. Then those blocks
    run again that in truth begin in another state, until none is left (`_Folding`). A recurrence that
    returns to None now and then, as a position does when it is left, forgets how a block began: so
    there are few such rounds, however many blocks there are, and a key with a third of all rows is
    spread over its blocks. No task ever holds more than one block of one key.
    """
    keys = key_list(by)
    blocks = blocks_for(df, order, blocks, keys)
    if blocks.is_single:

        def whole(rows: pa.Table) -> pa.Table:
            _, out = step(None, in_order(rows, order))
            return out.cast(to_arrow_schema(output))

        return df.groupBy(*keys).applyInArrow(whole, output)
    return _Folding(blocks.mark(df, order), step, output, state, keys, order).result()


def _emitter(
    step: Step, series: list[str], order: str, arrow: pa.Schema, width: int
) -> Callable[[dict | None, pa.Table], pa.Table]:
    """What a task does with a block: the step's output (`width` columns), and a row with the state it ends in."""

    def emit(before: dict | None, rows: pa.Table) -> pa.Table:
        after, out = step(before, in_order(rows, order))
        key = rows.select(series).slice(0, 1).to_pylist()[0]
        named = {f"_key_{k}": v for k, v in key.items()}
        end = pa.Table.from_pylist([named | {"_is_end": True, "_state": after}], schema=arrow)
        if out is None or not out.num_rows:
            return end
        n = out.num_rows
        rest = [
            pa.array([named[f.name]] * n, f.type) if f.name in named else pa.nulls(n, f.type)
            for f in list(arrow)[width:]
        ]
        told = pa.Table.from_arrays([*out.columns, *rest], names=arrow.names).cast(arrow)
        return pa.concat_tables([end, told])

    return emit


class _Folding:
    """The rounds of `fold_blocks`, each a written table of rows and of the states they end in.

    In the first two rounds every block runs whose state before it is another than it ran with. From
    then on such a block waits while its predecessor is one too, so that a state that lasts over many
    blocks is handed on block by block, and costs each of them one more run.
    """

    def __init__(self, df: DataFrame, step: Step, output: StructType, state: StructType, keys: list[str], order: str):
        self.output, self.state = output, state
        self.series = [*keys, "_block"]
        self.earlier = Window.partitionBy(*keys).orderBy("_block")
        self.rows = cut_lineage(df)
        self.emitted = StructType()
        for field in output:
            self.emitted.add(field.name, field.dataType)
        for key in self.series:
            self.emitted.add(f"_key_{key}", df.schema[key].dataType)
        self.emitted.add("_is_end", "boolean").add("_state", state)
        self.emit = _emitter(step, self.series, order, to_arrow_schema(self.emitted), len(output))

    def _run(self, begins: DataFrame | None) -> DataFrame:
        """The blocks that `begins` has a state for, or all of them, from nothing."""
        emit = self.emit
        if begins is None:
            grouped = self.rows.groupBy(*self.series)
            return cut_lineage(grouped.applyInArrow(lambda rows: emit(None, rows), self.emitted))

        def with_state(rows: pa.Table, states: pa.Table) -> pa.Table:
            return emit(states["_begin"][0].as_py(), rows)

        wanted = join_null_safe(self.rows, begins.select(*self.series), self.series, "left_semi")
        grouped = wanted.groupBy(*self.series).cogroup(begins.groupBy(*self.series))
        return cut_lineage(grouped.applyInArrow(with_state, self.emitted))

    def _ends(self, result: DataFrame, round_: int, begins: DataFrame | None) -> DataFrame:
        named = [F.col(f"_key_{k}").alias(k) for k in self.series]
        ends = result.filter("_is_end").select(*named, F.col("_state").alias("_end"))
        if begins is None:
            ends = ends.withColumn("_begin", F.lit(None).cast(self.state))
        else:
            ends = join_null_safe(ends, begins, self.series, "inner")
        return ends.withColumn("_round", F.lit(round_))

    def _stale(self, ends: DataFrame, settled: bool) -> DataFrame:
        coming = F.lag("_end").over(self.earlier)
        known = ends.withColumn("_coming", coming).withColumn("_stale", ~F.col("_coming").eqNullSafe(F.col("_begin")))
        if settled:
            waits = F.coalesce(F.lag("_stale").over(self.earlier), F.lit(False))
            known = known.withColumn("_stale", F.col("_stale") & ~waits)
        return known.filter("_stale").select(*self.series, F.col("_coming").alias("_begin"))

    def result(self) -> DataFrame:
        rounds = [self._run(None)]
        ends = cut_lineage(self._ends(rounds[0], 0, None))
        while not (begins := self._stale(ends, len(rounds) > 1)).isEmpty():
            begins = cut_lineage(begins)
            rounds.append(self._run(begins))
            anew = self._ends(rounds[-1], len(rounds) - 1, begins)
            kept = join_null_safe(ends, begins.select(*self.series), self.series, "left_anti")
            ends = cut_lineage(kept.unionByName(anew))
        done = []
        for number, result in enumerate(rounds):
            last = ends.filter(F.col("_round") == number).select(*[F.col(k).alias(f"_key_{k}") for k in self.series])
            names = [f"_key_{k}" for k in self.series]
            rows = join_null_safe(result.filter("_is_end is null"), last, names, "left_semi")
            done.append(rows.select(*self.output.names))
        return reduce(DataFrame.unionByName, done)


def in_order(rows: pa.Table, order: str) -> pa.Table:
    """Sorted as Spark sorts, rows without a time first."""
    return rows.take(pc.sort_indices(rows, [(order, "ascending")], null_placement="at_start"))


def least_time(df: DataFrame, order: str) -> Column:
    """The order as something to take the greatest of: rows without one lose to all others."""
    kind = df.schema[order].dataType
    least = F.lit(-(2**31)) if isinstance(kind, NumericType) else F.lit("0001-01-01")
    return F.coalesce(F.col(order), least.cast(kind))
