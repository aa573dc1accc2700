"""Entries, exits and trailing stops of positions."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructType

from tickloom.functions.numbers import half_even, quotient
from tickloom.operators.affine import affine_scan, in_series, placed
from tickloom.operators.blocks import Blocks, blocks_for, fold_blocks, over_lookback
from tickloom.operators.keyed import dedup_keep_first, dedup_keep_last, join_null_safe, latest_per_key
from tickloom.operators.stop import (
    Bar,
    Columns,
    Outcome,
    Position,
    StopRule,
    from_state,
    position_state,
    to_state,
)
from tickloom.operators.windows import trailing

BAR_COLUMNS = list(Bar._fields)


def exit_signal(positions: DataFrame, closes: DataFrame) -> DataFrame:
    """Exit orders for positions whose stop the latest close has crossed.

    Both sides are reduced to one row per symbol before they meet.
    """
    held = latest_per_key(positions.select("symbol", "start", "position_type", "stop_loss"))
    last = latest_per_key(closes.select("symbol", "start", "close")).select("symbol", "close")
    crossed = F.when(
        F.col("position_type") == "short", F.col("close") > F.col("stop_loss")
    ).otherwise(F.col("close") < F.col("stop_loss"))
    return held.join(last, "symbol").filter(crossed).select(
        "symbol",
        F.lit(None).cast("string").alias("position_type"),
        F.lit("exit").alias("type"),
        F.lit(None).cast("double").alias("price"),
    )


def entry_signal(signals: DataFrame, ledger: DataFrame) -> DataFrame:
    """Entry orders for flat symbols whose last signal is a trigger."""
    last = dedup_keep_last(
        signals.select("symbol", "start", "trigger", "price", "position_type"), "symbol", "start"
    )
    flat = ledger.filter(~F.col("position")).select("symbol")
    return last.filter("trigger").join(flat, "symbol").select(
        "symbol", "position_type", F.lit("entry").alias("type"), "price", "start"
    )


def apply_orders(ledger: DataFrame, orders: DataFrame) -> DataFrame:
    """The ledger after entry and exit orders, one per symbol; an exit clears its fields."""
    when = F.col("start") if "start" in orders.columns else F.lit(None).cast("timestamp")
    told = orders.select(
        "symbol",
        F.col("type").alias("_type"),
        F.col("position_type").alias("_position_type"),
        when.alias("_start"),
    )
    entered, left = F.col("_type") == "entry", F.col("_type") == "exit"

    def settle(new, column: str):
        kept = F.col(column) if column in ledger.columns else F.lit(None)
        return F.when(entered, new).when(left, F.lit(None)).otherwise(kept)

    return (
        ledger.join(told, "symbol", "left")
        .withColumns(
            {
                "position": F.when(entered, True).when(left, False).otherwise(F.col("position")),
                "position_type": settle(F.col("_position_type"), "position_type"),
                "position_time": settle(F.col("_start"), "position_time"),
            }
        )
        .drop("_type", "_position_type", "_start")
    )


class BarRows:
    """Bars of an Arrow table by number, made only when asked for."""

    def __init__(self, rows: pa.Table):
        self.rows = rows
        self.numbers = {
            name: rows[name].to_numpy()
            for name in BAR_COLUMNS
            if name not in ("start", "trigger", "position_type")
        }
        self.triggers = np.flatnonzero(pc.fill_null(rows["trigger"], False).to_numpy())

    @property
    def columns(self) -> Columns:
        return Columns(*(self.numbers[name].tolist() for name in Columns._fields))

    def __getitem__(self, i: int) -> Bar:
        numbers = {name: float(column[i]) for name, column in self.numbers.items()}
        return Bar(
            start=self.rows["start"][i].as_py(),
            trigger=self.rows["trigger"][i].as_py(),
            position_type=self.rows["position_type"][i].as_py(),
            **numbers,
        )

    def next_trigger(self, i: int) -> int:
        """Number of the first bar from i on with a trigger, or the number of bars."""
        place = np.searchsorted(self.triggers, i)
        return int(self.triggers[place]) if place < len(self.triggers) else self.rows.num_rows


def _table(columns: list, arrow: pa.Schema) -> pa.Table:
    """Columns, Arrow's or lists, as a table of the schema's types."""
    typed = [
        c.cast(f.type) if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type)
        for c, f in zip(columns, arrow)
    ]
    return pa.Table.from_arrays(typed, schema=arrow)


_STOP_FIELDS = (
    StructType()
    .add("controller", DoubleType())
    .add("controller_constant", DoubleType())
    .add("lag_number", LongType())
    .add("controller_sd", DoubleType())
    .add("stop_loss", DoubleType())
)


def _stop_values(rule: StopRule, position: Position) -> tuple:
    return (
        position.controller,
        position.constant,
        rule.lag_number(position),
        rule.controller_sd(position),
        position.stop_loss,
    )


def _initial(position_bars: DataFrame, keys: list[str]) -> DataFrame:
    """Each position's direction and first values, from its first bar."""
    first = dedup_keep_first(position_bars, keys, "start")
    kind, _, extreme = _directed(F.col("position_type"))
    return first.select(
        *keys, kind.alias("_kind"), F.col("start").alias("_since"),
        ((extreme - F.col("initial_controller")) * (extreme - F.col("initial_controller"))).alias("_constant"),
    )


def _directed(kind: Column) -> tuple[Column, Column, Column]:
    """Direction, pull and extreme of a bar."""
    short = kind == "short"
    return (
        kind,
        F.when(short, F.col("high")).otherwise(F.col("low")),
        F.when(short, F.col("low")).otherwise(F.col("high")),
    )


def _rate(rule: StopRule, deviation: Column, usual: Column) -> Column:
    """`StopRule.rate` as a column."""
    ratio = quotient(deviation, usual)
    moved = F.when(ratio == 0, F.lit(0.0)).otherwise(2 / (half_even(quotient(F.lit(float(rule.terms)), ratio)) + 1))
    followed = (usual != 0) & ~F.isnan(usual) & ~F.isnan(deviation) & (ratio < rule.ratio_limit)
    return F.when(followed, moved).otherwise(F.lit(rule.fast_rate))


def trailing_stop(
    position_bars: DataFrame, blocks: Blocks | None = None, rule: StopRule = StopRule()
) -> DataFrame:
    """Controller and stop on every bar of each position (symbol, position_time).

    The first bar holds the initial values; its direction is the position's. Every position is
    computed on its own, and each bar from the one before it, however many bars arrive at once.
    Controller and stop are both affine in what they were, so bars are scanned, not looped over: in
    one pass where a position fits a block, and else by two scans over blocks with a look-back for
    the squares between them. One lazy plan either way.
    """
    keys = ["symbol", "position_time"]
    schema = position_bars.schema
    output = StructType([schema[name] for name in (*keys, "start", "position_type")])
    numbers = ["initial_stop_loss", "initial_controller", "avg_sd"]
    blocks = blocks_for(position_bars, "start", blocks, keys)
    names = [*output.names, *_STOP_FIELDS.names]
    bars = position_bars.select(*output.names, "high", "low", *numbers)
    if blocks.is_single:
        held = placed(bars, keys, "start")
        kind = F.first("position_type").over(Window.partitionBy(*keys).orderBy("start"))
        held = held.withColumn("position_type", kind)
        _, pull, extreme = _directed(F.col("position_type"))
        rows = held.withColumns({"pull": pull, "extreme": extreme}).drop("high", "low")
        return in_series(rows, _STOP_FIELDS, ["pull", "extreme", *numbers], rule.scan).select(*names)

    first = _initial(bars, keys)
    held = join_null_safe(bars, first, keys, "inner")
    _, pull, extreme = _directed(F.col("_kind"))
    begins = F.col("start").eqNullSafe(F.col("_since"))
    held = held.withColumns({"_pull": pull, "_extreme": extreme, "_begins": begins})

    def scanned(rows: DataFrame, name: str, step: Column, start: str) -> DataFrame:
        a = F.when(F.col("_begins"), F.lit(0.0)).otherwise(1 - step)
        b = F.when(F.col("_begins"), F.col(start)).otherwise(step * F.col("_pull"))
        return affine_scan(rows, name, a, b, keys, "start", blocks)

    followed = scanned(held, "controller", F.lit(rule.controller_rate), "initial_controller")
    off = F.col("controller") - F.col("_extreme")
    followed = followed.withColumn("_square", off * off)

    def look_back(wide: DataFrame, partition: list[str]) -> DataFrame:
        window = trailing(partition, "start", rule.terms)
        return wide.withColumns(
            {"_sum": F.sum("_square").over(window), "_seen": F.count(F.lit(1)).over(window)}
        )

    summed = over_lookback(followed, rule.terms - 1, look_back, keys, "start", blocks)
    lag = F.lit(rule.terms) - F.col("_seen")
    deviation = F.sqrt((lag * F.col("_constant") + F.col("_sum")) / rule.terms)
    rated = summed.withColumns({"lag_number": lag.cast("long"), "controller_sd": deviation})
    step = _rate(rule, F.col("controller_sd"), F.col("avg_sd"))
    stopped = scanned(rated, "stop_loss", step, "initial_stop_loss")
    return stopped.withColumns(
        {"position_type": F.col("_kind"), "controller_constant": F.col("_constant")}
    ).select(*names)


def lifecycle_schema(time_type) -> StructType:
    out = (
        StructType()
        .add("symbol", "string")
        .add("start", time_type)
        .add("exited", BooleanType())
        .add("entered", BooleanType())
        .add("price", DoubleType())
        .add("position_type", "string")
        .add("position_time", time_type)
    )
    for field in _STOP_FIELDS:
        out = out.add(field)
    return out


_FLAT = (None,) * 7


def lifecycle_row(
    rule: StopRule, symbol: str, bar: Bar, price: float, outcome: Outcome
) -> tuple:
    position, values = outcome.position, _FLAT
    if position is not None:
        values = (position.position_type, position.position_time, *_stop_values(rule, position))
    paid = price if outcome.entered else None
    return (symbol, bar.start, outcome.exited, outcome.entered, paid, *values)


def position_lifecycle(
    signals: DataFrame, blocks: Blocks | None = None, rule: StopRule = StopRule()
) -> DataFrame:
    """Entries, exits and the stop of each symbol, bar by bar.

    One row per bar on which a position is open or has just been left. A symbol may leave and
    enter on one bar; the direction is the one at entry.
    """
    time_type = signals.schema["start"].dataType
    output = lifecycle_schema(time_type)

    def step(state: dict | None, rows: pa.Table) -> tuple[dict | None, pa.Table]:
        position, n = from_state(state), rows.num_rows
        bars, i = BarRows(rows), 0
        numbers = bars.columns
        places, events, held, stops = [], [], [], []

        def note(place: int, exited: bool, entered: bool, now: Position | None) -> None:
            places.append(place)
            events.append((exited, entered))
            held.append(now and (now.position_type, now.position_time))
            stops.append(_stop_values(rule, now) if now else (None,) * 5)

        while True:
            if position is None:  # nothing happens to a flat symbol before its next trigger
                i = bars.next_trigger(i)
                if i >= n:
                    break
                position = rule.open(bars[i].position_type, bars[i])
                note(i, False, True, position)
                i += 1
            position, stop, followed = rule.run(position, numbers, i, exits=True)
            places += range(i, stop)
            events += [(False, False)] * len(followed)
            held += [(position.position_type, position.position_time)] * len(followed)
            stops += [(x[0], position.constant, *x[1:]) for x in followed]
            i = stop
            if i >= n:
                break
            outcome = rule.next_bar(position, bars[i])
            position = outcome.position
            note(i, outcome.exited, outcome.entered, position)
            i += 1
        at, arrow = pa.array(places, pa.int64()), to_arrow_schema(output)
        entered = pa.array([e for _, e in events], pa.bool_())
        columns = [
            rows["symbol"].take(at), rows["start"].take(at), [x for x, _ in events], entered,
            pc.if_else(entered, rows["price"].take(at), pa.scalar(None, pa.float64())),
            [x and x[0] for x in held], [x and x[1] for x in held],
            *(map(list, zip(*stops)) if stops else [[]] * 5),
        ]
        return to_state(position), _table(columns, arrow)

    rows = signals.select("symbol", "price", *BAR_COLUMNS)
    return fold_blocks(rows, step, output, position_state(time_type), "symbol", "start", blocks)


def lifecycle_orders(lifecycle: DataFrame) -> DataFrame:
    """The orders behind the rows: an exit before an entry of the same bar."""
    none = F.lit(None)
    leave = F.struct(
        F.lit(0).alias("step"), F.lit("exit").alias("type"),
        none.cast("string").alias("position_type"), none.cast("double").alias("price"),
    )
    enter = F.struct(
        F.lit(1).alias("step"), F.lit("entry").alias("type"), "position_type", "price"
    )
    orders = F.filter(
        F.array(F.when(F.col("exited"), leave), F.when(F.col("entered"), enter)),
        lambda order: order.isNotNull(),
    )
    return lifecycle.select("symbol", "start", F.explode(orders).alias("order")).select(
        "symbol", "order.position_type", "order.type", "order.price", "start", "order.step"
    )
