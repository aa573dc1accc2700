"""The pipeline as streams, one query per stage, each with its own checkpoint.

ticks -> bars -> signals -> positions -> orders -> account. Stages meet in topics, so each can
stop and restart alone.
"""

import json
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType, TimestampType

from tickloom import schemas
from tickloom.functions.codec import json_rejects
from tickloom.operators.blocks import Blocks
from tickloom.operators.keyed import latest_per_key, tail_rows
from tickloom.operators.stop import Bar, Outcome, Position, StopRule, from_state, to_state
from tickloom.plans.account import (
    BUDGET,
    POSITION_VALUE,
    budget_after,
    capital_admission,
    exit_settlement,
    fill_from_status,
    ledger_after,
    order_status_snapshot,
)
from tickloom.plans.bars import bar_messages, enrich_ticks, minute_bars, ohlc_bars, stamp_ingest
from tickloom.plans.positions import BAR_COLUMNS, lifecycle_orders, lifecycle_row, lifecycle_schema
from tickloom.plans.signals import signals_bar_by_bar
from tickloom.sources.topics import read_records, read_topic, write_records
from tickloom.streaming.store import BarLog, VersionedTable

SIGNAL_MESSAGE = [f.name for f in schemas.SIGNAL]
ORDER_MESSAGE = [f.name for f in schemas.ORDER]
#: A symbol without a position and without signals is forgotten after a day of the others' signals.
QUIET = timedelta(days=1)


def start(writer, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Starts a writer; every stage has a checkpoint. The default trigger drains and stops."""
    options = trigger or {"availableNow": True}
    return writer.option("checkpointLocation", checkpoint).trigger(**options).start()


# --- ticks --------------------------------------------------------------------------------


def enrich_job(
    ticks: DataFrame, reference: DataFrame, out: dict, checkpoint: str, trigger: dict | None = None,
    stamp: bool = False,
) -> StreamingQuery:
    """Live ticks joined with the reference table, sent on as messages.

    With `stamp` a tick is dated with the second at which this job takes it in, as a live feed without
    times of its own needs.
    """
    enriched = enrich_ticks(stamp_ingest(ticks) if stamp else ticks, reference)
    columns = [c for c in schemas.TICK.names if c in enriched.columns]

    def send(batch: DataFrame, batch_id: int) -> None:
        write_records(batch, out, columns, batch_id)

    return start(enriched.writeStream.foreachBatch(send), checkpoint, trigger)


def reject_job(
    spark: SparkSession,
    topic: dict,
    schema: StructType,
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """The messages that do not decode, kept as they came."""
    broken = json_rejects(read_topic(spark, topic), schema)
    return start(broken.writeStream.format("parquet").option("path", path), checkpoint, trigger)


# --- bars and signals ---------------------------------------------------------------------


def warm_tails(history: DataFrame, usual: DataFrame, tail: int = 25) -> DataFrame:
    """The last stored bars of each symbol, with its avg_sd: what a stage knows before any tick."""
    known = usual.select("symbol", "avg_sd")
    last = tail_rows(history.drop("avg_sd"), tail).join(known, "symbol", "left")
    return last.select(*schemas.BAR.names)


_BAR_NAMES = schemas.BAR.names
_TAIL_STATE = StructType().add("bars", "string")
#: Bars to judge (`fresh`) and the bars before them that their windows look at.
TAILED = StructType(schemas.BAR.fields[:]).add("fresh", "boolean")


_NUMBERS = ["open", "high", "low", "close", "avg_sd"]


def _arrived(batches: Iterator[pd.DataFrame]) -> dict[int, tuple[list, bool]]:
    """New bars by start (nanoseconds), the last version of each: end, token, numbers; and if it is fresh."""
    rows = []
    for batch in batches:
        times = [batch[c].astype("int64").tolist() for c in ("start", "seq", "end")]
        tokens = [None if pd.isna(x) else int(x) for x in batch["instrument_token"].tolist()]
        numbers = [[None if x != x else x for x in batch[c].tolist()] for c in _NUMBERS]
        rows += zip(*times, tokens, *numbers, batch["fresh"].tolist())
    rows.sort(key=lambda row: row[:2])
    return {row[0]: (list(row[2:-1]), bool(row[-1])) for row in rows}


def _advance_tail(
    tail: int, key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
) -> Iterator[pd.DataFrame]:
    """Replaces and appends a symbol's bars, keeps the last ones, and gives out what is to be judged."""
    kept = {row[0]: (row[1:], False) for row in json.loads(state.get[0])} if state.exists else {}
    bars = sorted((kept | _arrived(batches)).items())
    state.update((json.dumps([[at, *row] for at, (row, _) in bars[-tail:]]),))
    first = next((i for i, (_, (_, fresh)) in enumerate(bars) if fresh), None)
    if first is None:
        return
    bars = bars[max(first - (tail - 1), 0) :]
    ends, tokens, *numbers = zip(*(row for _, (row, _) in bars))
    told = {
        "instrument_token": pd.array(tokens, "Int64"), "symbol": key[0],
        "start": pd.to_datetime([at for at, _ in bars]), "end": pd.to_datetime(list(ends)),
        **{c: np.array(x, float) for c, x in zip(_NUMBERS, numbers)},
        "fresh": [fresh for _, (_, fresh) in bars],
    }
    yield pd.DataFrame(told)[TAILED.names]


def with_tails(bars: DataFrame, tail: int = 25) -> DataFrame:
    """A stream of bars (with `seq` and `fresh`) together with the stored bars that their windows need.

    Each symbol's last `tail` bars are keyed state, so a batch writes those of its own symbols only. A
    bar that arrives again replaces its earlier version. Bars that are not `fresh` are stored and not
    judged: history that warms up the state.
    """
    columns = [F.col(c).cast(schemas.BAR[c].dataType).alias(c) for c in _BAR_NAMES]

    def advance(key, batches, state):
        return _advance_tail(tail, key, batches, state)

    rows = bars.select(*columns, "seq", "fresh")
    return rows.groupBy("symbol").applyInPandasWithState(
        advance, TAILED, _TAIL_STATE, "append", GroupStateTimeout.NoTimeout
    )


class SignalStage:
    """Judges the fresh bars of a batch, which brings the bars that they are judged by."""

    def __init__(self, out: dict, tail: int = 25, thresholds: dict | None = None):
        self.out, self.tail, self.thresholds = out, tail, thresholds or {}

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        # A symbol's bars of a batch have been in one task's memory already: one block.
        signals = signals_bar_by_bar(batch, self.tail, Blocks.single(), keep=["fresh"], **self.thresholds)
        write_records(signals.filter("fresh"), self.out, SIGNAL_MESSAGE, batch_id)


BAR_MESSAGE = [*_BAR_NAMES, "fresh"]


def bar_job(
    ticks: DataFrame,
    out: dict,
    checkpoint: str,
    width: str = "60 seconds",
    watermark: str = "2 seconds",
    mode: str = "append",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Bars from ticks as messages.

    `append` sends each bar once, when the watermark has passed it; `update` sends a growing bar again
    with every batch. Either drops the state of closed bars.
    """
    bars = ohlc_bars(ticks, width, watermark)

    def send(batch: DataFrame, batch_id: int) -> None:
        # A symbol's bars of a batch in one file, as they are in one partition of a broker.
        told = batch.withColumn("fresh", F.lit(True)).repartition("symbol")
        write_records(told, out, BAR_MESSAGE, batch_id)

    return start(bars.writeStream.outputMode(mode).foreachBatch(send), checkpoint, trigger)


def stored_to_topic(bars: DataFrame, out: dict, batch_id: int = -1) -> None:
    """Stored bars as messages that warm up the stage behind the topic and are not judged."""
    told = bars.withColumns({"fresh": F.lit(False), "seq": F.lit(-1).cast("long")})
    write_records(told, out, BAR_MESSAGE, batch_id)


def signal_job(
    spark: SparkSession, bars: dict, stage: SignalStage, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Signals from a topic of bars."""
    schema = StructType(schemas.BAR.fields[:]).add("fresh", "boolean")
    tailed = with_tails(read_records(spark, bars, schema), stage.tail)
    return start(tailed.writeStream.outputMode("append").foreachBatch(stage), checkpoint, trigger)


def merge_job(
    ticks: DataFrame, log: BarLog, messages: str, checkpoint: str, trigger: dict | None = None,
    delay: str = "1 day",
) -> StreamingQuery:
    """Minute bars that grow with the ticks, merged into the stored ones, and told when they change.

    A bar is keyed state until `delay` has passed it, and comes out again with every batch that
    changes it. So a batch's work is its own bars: neither the log nor earlier batches are looked at.
    Ticks later than that are dropped; `LateSplit` ahead of this job keeps them.
    """
    growing = minute_bars(ticks, watermark=delay)

    def merge(batch: DataFrame, batch_id: int) -> None:
        log.record(batch, batch_id)
        told = bar_messages(log.changed_by(batch_id), "date")
        told.write.mode("overwrite").parquet(f"{messages}/batch={batch_id}")

    return start(growing.writeStream.outputMode("update").foreachBatch(merge), checkpoint, trigger)


# --- positions ----------------------------------------------------------------------------


def _pack(position: Position | None) -> dict | None:
    state = to_state(position)
    return state and state | {"position_time": state["position_time"].isoformat()}


def _unpack(state: dict | None) -> Position | None:
    if state is None:
        return None
    return from_state(state | {"position_time": datetime.fromisoformat(state["position_time"])})


class SymbolState:
    """A symbol's position, and the one before its last bar.

    When that bar arrives again, its step is taken anew from the position before it. An exit or
    entry once told stays told.
    """

    def __init__(self, text: str | None = None, rule: StopRule = StopRule()):
        self.rule = rule
        known = json.loads(text) if text else {}
        self.position = _unpack(known.get("position"))
        self.before = _unpack(known.get("before"))
        self.last = datetime.fromisoformat(known["last"]) if known.get("last") else None

    def text(self) -> str:
        return json.dumps(
            {
                "position": _pack(self.position),
                "before": _pack(self.before),
                "last": self.last and self.last.isoformat(),
            }
        )

    @property
    def is_flat(self) -> bool:
        return self.position is None

    def take(self, bar: Bar) -> Outcome | None:
        """None for a bar older than the last one: it is too late."""
        if self.last is not None and bar.start < self.last:
            return None
        if self.last is None or bar.start > self.last:
            self.before, self.last = self.position, bar.start
            outcome = self.rule.next_bar(self.position, bar)
        else:
            outcome = self._again(bar)
        if outcome.exited:
            self.before = None
        self.position = outcome.position
        return outcome

    def _again(self, bar: Bar) -> Outcome:
        held = self.position
        if held is None or held.is_hit(bar.close):
            return self.rule.next_bar(held, bar)
        if held.position_time == bar.start:
            return Outcome(self.rule.open(held.position_type, bar), False, False)
        return Outcome(self.rule.follow(self.before, bar), False, False)


_SYMBOL_STATE = StructType().add("state", "string")

#: What `follow_positions` gives: lifecycle rows, and bars that came after a later one of their symbol.
FOLLOWED = lifecycle_schema(TimestampType()).add("late", "boolean")


def _advance_symbol(
    rule: StopRule, quiet: timedelta, key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()  # only flat symbols have a timeout
        return
    symbol = SymbolState(state.get[0] if state.exists else None, rule)
    rows = pd.concat(list(batches), ignore_index=True).sort_values(["start", "seq"], kind="stable")
    starts = [stamp.to_pydatetime() for stamp in rows["start"]]
    columns = [rows[c].tolist() if c != "start" else starts for c in BAR_COLUMNS]
    values = []
    for bar, price in zip(map(Bar._make, zip(*columns)), rows["price"].tolist()):
        outcome = symbol.take(bar)
        if outcome is None:
            nothing = lifecycle_row(rule, key[0], bar, price, Outcome(None, False, False))
            values.append((*nothing, True))
        elif outcome.position is not None or outcome.exited:
            values.append((*lifecycle_row(rule, key[0], bar, price, outcome), False))
    state.update((symbol.text(),))
    if symbol.is_flat:
        last = int(symbol.last.replace(tzinfo=timezone.utc).timestamp() * 1000)
        passed = max(last, state.getCurrentWatermarkMs())
        state.setTimeoutTimestamp(passed + int(quiet.total_seconds() * 1000))
    if values:
        yield pd.DataFrame(values, columns=FOLLOWED.names)


def follow_positions(
    signals: DataFrame, rule: StopRule = StopRule(), quiet: timedelta = QUIET
) -> DataFrame:
    """Lifecycle rows of a stream of signals; state of fixed size per symbol.

    The state of a symbol without a position goes when the newest signals are `quiet` past its last
    one: until then a bar may arrive again, or too late. A bar older than the symbol's last one changes
    nothing and comes out as a row of its own, with `late`. One that is `quiet` behind the newest of all
    is dropped; `LateSplit` ahead of this job keeps it.
    """
    rows = signals.select("symbol", "seq", "price", *BAR_COLUMNS)
    rows = rows.withWatermark("start", f"{int(quiet.total_seconds())} seconds")

    def advance(key, batches, state):
        return _advance_symbol(rule, quiet, key, batches, state)

    return rows.groupBy("symbol").applyInPandasWithState(
        advance, FOLLOWED, _SYMBOL_STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


def position_job(
    spark: SparkSession, signals: dict, out: dict, checkpoint: str, trigger: dict | None = None,
    late: dict | None = None, quiet: timedelta = QUIET,
) -> StreamingQuery:
    """Signals to orders. Bars too late for their symbol go to the topic `late`, if there is one."""
    lifecycle = follow_positions(read_records(spark, signals, schemas.SIGNAL), quiet=quiet)

    def send(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            told = lifecycle_orders(batch.filter(~F.col("late")))
            in_order = told.withColumn("seq", F.unix_micros("start") * 2 + F.col("step"))
            write_records(in_order, out, ORDER_MESSAGE, batch_id)
            if late is not None:
                missed = batch.filter("late").withColumn("seq", F.unix_micros("start"))
                write_records(missed, late, ["symbol", "start"], batch_id)
        finally:
            batch.unpersist()

    return start(lifecycle.writeStream.foreachBatch(send), checkpoint, trigger)


# --- account ------------------------------------------------------------------------------


class AccountStage:
    """Admits and settles each batch's orders against the ledger, in tables.

    An order goes to every account that lists its symbol. What a batch releases can be spent
    from the next batch on. Every order that goes out has an `intent_id` (account, symbol and batch;
    closing ones end in `:close`). The broker's status echoes it, and by it a position gets the order id
    and the fill of the order that opened it, however late they come.
    """

    def __init__(
        self,
        ledger: VersionedTable,
        budgets: VersionedTable,
        intents: str,
        position_value: float = POSITION_VALUE,
        close_filled: bool = True,
        statuses: Callable[[], DataFrame] | None = None,
    ):
        """`statuses` gets the latest state of each order, with the `intent_id` that it was sent with."""
        self.ledger, self.budgets, self.intents = ledger, budgets, intents
        self.position_value, self.close_filled = position_value, close_filled
        self.statuses = statuses

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        ledger, budgets = self.ledger.before(batch_id), self.budgets.before(batch_id)
        if self.statuses is not None:
            ledger = fill_from_status(ledger, self.statuses())
        orders = (
            batch.join(ledger.select("account_id", "symbol"), "symbol")
            .join(budgets, "account_id")
            .persist()
        )
        by, order = "account_id", "seq"
        try:
            admitted = capital_admission(
                orders, ledger, by, F.col("budget"), self.position_value, order
            )
            settled = exit_settlement(
                orders, ledger, by, self.position_value, self.close_filled, order
            )
            opening = F.concat_ws(":", "account_id", "symbol", F.lit(batch_id).cast("string"))
            admitted = admitted.withColumn("intent_id", opening)
            closing = F.concat(opening, F.lit(":close"))
            opened = F.col("intent_id") if "intent_id" in settled.columns else F.lit(None).cast("string")
            sent = F.when(F.col("action") == "place", closing).otherwise(opened)
            told = admitted.select(
                "account_id", "symbol", F.lit("place").alias("action"), "side", "quantity",
                F.lit(None).cast("long").alias("order_id"), "intent_id",
            ).unionByName(
                settled.filter(F.col("action") != "none").select(
                    "account_id", "symbol", "action", "side", "quantity", "order_id", sent.alias("intent_id")
                )
            )
            told.write.mode("overwrite").parquet(f"{self.intents}/batch={batch_id}")
            self.ledger.write(
                ledger_after(ledger, admitted, settled, ["account_id", "symbol"]), batch_id
            )
            self.budgets.write(budget_after(budgets, admitted, settled), batch_id)
        finally:
            orders.unpersist()


def account_job(
    spark: SparkSession,
    orders: dict,
    stage: AccountStage,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    records = read_records(spark, orders, schemas.ORDER)
    return start(records.writeStream.foreachBatch(stage), checkpoint, trigger)


def initial_budgets(ledger: DataFrame, budget: float = BUDGET) -> DataFrame:
    return ledger.select("account_id").distinct().withColumn("budget", F.lit(float(budget)))


# --- order status -------------------------------------------------------------------------


def status_job(
    statuses: DataFrame, table: VersionedTable, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """The latest state of each order, kept as a table. Of one second, the later arrival wins."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        columns = table.initial.columns
        order = ["order_timestamp", *(["seq"] if "seq" in batch.columns else [])]
        fresh = order_status_snapshot(batch, order, columns).withColumn("_batch", F.lit(1))
        both = table.before(batch_id).withColumn("_batch", F.lit(0)).unionByName(fresh)
        last = latest_per_key(both, "order_id", ["order_timestamp", "_batch"])
        table.write(last.drop("_batch"), batch_id)

    return start(statuses.writeStream.foreachBatch(keep), checkpoint, trigger)
