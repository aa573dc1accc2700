"""Orders against a capital budget, and the state of orders at the broker."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.clock import timestamp_text
from tickloom.functions.numbers import half_even, quotient, text_number
from tickloom.operators.keyed import Keys, dedup_keep_first, key_list, tail_rows

BUDGET = 200_000.0
POSITION_VALUE = 100_000.0


def first_orders(orders: DataFrame, by: Keys, order: Keys = "seq") -> DataFrame:
    """The first order of each symbol in a batch, entries and exits alike."""
    return dedup_keep_first(orders, [*key_list(by), "symbol"], order)


def _salts(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


def within_budget(
    candidates: DataFrame, by: Keys, budget: Column, salts: int | None = None
) -> DataFrame:
    """The cheapest candidates of each group whose running value stays below the budget.

    A group may be as large as the table, so it is thinned out in parts first. A part keeps
    what fits the whole budget on its own. Whatever fits within the group fits within its
    part, and the first one that does not fit is followed by dearer ones only, so the second
    pass over the few survivors finds exactly the rows that one pass over the group would.
    Ties go by symbol.
    """
    keys = key_list(by)
    order = ["value", "symbol"]
    parts = salts or _salts(candidates)
    part = F.pmod(F.xxhash64("symbol"), F.lit(parts))

    def pass_over(df: DataFrame, partition: list[str]) -> DataFrame:
        window = Window.partitionBy(*partition).orderBy(*order).rowsBetween(
            Window.unboundedPreceding, 0
        )
        return df.withColumn("running_value", F.sum("value").over(window)).filter(
            F.col("running_value") < budget
        )

    thinned = pass_over(candidates.withColumn("_part", part), [*keys, "_part"])
    return pass_over(thinned.drop("_part", "running_value"), keys)


def capital_admission(
    orders: DataFrame,
    ledger: DataFrame,
    by: Keys,
    budget: float | Column = BUDGET,
    position_value: float = POSITION_VALUE,
    order: Keys = "seq",
    salts: int | None = None,
) -> DataFrame:
    """Entry orders that the budget of their group (`by`) admits, with side and quantity.

    `ledger` has symbol, instrument_token, margin and position, and may have some of the `by`
    columns (an account). `budget` is a number or a column of the orders. Margins are positive.
    """
    keys = key_list(by)
    shared = [k for k in keys if k in ledger.columns]
    flat = ledger.filter(~F.col("position")).select(
        *shared, "symbol", "instrument_token", "margin"
    )
    limit = budget if isinstance(budget, Column) else F.lit(float(budget))
    wanted = (
        first_orders(orders.withColumn("_budget", limit), keys, order)
        .filter(F.col("type") == "entry")
        .select(*keys, "symbol", "position_type", "price", "_budget")
        .join(flat, [*shared, "symbol"])
        .withColumn("value", quotient(F.lit(position_value), F.col("margin")))
    )
    quantity = half_even(quotient(F.lit(position_value), F.col("price")))
    return within_budget(wanted, keys, F.col("_budget"), salts).select(
        *keys,
        "symbol",
        "instrument_token",
        "margin",
        "position_type",
        "price",
        "value",
        "running_value",
        F.when(F.col("position_type") == "short", "SELL")
        .when(F.col("position_type") == "long", "BUY")
        .alias("side"),
        quantity.alias("quantity"),
        quantity.alias("filled_quantity"),
    )


def exit_settlement(
    orders: DataFrame,
    ledger: DataFrame,
    by: Keys,
    position_value: float = POSITION_VALUE,
    close_filled: bool = True,
    order: Keys = "seq",
) -> DataFrame:
    """What to tell the broker about the open positions that are to be left, one row per action.

    Partly filled: cut the order to what is filled (`modify`) and trade that back (`place`).
    Not filled: `cancel`. Both name the position's `order_id`; a `place` is a new order and has none.
    Filled: trade back only with `close_filled`; without it nothing is told (`none`), though the
    position's capital is released all the same. `value` is that capital, on a position's first row
    only, so that it can be summed. If the ledger has the `intent_id` of the orders that opened its
    positions, the rows have it too.
    """
    keys = key_list(by)
    shared = [k for k in keys if k in ledger.columns]
    held = ledger.filter(F.col("position")).select(
        *shared, "symbol", "instrument_token", "margin",
        F.col("position_type").alias("held_type"), "filled_quantity", "quantity",
        _order_id_of(ledger).alias("_order_id"), _intent_id_of(ledger).alias("intent_id"),
    )
    leaving = (
        first_orders(orders, keys, order)
        .filter(F.col("type") == "exit")
        .select(*keys, "symbol")
        .join(held, [*shared, "symbol"])
    )
    filled, quantity = F.col("filled_quantity"), F.col("quantity")
    back = F.when(F.col("held_type") == "short", "BUY").when(F.col("held_type") == "long", "SELL")
    nothing = F.lit(None)

    def tell(action: str, side: Column, amount: Column) -> Column:
        return F.struct(
            F.lit(action).alias("action"),
            side.cast("string").alias("side"),
            amount.cast("double").alias("amount"),
        )

    place = tell("place", back, filled)
    whole = place if close_filled else tell("none", nothing, nothing)
    actions = (
        F.when(
            (filled < quantity) & (filled != 0), F.array(tell("modify", nothing, filled), place)
        )
        .when(filled < quantity, F.array(tell("cancel", nothing, nothing)))
        .when(filled != 0, F.array(whole))
        .otherwise(F.array(tell("none", nothing, nothing)))
    )
    value = quotient(F.lit(position_value), F.col("margin"))
    known = ["intent_id"] if "intent_id" in ledger.columns else []
    return leaving.select(
        *keys, "symbol", "instrument_token", "margin", value.alias("_value"), "_order_id", "intent_id",
        F.posexplode(actions).alias("step", "told"),
    ).select(
        *keys, "symbol", "instrument_token", "margin", "step",
        "told.action", "told.side", F.col("told.amount").alias("quantity"),
        F.when(F.col("told.action").isin("modify", "cancel"), F.col("_order_id")).alias("order_id"),
        F.when(F.col("step") == 0, F.col("_value")).alias("value"), *known,
    )


def _intent_id_of(ledger: DataFrame) -> Column:
    return F.col("intent_id") if "intent_id" in ledger.columns else F.lit(None).cast("string")


def _order_id_of(ledger: DataFrame) -> Column:
    return F.col("order_id") if "order_id" in ledger.columns else F.lit(None).cast("long")


def budget_after(
    budgets: DataFrame, admitted: DataFrame, settled: DataFrame, by: Keys = "account_id"
) -> DataFrame:
    """Budget per account less the value admitted and plus the value released."""
    keys = key_list(by)
    moves = (
        admitted.select(*keys, (-F.col("value")).alias("_move"))
        .unionByName(settled.select(*keys, F.col("value").alias("_move")))
        .groupBy(*keys)
        .agg(F.sum("_move").alias("_move"))
    )
    return budgets.join(moves, keys, "left").select(
        *keys, (F.col("budget") + F.coalesce("_move", F.lit(0.0))).alias("budget")
    )


def ledger_after(
    ledger: DataFrame, admitted: DataFrame, settled: DataFrame, by: Keys = "symbol"
) -> DataFrame:
    """The ledger with admitted positions opened and settled ones cleared.

    Neither has an order id: the broker's status brings that of a new order (`fill_from_status`). A
    ledger with an `intent_id` gets that of the orders admitted, and loses it with the position.
    """
    keys = key_list(by)
    opened = admitted.select(
        *keys, F.lit(True).alias("_open"), F.col("position_type").alias("_type"),
        F.col("quantity").alias("_quantity"), _intent_id_of(admitted).alias("_intent_id"),
    )
    closed = settled.filter(F.col("step") == 0).select(
        *keys, F.lit(False).alias("_open"), F.lit(None).cast("string").alias("_type"),
        F.lit(0.0).alias("_quantity"), F.lit(None).cast("string").alias("_intent_id"),
    )
    touched = F.col("_open").isNotNull()

    def now(new: str, old: str) -> Column:
        return F.when(touched, F.col(new)).otherwise(F.col(old)).alias(old)

    no_order = F.when(~F.coalesce(touched, F.lit(False)), _order_id_of(ledger)).alias("order_id")

    swapped = {
        "position": now("_open", "position"),
        "position_type": now("_type", "position_type"),
        "quantity": now("_quantity", "quantity"),
        "filled_quantity": now("_quantity", "filled_quantity"),
        "order_id": no_order,
        "intent_id": now("_intent_id", "intent_id") if "intent_id" in ledger.columns else None,
    }
    return ledger.join(opened.unionByName(closed), keys, "left").select(
        *[swapped.get(c, F.col(c)) for c in ledger.columns]
    )


STATUS_COLUMNS = [
    "average_price", "cancelled_quantity", "disclosed_quantity", "filled_quantity",
    "instrument_token", "order_id", "order_timestamp", "pending_quantity", "quantity",
    "status_message", "symbol", "transaction_type", "status",
]


def order_status_snapshot(
    orders: DataFrame, order: Keys = "order_timestamp", columns: list[str] | None = None
) -> DataFrame:
    """The latest state of each order: numeric id, time as text, `tradingsymbol` as `symbol`.

    Broker times are whole seconds: where states may share one, `order` needs a second column (a
    sequence number) that decides.
    """
    renamed = orders.withColumnRenamed("tradingsymbol", "symbol")
    typed = renamed.withColumn("order_id", text_number(F.col("order_id")))
    latest = tail_rows(typed, 1, "order_id", order)
    told = latest.withColumn("order_timestamp", timestamp_text(F.col("order_timestamp").cast("timestamp")))
    return told.select(*(columns or STATUS_COLUMNS))


def fill_from_status(ledger: DataFrame, status: DataFrame) -> DataFrame:
    """The ledger with order ids and filled quantities that the broker reports.

    `status` has one row per order. If ledger and status have an `intent_id`, an open position takes
    order id and fill from the order sent with its own, and from no other: neither an earlier order of
    its symbol nor another account's. An order that the status doesn't have yet leaves its position as
    it is. Without intents, a position goes by its order id, and one without takes that of its symbol's
    last order, if the status names symbols and times: right only where symbols are traded once.
    """
    if "intent_id" in ledger.columns and "intent_id" in status.columns:
        return _fill_by_intent(ledger, status)
    book = ledger
    if {"symbol", "order_timestamp"} <= set(status.columns) and "position" in ledger.columns:
        last = tail_rows(status, 1, "symbol", ["order_timestamp", "order_id"])
        last = last.select("symbol", F.col("order_id").alias("_last_id"))
        missing = F.col("position") & F.col("order_id").isNull()
        book = (
            ledger.join(last, "symbol", "left")
            .withColumn("order_id", F.when(missing, F.col("_last_id")).otherwise(F.col("order_id")))
            .drop("_last_id")
        )
    reported = status.select("order_id", F.col("filled_quantity").cast("double").alias("_filled"))
    return book.join(reported, "order_id", "left").select(
        *[
            F.coalesce("_filled", c).alias(c) if c == "filled_quantity" else F.col(c)
            for c in ledger.columns
        ]
    )


def _fill_by_intent(ledger: DataFrame, status: DataFrame) -> DataFrame:
    reported = status.filter(F.col("intent_id").isNotNull()).select(
        "intent_id", F.col("order_id").alias("_order_id"),
        F.col("filled_quantity").cast("double").alias("_filled"),
    )
    told = {"order_id": "_order_id", "filled_quantity": "_filled"}
    return ledger.join(reported, "intent_id", "left").select(
        *[
            F.when(F.col("position"), F.coalesce(told[c], c)).otherwise(F.col(c)).alias(c) if c in told else F.col(c)
            for c in ledger.columns
        ]
    )
