"""JSON messages in and out of columns."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from tickloom.functions.clock import SECOND_FORMAT
from tickloom.functions.numbers import known
from tickloom.schemas import WIRE_NAMES

_JSON_OUT = {
    "ignoreNullFields": "false",
    "timestampFormat": SECOND_FORMAT,
    "timestampNTZFormat": SECOND_FORMAT,
}


def _wire_schema(schema: StructType) -> StructType:
    wire = StructType()
    for field in schema:
        wire = wire.add(WIRE_NAMES.get(field.name, field.name), field.dataType, True)
    return wire


def _unpack(record: Column, schema: StructType) -> list[Column]:
    """Fields of a parsed record under engine names, NaN turned to null."""
    columns = []
    for field in schema:
        value = record.getField(WIRE_NAMES.get(field.name, field.name))
        if isinstance(field.dataType, DoubleType):
            value = known(value)
        columns.append(value.alias(field.name))
    return columns


def _is_broken(record: Column, schema: StructType) -> Column:
    nothing = F.lit(True)
    for field in _wire_schema(schema):
        nothing = nothing & record.getField(field.name).isNull()
    return nothing


def json_decode(
    messages: DataFrame, schema: StructType, value: str = "value", keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per message: `keep` columns, then the schema's fields. Bad text gives nulls."""
    parsed = F.from_json(F.col(value).cast("string"), _wire_schema(schema))
    return messages.select(*keep, parsed.alias("_record")).select(
        *keep, *_unpack(F.col("_record"), schema)
    )


def json_rejects(messages: DataFrame, schema: StructType, value: str = "value") -> DataFrame:
    """The messages that `json_decode` turns into nothing but nulls."""
    parsed = F.from_json(F.col(value).cast("string"), _wire_schema(schema))
    return (
        messages.withColumn("_record", parsed)
        .filter(_is_broken(F.col("_record"), schema))
        .drop("_record")
    )


def json_array_explode(
    messages: DataFrame, schema: StructType, value: str = "value", keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per element of each JSON array message, with its place in the array."""
    parsed = F.from_json(F.col(value).cast("string"), ArrayType(_wire_schema(schema)))
    return messages.select(*keep, F.posexplode(parsed).alias("position", "_record")).select(
        *keep, "position", *_unpack(F.col("_record"), schema)
    )


def json_records(
    messages: DataFrame, schema: StructType, value: str = "value", keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per record of messages that hold one object each or an array of them.

    `keep` columns, `position` (0 for an object), then the schema's fields. Bad text gives a row of nulls,
    an empty array none.
    """
    text = F.col(value).cast("string")
    several = F.from_json(text, ArrayType(_wire_schema(schema)))
    one = F.array(F.from_json(text, _wire_schema(schema)))
    records = F.when(F.ltrim(text).startswith("["), F.coalesce(several, one)).otherwise(one)
    return messages.select(*keep, F.posexplode(records).alias("position", "_record")).select(
        *keep, "position", *_unpack(F.col("_record"), schema)
    )


def json_encode(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The row as one JSON text under wire names; nulls are written, not dropped."""
    names = columns or df.columns
    fields = [F.col(f"`{name}`").alias(WIRE_NAMES.get(name, name)) for name in names]
    return F.to_json(F.struct(*fields), _JSON_OUT)


def series_json(
    keys: DataFrame, rows: DataFrame, by: str, order: str, columns: list[str]
) -> DataFrame:
    """Per key its rows in `order` as one JSON array; `[]` for a key without rows.

    An array is one value: bound the rows of a key first, by `tail_rows` or by a day in the key.
    """
    record = F.struct(F.col(order).alias("_order"), *[F.col(c) for c in columns])
    gathered = (
        rows.groupBy(by)
        .agg(F.array_sort(F.collect_list(record)).alias("_rows"))
    )
    body = F.transform(
        "_rows", lambda row: F.struct(*[row.getField(c).alias(c) for c in columns])
    )
    return keys.select(by).distinct().join(gathered, by, "left").select(
        by, F.coalesce(F.to_json(body, _JSON_OUT), F.lit("[]")).alias("series")
    )
