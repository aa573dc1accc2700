"""Topics of JSON messages: a broker's, or a folder's.

A topic is a dict of reader or writer options with a `format`. `kafka` takes Spark's connector
options (the connector must be on the class path); any file format takes a `path` whose files
hold `value` (text) and `seq` (long) columns. Messages to a broker are keyed by symbol, so that
one symbol's messages share a partition and its offsets tell their order.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickloom.functions.codec import json_decode, json_encode, json_records

MESSAGE = StructType().add("value", "string").add("seq", "long")


def _split(topic: dict) -> tuple[str, dict]:
    options = dict(topic)
    return options.pop("format"), options


def read_topic(spark: SparkSession, topic: dict) -> DataFrame:
    """Messages as `value` (text) and `seq` (order of arrival)."""
    kind, options = _split(topic)
    reader = spark.readStream.format(kind).options(**options)
    if kind == "kafka":
        return reader.load().select(
            F.col("value").cast("string").alias("value"), F.col("offset").alias("seq")
        )
    return reader.schema(MESSAGE).option("recursiveFileLookup", "true").load()


#: Records of an array message take this many numbers of order each.
SPREAD = 1 << 20


def read_records(
    spark: SparkSession, topic: dict, schema: StructType, arrays: bool = False
) -> DataFrame:
    """Decoded messages with `seq`; those that do not decode are left to `json_rejects`.

    With `arrays` a message may hold several records as a JSON array. They are ordered as they stand in
    it: `seq` is then the message's times SPREAD plus the place, for arrays of up to SPREAD records.
    """
    messages = read_topic(spark, topic)
    if not arrays:
        return json_decode(messages, schema, keep=("seq",)).dropna("all", subset=schema.names)
    records = json_records(messages, schema, keep=("seq",)).dropna("all", subset=schema.names)
    order = F.col("seq") * SPREAD + F.col("position")
    return records.withColumn("seq", order).drop("position")


def write_records(df: DataFrame, topic: dict, columns: list[str], batch_id: int) -> None:
    """One JSON message per row, sent from the executors.

    A `seq` column of `df` gives a folder topic its order of arrival; without one it is the
    batch's number. A folder topic gets one subfolder per batch, overwritten when the batch is run again; a
    broker may see a repeated batch twice, so readers must go by keys.
    """
    kind, options = _split(topic)
    seq = F.col("seq") if "seq" in df.columns else F.lit(batch_id).cast("long")
    key = F.col("symbol") if "symbol" in df.columns else F.lit(None)
    messages = df.select(
        key.cast("string").alias("key"), json_encode(df, columns).alias("value"), seq.alias("seq")
    )
    if kind == "kafka":
        named = {("topic" if k == "subscribe" else k): v for k, v in options.items()}
        messages.select("key", "value").write.format(kind).options(**named).save()
        return
    path = f"{options.pop('path')}/batch={batch_id}"
    messages.select("value", "seq").write.format(kind).options(**options).mode("overwrite").save(path)
