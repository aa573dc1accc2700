"""Files in and out: CSV with a header, JSON documents, and history stored by day."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_CSV = {"header": "true", "escape": '"'}


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The schema's columns, found by name in the header; others (a row number) are left unread."""
    raw = spark.read.options(**_CSV).csv(path)
    return raw.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**_CSV).csv(path)


def read_json_document(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One row per object of a JSON array that fills a file."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def read_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def write_history(history: DataFrame, path: str) -> None:
    """Bars as one folder per day; replaces the days that `history` contains.

    Rows of a day meet first, so that a day becomes one file, or several of the advised
    partition size where it holds very many rows.
    """
    by_day = history.withColumn("day", F.to_date("date"))
    (
        by_day.hint("rebalance", "day")
        .sortWithinPartitions("day", "instrument_token", "date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day")
        .parquet(path)
    )
