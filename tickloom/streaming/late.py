"""Rows that come too late for a window, sent to a topic of their own before the window loses them.

Spark drops such rows without a word. This stage runs ahead of the aggregate: it keeps the newest time
that earlier batches brought, and tells rows apart whose window a watermark has closed by then. What it
lets pass, a query behind it with that width and delay does not drop, as long as it takes the batches of
the topic whole, one or several at a time.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickloom.sources.topics import write_records
from tickloom.streaming.store import VersionedTable


def newest_table(spark: SparkSession, path: str) -> VersionedTable:
    """The newest time seen so far: one row per batch, two of them kept."""
    nothing = spark.range(1).select(F.lit(None).cast("timestamp").alias("newest"))
    return VersionedTable(spark, path, nothing)


class LateSplit:
    """Splits each batch into rows in time and late ones.

    A row is late if the window of `width` that it falls into ended `delay` or more before the newest
    time of the batches before its own. Rows without a time pass. Every row goes to one of the two topics,
    and a batch that is run again overwrites what it wrote.
    """

    def __init__(
        self, newest: VersionedTable, live: dict, late: dict, columns: list[str],
        width: str = "60 seconds", delay: str = "2 seconds", date: str = "date",
    ):
        self.newest, self.live, self.late, self.columns = newest, live, late, columns
        self.width, self.delay, self.date = width, delay, date

    def _closed(self) -> Column:
        end = F.window(self.date, self.width)["end"]
        return end <= F.col("_newest") - F.expr(f"INTERVAL {self.delay}")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            before = self.newest.before(batch_id)
            now = batch.agg(F.max(self.date).alias("newest")).unionByName(before)
            self.newest.write(now.agg(F.max("newest").alias("newest")), batch_id)
            marked = batch.withColumn("_newest", F.lit(before.first()["newest"]).cast("timestamp"))
            told = marked.withColumn("_late", F.coalesce(self._closed(), F.lit(False)))
            # A window leaves out rows without a time.
            untimed = marked.filter(F.col(self.date).isNull()).withColumn("_late", F.lit(False))
            told = told.unionByName(untimed)
            write_records(told.filter(~F.col("_late")), self.live, self.columns, batch_id)
            write_records(told.filter("_late"), self.late, self.columns, batch_id)
        finally:
            batch.unpersist()


def late_job(
    ticks: DataFrame, stage: LateSplit, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    options = trigger or {"availableNow": True}
    writer = ticks.writeStream.foreachBatch(stage).option("checkpointLocation", checkpoint)
    return writer.trigger(**options).start()
