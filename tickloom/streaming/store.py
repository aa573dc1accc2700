"""Tables kept between micro-batches: one version per batch, or a log of changes."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.keyed import latest_per_key
from tickloom.plans.bars import merge_bars


class VersionedTable:
    """Batch n reads version n-1 and writes version n.

    A batch that is run again finds the same input and overwrites its own output, so the table
    is exact though batches run at least once. Two versions are kept.
    """

    def __init__(self, spark: SparkSession, path: str, initial: DataFrame):
        self.spark, self.path, self.initial = spark, path, initial

    def _folder(self, version: int) -> str:
        return f"{self.path}/version={version}"

    def before(self, batch_id: int) -> DataFrame:
        if batch_id == 0:
            return self.initial
        return self.version(batch_id - 1)

    def version(self, number: int) -> DataFrame:
        return self.spark.read.schema(self.initial.schema).parquet(self._folder(number))

    def write(self, df: DataFrame, batch_id: int) -> None:
        df.select(*self.initial.columns).write.mode("overwrite").parquet(self._folder(batch_id))
        self._forget(batch_id - 2)

    def _forget(self, version: int) -> None:
        if version < 0:
            return
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self._folder(version))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class BarLog:
    """Stored minute bars, and what each batch of a stream has made of them since, by day.

    A batch writes the bars that it changed, as they are after it, into a folder that a repeated run
    overwrites; the last batch of a bar holds. Compact the log on a schedule, so that reading all bars
    stays cheap. Writing a batch and telling what it changed look at its own rows only.
    """

    COLUMNS = "symbol string, date timestamp, open double, high double, low double, close double, key string"

    def __init__(self, spark: SparkSession, path: str, stored: DataFrame):
        self.spark, self.path, self.stored = spark, path, stored
        nothing = spark.createDataFrame([], f"{self.COLUMNS}, batch long, day date")  # an empty log can be read
        nothing.write.mode("append").partitionBy("batch", "day").parquet(path)

    def record(self, bars: DataFrame, batch_id: int) -> None:
        """Merges a batch's bars (max, min, first, last since the stream began) into the stored ones."""
        days = bars.withColumn("day", F.to_date("date")).select("day", "symbol", "date")
        # Stored bars that know their day are looked up in the batch's days only.
        names = [c for c in ("day", "symbol", "date") if c in self.stored.columns]
        known = self.stored.join(days.select(*names), names, "left_semi").drop("day")
        merged = merge_bars(known, bars).withColumn("day", F.to_date("date"))
        merged.write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/batch={batch_id}")

    def changed_by(self, batch_id: int) -> DataFrame:
        """The bars that a batch touched, as they are after it: its own folder."""
        schema = f"{self.COLUMNS}, day date"
        return self.spark.read.schema(schema).parquet(f"{self.path}/batch={batch_id}").drop("day")

    def bars(self) -> DataFrame:
        schema = f"{self.COLUMNS}, batch long, day date"
        added = latest_per_key(self.spark.read.schema(schema).parquet(self.path), ["symbol", "date"], "batch")
        untouched = self.stored.join(added.select("symbol", "date"), ["symbol", "date"], "left_anti")
        names = [c for c in added.columns if c not in ("batch", "day")]
        return untouched.select(*names).unionByName(added.select(*names))

    def compacted(self, path: str) -> "BarLog":
        """A log under `path` that has this one's bars as stored ones, for the job's next start.

        What the job's state brings again there merges into bars that already hold it, which changes
        nothing.
        """
        self.bars().write.parquet(f"{path}/stored")
        stored = self.spark.read.schema(self.stored.schema).parquet(f"{path}/stored")
        return BarLog(self.spark, f"{path}/added", stored)
