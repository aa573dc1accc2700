"""Session settings and the shared folder for checkpoints."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, partitions: int = 8, app: str = "tickloom") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # Small inputs, costly steps: keep a task per core rather than one task per megabyte.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a local one only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tickloom-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Later jobs read only the columns and partitions they need, and a lost executor costs no
    recomputation of what came before. The table stays until `drop_written`.
    """
    spark = df.sparkSession
    path = shared_path(spark, "tickloom")
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_written: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, to be deleted by `drop_written`."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def drop_written(spark: SparkSession) -> int:
    """Deletes the tables that this process has written to the shared folder so far, and counts them.

    Call it when the results that read them are used up or stored elsewhere.
    """
    paths, _written[:] = _written[:], []
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return len(paths)
