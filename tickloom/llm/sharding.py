"""Shards by a fixed number of virtual slots and a versioned map from slots to shards.

A row's slot follows from its id alone and never changes. Bytes are summed per slot, and a map says
which shard holds which slot. To rebalance, or to add shards, the map is edited: a new version moves as
few slots as it can, and the older versions stay in the table beside it. The map's size is that of the
slots, whatever the rows are, so it is joined on the map side.

A slot with more than HEAVY of the bytes (one id on a third of all rows, say) is cut into parts by row
number, each a slot of its own in the map, so that balance doesn't depend on the ids being different.

DataFrame functions only.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.session import cut_lineage, shared_path

SLOTS = 4096
#: A slot with more than this share of all bytes is cut: at most 1 / HEAVY slots are, into at most
#: 2 / HEAVY parts together.
HEAVY = 1 / 1024
MAP = "version int, slot int, part int, bytes long, shard int"
#: Rows of a table of totals that are summed together before their sums are.
FAN = 1024


def slot_of(row_id: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of an id; null ids share the slot that an empty key hashes to."""
    return F.pmod(F.xxhash64(row_id.cast("string")), F.lit(slots)).cast("int")


def sized_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """Per row of `docs` its id, size, checksum of the text, slot and number, as a written table."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return cut_lineage(
        docs.select(
            F.col(f"`{id_col}`").alias("doc_id"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            slot_of(F.col(f"`{id_col}`"), slots).alias("hashed"),
            F.monotonically_increasing_id().alias("number"),
        )
    )


def slot_bytes(rows: DataFrame, heavy: float = HEAVY) -> DataFrame:
    """(slot, parts, bytes) of the slots that have rows; heavy ones in as many parts as it takes."""
    total = Window.partitionBy()  # over sums per slot: as many rows as there are slots
    sums = rows.groupBy(F.col("hashed").alias("slot")).agg(F.sum("size").alias("bytes"))
    most = F.greatest(F.sum("bytes").over(total) * heavy, F.lit(1.0))
    return sums.select("slot", F.ceil(F.col("bytes") / most).cast("int").alias("parts"), "bytes")


def with_parts(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """`rows` with the part of their slot, by row number."""
    cut = sizes.filter("parts > 1").select(F.col("slot").alias("hashed"), "parts")
    part = F.pmod(F.xxhash64("number"), F.coalesce("parts", F.lit(1))).cast("int")
    return rows.join(F.broadcast(cut), "hashed", "left").withColumn("part", part).drop("parts")


def part_bytes(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("hashed").alias("slot"), "part").agg(F.sum("size").alias("bytes"))


def first_map(sizes: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1: an even stretch of slots for each shard, whatever they weigh."""
    shard = F.floor(F.col("slot") * F.lit(shards) / F.lit(slots)).cast("int")
    return sizes.select(F.lit(1).alias("version"), "slot", "part", "bytes", shard.alias("shard"))


def rebalanced(held: DataFrame, shards: int) -> DataFrame:
    """The next version of a map, for `shards` shards (more than it has, or as many), balanced by bytes.

    A shard keeps its largest slots as long as they fit its even share of the bytes; the rest move, the
    largest first, each to the shard that is lightest by then. So no shard exceeds its share by more
    than the slot it got last. The work is on a map of bounded size, folded as one array.
    """
    by_size = Window.partitionBy("shard").orderBy(F.desc("bytes"), "slot", "part")
    share = F.sum("bytes").over(Window.partitionBy()) / F.lit(shards)
    kept = (
        held.withColumn("share", share)
        .withColumn("upto", F.sum("bytes").over(by_size.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("stays", F.col("upto") <= F.col("share"))
    )
    def load(shard: int) -> Column:
        held_there = F.sum(F.when(F.col("stays") & (F.col("shard") == shard), F.col("bytes")))
        return F.struct(F.coalesce(held_there, F.lit(0).cast("long")).alias("bytes"), F.lit(shard).alias("shard"))

    moving = F.collect_list(F.when(~F.col("stays"), F.struct("bytes", "slot", "part")))
    state = kept.agg(
        F.array(*[load(k) for k in range(shards)]).alias("loads"),
        F.sort_array(moving, asc=False).alias("moving"),
    )

    def give(so_far: Column, item: Column) -> Column:
        lightest = F.array_min(so_far["loads"])
        loads = F.transform(
            so_far["loads"],
            lambda x: F.when(
                x["shard"] == lightest["shard"],
                F.struct((x["bytes"] + item["bytes"]).alias("bytes"), x["shard"].alias("shard")),
            ).otherwise(x),
        )
        return F.struct(
            loads.alias("loads"), F.concat(so_far["given"], F.array(lightest["shard"])).alias("given")
        )

    nothing = F.struct(F.col("loads"), F.array().cast("array<int>").alias("given"))
    moved = (
        state.select("moving", F.aggregate("moving", nothing, give, lambda x: x["given"]).alias("given"))
        .select(F.inline(F.arrays_zip("moving", "given")))
        .select("moving.slot", "moving.part", F.col("given").alias("moved_to"))
    )
    return held.join(F.broadcast(moved), ["slot", "part"], "left").select(
        (F.col("version") + 1).alias("version"), "slot", "part", "bytes",
        F.coalesce("moved_to", "shard").alias("shard"),
    )


def grown(held: DataFrame, shards: int) -> DataFrame:
    """The next version of a map, with shard number `shards` added; it takes slots, and no other does.

    Each old shard gives its smallest slots beyond the new even share.
    """
    by_size = Window.partitionBy("shard").orderBy(F.desc("bytes"), "slot", "part")
    share = F.sum("bytes").over(Window.partitionBy()) / F.lit(shards + 1)
    upto = F.sum("bytes").over(by_size.rowsBetween(Window.unboundedPreceding, 0))
    return (
        held.withColumn("share", share).withColumn("upto", upto)
        .select(
            (F.col("version") + 1).alias("version"), "slot", "part", "bytes",
            F.when(F.col("upto") > F.col("share"), F.lit(shards)).otherwise(F.col("shard")).alias("shard"),
        )
    )


def store(held: DataFrame, path: str) -> None:
    """Adds the version of a map to the maps at `path`; a version that is there already is an error."""
    held.coalesce(1).write.partitionBy("version").mode("append").parquet(path)


def stored(spark: SparkSession, path: str, version: int) -> DataFrame:
    names = MAP.replace(" int", "").replace(" long", "").split(", ")
    return spark.read.schema(MAP).parquet(path).filter(F.col("version") == version).select(*names)


def placed(rows: DataFrame, held: DataFrame) -> DataFrame:
    """`rows` (with parts) with their shard, and their place in it, gapless from 0."""
    where = held.select(F.col("slot").alias("hashed"), "part", "shard")
    # Rows of a task in the order of their shards, numbered: a place in the shard is then the row's
    # distance to the task's first of that shard, plus what earlier tasks have of it.
    ordered = cut_lineage(
        rows.join(F.broadcast(where), ["hashed", "part"])
        .sortWithinPartitions("shard", "number")
        .withColumn("at", F.monotonically_increasing_id())
    ).withColumn("task", F.shiftright("at", 33))
    counts = ordered.groupBy("shard", "task").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    bounds = _before(cut_lineage(counts)).select("shard", "task", (F.col("before") - F.col("first")).alias("shift"))
    return ordered.join(bounds, ["shard", "task"]).withColumn("slot", F.col("at") + F.col("shift"))


def _before(counts: DataFrame) -> DataFrame:
    """Per shard and task, the rows of earlier tasks; sums of FAN tasks first, so that no group is long."""
    counts = counts.withColumn("batch", F.expr(f"task div {FAN}"))
    batches = counts.groupBy("shard", "batch").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("shard", "batch").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    sums = batches.select("shard", "batch", F.coalesce(F.sum("n").over(earlier), none).alias("earlier"))
    return counts.join(sums, ["shard", "batch"]).withColumn(
        "before", F.col("earlier") + F.coalesce(F.sum("n").over(within), none)
    )


def shard_rows(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
    slots: int = SLOTS, path: str | None = None,
) -> DataFrame:
    """Where each row of `docs` goes, with shards of nearly equal bytes.

    doc_id, size (UTF-8 bytes of the text and 1; null counts as no text), text_crc32, shard, slot (place
    in the shard, gapless from 0), virtual_slot, part, map_version. The maps are stored at `path`, by
    version: 1 before, 2 after rebalancing. Sizes are as equal as whole rows allow: rows that repeat an
    id are spread, a single row is never cut. Null ids hash like any other. Equal texts go where their
    ids go. No rows give no rows; other columns of `docs` are left out, whatever their names.
    """
    spark = docs.sparkSession
    path = path or shared_path(spark, "slots")
    sized = sized_rows(docs, id_col, text_col, slots)
    rows = with_parts(sized, cut_lineage(slot_bytes(sized)))
    store(first_map(part_bytes(rows), shards, slots), path)
    store(rebalanced(stored(spark, path, 1), shards), path)
    return placed(rows, stored(spark, path, 2)).select(
        "doc_id", "size", "text_crc32", "shard", "slot", F.col("hashed").alias("virtual_slot"), "part",
        F.lit(2).alias("map_version"),
    )
