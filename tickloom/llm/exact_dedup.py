"""Exact deduplication with the frequent texts taken out before the shuffle.

Built from DataFrame functions only. A Misra-Gries summary (Spark's frequent-items sketch, merged
over partitions) names the digests that may be frequent. Their true counts and winners are then
taken from all rows, and those that are frequent indeed, at most 1 / SHARE of them by counting, are
broadcast and joined on the map side. The other digests meet in an ordinary shuffle, where no group
has more than SHARE of all rows.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import cut_lineage

#: A digest is frequent from this share of all rows on; so at most 1 / SHARE are.
SHARE = 1 / 1024
#: Counters of a partition's summary; a power of two, 3/4 of them in use: the summary's error is
#: below a third of SHARE, so that no frequent digest is missed.
COUNTERS = 8192


def frequent_digests(digests: DataFrame, least: int) -> DataFrame:
    """Digests that may have `least` rows: at most COUNTERS * 3 / 4."""
    top = F.expr(f"approx_top_k(digest, {COUNTERS * 3 // 4}, {COUNTERS})")
    return (
        digests.agg(top.alias("top"))
        .select(F.explode("top").alias("item"))
        .filter(F.col("item.count") >= least)
        .select(F.col("item.item").alias("digest"))
    )


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE
) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their UTF-8 bytes are; a null text counts as empty. Of equal texts the row
    with the largest id stays; a null id is smaller than any other; of rows that repeat that id one
    stays, whichever was read first. keep_id is null only if every id of the group is. An empty
    table gives no rows; other columns of `docs` are not looked at, whatever their names.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    digests = cut_lineage(
        docs.select(
            F.col(f"`{id_col}`").alias("doc_id"),
            F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"),
            F.monotonically_increasing_id().alias("row"),
        )
    ).withColumn("digest", F.hex("sha"))
    least = max(2, int(digests.count() * share))
    top = frequent_digests(digests.select("digest"), least)
    # Counted exactly. The summary is of fixed size, and so is what is broadcast here.
    seen = digests.join(F.broadcast(top), "digest", "left_semi")
    winners = cut_lineage(_winners(seen).filter(F.col("group_size") >= least))
    marked = digests.join(F.broadcast(winners), "digest", "left")
    group = Window.partitionBy("digest")
    order = group.orderBy(F.desc_nulls_last("doc_id"), "row")
    cold = (
        marked.filter(F.col("group_size").isNull())
        .select("digest", "doc_id", "row")
        .withColumn("group_size", F.count(F.lit(1)).over(group))
        .withColumn("keep_id", F.max("doc_id").over(group))
        .withColumn("kept", F.row_number().over(order) == 1)
    )
    hot = marked.filter(F.col("group_size").isNotNull()).withColumn(
        "kept", F.col("row") == F.col("keep_row")
    )
    columns = ["doc_id", "keep_id", "group_size", "kept", "digest", "row"]
    return (
        hot.select(*columns)
        .unionByName(cold.select(*columns))
        .withColumn("text_sha256", F.lower("digest"))
        .drop("digest")
    )


def _winners(digests: DataFrame) -> DataFrame:
    """Per digest its size and the row that stays: the largest id, then the first row read.

    Longs only, so that both aggregates stay hash-based and partial.
    """
    by_id = digests.groupBy("digest", "doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("row").alias("first")
    )
    rank = F.coalesce("doc_id", F.lit(-(2**63)).cast("long"))
    return by_id.groupBy("digest").agg(
        F.sum("n").alias("group_size"),
        F.max("doc_id").alias("keep_id"),
        F.max_by("first", rank).alias("keep_row"),
    )


def _unused(name: str, taken: list[str]) -> str:
    """`name`, with as many underscores in front as it takes to clash with none of `taken`."""
    while name.lower() in (c.lower() for c in taken):
        name = f"_{name}"
    return name


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, all columns as they are, whatever their names."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    sha, digest, keep, kept, times = (
        _unused(c, docs.columns) for c in ("_sha", "_digest", "_keep_id", "_kept", "_times")
    )
    found = exact_dedup(docs, id_col, text_col)
    wanted = cut_lineage(
        found.groupBy(F.col("text_sha256").alias(digest), F.col("doc_id").alias(keep))
        .agg(F.max("kept").alias(kept), F.count(F.lit(1)).alias(times))
        .filter(F.col(kept))
    )
    marked = docs.withColumn(sha, F.sha2(text.cast("binary"), 256))
    same = (F.col(sha) == F.col(digest)) & F.col(f"`{id_col}`").eqNullSafe(F.col(keep))
    stay = marked.join(wanted, same, "left_semi")
    if not wanted.filter(F.col(times) > 1).isEmpty():  # rows that repeat id and text
        stay = stay.dropDuplicates([id_col, sha])
    return stay.drop(sha)
