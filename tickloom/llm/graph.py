"""Connected components by contraction, and joins with the summary of a skewed key."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import cut_lineage

#: A group with this share of all rows is joined on the map side; at most 1 / SHARE are.
SHARE = 1 / 1024


def join_groups(
    rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, how: str = "inner"
) -> DataFrame:
    """`rows` joined with one row per key of `groups`, whose column `size` counts rows of the key.

    The at most 1 / SHARE keys with many of the `total` rows are broadcast, so that no task gets a
    frequent key whole; the others meet in a shuffle. `groups` should be a written table.
    """
    large = F.col(size) >= max(2, int(total * SHARE))
    hot, rest = groups.filter(large), groups.filter(~large)
    frequent = rows.join(F.broadcast(hot), keys)
    others = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys, how)
    return frequent.unionByName(others)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of `edges` (a, b); label is the component's smallest node.

    Each round, nodes point to their smallest smaller neighbour, the pointers are doubled until they
    end in roots, and edges are drawn between roots. All in written tables, nothing on the driver.
    Loops and repeated edges do no harm; null ends are left out; no edges give no rows.
    """
    between = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    first = cut_lineage(
        edges.filter("a is not null and b is not null and a <> b").select(*between).distinct()
    )
    left, maps = first, []
    while not left.isEmpty():
        up = cut_lineage(
            left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))
            .withColumn("moved", F.lit(True))
        )
        while not up.filter("moved").isEmpty():
            above = up.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
            up = cut_lineage(
                up.join(above, "parent", "left").select(
                    "node",
                    F.coalesce("next", "parent").alias("parent"),
                    F.col("next").isNotNull().alias("moved"),
                )
            )
        up = up.drop("moved")
        maps.append(up)
        for end in ("a", "b"):
            root = up.select(F.col("node").alias(end), F.col("parent").alias("root"))
            left = left.join(root, end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
        left = cut_lineage(left.filter("a <> b").select(*between).distinct())
    nodes = first.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return reduce(_relabel, maps, nodes.withColumn("label", F.col("node")))


def _relabel(labels: DataFrame, up: DataFrame) -> DataFrame:
    above = up.select(F.col("node").alias("label"), F.col("parent").alias("root"))
    return labels.join(above, "label", "left").select(
        "node", F.coalesce("root", "label").alias("label")
    )
