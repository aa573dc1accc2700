"""Near duplicates of vectors by product quantisation.

Unit vectors fall into inverted lists around coarse centroids; the residual to the centroid is coded
by one of CODES codewords in each of SUBSPACES subspaces. A query looks into every list whose
centroid is nearly as close as its own list's; there, table look-ups give its distance to each coded
vector, and those that the known coding errors can't rule out are compared exactly.

Centroids and codewords are fitted on a bounded sample; every vector is indexed. Equal vectors are
indexed once. Lists are cut into chunks of members and of queries, so no task gets a long list whole.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.graph import components, join_groups
from tickloom.session import cut_lineage

SAMPLE = 20_000
SUBSPACES = 8
CODES = 64
PER_LIST = 256  # vectors, on average, up to MOST_LISTS lists
MOST_LISTS = 1024
CHUNK = 2048
#: A neighbour at the threshold lies in a list whose centroid's cosine is smaller by up to this: over
#: three deviations of a random direction in 64 dimensions. Each pair is looked for from both ends.
SLACK = 0.25
ROUNDS = 12


@dataclass
class Index:
    centroids: np.ndarray  # (lists, d), unit length
    words: np.ndarray  # (subspaces, codes, width)
    d: int  # padded to a multiple of the subspaces

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.d - x.shape[1])))

    def parts(self, x: np.ndarray) -> np.ndarray:
        return x.reshape(len(x), len(self.words), -1)

    def encode(self, unit: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and how far each coded vector is from the vector."""
        parts = self.parts(unit - self.centroids[lists])
        codes = np.empty(parts.shape[:2], np.uint8)
        error = np.zeros(len(unit))
        for m, words in enumerate(self.words):
            far = _squares(parts[:, m], words)
            codes[:, m] = far.argmin(axis=1)
            error += far.min(axis=1)
        return codes, np.sqrt(error)

    def distances(self, queries: np.ndarray, number: int, codes: np.ndarray) -> np.ndarray:
        """(queries, members) distances to the coded members of one list, by table look-up."""
        parts = self.parts(queries - self.centroids[number])
        out = np.zeros((len(queries), len(codes)))
        for m, words in enumerate(self.words):
            out += _squares(parts[:, m], words)[:, codes[:, m]]
        return np.sqrt(out)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ y.T + (y**2).sum(axis=1), 0)


def _means(x: np.ndarray, k: int, rng: np.random.Generator, unit: bool) -> np.ndarray:
    """k-means; on the sphere if `unit`."""
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(ROUNDS):
        near = (x @ centres.T).argmax(axis=1) if unit else _squares(x, centres).argmin(axis=1)
        n = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, column, k) for column in x.T], axis=1)
        empty = n == 0
        sums[empty], n[empty] = x[rng.choice(len(x), empty.sum())], 1
        centres = sums / n[:, None]
        if unit:
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def fit(unit: np.ndarray, lists: int, seed: int = 7) -> Index:
    rng = np.random.default_rng(seed)
    d = -(-unit.shape[1] // SUBSPACES) * SUBSPACES
    unit = np.pad(unit, ((0, 0), (0, d - unit.shape[1])))
    centroids = _means(unit, lists, rng, unit=True)
    residual = unit - centroids[(unit @ centroids.T).argmax(axis=1)]
    parts = residual.reshape(len(unit), SUBSPACES, -1)
    words = np.stack([_means(parts[:, m], CODES, rng, unit=False) for m in range(SUBSPACES)])
    return Index(centroids, words, d)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of doubles; shorter lists are padded with zeros."""
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    edges = column.offsets.to_numpy()
    flat, edges = flat[: edges[-1]], edges
    size = np.diff(edges)
    out = np.zeros((len(column), width))
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(row)) - np.repeat(edges[:-1] - edges[0], size)] = flat[edges[0] :]
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), np.finfo(float).tiny)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _distinct(rows: DataFrame) -> DataFrame:
    """One row per different vector: digest, node (its smallest id), times, vector."""
    return (
        rows.filter("digest is not null").groupBy("digest")
        .agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("times"), F.first("vector").alias("vector"))
    )


def _rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, node, vector and its digest, which is null for vectors that link with nothing."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = ~bad & F.exists(x, lambda v: v != 0)
    key = F.col(f"`{id_col}`").cast("long")
    unnamed = F.lit(2**63 - 1) - F.shiftrightunsigned(F.xxhash64(x), 2)
    return vectors.select(
        key.alias("vec_id"),
        F.coalesce(key, unnamed).alias("node"),
        F.when(good, x).alias("vector"),
        F.when(good, F.unhex(F.sha2(x.cast("string"), 256))).alias("digest"),
    )


def links(distinct: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b), a < b, of nodes of different vectors with a cosine of `least` or more."""
    spark = distinct.sparkSession
    n, width = distinct.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    if not n:
        return spark.createDataFrame([], "a long, b long")
    lists = int(min(MOST_LISTS, max(1, 2 ** round(np.log2(max(1, n / PER_LIST))))))
    sample = distinct.orderBy(F.xxhash64("digest"), "digest").limit(SAMPLE).select("vector").toArrow()
    sample = _matrix(sample.column(0).combine_chunks(), width)
    index = spark.sparkContext.broadcast(fit(_unit(sample), lists))  # of bounded size
    reach = float(np.sqrt(2 - 2 * least))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = index.value
        for batch in batches:
            for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                raw = _matrix(part.column(1), width)
                unit = held.padded(_unit(raw))
                near = unit @ held.centroids.T
                own = near.argmax(axis=1)
                codes, error = held.encode(unit, own)
                probes = near >= near.max(axis=1, keepdims=True) - SLACK
                row, place = np.nonzero(probes)
                edges = np.concatenate([[0], np.cumsum(probes.sum(axis=1))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([x.tobytes() for x in raw], pa.binary()),
                        pa.array(own.astype(np.int32)), pa.array([x.tobytes() for x in codes], pa.binary()),
                        pa.array(error), pa.ListArray.from_arrays(edges, pa.array(place.astype(np.int32))),
                    ],
                    ["node", "vector", "own", "codes", "error", "probes"],
                )

    coded = cut_lineage(
        distinct.select("node", "vector").mapInArrow(
            encode, "node long, vector binary, own int, codes binary, error double, probes array<int>"
        )
    )
    members = coded.select("node", "vector", "codes", "error", F.col("own").alias("list"))
    queries = coded.select("node", "vector", F.explode("probes").alias("list"))

    def chunks(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias(name))

    # At most MOST_LISTS rows.
    sizes = F.broadcast(cut_lineage(chunks(members, "m_chunks").join(chunks(queries, "q_chunks"), "list")))

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        """Each row into its own chunk, once for every chunk of the other side."""
        mine = F.pmod(F.xxhash64("node", F.lit(own)), F.col(f"{own}_chunks")).cast("int").alias(own)
        each = F.explode(F.sequence(F.lit(0), F.col(f"{other}_chunks") - 1)).alias(other)
        return rows.join(sizes, "list").select(*rows.columns, mine, each)

    both = dealt(members, "m", "q").unionByName(dealt(queries, "q", "m"), allowMissingColumns=True)

    def compare(table: pa.Table) -> pa.Table:
        held = index.value
        member = table.column("codes").is_valid().to_numpy()

        def side(which, name):
            return table.column(name).filter(pa.array(which)).combine_chunks()

        def vectors(which):
            flat = b"".join(side(which, "vector").to_pylist())
            return np.frombuffer(flat).reshape(-1, width)

        a, b = (side(which, "node").to_numpy() for which in (~member, member))
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(a) and len(b):
            codes = np.frombuffer(b"".join(side(member, "codes").to_pylist()), np.uint8).reshape(len(b), -1)
            bound = reach + side(member, "error").to_numpy() + 1e-6
            raw_a, raw_b = vectors(~member), vectors(member)
            unit_a, unit_b = _unit(raw_a), _unit(raw_b)
            number = table.column("list")[0].as_py()
            for low in range(0, len(a), 256):
                far = held.distances(held.padded(unit_a[low : low + 256]), number, codes)
                i, j = np.nonzero(far <= bound)
                i += low
                near = a[i] != b[j]
                i, j = i[near], j[near]
                cosine = (unit_a[i] * unit_b[j]).sum(axis=1)
                out_a.append(a[i][cosine >= least])
                out_b.append(b[j][cosine >= least])
        x, y = np.concatenate(out_a), np.concatenate(out_b)
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return both.groupBy("list", "m", "q").applyInArrow(compare, "a long, b long").distinct()


def near_vectors(
    vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row per row of `vectors`: vec_id, n_links, component_id, kept.

    Vectors are linked when their cosine in double precision is `least` or more; shorter ones count as
    padded with zeros. Null, empty and zero vectors and those with null or non-finite components link
    with nothing. n_links counts other rows linked directly, equal vectors included. component_id is
    the smallest id reachable, kept says that it is the row's own. Rows that repeat an id are one
    node. Rows without an id are one node per vector, larger than all ids, which are below 2^62; a
    component of such rows alone has a null component_id. An empty table gives no rows; other columns
    are not looked at.
    """
    rows = cut_lineage(_rows(vectors, id_col, vector_col))
    distinct = cut_lineage(_distinct(rows))
    found = cut_lineage(links(distinct, least))
    either = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    times = distinct.groupBy("node").agg(F.sum("times").alias("times"))
    degree = (
        either.join(times, either["b"] == times["node"]).groupBy("a").agg(F.sum("times").alias("others"))
        .withColumnRenamed("a", "node")
    )
    label = components(found)
    groups = (
        distinct.select("digest", "node", "times")
        .join(degree, "node", "left").join(label, "node", "left")
        .select(
            "digest", "times",
            (F.col("times") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
            F.coalesce("label", "node").alias("label"),
        )
    )
    linked = join_groups(
        rows.filter("digest is not null").select("vec_id", "node", "digest"),
        cut_lineage(groups), ["digest"], "times", rows.count(),
    )
    alone = rows.filter("digest is null").select(
        "vec_id", "node", F.lit(0).cast("long").alias("n_links"), F.col("node").alias("label")
    )
    return linked.select("vec_id", "node", "n_links", "label").unionByName(alone).select(
        "vec_id",
        "n_links",
        F.when(F.col("label") < 2**62, F.col("label")).alias("component_id"),
        (F.col("node") == F.col("label")).alias("kept"),
    )
