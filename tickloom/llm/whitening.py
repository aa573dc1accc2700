"""Whitening of vectors with the covariance of the different ones.

Vectors become whole numbers, floor(SCALE * entry), and identical ones are grouped, by their bytes. The
fit runs over the different vectors, each weighted with its count or with one: sums first (exactly),
then the weighted product of centred blocks with themselves, a matrix per task, added up in rounds of
FAN tasks. The driver holds one matrix, of the vectors' dimension. Each different vector is whitened
once and joined back to its rows.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.graph import join_groups
from tickloom.session import cut_lineage

SCALE = 256.0
#: Numbers in a block of vectors that is multiplied at once.
BLOCK = 1 << 19
#: Tasks whose sums are added in one group.
FAN = 64
#: Sums of squares below this are taken in longs, larger ones in Python's numbers.
EXACT = 1 << 62
WIDTHS = (np.int16, np.int32, np.int64)


@dataclass
class Fit:
    """What the fit list says: its size, exact sums per dimension, and unit components by falling variance."""

    n: int
    sums: list[int]
    components: np.ndarray  # (components, d)
    variances: np.ndarray
    total: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def _pack(x: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Rows of longs as bytes, the same for the same numbers: trailing zeros off, smallest width that fits.

    And how many numbers each has.
    """
    used = np.where(x != 0, np.arange(1, x.shape[1] + 1), 0).max(axis=1, initial=0)
    low, high = x.min(axis=1, initial=0), x.max(axis=1, initial=0)
    width = np.zeros(len(x), np.int64)
    for kind in WIDTHS[:-1]:
        limit = np.iinfo(kind)
        width += (low < limit.min) | (high > limit.max)
    narrow = [x.astype(kind) if (width == k).any() else x for k, kind in enumerate(WIDTHS)]
    each = enumerate(zip(width.tolist(), used.tolist()))
    return [bytes([k]) + narrow[k][i, :n].tobytes() for i, (k, n) in each], used


def _unpack(keys: list[bytes], d: int) -> np.ndarray:
    """The reverse, as rows of d longs."""
    out = np.zeros((len(keys), d), np.int64)
    by_length: dict[tuple[int, int], list[int]] = {}
    for i, key in enumerate(keys):
        by_length.setdefault((key[0], len(key)), []).append(i)
    for (k, length), rows in by_length.items():
        data = np.frombuffer(b"".join(keys[i] for i in rows), np.uint8).reshape(len(rows), length)[:, 1:]
        numbers = np.ascontiguousarray(data).view(WIDTHS[k])
        out[rows, : numbers.shape[1]] = numbers
    return out


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, key, used numbers) of the rows whose vector is not null and has finite entries only."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    wanted = rows.select(F.col(f"`{id_col}`").alias("vec_id"), vector.alias("vector")).filter(
        F.col("vector").isNotNull()
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            edges = column.offsets.to_numpy()
            flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null becomes NaN
            size = np.diff(edges)
            wide = max(int(size.max(initial=0)), 1)
            for first in range(0, len(size), max(1, BLOCK // wide)):
                n = size[first : first + max(1, BLOCK // wide)]
                row = np.repeat(np.arange(len(n)), n)
                place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                entries = flat[edges[first] : edges[first] + len(row)]
                good = np.bincount(row[~np.isfinite(entries)], minlength=len(n)) == 0
                x = np.zeros((len(n), wide), np.int64)
                x[row, place] = _floors(entries)
                ids = batch.column(0).slice(first, len(n)).filter(pa.array(good))
                keys, used = _pack(x[good])
                columns = [ids, pa.array(keys, pa.binary()), pa.array(used, pa.int32())]
                yield pa.record_batch(columns, ["vec_id", "key", "used"])

    kind = wanted.schema["vec_id"].dataType.simpleString()
    return wanted.mapInArrow(run, f"vec_id {kind}, key binary, used int")


def _floors(entries: np.ndarray) -> np.ndarray:
    """floor(SCALE * entry) as longs; what is beyond them becomes the nearest one."""
    scaled = np.floor(SCALE * np.where(np.isfinite(entries), entries, 0.0))
    inside = np.clip(scaled, -(2.0**63), 2.0**63 - 1024)
    return np.where(scaled >= 2.0**63, np.iinfo(np.int64).max, inside.astype(np.int64))


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(vectors, weights) of a few rows at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, max(1, BLOCK // d)):
            part = batch.slice(first, max(1, BLOCK // d))
            yield _unpack(part.column(0).to_pylist(), d), part.column(1).to_numpy(zero_copy_only=False)


Add = Callable[[np.ndarray, np.ndarray, np.ndarray], None]


def _summed(kinds: DataFrame, start: Callable[[], np.ndarray], add: Add, d: int) -> np.ndarray:
    """`add` collects the rows of a task in a matrix of doubles or longs; the matrices of all tasks, added."""
    zero = start()
    real = "double" if zero.dtype.kind == "f" else "long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = start()
        for x, weight in _blocks(batches, d):
            add(total, x, weight)
        task = TaskContext.get().partitionId()
        for i in range(len(total)):
            yield pa.record_batch([[task], [i], [total[i].tolist()]], schema=layout)

    numbers = pa.float64() if real == "double" else pa.int64()
    layout = pa.schema([("task", pa.int64()), ("line", pa.int32()), ("part", pa.list_(numbers))])
    schema = f"task long, line int, part array<{real}>"

    def together(table: pa.Table) -> pa.Table:
        values = table.sort_by("task").column("part").combine_chunks()
        lines = np.asarray(values.flatten()).reshape(table.num_rows, -1).sum(axis=0)
        return pa.table(
            [[table.column("task")[0].as_py() // FAN], [table.column("line")[0].as_py()], [lines.tolist()]],
            schema=layout,
        )

    parts = cut_lineage(kinds.select("key", "weight").mapInArrow(run, schema))
    last = parts.agg(F.max("task")).first()[0]
    while last:
        grouped = parts.withColumn("group", F.floor(F.col("task") / FAN)).groupBy("group", "line")
        parts, last = cut_lineage(grouped.applyInArrow(together, schema)), last // FAN
    out = zero
    for line in parts.collect():  # one matrix
        out[line["line"]] = line["part"]
    return out


def fit(kinds: DataFrame, d: int, most: int | None = None) -> Fit:
    """The fit over rows (key, weight), as many components as have variance, `most` at most.

    Needs a row at least. Weighted with counts it is that of all rows, with ones that of the different
    vectors.
    """

    def add_sums(total: np.ndarray, x: np.ndarray, weight: np.ndarray) -> None:
        for k in range(4):  # 16 bits of each number, so that sums stay in a long up to 2^47 rows
            quarter = x >> 48 if k == 3 else (x >> (16 * k)) & 0xFFFF
            total[k, :d] += (weight[:, None] * quarter).sum(axis=0)
        total[0, d] += weight.sum()

    quarters = _summed(kinds, lambda: np.zeros((4, d + 1), np.int64), add_sums, d).tolist()
    n, sums = quarters[0][d], [sum(q[j] << (16 * k) for k, q in enumerate(quarters)) for j in range(d)]
    mean = np.array([s / n for s in sums])

    def add_products(total: np.ndarray, x: np.ndarray, weight: np.ndarray) -> None:
        centred = x - mean
        total += (centred * weight[:, None]).T @ centred

    covariance = _summed(kinds, lambda: np.zeros((d, d)), add_products, d) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[: most or d]
    order = order[values[order] > max(values.max(), 0) * d * np.finfo(float).eps]
    components = vectors.T[order]
    signs = np.sign(components[np.arange(len(order)), np.abs(components).argmax(axis=1)])
    return Fit(n, sums, components * signs[:, None], values[order], float(np.trace(covariance)))


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """sum((n * x - S)^2) of each row, exactly; none where a long can't hold it."""
    far = np.abs(x.astype(float) * n - np.array(sums, float))
    large = (far**2).sum(axis=1) * 1.000001 >= EXACT
    whole = np.array([s if abs(s) < EXACT else 0 for s in sums], np.int64)
    with np.errstate(over="ignore"):
        out = ((x * n - whole) ** 2).sum(axis=1).tolist()
    for i in np.flatnonzero(large):
        exact = sum((n * v - s) ** 2 for v, s in zip(x[i].tolist(), sums))
        out[i] = exact if exact < 1 << 63 else None
    return out


def whitened_kinds(kinds: DataFrame, d: int, model: Fit) -> DataFrame:
    """(key, times, deviation, whitened) of each different vector, once."""
    mean, turn = model.mean, model.components.T / np.sqrt(model.variances)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, max(1, BLOCK // d)):
                part = batch.slice(first, max(1, BLOCK // d))
                x = _unpack(part.column(0).to_pylist(), d)
                white = (x - mean) @ turn
                yield pa.record_batch(
                    [part.column(0), part.column(1), pa.array(_deviations(x, model.n, model.sums), pa.int64()),
                     pa.array(white.tolist(), pa.list_(pa.float64()))],
                    ["key", "times", "deviation", "whitened"],
                )

    return kinds.select("key", "times").mapInArrow(
        run, "key binary, times long, deviation long, whitened array<double>"
    )


def identity_error(kinds: DataFrame, count: int, weight: str) -> float:
    """How far the whitened vectors' covariance is from the identity, at most, over all entries."""
    if not count:
        return 0.0
    each = F.col("times") if weight == "counts" else F.lit(1)
    w = [F.element_at("whitened", k + 1) for k in range(count)]
    means = kinds.agg(*[F.sum(x * each) / F.sum(each) for x in w]).first()
    centred = [x - F.lit(float(m)) for x, m in zip(w, means)]
    pairs = [(i, j) for i in range(count) for j in range(i + 1)]
    found = kinds.agg(*[F.sum(centred[i] * centred[j] * each) / F.sum(each) for i, j in pairs]).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(found, pairs))


def whiten(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
    components: int | None = None, weights: str = "one",
) -> DataFrame:
    """One row per row of `rows` with a usable vector: vec_id, times, n, deviation, whitened, explained, identity_error.

    Left out are null vectors and those with null or non-finite entries. An entry c counts as
    floor(256 * c), as a long; shorter vectors as if zeros followed, and an empty one as zeros only.
    `times` is how many rows have the vector. With weights "one" the fit has each different vector once,
    with "counts" as often as it occurs; n is the sum of the weights and S that of the weighted vectors.
    `deviation` is sum((n * x - S)^2), exact, null beyond a long. `whitened` has the vector minus S / n on
    each component over the root of its variance, by falling variance, `components` of them at most;
    `explained` their shares of the whole variance. Directions without variance have no component, so
    if all vectors are alike both are empty. Equal variances come in any order, the same for all rows;
    a component's largest entry is positive. Null and repeated ids have a row each; an empty table, or
    one without a usable vector, gives none. Other columns are left out, whatever their names.
    """
    if weights not in ("one", "counts"):
        raise ValueError('weights is "one" or "counts"')
    keyed = cut_lineage(whole_vectors(rows, id_col, vector_col))
    counted = keyed.groupBy("key", "used").agg(F.count(F.lit(1)).alias("times"))
    weight = F.col("times") if weights == "counts" else F.lit(1).cast("long")
    kinds = cut_lineage(counted.withColumn("weight", weight))
    seen = kinds.agg(F.max("used").alias("d"), F.sum("times").alias("rows")).first()
    if seen["rows"] is None:
        return keyed.select(
            "vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (
                ("times", "long"), ("n", "long"), ("deviation", "long"), ("whitened", "array<double>"),
                ("explained", "array<double>"), ("identity_error", "double"))],
        )
    d = max(int(seen["d"]), 1)
    model = fit(kinds, d, components)
    white = cut_lineage(whitened_kinds(kinds, d, model))
    error = identity_error(white, len(model.variances), weights)
    joined = join_groups(keyed.drop("used"), white, ["key"], "times", seen["rows"])
    share = [float(v / model.total) for v in model.variances]
    return joined.select(
        "vec_id", "times", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.array(*[F.lit(v) for v in share]).cast("array<double>").alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )
