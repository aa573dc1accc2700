"""Near duplicates of word-shingle sets by HyperMinHash.

A signature has 128 buckets; each keeps, of the smallest hash that fell into it, the number of
leading zeros and the ten bits after the first one. Small sets would leave buckets empty, so every
shingle is hashed several times over, as often as the size class of its set asks for; that leaves
the Jaccard similarity as it is. Sets close to the next class are signed for both.

Registers are banded by four. Sets that share a band are compared by their registers, corrected
for chance collisions, then on the full sets. Within a band every set is compared with one of them
first, another one in every band. What that links is one component, and only pairs across components are compared further.
Of those only the pairs come out of the join whose masks leave room for a link: 64 * MASK bits, each set
where the set has a shingle that falls on it. A bit that one has and the other lacks is a shingle that they
don't share. In a large group of copies with edits of their own, most of what no pivot has linked has no
link at all, and that shows in the masks.
"""

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.graph import components, join_groups
from tickloom.llm.words import Words, give_back, let_go, mix, running, windows, word_runs
from tickloom.session import cut_lineage

SHINGLE = 4
BUCKET_BITS = 7
BUCKETS = 1 << BUCKET_BITS
MANTISSA = 10
BAND = 4  # registers; 32 bands: a pair at 0.8 shares none with a chance of 5e-8
FILL = 16  # hashes per bucket, at least
#: Pairs estimated this far below the threshold are not compared in full: four and a half deviations
#: of an estimate from 128 registers at 0.8, a chance of 3 in a million.
MARGIN = 0.16
MASK = 16  # longs: sets of up to some hundred shingles are told apart well, larger ones less
#: A node with more keys (an id with several texts) may bring a pair once for each key that it meets in.
MOST_KEYS = 256
#: Bytes of text, and hashes, that a worker looks at together. Bounds on memory, not on results.
CHUNK = 1 << 20
TOGETHER = 1 << 18
_MASKS = [f"mask{i}" for i in range(MASK)]
_STEP = np.uint64(0xD1342543DE82EF95)


def shingles(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct shingles of every row, sorted.

    A row of fewer words has its whole sequence as one shingle; one without words has none.
    """
    hashes = words.hashes()
    found, at = windows(words, hashes, size)
    rows = words.row[at]
    cut = words.cut
    for width in range(1, size):
        short = np.flatnonzero(np.diff(cut) == width)
        if len(short):
            whole = np.zeros(len(short), np.uint64)
            for k in range(width):
                whole = mix(whole * _STEP + hashes[cut[short] + k] + np.uint64(width))
            found, rows = np.concatenate([found, whole]), np.concatenate([rows, short])
    order = np.lexsort((found, rows))
    found, rows = found[order], rows[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (rows[1:] != rows[:-1])
    return rows[new], found[new]


def registers(row: np.ndarray, hashes: np.ndarray, rows: int, copies: int) -> np.ndarray:
    """(rows, BUCKETS) registers of the sets given as sorted rows and hashes."""
    least = np.full(rows * BUCKETS, np.iinfo(np.uint64).max, np.uint64)
    together = max(1, TOGETHER // max(1, len(hashes)))
    for low in range(0, copies, together):
        turn = np.arange(low + 1, min(copies, low + together) + 1, dtype=np.uint64) * _STEP
        each = mix(hashes[None, :] + turn[:, None])
        place = row * BUCKETS + (each >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        np.minimum.at(least, place.ravel(), (each << np.uint64(BUCKET_BITS)).ravel())
    _, exponent = np.frexp((least >> np.uint64(11)).astype(np.float64))
    zeros = (53 - exponent).astype(np.uint64)
    bits = (least << zeros << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    return ((zeros << np.uint64(MANTISSA)) | bits).astype(np.uint16).reshape(rows, BUCKETS)


def size_class(n: np.ndarray) -> np.ndarray:
    """k for sets of 2^k to 2^(k+1) - 1 shingles."""
    return np.frexp(np.maximum(n, 1).astype(np.float64))[1] - 1


def class_copies(k: int) -> int:
    return max(1, BUCKETS * FILL >> k)


def band_keys(regs: np.ndarray, k: np.ndarray) -> np.ndarray:
    """(rows, bands) keys; equal keys mean equal class, band and registers, but for rare chance."""
    bands = BUCKETS // BAND
    packed = np.ascontiguousarray(regs).view(np.uint64).reshape(len(regs), bands)
    salt = mix(k.astype(np.uint64)[:, None] * np.uint64(1000) + np.arange(1, bands + 1, dtype=np.uint64))
    return mix(packed ^ salt).view(np.int64)


@lru_cache(4096)
def chance(a: float, b: float) -> float:
    """How often registers of disjoint sets with a and b hashes per bucket agree.

    Summed over register values: the chance that both least hashes fall into the value's cell.
    """
    zeros = np.arange(48)[:, None]
    cell = 2.0 ** -(zeros + 1)
    low = cell * (1 + np.arange(1 << MANTISSA) / (1 << MANTISSA))
    high = low + cell / (1 << MANTISSA)

    def mass(n):
        return np.exp(n * np.log1p(-low)) - np.exp(n * np.log1p(-np.minimum(high, 1 - 1e-16)))

    return float((mass(a) * mass(b)).sum())


def estimate(left: np.ndarray, right: np.ndarray, n_left, n_right, k) -> np.ndarray:
    """Jaccard similarity from registers, corrected for chance collisions."""
    same = (left == right).mean(axis=1)
    per = np.array([class_copies(int(x)) for x in k]) / BUCKETS
    # To the nearest eighth of a power of two: the correction is below 1e-3 anyway.
    a, b = (2.0 ** (np.round(8 * np.log2(n * per)) / 8) for n in (n_left, n_right))
    by_chance = np.array([chance(float(x), float(y)) for x, y in zip(a, b)])
    return np.clip((same - by_chance) / (1 - by_chance), 0, 1)


SIGNED = (
    "node long, doc_id long, n_shingles long, d1 long, d2 long, k int, regs binary, regs_up binary, "
    + ", ".join(f"{c} long" for c in ("bits", *_MASKS))
)


def sign(docs: DataFrame, size: int, id_col: str, text_col: str, percent: int) -> DataFrame:
    """Per row its set's size, a 128-bit digest of the set, and its registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for words in word_runs(batch.column(2), lower=True, chunk=CHUNK):
                part = batch.slice(words.first, words.rows)
                yield _signed(part.column(0), part.column(1), words, size, percent)
                del part, words
                give_back()

    return docs.select(*_wanted(id_col, text_col)).mapInArrow(run, SIGNED)


def _wanted(id_col: str, text_col: str) -> list:
    key = F.col(f"`{id_col}`").cast("long")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    unnamed = F.lit(2**63 - 1) - F.shiftrightunsigned(F.xxhash64(text), 2)
    return [
        F.coalesce(key, unnamed).alias("node"),
        key.alias("doc_id"),
        text.alias("text"),
    ]


def _digests(hashes: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Two halves of a 128-bit digest of each row's set; `n`: shingles by row."""
    cut, out = running(n), []
    for seed in (1, 2):
        sums = running(mix(hashes ^ mix(np.array([seed], np.uint64))))
        out.append((sums[cut[1:]] - sums[cut[:-1]]).view(np.int64))
    return out


def masks(row: np.ndarray, hashes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """How many bits each row has, and (rows, MASK) longs with a bit for each shingle; some fall together."""
    there = np.zeros((rows, 64 * MASK), bool)
    there[row, (hashes % np.uint64(64 * MASK)).astype(np.int64)] = True
    return there.sum(axis=1), np.packbits(there, axis=1).view(np.int64)


def _signed(nodes, ids, words: Words, size: int, percent: int) -> pa.RecordBatch:
    row, hashes = shingles(words, size)
    n = np.bincount(row, minlength=words.rows)
    digests = _digests(hashes, n)
    bits, masked = masks(row, hashes, words.rows)
    k = size_class(n)
    own = np.zeros((words.rows, BUCKETS), np.uint16)
    upper = np.zeros((words.rows, BUCKETS), np.uint16)
    # The smallest set that can be linked with one of the next class.
    near = (n > 0) & (100 * n >= percent * (1 << (k + 1)))
    for out, at_class, chosen in ((own, k, n > 0), (upper, k + 1, near)):
        for c in np.unique(at_class[chosen]):
            rows = np.flatnonzero(chosen & (at_class == c))
            place = np.full(words.rows, -1)
            place[rows] = np.arange(len(rows))
            mine = place[row] >= 0
            out[rows] = registers(place[row[mine]], hashes[mine], len(rows), class_copies(int(c)))
    return pa.RecordBatch.from_arrays(
        [
            nodes, ids, pa.array(n.astype(np.int64)), pa.array(digests[0]), pa.array(digests[1]),
            pa.array(k.astype(np.int32)),
            pa.array([x.tobytes() for x in own], pa.binary()),
            pa.array([x.tobytes() if y else None for x, y in zip(upper, near)], pa.binary()),
            pa.array(bits), *[pa.array(np.ascontiguousarray(x)) for x in masked.T],
        ],
        ["node", "doc_id", "n_shingles", "d1", "d2", "k", "regs", "regs_up", "bits", *_MASKS],
    )


def _matrix(column: pa.Array) -> np.ndarray:
    flat = b"".join(x or b"\0" * (2 * BUCKETS) for x in column.to_pylist())
    return np.frombuffer(flat, np.uint16).reshape(len(column), BUCKETS)


def bands(signed: DataFrame) -> DataFrame:
    """(key, node) for every band of every signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                node, k = part.column(0).to_numpy(), part.column(1).to_numpy()
                for column, up in ((2, 0), (3, 1)):
                    there = np.flatnonzero(part.column(column).is_valid().to_numpy(zero_copy_only=False))
                    keys = band_keys(_matrix(part.column(column))[there], k[there] + up)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.ravel()), pa.array(np.repeat(node[there], keys.shape[1]))],
                        ["key", "node"],
                    )
            give_back()

    return signed.select("node", "k", "regs", "regs_up").mapInArrow(run, "key long, node long")


def similar(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose registers say that they may reach the threshold."""
    columns = ("n_shingles", "k", "regs", "regs_up")

    def side(end: str) -> DataFrame:
        return signed.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns])

    n_a, n_b = F.col("n_shingles_a"), F.col("n_shingles_b")
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.filter(F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent)
    # The class that both are signed for.
    k = F.greatest("k_a", "k_b")
    both = both.select(
        "a", "b", k.alias("k"), n_a, n_b,
        *[F.when(F.col(f"k_{e}") == k, F.col(f"regs_{e}")).otherwise(F.col(f"regs_up_{e}")) for e in "ab"],
    ).toDF("a", "b", "k", "n_a", "n_b", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                k, n_a, n_b = (part.column(c).to_numpy() for c in ("k", "n_a", "n_b"))
                got = estimate(_matrix(part.column(5)), _matrix(part.column(6)), n_a, n_b, k)
                keep = pa.array(got >= percent / 100 - MARGIN)
                yield part.select(["a", "b"]).filter(keep)
            give_back()

    return both.mapInArrow(run, "a long, b long")


def linked(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold. `texts`: (node, text) of all ends."""

    def side(end: str) -> DataFrame:
        return texts.select(F.col("node").alias(end), F.col("text").alias(f"text_{end}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                yield part.select(["a", "b"]).filter(pa.array(_reach(part, size, percent)))
            give_back()

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(run, "a long, b long")


def _reach(part: pa.RecordBatch, size: int, percent: int) -> np.ndarray:
    rows, hashes = [], []
    count = np.zeros(part.num_rows, np.int64)
    for column in (2, 3):
        for words in word_runs(part.column(column), lower=True, chunk=CHUNK):
            row, found = shingles(words, size)
            rows.append(row + words.first)
            hashes.append(found)
            count += np.bincount(row + words.first, minlength=part.num_rows)
    row, found = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((found, row))
    row, found = row[order], found[order]
    both = (row[1:] == row[:-1]) & (found[1:] == found[:-1])
    shared = np.bincount(row[1:][both], minlength=part.num_rows)
    return 100 * shared >= percent * (count - shared)


def near_duplicates(
    docs: DataFrame,
    size: int = SHINGLE,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept.

    Words are lower-cased in A-Z. Sets are linked when 100 * shared >= percent * united; a null text
    or one without words has the empty set, linked with nothing. component_id is the smallest id
    reachable over links, kept says that it is the row's own. Rows that repeat an id are one node:
    they are in one component and stay or go together. Rows without an id are one node per text, larger
    than all ids, which are below 2^62; a component of such rows alone has a null component_id.
    An empty table gives no rows. Columns other than the two named are not looked at.
    """
    signed = cut_lineage(sign(docs, size, id_col, text_col, percent))
    total = signed.count()
    filled = signed.filter("n_shingles > 0")
    groups = cut_lineage(
        filled.groupBy("d1", "d2", "n_shingles").agg(
            F.min("node").alias("rep"), F.count(F.lit(1)).alias("times")
        )
    )
    repeated = groups.filter("times > 1")
    alike = cut_lineage(
        join_groups(filled, repeated, ["d1", "d2", "n_shingles"], "times", total)
        .filter("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    )
    reps = cut_lineage(filled.join(groups.select(F.col("rep").alias("node")), "node", "left_semi"))
    banded = cut_lineage(bands(reps))
    shared = cut_lineage(
        banded.groupBy("key")
        .agg(
            F.min_by("node", F.xxhash64("key", "node")).alias("pivot"), F.count(F.lit(1)).alias("times")
        )
        .filter("times > 1")
    )
    met = cut_lineage(join_groups(banded, shared, ["key"], "times", 32 * total).drop("times"))
    tried = cut_lineage(
        met.filter("node <> pivot")
        .select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct()
    )
    texts = docs.select(*_wanted(id_col, text_col)).select("node", "text")
    links = _confirmed(tried, reps, texts, size, percent)
    labels = cut_lineage(components(links))
    # Pairs of a band that are not in one component yet.
    known = cut_lineage(
        met.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    )
    counts = known.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    split = counts.groupBy("key").agg(
        F.max_by("label", "n").alias("major"), F.count(F.lit(1)).alias("labels")
    )
    open_keys = cut_lineage(known.join(split.filter("labels > 1"), "key"))
    columns = ["node", "label", "n_shingles", "bits", "ks", *_MASKS]
    sets = reps.select("node", "n_shingles", "bits", *_MASKS).distinct()
    able = cut_lineage(_with_keys(open_keys.join(sets, "node")).select("key", "major", *columns))
    minor = able.filter("label != major").select("key", *[F.col(c).alias(f"{c}_x") for c in columns])
    # One of a pair is not of the band's largest component; if both are not, the smaller comes first. And
    # of the bands that a pair shares it comes from the one with the least key.
    first = (F.col("label") == F.col("major")) | (F.col("node") < F.col("node_x"))
    once = F.coalesce(F.array_min(F.array_intersect("ks", "ks_x")) == F.col("key"), F.lit(True))
    across = (
        able.join(minor, "key")
        .filter((F.col("label") != F.col("label_x")) & first & _room(percent) & once)
        .select(F.least("node", "node_x").alias("a"), F.greatest("node", "node_x").alias("b")).distinct()
    )
    more = _confirmed(cut_lineage(across.join(tried, ["a", "b"], "left_anti")), reps, texts, size, percent)
    found = cut_lineage(components(links.unionByName(more).unionByName(alike)))
    return (
        signed.select("node", "doc_id", "n_shingles")
        .join(found, "node", "left")
        .withColumn("label", F.coalesce("label", "node"))
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("label") < 2**62, F.col("label")).alias("component_id"),
            (F.col("node") == F.col("label")).alias("kept"),
        )
    )


def _room(percent: int) -> Column:
    """If two sets (n_shingles, bits, masks, and those with _x) can share as much as a link takes.

    Of the bits in which the masks differ, (differ + bits - bits_x) / 2 are the first set's: as many of its
    shingles, at least, are not shared.
    """
    differ = reduce(
        lambda a, b: a + b, [F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_x"))) for c in _MASKS]
    )
    n, n_x, more = F.col("n_shingles"), F.col("n_shingles_x"), F.col("bits") - F.col("bits_x")
    twice_shared = F.least(2 * n - more, 2 * n_x + more) - differ
    return twice_shared * (100 + percent) >= (n + n_x) * 2 * percent


def _with_keys(rows: DataFrame) -> DataFrame:
    """With `ks`, the keys of the row's node, if it has no more than MOST_KEYS."""
    node = Window.partitionBy("node")
    counted = rows.withColumn("_n", F.count(F.lit(1)).over(node))
    few = F.when(F.col("_n") <= MOST_KEYS, F.col("key"))
    return counted.withColumn("ks", F.when(F.col("_n") <= MOST_KEYS, F.collect_list(few).over(node))).drop("_n")


def _confirmed(tried: DataFrame, reps: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs that pass the registers, then the full sets."""
    maybe = cut_lineage(similar(tried, reps, percent).distinct())
    ends = maybe.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # A merge at every size: the ends are a part of all documents, so no bound lets them be broadcast.
    needed = cut_lineage(texts.join(ends.hint("merge"), "node", "left_semi"))
    return cut_lineage(linked(maybe, needed, size, percent).distinct())
