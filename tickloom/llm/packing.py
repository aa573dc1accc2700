"""Packing documents into sequences of fixed size by patterns fitted to the length histogram.

Documents become pieces of at most `size` tokens. The driver sees the histogram of piece lengths
only (at most `size` numbers): patterns of up to three lengths that fill a sequence exactly are
fitted to it by non-negative least squares, rounded down, and what is left is packed best fit,
longest first, by counts. The plan says which rank among the pieces of a length goes where; ranks
come from counters within tasks and sums of the tasks' counts. The plan's size depends on `size`
and never on the number of documents.
"""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.byte_bpe import byte_bpe
from tickloom.llm.words import give_back, let_go, text_runs
from tickloom.session import cut_lineage

SIZE = 1024
END_ID = 2
#: Bytes of text that a worker encodes together. It bounds memory, not results.
CHUNK = 1 << 20
ROUNDS = 400  # of the least-squares fit
_RANKS = np.int64(1) << 48  # more pieces than any length has


@dataclass
class Plan:
    """Slots by length and first rank: pieces of `key` up to the next key's go to `sequence` on."""

    key: np.ndarray  # length * _RANKS + first rank
    sequence: np.ndarray  # of the first rank; each further rank takes the next one
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = length.astype(np.int64) * _RANKS + rank
        slot = np.searchsorted(self.key, key, "right") - 1
        return self.sequence[slot] + (key - self.key[slot]), self.offset[slot]


def exact_patterns(lengths: np.ndarray, size: int) -> np.ndarray:
    """Up to three of the given lengths, longest first, with sum `size`; 0 fills the row."""
    there = np.zeros(size + 1, bool)
    there[lengths] = True
    rows = [np.array([[size, 0, 0]])] if there[size] else []
    first = lengths[lengths < size]
    a, b = np.meshgrid(first, first, indexing="ij")
    a, b = a[a >= b], b[a >= b]
    c = size - a - b
    good = (c >= 0) & (c <= b) & (there[np.clip(c, 0, size)] | (c == 0))
    rows.append(np.stack([a[good], b[good], c[good]], axis=1))
    return np.concatenate(rows)


def fit_repeats(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """How often to use each pattern: non-negative least squares by accelerated projection."""
    n, total = len(patterns), max(1.0, float(counts.sum()))
    aim = counts / total

    def used(x):
        out = np.bincount(patterns.ravel(), np.repeat(x, 3), len(counts))
        out[0] = 0
        return out

    def back(r):
        return r[patterns].sum(axis=1)

    probe = np.ones(n) / np.sqrt(n)
    for _ in range(20):
        probe = back(used(probe))
        steep = np.linalg.norm(probe)
        probe /= steep
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(rounds):
        gap = used(y) - aim
        gap[0] = 0
        new = np.maximum(0.0, y - back(gap) / (1.05 * steep))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x * total


def plan_packing(counts: np.ndarray) -> Plan:
    """Sequences for counts[l] pieces of each length l from 1 to len(counts) - 1."""
    size = len(counts) - 1
    left = counts.astype(np.int64).copy()
    uses: list[tuple[tuple[int, ...], int]] = []
    lengths = np.flatnonzero(left)
    if len(lengths):
        patterns = exact_patterns(lengths, size)
        repeats = fit_repeats(patterns, left.astype(float)) if len(patterns) else np.zeros(0)
        for row in np.argsort(-repeats, kind="stable"):
            wish = int(repeats[row])
            if wish < 1:
                break
            pattern = [int(x) for x in patterns[row] if x]
            times = min([wish, *(int(left[x]) // pattern.count(x) for x in pattern)])
            if times:
                uses.append((tuple(pattern), times))
                for x in pattern:
                    left[x] -= times
    uses += _best_fit(left)
    keys, sequences, offsets = [], [], []
    ranks = np.zeros(size + 1, np.int64)
    number = 0
    for pattern, times in uses:
        offset = 0
        for length in pattern:
            keys.append(length * int(_RANKS) + int(ranks[length]))
            sequences.append(number)
            offsets.append(offset)
            ranks[length] += times
            offset += length
        number += times
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    return Plan(
        np.array(keys, np.int64)[order],
        np.array(sequences, np.int64)[order],
        np.array(offsets, np.int64)[order],
        number,
    )


def _best_fit(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Longest pieces first into the fullest sequences that take them, whole groups at a time."""
    size = len(left) - 1
    spaces: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(size + 1)]

    def put(pattern, times, length, copies):
        filled = pattern + (length,) * copies
        spaces[size - sum(filled)].append((filled, times))

    for length in range(size, 0, -1):
        rest = int(left[length])
        space = length
        while rest:
            while space < size and not spaces[space]:
                space += 1
            pattern, times = spaces[space].pop() if spaces[space] else ((), rest)
            copies = (size - sum(pattern)) // length
            whole = min(times, rest // copies)
            if whole:
                put(pattern, whole, length, copies)
                rest -= whole * copies
            if pattern and times > whole:
                spaces[size - sum(pattern)].append((pattern, times - whole))
            if whole == 0:  # fewer pieces than one sequence takes
                if pattern:
                    spaces[size - sum(pattern)].pop()
                    if times > 1:
                        spaces[size - sum(pattern)].append((pattern, times - 1))
                put(pattern, 1, length, rest)
                rest = 0
    return [use for group in spaces for use in group]


PIECES = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long, "
    "ids array<int>"
)


def cut_pieces(
    docs: DataFrame, tokenizer: str, size: int, end_id: int, id_col: str, text_col: str, ids: bool
) -> DataFrame:
    """One row per piece, ranked among the pieces of its length in its task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, ranks = byte_bpe(tokenizer), np.zeros(size + 1, np.int64)
        part = TaskContext.get().partitionId()
        for batch in batches:
            for first, data, offsets in text_runs(batch.column(1), CHUNK):
                tokens, at = encoder.encode(data, offsets)
                yield _pieces(
                    batch.column(0).slice(first, len(offsets) - 1), tokens, at, size, end_id,
                    part, ranks, ids,
                )
                del tokens, at
                give_back()

    wanted = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
    )
    return wanted.mapInArrow(cut, PIECES)


def _pieces(doc_ids, tokens, at, size, end_id, part, ranks, with_ids) -> pa.RecordBatch:
    rows = len(at) - 1
    # The end id after each document's ids.
    stream = np.insert(tokens, at[1:], end_id).astype("<u4")
    begin = at[:-1] + np.arange(rows)
    total = np.diff(at) + 1
    pieces = -(-total // size)
    doc = np.repeat(np.arange(rows), pieces)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    head = total - (pieces - 1) * size  # the first piece takes what is over
    start = np.where(piece == 0, 0, head[doc] + (piece - 1) * size)
    length = np.where(piece == 0, head[doc], size)
    low = begin[doc] + start
    raw = stream.tobytes()
    crc = [zlib.crc32(raw[4 * b : 4 * (b + n)]) for b, n in zip(low.tolist(), length.tolist())]
    order = np.argsort(length, kind="stable")
    same = length[order]
    inner = np.arange(len(same)) - np.searchsorted(same, same)
    rank = np.empty(len(same), np.int64)
    rank[order] = inner + ranks[same]
    ranks += np.bincount(length, minlength=size + 1)
    if with_ids:
        edges = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
        ids = pa.ListArray.from_arrays(edges, pa.array(stream.astype(np.int32)))
    else:
        ids = pa.nulls(len(doc), pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays(
        [
            doc_ids.take(pa.array(doc)), pa.array(piece.astype(np.int32)),
            pa.array(start.astype(np.int64)), pa.array(length.astype(np.int64)),
            pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part, np.int32)),
            pa.array(rank), ids,
        ],
        ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", "ids"],
    )


def pack(
    docs: DataFrame,
    tokenizer: str,
    size: int = SIZE,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A document is its text's ids and `end_id`; a null or empty text has that alone. Longer ones are
    cut into pieces of `size`, the first of which may be shorter. Rows that repeat an id are
    packed each; a null id stays null. An empty table gives no rows. Columns other than the two
    named are not looked at. `tokenizer` is a path that every executor can open.
    """
    spark = docs.sparkSession
    pieces = cut_pieces(docs, tokenizer, size, end_id, id_col, text_col, with_ids)
    pieces = cut_lineage(pieces if with_ids else pieces.drop("ids"))
    by_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    # One row per task and length; sums run over tasks.
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = cut_lineage(by_part.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))))
    counts = np.zeros(size + 1, np.int64)
    for length, n in base.groupBy("length").agg(F.sum("n")).collect():  # at most `size` rows
        counts[length] = n
    plan = spark.sparkContext.broadcast(plan_packing(counts))
    placed = pieces.join(base.drop("n"), ["part", "length"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    placed = placed.select(*names, (F.col("rank") + F.col("base")).alias("rank"))
    schema = placed.drop("rank").schema.add("sequence_id", "long").add("offset", "long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = plan.value.place(length, rank)
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence), pa.array(offset)],
                [*names, "sequence_id", "offset"],
            )

    return placed.mapInArrow(place, schema)
