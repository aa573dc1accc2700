"""A hidden Markov language model, trained by Baum-Welch over the whole corpus.

A latent state emits a word in two steps: one of CLASSES word classes (the leading bits of the word's
hash, so that the tables have a fixed size however many words there are) by the state, and the word
within its class by its share of the class's training tokens. A text's likelihood is therefore the
forward recursion over classes times the shares of its words, and the shares need no order: counts
of words are joined block by block, through each block's own dictionary.

Training goes through disjoint parts of the training documents that double in size and together are
all of them; each part's expected counts, summed over partitions, are added to the faded earlier
ones. Recursions run over all documents of a block at a time, longest first.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.blocks import BLOCK, bucketed, in_blocks, pack_rows, unpack_rows
from tickloom.llm.words import word_runs
from tickloom.session import cut_lineage

STATES = 8
CLASS_BITS = 12
CLASSES = 1 << CLASS_BITS  # the end of a text is one more
#: Training documents by hash mod PARTS; each round takes up to the next mark.
PARTS = 32
ROUNDS = (0, 1, 2, 4, 8, 16, 32)
FADE = 0.5  # what earlier rounds' counts still weigh
PSEUDO = 50.0  # tokens of the overall class shares that each state's emissions start with


@dataclass
class Model:
    start: np.ndarray  # (states,)
    move: np.ndarray  # (states, states)
    emit: np.ndarray  # (classes + 1, states)


def first_model(shares: np.ndarray, states: int, seed: int = 1) -> Model:
    rng = np.random.default_rng(seed)
    emit = shares[:, None] * np.exp(0.5 * rng.standard_normal((len(shares), states)))
    move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


@dataclass
class Batch:
    """Sequences side by side, longest first: step t has the first active[t] of them."""

    order: np.ndarray  # the sequence in each place
    active: np.ndarray
    at: np.ndarray  # where each step's symbols begin
    symbols: np.ndarray


def side_by_side(symbols: np.ndarray, lengths: np.ndarray) -> Batch:
    """`symbols`: the sequences end to end; none is empty."""
    order = np.argsort(-lengths, kind="stable")
    place = np.empty(len(lengths), np.int64)
    place[order] = np.arange(len(lengths))
    sequence = np.repeat(np.arange(len(lengths)), lengths)
    step = np.arange(len(symbols)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    active = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(lengths.max()), "right")
    at = np.cumsum(active) - active
    packed = np.empty(len(symbols), symbols.dtype)
    packed[at[step] + place[sequence]] = symbols
    return Batch(order, active, at, packed)


def log10_likelihood(model: Model, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of each sequence, by the scaled forward recursion."""
    b = side_by_side(symbols, lengths)
    emitted = model.emit[b.symbols]
    out = np.zeros(len(lengths))
    state = np.broadcast_to(model.start, (len(lengths), len(model.start))) * emitted[: len(lengths)]
    active = b.active.tolist()
    for t, (n, at) in enumerate(zip(active, b.at.tolist())):
        if t == 0:
            continue
        if n < len(state):
            out[n : len(state)] += np.log10(state[n:].sum(axis=1))
            state = state[:n]
        state = state @ model.move
        state *= emitted[at : at + n]
        if t % 8 == 0:
            scale = state.sum(axis=1)
            out[:n] += np.log10(scale)
            state /= scale[:, None]
    out[: len(state)] += np.log10(state.sum(axis=1))
    result = np.empty(len(lengths))
    result[b.order] = out
    return result


def expected_counts(model: Model, symbols: np.ndarray, lengths: np.ndarray) -> Model:
    """Expected starts, moves and emissions of all sequences together."""
    b = side_by_side(symbols, lengths)
    emitted = model.emit[b.symbols]
    forward, scales = np.empty_like(emitted), np.empty(len(emitted))
    state = None
    steps = list(zip(b.active.tolist(), b.at.tolist()))
    for n, at in steps:
        state = np.tile(model.start, (n, 1)) if state is None else state[:n] @ model.move
        state *= emitted[at : at + n]
        scale = state.sum(axis=1)
        state /= scale[:, None]
        forward[at : at + n], scales[at : at + n] = state, scale
    emitted /= scales[:, None]
    backward = np.ones_like(emitted)
    moves = np.zeros_like(model.move)
    back = model.move.T
    for (_, at), (n, after) in zip(steps[-2::-1], steps[:0:-1]):
        ahead = backward[after : after + n] * emitted[after : after + n]
        moves += forward[at : at + n].T @ ahead
        backward[at : at + n] = ahead @ back
    forward *= backward
    emits = np.stack(
        [np.bincount(b.symbols, forward[:, k], len(model.emit)) for k in range(forward.shape[1])], axis=1
    )
    return Model(forward[: len(lengths)].sum(axis=0), moves * model.move, emits)


def maximised(counts: Model, shares: np.ndarray) -> Model:
    start, move = counts.start + 1.0, counts.move + 1.0
    emit = counts.emit + PSEUDO * shares[:, None]
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _tokens(docs: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Dictionary places of a block's tokens end to end (the end is -1), and tokens per document."""
    column = docs.column("tokens")
    return column.values.to_numpy(), np.diff(column.offsets.to_numpy())


def _classes(hashes: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    of_word = (hashes.view(np.uint64) >> np.uint64(64 - CLASS_BITS)).astype(np.int64)
    return np.append(of_word, CLASSES)[tokens]


def write_tokens(docs: DataFrame, training: Column, id_col: str, text_col: str, size: int = BLOCK) -> DataFrame:
    """(block, docs, hashes, n): documents as places in the block's dictionary, and how often each word
    occurs in the block's training documents."""
    key = F.col(f"`{id_col}`")
    rows = docs.select(
        key.alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"),
        training.alias("training"), F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int").alias("part"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in in_blocks(batches, size):
            words = next(word_runs(batch.column(1), lower=True, chunk=1 << 62))
            hashes, place = np.unique(words.hashes().view(np.int64), return_inverse=True)
            taught = batch.column(2).to_numpy(zero_copy_only=False)
            n = np.bincount(place, taught[words.row], len(hashes)).astype(np.int64)
            cut = words.cut
            tokens = np.insert(place.astype(np.int32), cut[1:], -1)
            edges = (cut + np.arange(len(cut))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(tokens))
            packed = pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), lists],
                ["doc_id", "training", "part", "tokens"],
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number]), pa.array([pack_rows(packed)], pa.binary()),
                    pa.array([hashes], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int64())),
                ],
                ["block", "docs", "hashes", "n"],
            )

    return bucketed(rows.mapInArrow(run, "block long, docs binary, hashes array<long>, n array<long>"))


def word_counts(table: DataFrame) -> DataFrame:
    """(block, hash, c, first): per block its words, in order, their counts in all training documents,
    and whether the block is the one that answers for the word. A word is one row per block."""
    words = table.select("block", F.explode(F.arrays_zip("hashes", "n")).alias("w")).select(
        "block", F.col("w.hashes").alias("hash"), F.col("w.n").alias("n")
    )
    same = Window.partitionBy("hash")
    counted = words.select(
        "block", "hash", F.sum("n").over(same).alias("c"),
        (F.min("block").over(same) == F.col("block")).alias("first"),
    )
    lists = F.sort_array(F.collect_list(F.struct("hash", "c", "first")))
    return cut_lineage(
        counted.groupBy("block").agg(lists.alias("r")).select("block", "r.hash", "r.c", "r.first")
    )


def class_totals(counts: DataFrame) -> np.ndarray:
    """(CLASSES, 2): training tokens and distinct training words of every class."""
    word = F.col("w")
    of_class = F.shiftrightunsigned(word["hash"], 64 - CLASS_BITS)
    rows = (
        counts.select(F.explode(F.arrays_zip("hash", "c", "first")).alias("w"))
        .filter(word["first"] & (word["c"] > 0))
        .groupBy(of_class.alias("class"))
        .agg(F.sum(word["c"]).alias("tokens"), F.count(F.lit(1)).alias("words"))
        .collect()  # at most CLASSES rows
    )
    totals = np.zeros((CLASSES, 2))
    for row in rows:
        totals[row["class"]] = row["tokens"], row["words"]
    return totals


def baum_welch(table: DataFrame, totals: np.ndarray, documents: int, states: int = STATES) -> Model:
    shares = np.append(totals[:, 0], documents) + 0.5
    shares /= shares.sum()
    model, total = first_model(shares, states), None
    names = [f"s{k}" for k in range(states)]
    schema = "slot int, " + ", ".join(f"{x} double" for x in names)
    for low, high in zip(ROUNDS, ROUNDS[1:]):
        # Of fixed size: the model, and back the counts of its parameters.
        got = table.select("docs", "hashes").mapInArrow(_counting(model, low, high), schema)
        rows = got.groupBy("slot").agg(*[F.sum(x).alias(x) for x in names]).collect()
        sums = np.zeros((CLASSES + 2 + states, states))
        for row in rows:
            sums[row[0]] = row[1:]
        new = Model(sums[CLASSES + 1], sums[CLASSES + 2 :], sums[: CLASSES + 1])
        if total is not None:
            new = Model(
                new.start + FADE * total.start, new.move + FADE * total.move, new.emit + FADE * total.emit
            )
        total, model = new, maximised(new, shares)
    return model


def _counting(model: Model, low: int, high: int):
    """Expected counts of a task's training documents of parts low to high - 1, a row per parameter row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(model.emit) + 1 + len(model.start), len(model.start)))
        for batch in batches:
            for payload, hashes in zip(batch.column(0), batch.column(1)):
                docs = unpack_rows(payload.as_py())
                tokens, lengths = _tokens(docs)
                part = docs.column("part").to_numpy()
                take = docs.column("training").to_numpy(zero_copy_only=False) & (part >= low) & (part < high)
                if not take.any():
                    continue
                symbols = _classes(hashes.values.to_numpy(), tokens)[np.repeat(take, lengths)]
                found = expected_counts(model, symbols, lengths[take])
                sums += np.concatenate([found.emit, found.start[None, :], found.move])
        there = np.flatnonzero(sums.any(axis=1))
        columns = [pa.array(there.astype(np.int32)), *(pa.array(sums[there, k]) for k in range(sums.shape[1]))]
        yield pa.RecordBatch.from_arrays(columns, ["slot", *(f"s{k}" for k in range(sums.shape[1]))])

    return run


def lm_scores(
    docs: DataFrame,
    held_out: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    states: int = STATES,
    size: int = BLOCK,
) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words of a text, lower-cased in A-Z, and one end; a null text has the end alone.
    Everything is learnt from rows for which `held_out` is false. base_score is the log10 probability
    under add-one unigram counts, score that under the hidden Markov model, to which all unseen words
    of a class are one. Rows that repeat an id are rows like others; a null id stays null. Without
    training rows the counts are 0 and the states alike. An empty table gives no rows.
    """
    training = ~F.coalesce(held_out, F.lit(False))
    table = write_tokens(docs, training, id_col, text_col, size)
    counts = word_counts(table)
    totals = class_totals(counts)
    documents = docs.filter(training).count()
    model = baum_welch(table, totals, documents, states)
    n_train = int(totals[:, 0].sum()) + documents
    vocabulary = int(totals[:, 1].sum()) + (documents > 0)
    floor = np.log10(n_train + vocabulary + 1)
    of_class = np.log10(totals.sum(axis=1) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, hashes, c in zip(*(batch.column(i) for i in range(3))):
                rows = unpack_rows(payload.as_py())
                tokens, lengths = _tokens(rows)
                h = hashes.values.to_numpy() if hashes.is_valid else np.zeros(0, np.int64)
                n = c.values.to_numpy() if c.is_valid else np.zeros(0, np.int64)
                symbols = _classes(h, tokens)
                row = np.repeat(np.arange(len(lengths)), lengths)
                times = np.append(n, documents)[tokens]
                log_times = np.log10(np.append(n, documents) + 1.0)[tokens]
                base = np.bincount(row, log_times - floor, len(lengths))
                within = np.where(tokens < 0, 0.0, log_times - np.append(of_class, 0.0)[symbols])
                found = log10_likelihood(model, symbols, lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id"), pc.invert(rows.column("training")),
                        pa.array(lengths.astype(np.int64)),
                        pa.array(np.bincount(row, times > 0, len(lengths)).astype(np.int64)),
                        pa.array(np.full(len(lengths), n_train)), pa.array(base),
                        pa.array(found + np.bincount(row, within, len(lengths))),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    key = next(f for f in docs.schema if f.name == id_col).dataType.simpleString()
    schema = (
        f"doc_id {key}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double"
    )
    joined = table.select("block", "docs").join(counts.select("block", "hash", "c"), "block", "left")
    return joined.select("docs", "hash", "c").mapInArrow(run, schema)
