"""Toxicity by class-conditional Kneser-Ney models of words, character by character.

Two models, of toxic and of ordinary documents, predict each character of a word from up to ORDER - 1
before it. From CLASS_ORDER on up each has counts of its own; below, both share one set of
Kneser-Ney continuation counts, so that an expression neither has seen says nothing about the class.
A document's evidence is the difference of its log-likelihoods divided by its number of words, of
which a word counts as far as it exceeds a noise level: rare ordinary words, seen once in one class
by chance, stay below. The level and a logistic curve of the evidence's logarithm are fitted on
training documents that the counts left out; then these are counted too.

The models are fitted on a bounded sample: at most SAMPLE labelled training documents of each class,
whole, in the order of a hash of their ids. Their size follows the sample, not the corpus.
"""

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.words import Words, give_back, kept, let_go, running, text_runs, word_runs
from tickloom.session import cut_lineage

ORDERS = (1, 2, 3, 5, 7, 10)  # lengths of counted sequences; each backs off to the one before
ORDER = ORDERS[-1]
CLASS_ORDER = 3
#: Sequences longer than this that were seen once only are left to the shorter ones.
ONCE = 5
DISCOUNT = 0.75
NOISE = (1.0, 2.0, 3.0, 4.0, 6.0, 8.0)  # levels to choose from, in nats
FLOOR = 0.01  # evidence by word that is as good as none
#: Labelled training documents of a class, at most; every CALIBRATION-th is left to the curve.
SAMPLE = 10_000
CALIBRATION = 4
#: Words whose evidence a worker keeps; with more the store starts anew.
KEPT = 800_000
#: Bytes of text, and words not met before, that are looked at together. Bounds on memory, not on results.
CHUNK = 1 << 20
TOGETHER = 1 << 14
THRESHOLD = 0.7
PRIOR = 0.2  # the share of toxic documents that scores assume

_BITS = 6
#: Symbols: padding before a word 0, letters 1 to 26, bytes of other letters 27 to 58, digits 59, other
#: ASCII 60 to 62, end of word 63.
_SYMBOL = np.array(
    [27 + (b & 31) if b >= 128 else 59 if 48 <= b < 58 else b - 96 if 97 <= b < 123 else 60 + b % 3
     for b in range(256)],
    np.int64,
)


def word_codes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the ORDER symbols that end at each byte and at each word's end; the word of each."""
    size = end - begin
    width = size + ORDER  # ORDER - 1 of padding, the bytes, the end mark
    starts = running(width)
    word = np.repeat(np.arange(len(begin)), width)
    inner = np.arange(starts[-1]) - starts[:-1][word]
    symbols = np.zeros(len(word), np.int64)
    is_byte = (inner >= ORDER - 1) & (inner < ORDER - 1 + size[word])
    at = begin[word] + inner - (ORDER - 1)
    symbols[is_byte] = _SYMBOL[data[at[is_byte]]]
    symbols[starts[1:] - 1] = 63
    codes = np.zeros(len(word), np.int64)
    for back in range(ORDER):
        codes[back:] |= symbols[: len(symbols) - back] << (_BITS * back)
    there = inner >= ORDER - 1
    return codes[there], word[there]


def tail(codes: np.ndarray, order: int) -> np.ndarray:
    """The last `order` symbols of each code."""
    return codes & ((1 << (_BITS * order)) - 1)


def _sum_by(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    found, place = np.unique(keys, return_inverse=True)
    return found, [np.bincount(place, v, len(found)) for v in values]


@dataclass
class Model:
    """Sorted codes and, by class, what they add. A code not listed adds nothing."""

    grams: list[tuple[np.ndarray, np.ndarray]]  # per order: codes, discounted shares (n, 2)
    contexts: list[tuple[np.ndarray, np.ndarray]]  # per order: codes, weights of the lower order
    noise: float = 0.0
    slope: float = 1.0
    offset: float = 0.0
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def evidence(self, codes: np.ndarray) -> np.ndarray:
        """log of the toxic over the ordinary model's probability of each code's last symbol."""
        p = np.full((len(codes), 2), 1.0 / 64)
        for order, grams, contexts in zip(ORDERS, self.grams, self.contexts):
            own = _looked_up(tail(codes, order), *grams, 0.0)
            rest = _looked_up(tail(codes >> _BITS, order - 1), *contexts, 1.0)
            p = own + rest * p
        return np.log(p[:, 1]) - np.log(p[:, 0])


def _looked_up(codes: np.ndarray, keys: np.ndarray, values: np.ndarray, missing: float) -> np.ndarray:
    if len(keys) == 0:
        return np.full((len(codes), 2), missing)
    at = np.searchsorted(keys, codes)
    at[at == len(keys)] = 0
    out = values[at]
    out[keys[at] != codes] = missing
    return out


def _tables(
    keys: np.ndarray, counts: np.ndarray, ctx_keys: np.ndarray, total: np.ndarray, kinds: np.ndarray
) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Discounted shares of an order's sorted sequences, and the weights of their sorted contexts."""
    safe = np.maximum(total, 1e-12)
    share = np.maximum(counts - DISCOUNT, 0) / safe[np.searchsorted(ctx_keys, keys >> _BITS)]
    return (keys, share), (ctx_keys, np.where(total > 0, DISCOUNT * kinds / safe, 1.0))


def fit_model(codes: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray) -> Model:
    """Kneser-Ney tables from counts of codes of ORDER symbols in either class, in memory."""
    grams, contexts = [], []
    for order, above in zip(ORDERS, (*ORDERS[1:], None)):
        if order < CLASS_ORDER:
            # Shared: how many different sequences of the next order end so, in either class.
            longer = np.unique(tail(codes, above))
            keys, (n,) = _sum_by(tail(longer, order), np.ones(len(longer)))
            counts = np.stack([n, n], axis=1)
        else:
            keys, both = _sum_by(tail(codes, order), ordinary, toxic)
            counts = np.stack(both, axis=1)
        ctx_keys, sums = _sum_by(keys >> _BITS, *counts.T, *(counts > 0).T)
        total, kinds = np.stack(sums[:2], axis=1), np.stack(sums[2:], axis=1)
        if order > ONCE:
            often = counts.sum(axis=1) > 1
            keys, counts = keys[often], counts[often]
            used = np.isin(ctx_keys, keys >> _BITS)
            ctx_keys, total, kinds = ctx_keys[used], total[used], kinds[used]
        found = _tables(keys, counts, ctx_keys, total, kinds)
        grams.append(found[0])
        contexts.append(found[1])
    return Model(grams, contexts)


def count_orders(counted: DataFrame, fits: tuple[str, ...]) -> list[tuple[DataFrame, DataFrame]]:
    """Per order the sequences' and the contexts' counts, from a table (code, n0, n1) for fit "n".

    Each order is counted from the one above. Contexts that only lead to what ONCE leaves out go here.
    """
    out: list[tuple[DataFrame, DataFrame]] = []
    names = [f"{x}{y}" for x in fits for y in "01"]
    keys = counted.withColumnRenamed("code", "key")
    for order in reversed(ORDERS):
        key = F.col("key").bitwiseAND(F.lit((1 << (_BITS * order)) - 1)).alias("key")
        if order < CLASS_ORDER:
            # Shared: how many different sequences of the next order end so, in either class.
            n = {x: F.sum((F.col(f"{x}0") + F.col(f"{x}1") > 0).cast("long")) for x in fits}
            keys = cut_lineage(keys.groupBy(key).agg(*[n[c[:-1]].alias(c) for c in names]))
        elif order < ORDER:
            keys = cut_lineage(keys.groupBy(key).agg(*[F.sum(c).alias(c) for c in names]))
        most = [F.max(F.col(f"{x}0") + F.col(f"{x}1")).alias(f"{x}_most") for x in fits]
        kinds = [F.sum((F.col(c) > 0).cast("long")).alias(f"{c}_kinds") for c in names]
        contexts = (
            keys.groupBy(F.shiftright("key", _BITS).alias("key"))
            .agg(*[F.sum(c).alias(c) for c in names], *kinds, *most)
            .filter(F.greatest(*[f"{x}_most" for x in fits], F.lit(0)) > _least(order))
        )
        out.append((keys, cut_lineage(contexts)))
    return out[::-1]


def _least(order: int) -> int:
    """Sequences seen so often are left to the shorter ones."""
    return 1 if order > ONCE else 0


def fit_counted(orders: list[tuple[DataFrame, DataFrame]], fit: str = "n") -> Model:
    """fit_model of `count_orders`; the driver gets what the model keeps."""
    grams, contexts = [], []
    for order, (keys, ctx) in zip(ORDERS, orders):
        n = (f"{fit}0", f"{fit}1")
        found, counts = _sorted_table(keys.filter(F.col(n[0]) + F.col(n[1]) > _least(order)).select("key", *n))
        ctx = ctx.filter(F.col(f"{fit}_most") > _least(order))
        ctx_found, sums = _sorted_table(ctx.select("key", *n, *[f"{c}_kinds" for c in n]))
        got = _tables(found, counts, ctx_found, sums[:, :2], sums[:, 2:])
        grams.append(got[0])
        contexts.append(got[1])
    return Model(grams, contexts)


def _sorted_table(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The keys in order, and the other columns as a matrix in that order."""
    table = rows.toArrow()  # bounded by the sample
    keys = table.column("key").to_numpy()
    order = np.argsort(keys, kind="stable")
    out = np.empty((len(keys), table.num_columns - 1))
    for i in range(out.shape[1]):
        out[:, i] = table.column(i + 1).to_numpy()[order]
    return keys[order], out


class Scorer:
    """Log evidence of whole texts, each distinct word looked at once."""

    def __init__(self, model: Model, kept: int = KEPT):
        self.model, self.kept = model, kept
        self.known, self.value = np.zeros(0, np.uint64), np.zeros(0)

    def log_evidence(self, column: pa.Array, levels: tuple[float, ...]) -> Iterator[np.ndarray]:
        """(rows, levels): logarithm of the evidence by word; a text without words has none."""
        for words in _lowered_runs(column):
            hashes, first, place = np.unique(words.hashes(), return_index=True, return_inverse=True)
            if len(self.known) + len(hashes) > self.kept:
                self.known, self.value = np.zeros(0, np.uint64), np.zeros(0)
            at = np.searchsorted(self.known, hashes)
            new = at == len(self.known)
            new[~new] = self.known[at[~new]] != hashes[~new]
            if new.any():
                value = self._of_words(words.data, words.begin[first[new]], words.end[first[new]])
                known = np.concatenate([self.known, hashes[new]])
                order = np.argsort(known, kind="stable")
                self.known, self.value = known[order], np.concatenate([self.value, value])[order]
                at = np.searchsorted(self.known, hashes)
            value = self.value[at][place]
            n = np.maximum(np.bincount(words.row, minlength=words.rows), 1)
            sums = [np.bincount(words.row, np.maximum(value - x, 0), words.rows) for x in levels]
            out = np.log(FLOOR + np.stack(sums, axis=1) / n[:, None])
            del words, hashes, first, place, at, new, value, n, sums
            give_back()
            yield out


    def _of_words(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.empty(len(begin))
        for low in range(0, len(begin), TOGETHER):
            some = slice(low, low + TOGETHER)
            codes, word = word_codes(data, begin[some], end[some])
            out[some] = np.bincount(word, self.model.evidence(codes), len(out[some]))
        return out


def scorer_of(model: Model) -> Scorer:
    """The worker's scorer for the model; one is kept."""
    return kept(("scorer", model.name), lambda: Scorer(model))


def _lowered_runs(column: pa.Array) -> Iterator[Words]:
    """Words in lower case, of some rows at a time: no copy of the whole column is made."""
    for first, _, offsets in text_runs(column, CHUNK):
        some = column.slice(first, len(offsets) - 1).cast(pa.large_string())
        for words in word_runs(pc.utf8_lower(some), chunk=2 * CHUNK):
            words.first += first
            yield words


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton's method with a small ridge."""
    if len(x) == 0 or y.min() == y.max():
        return 1.0, 0.0
    scale = max(float(np.abs(x).mean()), 1e-9)
    a = np.stack([x / scale, np.ones(len(x))], axis=1)
    w, ridge = np.zeros(2), 1e-3 * np.eye(2) * weight.sum() / max(len(x), 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        slope = a.T @ (weight * (p - y)) + ridge @ w
        bend = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge
        step = np.linalg.solve(bend, slope)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
    return float(w[0] / scale), float(w[1])


def _sampled(docs: DataFrame, labels: DataFrame, training: Column, sample: int) -> DataFrame:
    """Text, class and part (counts or curve) of the training sample."""
    marked = labels.select(F.col("doc_id").alias("key"), F.col("toxic").cast("int").alias("toxic"))
    marked = marked.filter("key is not null and toxic in (0, 1)").groupBy("key").agg(
        F.max("toxic").alias("toxic")
    )
    key = F.xxhash64("key")
    of_class = [
        marked.filter(F.col("toxic") == y)
        .join(docs.filter(training).select(F.col("doc_id").alias("key")), "key", "left_semi")
        .orderBy(key, "key").limit(sample)
        for y in (0, 1)
    ]
    chosen = cut_lineage(of_class[0].unionByName(of_class[1]).withColumn("part", F.pmod(key, F.lit(CALIBRATION))))
    # At most 2 * sample rows.
    return docs.join(F.broadcast(chosen), docs["doc_id"] == chosen["key"]).select("text", "toxic", "part")


def train(docs: DataFrame, labels: DataFrame, training: Column, sample: int = SAMPLE) -> Model:
    """The two models and the curve, from documents (doc_id, text) that satisfy `training`.

    Without labelled documents of both classes every score is 0.5 or less.
    """
    rows = cut_lineage(_sampled(docs, labels, training, sample))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            give_back()
            toxic, part = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            for words in _lowered_runs(batch.column(0)):
                _, first, place = np.unique(words.hashes(), return_index=True, return_inverse=True)
                row = words.first + words.row
                of, left = toxic[row], part[row] != 0
                kinds = [of == 0, of == 1, (of == 0) & left, (of == 1) & left]
                n = [np.bincount(place, x, len(first)) for x in kinds]
                codes, word = word_codes(words.data, words.begin[first], words.end[first])
                keys, sums = _sum_by(codes, *[x[word] for x in n])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), *[pa.array(x.astype(np.int64)) for x in sums]], ["code", *names]
                )

    # Fit "n" is of the whole sample, fit "m" of what is not left to the curve.
    names = ("n0", "n1", "m0", "m1")
    counted = rows.select("text", "toxic", "part").mapInArrow(count, ", ".join(f"{x} long" for x in ("code", *names)))
    counted = cut_lineage(counted.groupBy("code").agg(*[F.sum(x).alias(x) for x in names]))
    there = counted.agg(*[F.max(x).alias(x) for x in names]).first()
    if not all(there[x] for x in names):
        return Model([], [], slope=0.0)
    orders = count_orders(counted, ("n", "m"))
    held = rows.sparkSession.sparkContext.broadcast(fit_counted(orders, "m"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(held.value)
        for batch in batches:
            first = 0
            for x in scorer.log_evidence(batch.column(0), NOISE):
                xs = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NOISE))
                y = batch.column(1).slice(first, len(x))
                yield pa.RecordBatch.from_arrays([xs.cast(pa.list_(pa.float64())), y], ["x", "y"])
                first += len(x)

    seen = rows.filter("part = 0").select("text", "toxic").mapInArrow(look, "x array<double>, y int")
    seen = seen.toArrow()  # bounded by the sample
    x = np.array(seen.column("x").to_pylist()).reshape(-1, len(NOISE))
    y = seen.column("y").to_numpy().astype(float)
    # The sample's shares of the classes are not the corpus's.
    toxic = max(1, int(y.sum()))
    weight = np.where(y == 1, PRIOR / toxic, (1 - PRIOR) / max(1, len(y) - toxic)) * len(y)
    curves = [(*fit_curve(x[:, i], y, weight), level) for i, level in enumerate(NOISE)]
    loss = [_loss(slope * x[:, i] + offset, y, weight) for i, (slope, offset, _) in enumerate(curves)]
    held.destroy()
    model = fit_counted(orders, "n")
    model.slope, model.offset, model.noise = curves[int(np.argmin(loss))]
    return model


def _loss(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    return float((weight * (np.logaddexp(0, z) - y * z)).sum())


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The columns of `docs` (whose second is the text) with score and predicted behind them."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType(docs.schema.fields[:]).add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, fitted = scorer_of(held.value), held.value
        for batch in batches:
            found = [np.zeros(0)]
            if fitted.grams:
                found += (x[:, 0] for x in scorer.log_evidence(batch.column(1), (fitted.noise,)))
            else:
                found.append(np.full(batch.num_rows, np.log(FLOOR)))
            x = np.concatenate(found)
            p = 1 / (1 + np.exp(-np.clip(fitted.slope * x + fitted.offset, -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                [*batch.schema.names, "score", "predicted"],
            )

    return docs.mapInArrow(run, schema)


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether crc32(id as text) mod `folds` is `fold`; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % folds == fold


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample: int = SAMPLE,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted.

    Scores lie between 0 and 1 and follow from the text alone; a null text counts as empty. Labels
    are learnt from rows that are not held out; null ids or labels other than 0 and 1 teach
    nothing, of an id that is labelled both ways the toxic label counts. Rows that repeat an id are
    scored each. An empty table gives no rows; other columns are not looked at.
    """
    own = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")
    )
    model = train(own, labels, ~held_out(F.col("doc_id")), sample)
    return score(own, model, threshold).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )
