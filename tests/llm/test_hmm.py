"""Recursions against plain loops, and the operator against plain counts and a held-out gain."""

import itertools
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import docs_frame, documents, plain_words
from tickloom.llm import hmm

FOLDER = "/root/testdata/sf0.01"


def small_model(states=3, symbols=5):
    rng = np.random.default_rng(4)
    return hmm.Model(
        rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states),
        rng.dirichlet(np.ones(symbols), states).T.copy(),
    )


def sequences():
    rng = np.random.default_rng(5)
    return [rng.integers(0, 5, n) for n in (1, 6, 2, 4, 4, 1, 5)]


def paths(model, seq):
    for path in itertools.product(range(3), repeat=len(seq)):
        p = model.start[path[0]] * model.emit[seq[0], path[0]]
        for (a, b), s in zip(zip(path, path[1:]), seq[1:]):
            p *= model.move[a, b] * model.emit[s, b]
        yield path, p


def test_likelihood_and_counts_over_all_paths():
    model, seqs = small_model(), sequences()
    lengths, symbols = np.array([len(s) for s in seqs]), np.concatenate(seqs)
    want = [math.log10(sum(p for _, p in paths(model, s))) for s in seqs]
    assert np.allclose(hmm.log10_likelihood(model, symbols, lengths), want)
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for s in seqs:
        total = sum(p for _, p in paths(model, s))
        for path, p in paths(model, s):
            start[path[0]] += p / total
            for a, b in zip(path, path[1:]):
                move[a, b] += p / total
            for x, k in zip(s, path):
                emit[x, k] += p / total
    got = hmm.expected_counts(model, symbols, lengths)
    assert np.allclose(got.start, start) and np.allclose(got.move, move) and np.allclose(got.emit, emit)


def test_long_sequences_do_not_underflow():
    model = small_model()
    symbols = np.random.default_rng(0).integers(0, 5, 30_000)
    whole = hmm.log10_likelihood(model, symbols, np.array([30_000]))
    assert np.isfinite(whole).all() and whole[0] < -10_000


def test_training_raises_likelihood():
    rng = np.random.default_rng(1)
    seqs = [np.repeat(rng.integers(0, 2), 40) * 10 + rng.integers(0, 10, 40) for _ in range(60)]
    lengths, symbols = np.full(60, 40), np.concatenate(seqs)
    shares = np.full(20, 1 / 20)
    model = hmm.first_model(shares, 2)
    seen = [hmm.log10_likelihood(model, symbols, lengths).sum()]
    for _ in range(25):
        model = hmm.maximised(hmm.expected_counts(model, symbols, lengths), shares * 0.01)
        seen.append(hmm.log10_likelihood(model, symbols, lengths).sum())
    assert all(b >= a - 1 for a, b in zip(seen, seen[1:])) and seen[-1] > seen[0] + 500


@pytest.mark.parametrize("size", [2000, 4 << 20])
def test_counts_and_base(spark, size):
    rows = documents(100) + [(None, "no id"), (4, "again four")]
    out_of = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    got = hmm.lm_scores(docs_frame(spark, rows), held, size=size).collect()
    counts = {}
    for i, text in rows:
        if i is None or not out_of(i):
            for w in [*plain_words(text, lower=True), None]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, text in rows:
        ws = [*plain_words(text, lower=True), None]
        base = sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in ws)
        known = sum(w in counts for w in ws)
        want.append((str(i), i is not None and out_of(i), len(ws), known, n, round(base, 6)))
    have = [
        (str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
        for r in got
    ]
    assert sorted(have) == sorted(want)
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)


def test_beats_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    got = hmm.lm_scores(docs, held).filter("held_out").agg(
        F.sum("score"), F.sum("base_score"), F.sum("n_tokens")
    ).first()
    assert got[0] > got[1] + 0.1 * got[2]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert hmm.lm_scores(empty, F.lit(False)).collect() == []
