"""Held-out accuracy on the given tables and on made texts, and Kneser-Ney sums to one."""

import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa

from tests.llm.helpers import ODD, docs_frame
from tickloom.llm import toxicity as t


def made(n=400, seed=2):
    rng = random.Random(seed)
    calm = ["".join(rng.choices("abdeghilmnorst", k=rng.randint(2, 8))) for _ in range(500)]
    bad = ["vex" + "".join(rng.choices("aeiou", k=rng.randint(1, 3))) for _ in range(30)] + ["grob", "fies"]
    rows, labels = [], []
    for i in range(n):
        ws, toxic = rng.choices(calm, k=rng.randint(10, 120)), rng.random() < 0.4
        for _ in range(max(2, len(ws) // 30) if toxic else 0):
            ws.insert(rng.randrange(len(ws)), rng.choice(bad))
        rows.append((i, " ".join(ws)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = made()
    odd = [(1000 + i, text) for i, text in enumerate(ODD)] + [(None, "nobody"), (3, rows[3][1])]
    extra = [(None, 1, 1), (2000, 1, 1), (5, 1, None), (6, 1, 7)]
    table = spark.createDataFrame(labels + extra, "doc_id long, quality int, toxic int")
    out = t.toxicity(docs_frame(spark, rows + odd), table).collect()
    assert len(out) == len(rows) + len(odd)
    toxic = {i: y for i, _, y in labels}
    right = []
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (zlib.crc32(str("null" if r.doc_id is None else r.doc_id).encode()) % 3 == 1)
        if r.held_out and r.doc_id in toxic:
            right.append(r.predicted == toxic[r.doc_id])
    assert len(right) > 80 and np.mean(right) > 0.95
    blank = {1000 + i for i, text in enumerate(ODD) if not (text or "").strip()}
    assert len(blank) == 3 and all(r.predicted == 0 for r in out if r.doc_id in blank)


def test_probabilities_sum_to_one():
    words = [b"abc", b"abd", b"b", b"cab"]
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    codes, word = t.word_codes(data, end - [len(w) for w in words], end)
    assert np.bincount(word).tolist() == [4, 4, 2, 4]
    keys, (a, b) = t._sum_by(codes, np.ones(len(codes)), np.arange(len(codes)) * 1.0)
    model = t.fit_model(keys, a, b)
    context = codes[2] >> t._BITS << t._BITS  # what comes before the third symbol
    every = context | np.arange(64)
    p = np.full((64, 2), 1 / 64)
    for order, grams, contexts in zip(t.ORDERS[:4], model.grams, model.contexts):
        p = t._looked_up(t.tail(every, order), *grams, 0.0) + p * t._looked_up(
            t.tail(every >> t._BITS, order - 1), *contexts, 1.0
        )
        assert np.allclose(p.sum(axis=0), 1, atol=1e-9)


def test_tables_counted_by_spark(spark):
    rng = np.random.default_rng(3)
    words = [bytes(rng.choice(list(b"abcde\xc3\xa91-"), rng.integers(1, 12)).tolist()) for _ in range(400)]
    data, end = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    codes, _ = t.word_codes(data, end - [len(w) for w in words], end)
    n = rng.integers(0, 3, (len(codes), 2))
    m = n * (rng.random((len(codes), 1)) < 0.7)
    keys, sums = t._sum_by(codes, *n.T, *m.T)
    rows = list(zip(keys.tolist(), *[x.astype(int).tolist() for x in sums]))
    table = spark.createDataFrame(rows, "code long, n0 long, n1 long, m0 long, m1 long").repartition(4)
    orders = t.count_orders(table, ("n", "m"))
    for fit, (a, b) in (("n", sums[:2]), ("m", sums[2:])):
        there = a + b > 0
        want, got = t.fit_model(keys[there], a[there], b[there]), t.fit_counted(orders, fit)
        for have, plain in zip(got.grams + got.contexts, want.grams + want.contexts):
            assert np.array_equal(have[0], plain[0]) and np.allclose(have[1], plain[1], rtol=1e-12)
        assert len(got.grams[-1][0]) < len(keys)


def test_sample_of_each_class():
    assert t.SAMPLE >= 10_000


def test_no_labels_and_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows, labels = made(30)
    assert all(r.predicted == 0 for r in t.toxicity(docs_frame(spark, rows), none).collect())
    empty = spark.createDataFrame([], "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert t.toxicity(empty, table).collect() == []


def test_a_worker_looks_at_few_words_at_a_time(monkeypatch):
    given, back = [], t.give_back
    monkeypatch.setattr(t, "give_back", lambda: given.append(1) or back())
    rng = np.random.default_rng(5)
    size = 120_000
    letters = rng.integers(97, 123, (size, 12), np.uint8)
    letters[:, 9:] = 32
    letters[rng.random(letters.shape) < 0.02] = 32
    texts = pa.array([x.tobytes().decode().title() for x in letters.reshape(300, -1)] + [None, "", "Ünï " * 9])
    keys = np.unique(rng.integers(0, 1 << 60, 3000))
    model = t.fit_model(keys, np.ones(len(keys)), np.arange(len(keys)) % 3.0)
    scorer = t.Scorer(model)
    tracemalloc.start()
    got = np.concatenate(list(scorer.log_evidence(texts, (1.0,))))
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(given) >= 2
    assert len(scorer.known) > 100_000 and most < 90 << 20
    plain = np.concatenate([x for one in texts for x in t.Scorer(model).log_evidence(pa.array([one]), (1.0,))])
    assert np.allclose(got, plain, rtol=1e-12)
