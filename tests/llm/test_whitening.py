"""Whitening against NumPy over all rows at once, and what becomes of odd vectors."""

from collections import Counter

import numpy as np
import pytest

from tickloom.llm import whitening
from tickloom.llm.queries import op12_whitening
from tickloom.llm.whitening import whiten


def usable(v):
    return v is not None and all(c is not None and np.isfinite(c) for c in v)


def plain(vectors, weights="one"):
    """Per usable vector: its whole numbers; and n, sums, covariance of the fit list."""
    d = max([len(v) for v in vectors if usable(v)] + [1])
    whole = {i: tuple(np.floor(256 * np.array(list(v) + [0.0] * (d - len(v)))).astype(int).tolist()) for i, v in enumerate(vectors) if usable(v)}
    times = Counter(whole.values())
    fit = [x for x, k in times.items() for _ in range(k if weights == "counts" else 1)]
    x = np.array(fit, float).reshape(-1, d)
    centred = x - x.mean(axis=0) if len(x) else x
    sums = [sum(column) for column in zip(*fit)]
    return whole, times, len(fit), sums, centred.T @ centred / max(len(fit), 1)


def check(rows, vectors, weights="one", most=4):
    whole, times, n, sums, cov = plain(vectors, weights)
    assert sorted(r.vec_id for r in rows) == sorted(whole)
    if not rows:
        return
    values, directions = np.linalg.eigh(cov)
    values, directions = values[::-1], directions.T[::-1]
    count = min(most, int((values > max(values[0], 0) * 1e-12).sum()))
    for r in rows:
        x = whole[r.vec_id]
        assert (r.n, r.times) == (n, times[x])
        assert r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums))
        assert len(r.whitened) == len(r.explained) == count
        np.testing.assert_allclose(r.explained, values[:count] / np.trace(cov), rtol=1e-9)
        assert r.identity_error < 1e-8
    got = np.array([r.whitened for r in rows]).reshape(len(rows), -1)
    want = np.array([(np.array(whole[r.vec_id]) - np.array(sums) / n) @ directions[:count].T for r in rows])
    want /= np.sqrt(values[:count])
    signs = np.sign((got * want).sum(axis=0))
    np.testing.assert_allclose(got, want * signs, atol=1e-6)


def frame(spark, vectors):
    rows = [(i, v, 1, "k", 2.0) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, times long, key string, n double").repartition(3)


def cloud(n=300, d=6, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * np.arange(1, d + 1) + rng.normal(size=d)
    out = [v.tolist() for v in x]
    out += [out[3]] * (n // 2)  # a third of all rows are one vector
    return out + [out[5]] * 7


@pytest.mark.parametrize("weights", ["one", "counts"])
def test_agrees_with_numpy(spark, weights):
    vectors = cloud()
    check(whiten(frame(spark, vectors), components=4, weights=weights).collect(), vectors, weights)


def test_odd_vectors(spark):
    vectors = cloud(60) + [
        None, [], [1.0], [0.0] * 6, [1.0, 0.0], [float("nan")] * 6, [1.0, None, 2.0], [float("inf"), 1.0],
        [-0.0, 1e-9, -1e-9, 0.5, 0.25, 255.99], [3e4, -3e4, 1.0],
    ]
    rows = whiten(frame(spark, vectors), components=4).collect()
    check(rows, vectors)
    same = {r.vec_id: r for r in rows}
    short, padded = vectors.index([1.0]), vectors.index([1.0, 0.0])
    assert same[short].whitened == same[padded].whitened and same[short].times == 2


@pytest.mark.parametrize(
    "vectors", [[], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [[]], [[1.0, 0.0], [2.0, 0.0], [5.0, 0.0]]]
)
def test_few_vectors(spark, vectors):
    source = frame(spark, vectors) if vectors else spark.createDataFrame([], "vec_id long, embedding array<float>")
    check(whiten(source).collect(), vectors)


def test_entries_beyond_longs(spark):
    vectors = [[1e300, 1.0], [-1e300, 2.0], [1e17, 3.0], [0.0, 4.0]]
    rows = whiten(frame(spark, vectors)).collect()
    assert len(rows) == 4 and all(r.deviation is None for r in rows) and all(np.isfinite(r.whitened).all() for r in rows)


def test_sums_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 3)
    monkeypatch.setattr(whitening, "BLOCK", 40)
    vectors = cloud(200, seed=5)
    rows = [(i, v) for i, v in enumerate(vectors)]
    wide = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(11)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        check(whiten(wide, components=4).collect(), vectors)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_packed_keys():
    rng = np.random.default_rng(3)
    x = np.vstack([rng.integers(-300, 300, (20, 5)), rng.integers(-(10**6), 10**6, (20, 5)), rng.integers(-(2**62), 2**62, (20, 5))])
    x[::3, 3:] = 0
    keys, used = whitening._pack(x)
    assert (whitening._unpack(keys, 5) == x).all() and used.max() == 5
    assert len(set(keys)) == len({tuple(r) for r in x.tolist()})
    assert whitening._pack(np.hstack([x, x * 0]))[0] == keys


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    source = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    by_row = {}
    for r in op12_whitening(spark, folder).collect():
        by_row.setdefault(r.vec_id, {})[r.component] = r
    vectors = {r.vec_id: [float(c) for c in r.embedding] for r in source}
    ids = sorted(vectors)
    whole, _, n, sums, cov = plain([vectors[i] for i in ids])
    values, directions = np.linalg.eigh(cov)
    assert sorted(by_row) == ids
    for k, i in enumerate(ids):
        assert sorted(by_row[i]) == [1, 2, 3, 4]
        for c, r in by_row[i].items():
            want = (np.array(whole[k]) - np.array(sums) / n) @ directions[:, -c] / np.sqrt(values[-c])
            assert abs(abs(r.whitened) - abs(want)) < 1e-6 and r.n == n
            assert abs(r.explained - values[-c] / np.trace(cov)) < 1e-9
            assert r.deviation == sum((n * a - s) ** 2 for a, s in zip(whole[k], sums))
