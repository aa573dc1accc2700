"""Links and components against all pairs, and distances against the coded vectors themselves."""

import numpy as np

from tests.llm.helpers import smallest_reachable
from tickloom.llm import quantised as q

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, node string"


def plain(rows, least=0.9):
    width = max((len(v) for _, v in rows if v), default=0)
    good = {}
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.pad(np.array(v, float), (0, width - len(v)))
            good[k] = x / np.linalg.norm(x)
    near = [(a, b) for a in good for b in good if a < b and good[a] @ good[b] >= least]
    return near


def made(seed=0, n=400):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((40, 64)).astype(np.float32)
    rows = []
    for i in range(n):
        v = base[rng.integers(0, 40)] + rng.choice([0, 0.05, 0.3, 1.0]) * rng.standard_normal(64)
        rows.append((i * 2, [float(np.float32(x)) for x in v]))
    rows += [(5001 + i, rows[0][1]) for i in range(30)]
    rows += [(9001, None), (9002, []), (9003, [0.0] * 64), (9004, [float("nan")] * 64), (9005, [None] * 64)]
    rows += [(9006, [float("inf")] + [1.0] * 63), (9007, [1e30] * 64), (9008, [1e-30] * 64), (9009, [2.0])]
    rows += [(9010, [3.0]), (9011, [x * 7 for x in rows[3][1]])]
    return rows


def test_links_and_components(spark, monkeypatch):
    monkeypatch.setattr(q, "CHUNK", 37)
    rows = made()
    wide = [(i, v, 0, "x") for i, v in rows]
    got = {r.vec_id: r for r in q.near_vectors(spark.createDataFrame(wide, SCHEMA).repartition(3)).collect()}
    near = plain([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])
    label = smallest_reachable(range(len(rows)), near)
    degree = np.bincount(np.array(near).ravel(), minlength=len(rows))
    ids = [i for i, _ in rows]
    for k, (i, _) in enumerate(rows):
        component = min(ids[x] for x in range(len(rows)) if label[x] == label[k])
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (degree[k], component, component == i)
    assert degree.max() > 30


def test_recall_on_the_given_vectors(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    degree = np.bincount(np.array(plain(rows), int).reshape(-1, 2).ravel(), minlength=len(rows))
    got = {r.vec_id: r.n_links for r in q.near_vectors(table).collect()}
    found = sum(min(got[i], degree[k]) for k, (i, _) in enumerate(rows))
    assert found >= 0.99 * degree.sum() and all(got[i] <= degree[k] for k, (i, _) in enumerate(rows))


def test_missing_ids_and_empty_table(spark):
    v, w = [1.0, 2.0], [2.0, -1.0]
    rows = [(None, v, 0, ""), (None, v, 0, ""), (7, w, 0, ""), (7, w, 0, ""), (None, None, 0, "")]
    got = q.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(
        str(x) for x in [(None, 1, None, True)] * 2 + [(7, 1, 7, True)] * 2 + [(None, 0, None, True)]
    )
    assert q.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_table_lookups_are_distances_to_coded_vectors():
    rng = np.random.default_rng(3)
    unit = q._unit(rng.standard_normal((600, 20)))
    index = q.fit(unit, 4)
    unit = index.padded(unit)
    lists = (unit @ index.centroids.T).argmax(axis=1)
    mine = np.flatnonzero(lists == 2)
    codes, error = index.encode(unit[mine], lists[mine])
    coded = index.centroids[2] + np.concatenate([index.words[m][codes[:, m]] for m in range(8)], axis=1)
    far = index.distances(unit[:50], 2, codes)
    assert np.allclose(far, np.linalg.norm(unit[:50, None] - coded[None], axis=2))
    assert np.allclose(error, np.linalg.norm(unit[mine] - coded, axis=1))
