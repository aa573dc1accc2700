"""Runs against a plain search, on odd texts and by hand; the query against the words it stands for."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import docs_frame, documents, plain_words
from tickloom.llm import periodic
from tickloom.llm.queries import op13_periodic_runs


def plain_runs(words):
    """(start, length, period) by the definition."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            s, e = i, j + q
            smaller = any(words[s : e - p] == words[s + p : e] for p in range(1, q))
            if j > i and e - s >= max(6, 4 * q) and not smaller:
                out.append((s, e - s, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone).decode()


def texts_with_repeats(seed, n):
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        letters = rng.choice(["a", "ab", "abc", "abcdefghij"])
        words = [rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 6, 7, 8, 9, 30, 150]))]
        for _ in range(rng.randint(0, 4)):
            a = rng.randrange(len(words) + 1)
            words[a:a] = words[a : a + rng.randint(1, 12)] * rng.randint(2, 6)
        texts.append(rng.choice([" ", "\n", " \t "]).join(words))
    texts += [rng.choice(texts) for _ in range(n // 4)]
    return texts + [None, "", " \n", "é " * 9, "x" * 4000, "  " * 7]


@pytest.mark.parametrize("seed", range(4))
def test_runs_and_collapsed_texts(spark, seed):
    texts = texts_with_repeats(seed, 150)
    rows = [(None if i % 50 == 7 else i // 2, t) for i, t in enumerate(texts)]
    got = periodic.periodic_runs(docs_frame(spark, rows)).collect()
    want = []
    for i, t in rows:
        words = plain_words(t)
        runs = plain_runs(words)
        want.append((str(i), len(words), runs, plain_collapsed(words, runs)))
    found = [(str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got]
    assert sorted(found) == sorted(want)


def ids_of(text):
    words = text.split()
    codes = {w: k for k, w in enumerate(dict.fromkeys(words))}
    return np.array([codes[w] for w in words], np.int64), len(codes)


def test_grammar_derives_the_text():
    rng = random.Random(9)
    ids, k = ids_of(" ".join(rng.choice("abcd") for _ in range(3000)) + " a b" * 500)
    row = np.sort(np.array([rng.randrange(5) for _ in ids]))
    g = periodic.re_pair(ids, row, k)
    assert len(g.left) and len(g.symbols) < len(ids) / 3

    def derive(x):
        return [x] if x < g.words else derive(g.left[x - g.words]) + derive(g.right[x - g.words])

    assert [w for x in g.symbols for w in derive(x)] == ids.tolist()
    for i in range(len(g.left)):
        x = i + g.words
        assert derive(x) == ids[g.first[i] : g.first[i] + g.length[x]].tolist()
    ends = g.at + g.length[g.symbols]
    assert (row[g.at] == row[ends - 1]).all()  # no symbol reaches over two texts


def test_a_wrong_hash_changes_nothing(monkeypatch):
    """With comparisons by hash that always say yes, the check word by word finds the truth."""
    rng = random.Random(2)
    text = " ".join(rng.choice("ab") for _ in range(60)) + " c d e" * 6 + " f" * 9
    ids, k = ids_of(text)
    row, cut = np.zeros(len(ids), np.int64), np.array([0, len(ids)])
    right = [x.tolist() for x in periodic.runs_of(ids, row, cut, k)]
    monkeypatch.setattr(periodic.Text, "alike", lambda self, i, q, n: np.ones(len(i), bool))
    assert [x.tolist() for x in periodic.runs_of(ids, row, cut, k)] == right
    assert right[2] and plain_runs(text.split()) == [(s, e - s, q) for s, e, q in zip(*right)]


def test_long_words_that_differ_late():
    """Words are told apart by their bytes: two of 1,024 letters that a hash mod 2^64 takes for one."""
    thue = "a"
    while len(thue) < 1024:
        thue += thue.translate(str.maketrans("ab", "ba"))
    other = thue.translate(str.maketrans("ab", "ba"))
    for words in ([thue, other] * 5, [thue] * 3 + [other] * 3):
        ((n, runs, _),) = [tuple(c.to_pylist()[0] for c in periodic._rows(w)) for w in periodic.word_runs(pa.array([" ".join(words)]))]
        assert n == len(words) and [(r["start"], r["length"], r["period"]) for r in runs] == plain_runs(words)


def test_texts_of_some_megabytes():
    for text, runs in (("a " * 700_000, [(0, 700_000, 1)]), ("a b c " * 300_000 + "a", [(0, 900_001, 3)])):
        (words,) = periodic.word_runs(pa.array([text]))
        n, found, collapsed = periodic._rows(words)
        assert [(r["start"], r["length"], r["period"]) for r in found[0].as_py()] == runs
        assert collapsed[0].as_py().decode().split() == text.split()[: runs[0][2]]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, runs string")
    assert periodic.periodic_runs(empty).collect() == []


def test_query(spark, tmp_path):
    rows = documents(150, seed=8)
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    spark.createDataFrame([(i, t, "x", "y", 0) for i, t in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    altered = 0
    for i, text in rows:
        words, h = plain_words(text), zlib.crc32(str(i).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            altered += 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (j - a) % p] for j in range(a, n)]
        runs, r = plain_runs(words), got[i]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        shape = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *shape)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(plain_collapsed(words, runs).encode()).hexdigest()
    assert altered > 5
