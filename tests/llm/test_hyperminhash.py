"""Components against all pairs of full sets, and the estimate against the true similarity."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from tests.llm.helpers import docs_frame, documents, plain_words, smallest_reachable
from tickloom.llm import hyperminhash as h
from tickloom.llm.words import word_runs


def plain_sets(rows):
    out = []
    for _, text in rows:
        ws = plain_words(text, lower=True)
        if 0 < len(ws) < 4:
            out.append({tuple(ws)})
        else:
            out.append({tuple(ws[i : i + 4]) for i in range(len(ws) - 3)})
    return out


def test_near_duplicates(spark):
    rows = documents(160, seed=5)
    rows += [(900 + i, " ".join(["base"] * i + [f"w{j}" for j in range(60)])) for i in range(12)]
    rows += [(2, rows[5][1]), (2, "two texts under one id, the other one copied"), (990, rows[-1][1])]
    rows += [(None, "nobody's text is here with words"), (None, "nobody's text is here with words")]
    sets = plain_sets(rows)
    nodes = [10**9 if i is None else i for i, _ in rows]
    links = [
        (nodes[a], nodes[b])
        for a in range(len(rows)) for b in range(a)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    label = smallest_reachable(nodes, links)
    want = sorted(
        str((i, len(s), None if label[n] == 10**9 else label[n], label[n] == n))
        for (i, _), n, s in zip(rows, nodes, sets)
    )
    got = h.near_duplicates(docs_frame(spark, rows)).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in got) == want
    assert len(set(label.values())) < len(set(nodes))


def test_repeated_rows_in_a_cloud(spark):
    rng = random.Random(7)

    def edited(words, n):
        words = list(words)
        for at in rng.sample(range(5, 95), n):
            words[at] = f"e{rng.random()}"
        return words

    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(edited(base, 3))) for i in range(150)]
    for i in range(150, 180, 2):
        one = edited(base, 3)
        other = " ".join(edited(one, 1))
        rows += [(i, " ".join(one))] * 2 + [(i + 1, other), (i + 1, f"another text {i} under the same id")]
    sets = plain_sets(rows)
    links = [
        (rows[a][0], rows[b][0])
        for a in range(len(rows)) for b in range(a)
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    label = smallest_reachable([i for i, _ in rows], links)
    got = h.near_duplicates(docs_frame(spark, rows)).collect()
    assert len(set(label.values())) >= 150
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted((i, label[i]) for i, _ in rows)


def test_masks_leave_room_for_every_link():
    """The bound of the masks is never below what two sets share."""
    rng = random.Random(11)
    for n in (1, 5, 60, 400, 3000):
        base = [f"w{rng.randrange(3 * n)}" for _ in range(n + 3)]
        texts = [" ".join(w if rng.random() > share else f"e{rng.random()}" for w in base) for share in (0, 0.02, 0.05, 0.5)]
        words = next(word_runs(pa.array(texts), chunk=1 << 40))
        row, hashes = h.shingles(words)
        count, masked = h.masks(row, hashes, 4)
        bits = np.unpackbits(masked.view(np.uint8), axis=1).astype(bool)
        assert (bits.sum(axis=1) == count).all()
        sets = [set(hashes[row == r].tolist()) for r in range(4)]
        for a in range(4):
            for b in range(4):
                own = (bits[a] & ~bits[b]).sum()
                assert len(sets[a] & sets[b]) <= len(sets[a]) - own
                assert 2 * own == (bits[a] ^ bits[b]).sum() + count[a] - count[b]


def test_few_pairs_in_a_cloud(spark, monkeypatch):
    """In a cloud of near copies that no pivot links, hardly more pairs are compared than have a link."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(80)]

    def edited():
        words = list(base)
        for at in rng.sample(range(80), 3):
            words[at] = rng.choice(["x", "y", "z"])
        return " ".join(words)

    rows = [(i, edited()) for i in range(300)]
    pairs = []
    confirmed = h._confirmed
    monkeypatch.setattr(h, "_confirmed", lambda tried, *rest: pairs.append(tried.count()) or confirmed(tried, *rest))
    got = h.near_duplicates(docs_frame(spark, rows)).collect()
    sets = plain_sets(rows)
    links = [
        (a, b) for a in range(300) for b in range(a)
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    label = smallest_reachable(range(300), links)
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted(label.items())
    assert pairs[1] < 0.1 * 300 * 299 / 2


def test_estimate_follows_similarity():
    rng = random.Random(1)
    for n in (6, 40, 300, 3000):
        a = [f"a{rng.random()}" for _ in range(n)]
        gaps = []
        for change in (0, 1, n // 10, n // 3, n):
            b = a[: n - change] + [f"b{rng.random()}" for _ in range(change)]
            words = next(word_runs(pa.array([" ".join(a), " ".join(b)]), chunk=1 << 40))
            row, hashes = h.shingles(words)
            sets = [set(hashes[row == r].tolist()) for r in (0, 1)]
            true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
            size = np.array([len(s) for s in sets])
            k = h.size_class(size).max()
            regs = h.registers(row, hashes, 2, h.class_copies(int(k)))
            got = h.estimate(regs[:1], regs[1:], size[:1], size[1:], np.array([k]))[0]
            gaps.append(abs(got - true))
        assert max(gaps) < 0.2


def test_chance_is_that_of_disjoint_sets():
    rng = np.random.default_rng(0)
    hashes = rng.integers(0, 2**64, 2 * 400 * 2048, np.uint64)
    row = np.repeat(np.arange(800), 2048)
    regs = h.registers(row, hashes, 800, 1)
    seen = (regs[:400] == regs[400:]).mean()
    assert abs(seen - h.chance(16.0, 16.0)) < 5e-4


def thue_morse(letters="ab", n=1024):
    word = letters[0]
    while len(word) < n:
        word += word.translate(str.maketrans(letters, letters[::-1]))
    return word, word.translate(str.maketrans(letters, letters[::-1]))


def test_words_that_differ_by_a_rule_are_different(spark):
    """Two words of 1,024 letters that sums by powers of one base, mod 2^64, take for one."""
    one, other = thue_morse()
    got = {r.doc_id: r for r in h.near_duplicates(docs_frame(spark, [(1, one), (2, other), (3, one)])).collect()}
    assert {i: (r.component_id, r.kept) for i, r in got.items()} == {1: (1, True), 2: (2, True), 3: (1, False)}


def test_empty_table(spark):
    assert h.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_registers_hash_few_at_a_time():
    hashes = np.sort(np.random.default_rng(4).integers(0, 2**64, 3000, np.uint64))
    row = np.repeat(np.arange(1000), 3)
    tracemalloc.start()
    got = h.registers(row, hashes, 1000, 1024)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 24 << 20
    assert all(np.array_equal(got[i], h.registers(np.zeros(3, int), hashes[3 * i : 3 * i + 3], 1, 1024)[0]) for i in (0, 7, 999))
