"""Removed words against a plain search for earlier windows."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import docs_frame, documents, plain_words
from tickloom.llm import blocks, debruijn, words
from tickloom.llm.debruijn import substring_dedup


def plain(rows, window):
    """Per row: words, words that stay."""
    last = 2**63 - 1
    texts = [(last if i is None else i, plain_words(t)) for i, t in rows]
    first = {}
    for i, ws in texts:
        for s in range(len(ws) - window + 1):
            k = tuple(ws[s : s + window])
            first[k] = min(first.get(k, last), i)
    out = []
    for i, ws in texts:
        seen, gone = set(), set()
        for s in range(len(ws) - window + 1):
            k = tuple(ws[s : s + window])
            if first[k] < i or k in seen:
                gone.update(range(s, s + window))
            seen.add(k)
        out.append((len(ws), len(gone), b" ".join(w for j, w in enumerate(ws) if j not in gone).decode()))
    return out


def passages(seed):
    """Shared stretches that overlap in all ways, loops within texts, and one-word alphabets."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(50)}" for _ in range(300)]
    rows = []
    for i in range(60):
        ws = []
        for _ in range(rng.randint(0, 5)):
            a = rng.randrange(260)
            ws += base[a : a + rng.randint(1, 60)]
            ws += [f"u{rng.randrange(9)}" for _ in range(rng.randint(0, 6))]
        rows.append((i, "  ".join(ws)))
    rows += [(100, "a " * 90), (101, "a " * 30), (102, "a b " * 40), (103, "b a " * 40)]
    rows += [(104, None), (105, ""), (105, rows[3][1]), (None, rows[4][1]), (None, rows[5][1]), (3, rows[6][1])]
    return rows


@pytest.mark.parametrize("window,anchor", [(20, 8), (5, 2), (4, 4)])
@pytest.mark.parametrize("size", [300, 4 << 20])
def test_removed_words(spark, monkeypatch, window, anchor, size):
    monkeypatch.setattr(blocks.write_blocks, "__defaults__", (size,))
    for rows in (passages(window), documents()):
        out = substring_dedup(docs_frame(spark, rows), window, anchor).collect()
        got = [(r.doc_id, r.text, r.n_words, r.n_removed, r.kept_text) for r in out]
        want = [(i, t, *x) for (i, t), x in zip(rows, plain(rows, window))]
        assert sorted(map(str, got)) == sorted(map(str, want))
        for r in out:
            assert sum(s.n_words for s in r.spans) == r.n_removed
            gone = {s.start + k for s in r.spans for k in range(s.n_words)}
            ws = plain_words(r.text)
            assert r.kept_text == b" ".join(w for j, w in enumerate(ws) if j not in gone).decode()
            assert r.rest.c1 == "src"


def test_empty_table(spark):
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_words_that_differ_by_a_rule_are_different(spark):
    from tests.llm.test_hyperminhash import thue_morse

    one, other = thue_morse()
    rows = [(1, " ".join([one] * 20)), (2, " ".join([other] * 20)), (3, " ".join([one] * 20))]
    got = {r.doc_id: r.n_removed for r in substring_dedup(docs_frame(spark, rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 20}


NONE = np.zeros(0, np.int64)


def block_of(rows):
    ids, texts = zip(*rows)
    rest = pa.array([{"c0": i} for i in range(len(rows))])
    return pa.record_batch([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), rest], ["doc_id", "text", "rest"])


@pytest.mark.parametrize("chunk", [1, 300, 1 << 20])
def test_parts_of_a_block_know_of_each_other(monkeypatch, chunk):
    monkeypatch.setattr(debruijn, "CHUNK", chunk)
    for window, anchor in ((20, 8), (5, 2)):
        rows = passages(window)
        block = block_of(rows)
        out = pa.Table.from_batches(list(debruijn._kept(block, window, anchor, NONE, NONE, NONE, NONE, NONE)))
        got = list(zip(*(out.column(c).to_pylist() for c in ("doc_id", "text", "n_words", "n_removed", "kept_text"))))
        assert got == [(i, t, *x) for (i, t), x in zip(rows, plain(rows, window))]
        assert [x["c0"] for x in out.column("rest").to_pylist()] == list(range(len(rows)))
        found = [debruijn._extremes(w.hash, (w.doc[w.of_row],), debruijn.EDGE) for w in debruijn.parts_of(block, window, anchor)]
        edges, (first,) = debruijn._together(found, debruijn.EDGE)
        assert np.all(edges[1:] > edges[:-1])
        least = {}
        for i, t in rows:
            ws = plain_words(t)
            for s in range(len(ws) - window + 1):
                k = tuple(ws[s : s + window])
                least[k] = min(least.get(k, debruijn.LAST), debruijn.LAST if i is None else i)
        assert sorted(least.values()) == sorted(first.tolist())


def test_a_worker_looks_at_a_part_of_a_block():
    """Four megabytes of words of seven bytes, each document new but for a passage."""
    rng = random.Random(8)
    passage = " ".join(f"p{k:05d}" for k in range(40))
    rows = [(i, " ".join(f"{rng.randrange(10**6):06d}" for _ in range(560)) + " " + passage) for i in range(1000)]
    block = block_of(rows)
    peaks = []
    for work in (
        lambda: [len(w.head) for w in debruijn.parts_of(block, 20, 8)],
        lambda: sum(x.column("n_removed").to_numpy().sum() for x in debruijn._kept(block, 20, 8, NONE, NONE, NONE, NONE, NONE)),
    ):
        work()
        tracemalloc.start()
        got = work()
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert got == 999 * 40
    assert peaks[0] < 45 << 20 and peaks[1] < 90 << 20


class Held:
    """What other stages keep; it says when it goes."""

    alive = 0

    def __init__(self):
        Held.alive += 1

    def __del__(self):
        Held.alive -= 1


def test_blocks_end_what_other_stages_keep():
    one = words.kept("one", Held)
    assert words.kept("one", Held) is one and Held.alive == 1
    del one
    words.kept("two", Held)
    assert list(words._kept) == ["two"] and Held.alive == 1
    assert list(debruijn._blocks(iter([]))) == []
    assert words._kept == {} and Held.alive == 0
