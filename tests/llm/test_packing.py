"""Pieces against the tokenizer itself, and sequences against what packing must keep."""

import subprocess
import sys
import weakref
import zlib
from collections import defaultdict

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.helpers import docs_frame, documents
from tickloom.llm import byte_bpe as bpe
from tickloom.llm import words
from tickloom.llm.byte_bpe import ByteBpe, byte_bpe
from tickloom.llm.packing import pack, plan_packing
from tickloom.llm.words import text_runs
import pyarrow as pa

PATH = public_tokenizers.path("byte_bpe_50k.json")
STRANGE = [
    "", None, " ", "  lead", "trail  ", "a  b", "a  b", "é à ï ß x", "  x 　 y  z",
    "don't we'll x's", "1 22 333", "tabs\t and\n\n new  lines ", "\u0085 q", "<|endoftext|> a", "日本 語 。 x",
    "\x1c a \x1f b", "a\x00 b", "🙂 🙂🙂 x",
]


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(PATH)
    found.encode_special_tokens = True
    return found


def test_parts_encode_as_whole_texts(tokenizer):
    texts = STRANGE * 2 + [t for _, t in documents()]
    for kept in (400_000, 50):
        encoder = ByteBpe(PATH, kept)
        for first, data, offsets in text_runs(pa.array(texts), 3000):
            ids, at = encoder.encode(data, offsets)
            for i in range(len(offsets) - 1):
                want = tokenizer.encode(texts[first + i] or "", add_special_tokens=False).ids
                assert ids[at[i] : at[i + 1]].tolist() == want
                assert encoder.n_bytes[want].sum() == offsets[i + 1] - offsets[i]


def test_line_ends_before_letters(tokenizer):
    texts = ["a\n\nb", "one.\n\n\n\nTwo", "\n\nb", "a \n\nb", "a\r\n\r\nb", "a\n \nb", "x\u3000\nb\n\n", "\n", "1\n\n\n2\nc"]
    encoder = ByteBpe(PATH)
    for first, data, offsets in text_runs(pa.array([*texts, "\n\n".join(texts)])):
        ids, at = encoder.encode(data, offsets)
        for i, text in enumerate([*texts, "\n\n".join(texts)]):
            assert ids[at[i] : at[i + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_a_full_store_keeps_what_is_met_again(tokenizer):
    common = [f" common{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(100)]
    encoder, seen = ByteBpe(PATH, 400), []
    fresh = encoder.fresh

    def looked_at(data, begin, end):
        seen.extend(data[b:e].tobytes().decode() for b, e in zip(begin, end))
        return fresh(data, begin, end)

    encoder.fresh = looked_at
    for run in range(30):
        once = [f" once{chr(97 + run % 26)}{chr(97 + run // 26)}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(50)]
        text = "".join(common + once)
        _, data, offsets = next(text_runs(pa.array([text])))
        ids, _ = encoder.encode(data, offsets)
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert len(encoder.known) <= 400
    assert sum(x.startswith(" common") for x in seen) == 100
    assert sum(x.startswith(" once") for x in seen) == 30 * 50


def test_parts_encoded_in_stretches(tokenizer, monkeypatch):
    texts = STRANGE * 2 + [t for _, t in documents()]
    for stretch in (1, 7, 100):
        monkeypatch.setattr(bpe, "STRETCH", stretch)
        encoder = ByteBpe(PATH)
        for first, data, offsets in text_runs(pa.array(texts)):
            ids, at = encoder.encode(data, offsets)
            for i in range(len(offsets) - 1):
                want = tokenizer.encode(texts[first + i] or "", add_special_tokens=False).ids
                assert ids[at[i] : at[i + 1]].tolist() == want


def test_pack(spark, tokenizer):
    rows = documents(200) + [(None, "no id here"), (7, "seven again"), (7, "seven again")]
    size = 64
    out = pack(docs_frame(spark, rows), PATH, size=size, with_ids=True).collect()
    want = []
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        head = (len(ids) - 1) % size + 1
        cuts = [0, *range(head, len(ids) + 1, size)]
        for piece, (b, e) in enumerate(zip(cuts, cuts[1:])):
            crc = zlib.crc32(np.array(ids[b:e], "<u4").tobytes())
            want.append((i, piece, b, e - b, crc, ids[b:e]))
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.ids) for r in out]
    assert sorted(map(str, got)) == sorted(map(str, want))
    check_sequences([(r.sequence_id, r.offset, r.length) for r in out], size)


def check_sequences(pieces, size):
    """Gapless and no longer than `size`; returns how many."""
    by = defaultdict(list)
    for sequence, offset, length in pieces:
        by[sequence].append((offset, length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_plan_comes_close_to_the_bound():
    rng = np.random.default_rng(5)
    counts = np.bincount(np.clip(rng.lognormal(5.5, 1, 50_000).astype(int), 1, 1024), minlength=1025)
    plan = plan_packing(counts)
    length = np.repeat(np.arange(1025), counts)
    rank = np.concatenate([np.arange(n) for n in counts])
    sequence, offset = plan.place(length, rank)
    n = check_sequences(zip(sequence.tolist(), offset.tolist(), length.tolist()), 1024)
    assert n == plan.sequences
    assert n <= 1.01 * np.ceil((counts * np.arange(1025)).sum() / 1024)


def test_empty_table_and_tiny_plans(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pack(empty, PATH).collect() == []
    for counts in ([0, 5], [0, 0, 0, 0, 1], [0, 3, 1, 0, 0, 0, 2]):
        plan = plan_packing(np.array(counts))
        length = np.repeat(np.arange(len(counts)), counts)
        rank = np.concatenate([np.arange(n) for n in counts])
        sequence, offset = plan.place(length, rank)
        check_sequences(zip(sequence.tolist(), offset.tolist(), length.tolist()), len(counts) - 1)


def test_a_worker_keeps_one_thing():
    one = byte_bpe(PATH)
    assert byte_bpe(PATH) is one
    gone = weakref.ref(one)
    del one
    words.let_go()
    assert gone() is None


def test_a_worker_s_encoder_starts_no_threads():
    code = f"""
import os
import numpy as np
from tickloom.llm.byte_bpe import byte_bpe
os.environ.pop("TOKENIZERS_PARALLELISM", None)
encoder = byte_bpe({PATH!r})
before = len(os.listdir("/proc/self/task"))
data = np.frombuffer("".join(f" w{{i}} é{{i}}" for i in range(9000)).encode(), np.uint8)
encoder.encode(data, np.array([0, len(data)]))
assert len(os.listdir("/proc/self/task")) == before
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=100)
