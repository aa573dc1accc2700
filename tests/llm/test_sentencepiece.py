"""Ids and texts against the library, the shortest path against plain merging."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece

from tests.llm.helpers import docs_frame, documents
from tickloom.llm.sentencepiece_wfst import Transducer, _encoded, decode, encode
from tickloom.llm.words import text_runs

PATH = public_tokenizers.path("piece_bpe_32k.model")
STRANGE = [
    "", None, " ", "   ", "  lead", "trail  ", "a  b   c", "tabs\tand\nlines \n x", "▁ mark ▁▁ x▁", "a ▁ b",
    "日本語のテキスト と 漢字", "🙂 emoji 🙂🙂", "\x00\x01 é à", "<s> </s> <0x0A> <unk>", "ѐЉ 𐍈 ￿", "x" * 200,
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaab", "123456789 1.5e-7", "!!!!!!! ???", " " * 40 + "far",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    rng = random.Random(8)
    pool = "abcdefghilmnoprstuvz  .,ÄÖéèßñ\n'-0123" + "▁漢🙂"
    noise = ["".join(rng.choices(pool, k=rng.randint(1, 80))) for _ in range(300)]
    return STRANGE + noise + [t for _, t in documents()]


def test_ids_are_the_library_s(library):
    all_texts = texts()
    for kept in (400_000, 40):
        machine = Transducer(PATH, kept)
        for first, data, offsets in text_runs(pa.array(all_texts), 4000):
            ids, at = machine.encoded(data, offsets)
            for i in range(len(offsets) - 1):
                want = library.encode(all_texts[first + i] or "")
                assert ids[at[i] : at[i + 1]].tolist() == want, all_texts[first + i]


def test_the_path_is_what_merging_leaves():
    machine, rng = Transducer(PATH), random.Random(3)
    for _ in range(400):
        text = "▁" + "".join(rng.choices("aehilnorstu", k=rng.randint(1, 14)))
        assert machine.shortest(text) == machine.merged(text)


def test_round_trip_in_spark(spark, library):
    rows = documents() + [(None, "no id"), (4, "again four")] + list(enumerate(STRANGE))
    coded = encode(docs_frame(spark, rows), PATH)
    out = decode(coded, PATH).collect()
    assert sorted(str((r.doc_id, r.text)) for r in out) == sorted(str(r) for r in rows)
    for r in out:
        assert r.ids == library.encode(r.text or "")
        assert r.decoded == (r.text or "").replace("▁", " ")


def test_decoding_odd_ids(spark, library):
    ids = [None, [], [0, 1, 2], [99_999, -4, 300], [198, 3, 300], [259, 300]]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "k int, ids array<int>")
    out = {r.k: r.decoded for r in decode(rows, PATH).collect()}
    assert out[0] == out[1] == out[2] == ""
    assert out[3] == library.decode([300]) and "�" in out[4]
    assert decode(rows.limit(0), PATH).collect() == []


def test_other_models_are_refused(tmp_path):
    with open(PATH, "rb") as file:
        data = file.read()
    other = tmp_path / "other.model"
    other.write_bytes(data + bytes([2 << 3 | 2, 2, 3 << 3, 1]))  # a later trainer field: unigram
    with pytest.raises(ValueError):
        Transducer(str(other))
    assert np.all(Transducer(PATH).byte_ids == np.arange(3, 259))


def test_memory_follows_the_run_not_the_batch(library):
    rng = random.Random(11)
    words = ["".join(rng.choices("aehilnorstu", k=5)) for _ in range(500)]
    all_texts = [" ".join(rng.choices(words, k=300)) for _ in range(4000)]  # 7 MB
    batch = pa.record_batch([pa.array(range(4000)), pa.array(all_texts)], ["doc_id", "text"])
    sum(part.num_rows for part in _encoded(iter([batch]), PATH))
    tracemalloc.start()
    done = 0
    for part in _encoded(iter([batch]), PATH):
        assert part.column(2)[0].as_py() == library.encode(all_texts[done])
        done += part.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert done == 4000
    assert peak < 20 << 20
