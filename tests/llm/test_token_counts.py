"""Counts against the tokenizer's own offsets and a walk over tokens."""

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.helpers import documents
from tickloom.llm.token_counts import section_of, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain(values, tokenizer, rule):
    """(field, section, start, end, tokens, crossing) of the joined fields."""
    text = "\n".join(v or "" for v in values)
    sections, at = [], 0
    for f, v in enumerate(values):
        body = (v or "") + ("\n" if f + 1 < len(values) else "")
        cuts = [0, *(i + 1 for i, c in enumerate(body[:-1]) if c == "\n"), len(body)]
        sections += [(f, s, at + b, at + e) for s, (b, e) in enumerate(zip(cuts, cuts[1:]))]
        at += len(body)
    byte_at = np.cumsum([0, *(len(c.encode()) for c in text)])
    counts, crossing = [0] * len(sections), [0] * len(sections)
    pos = 0
    for i in tokenizer.encode(text, add_special_tokens=False).ids:
        start, pos = pos, pos + len(tokenizer.id_to_token(i))
        share = [max(0, min(pos, byte_at[e]) - max(start, byte_at[b])) for _, _, b, e in sections]
        touched = [k for k, n in enumerate(share) if n]
        own = touched[0] if rule == "first" else max(touched, key=lambda k: (share[k], -k))
        counts[own] += 1
        crossing[own] += len(touched) > 1
    return [(*s, n, c) for s, n, c in zip(sections, counts, crossing)]


@pytest.mark.parametrize("rule", ["largest", "first"])
@pytest.mark.parametrize("fields", [("text",), ("lang", "text", "extra")])
def test_counts(spark, rule, fields):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    rows = [(i, t, "en\nx" if i % 2 else None, "" if i % 3 else "日本\n\n語") for i, t in documents(60)]
    rows += [(None, "a\n\n\n\nb\n", "x", None), (1, "  \n  \n", "y", "z"), (2, "\n", "\n", "\n"), (3, "日\n本", "é", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, extra string")
    got = token_counts(df.repartition(3), PATH, fields, rule=rule).collect()
    names = {"text": 1, "lang": 2, "extra": 3}
    want = [(r[0], *x) for r in rows for x in plain([r[names[f]] for f in fields], tokenizer, rule)]
    have = [tuple(r) for r in got]
    assert sorted(map(str, have)) == sorted(map(str, want))


def test_rules():
    bounds = np.array([0, 4, 4, 6, 10])
    start, end = np.array([0, 2, 5, 9]), np.array([2, 5, 9, 10])
    first, crossing = section_of(start, end, bounds, "first")
    assert first.tolist() == [0, 0, 2, 3] and crossing.tolist() == [False, True, True, False]
    assert section_of(start, end, bounds, "largest")[0].tolist() == [0, 0, 3, 3]


def test_empty_table_and_bad_rule(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts(empty, PATH).collect() == []
    with pytest.raises(ValueError):
        token_counts(empty, PATH, rule="other")


def test_words_that_differ_by_a_rule_have_their_own_ids():
    from tests.llm.test_hyperminhash import thue_morse
    from tickloom.llm.byte_bpe import byte_bpe
    from tickloom.llm.words import text_runs

    encoder = byte_bpe(public_tokenizers.path("byte_bpe_50k.json"))
    texts = list(thue_morse()) + ["x " + w for w in thue_morse()]
    for _, data, offsets in text_runs(pa.array(texts)):
        ids, at = encoder.encode(data, offsets)
    want = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [ids[b:e].tolist() for b, e in zip(at, at[1:])] == [x.ids for x in want]
