"""Each stage's decisions on its own input, against plain versions of the stages."""

import zlib

import pytest
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.helpers import plain_words, smallest_reachable
from tests.llm.test_debruijn import plain as plain_windows
from tests.llm.test_packing import check_sequences

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = spark.createDataFrame(
        [(10_000, None, None, None, None), (10_001, "", "en", "s", 0), (None, "nobody wrote this", "en", "s", 3),
         (10_002, "one and the same", "en", "s", 1), (10_003, "one and the same", "de", "t", 2)],
        docs.schema,
    )
    docs = docs.unionByName(extra)
    results = {"documents": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, FOLDER))
        results[name] = docs.collect()
        assert docs.columns == COLUMNS or name == "best_fit_packing"
    return results


def rows_of(rows):
    return sorted(str(tuple(r)) for r in rows)


def test_toxicity_keeps_calm_documents(spark, stages):
    before, after = stages["documents"], stages["toxicity"]
    assert set(rows_of(after)) <= set(rows_of(before)) and len(after) > 0.6 * len(before)
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    taught = [i for i in toxic if zlib.crc32(str(i).encode()) % 3 != 1]
    clean = [i for i in taught if not toxic[i]]
    assert sum(i in kept for i in clean) >= 0.95 * len(clean)


def test_exact_copies(stages):
    before, after = stages["toxicity"], stages["exact_dedup"]
    last = {}
    for r in before:
        best = last.get(r.text or "")
        if best is None or best.doc_id is None or (r.doc_id is not None and r.doc_id > best.doc_id):
            last[r.text or ""] = r
    assert rows_of(after) == rows_of(last.values())


def test_near_copies(stages):
    before, after = stages["exact_dedup"], stages["minhash_near_dedup"]
    big = 10**9
    sets = []
    for r in before:
        ws = plain_words(r.text, lower=True)
        sets.append({tuple(ws)} if 0 < len(ws) < 5 else {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)})
    ids = [big if r.doc_id is None else r.doc_id for r in before]
    near = [
        (ids[a], ids[b]) for a in range(len(ids)) for b in range(a)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    label = smallest_reachable(ids, near)
    want = [r for r, i in zip(before, ids) if label[i] == i and r.doc_id is not None]
    assert rows_of(r for r in after if r.doc_id is not None) == rows_of(want)


def test_passages(stages):
    before, after = stages["minhash_near_dedup"], stages["substring_dedup"]
    want = []
    for r, (_, gone, text) in zip(before, plain_windows([(r.doc_id, r.text) for r in before], 20)):
        kept = text if gone else r.text
        want.append((r.doc_id, kept, r.lang, r.source, None if kept is None else len(kept)))
    assert rows_of(after) == sorted(map(str, want))


def test_packing(stages):
    before, after = stages["substring_dedup"], stages["best_fit_packing"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    total = {}
    for r in before:
        total[r.doc_id] = len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1
    packed = dict.fromkeys(total, 0)
    for r in after:
        packed[r.doc_id] += r.length
    assert packed == total
    n = check_sequences([(r.sequence_id, r.offset, r.length) for r in after], 1024)
    assert n <= 1.05 * sum(total.values()) / 1024 + 2


def test_run_and_empty_input(spark, tmp_path, stages):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.count() > 0 and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).collect() == []


def test_columns_of_any_name_pass_through(spark):
    """Names that the stages use themselves, and one with a dot."""
    odd = ["predicted", "score", "_sha", "_digest", "_kept", "kept_id", "rest", "c0", "node", "row", "a.b"]
    rows = [(i, f"text number {i % 7} of a few " * 4, 3, *[f"{c}{i}" for c in odd]) for i in range(12)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "n_chars", *odd])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: tuple(r)[3:] for r in docs.collect()}
        got = stage(spark, docs, FOLDER)
        assert got.columns == docs.columns, name
        after = {r.doc_id: tuple(r)[3:] for r in got.collect()}
        assert after and all(before[i] == values for i, values in after.items()), name


def test_a_text_of_some_megabytes(spark):
    """One very long document among short ones goes through every stage, with what it repeats cut once."""
    long = " ".join(f"w{i}" for i in range(400_000))
    passage = " ".join(f"w{i}" for i in range(1000, 1100))
    rows = [(1, long, 0), (2, "short words " + passage, 0), (3, long, 0), (4, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, FOLDER))
        if name == "substring_dedup":
            texts = {r.doc_id: r.text for r in docs.collect()}
            assert texts == {2: "short words " + passage, 3: " ".join(w for w in long.split() if not 1000 <= int(w[1:]) < 1100), 4: None}
    assert {r.doc_id for r in docs.collect()} == {2, 3, 4}
