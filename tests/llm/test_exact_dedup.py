"""Winners against a plain grouping, with and without frequent texts, and no Python in the plan."""

import hashlib
import random
from collections import defaultdict

import pytest

from tests.llm.helpers import docs_frame, documents
from tickloom.llm.exact_dedup import exact_dedup, keep_one


def rows_with_copies(hot=0):
    rng = random.Random(1)
    rows = documents(150)
    rows += [(2000 + i, rng.choice(rows)[1]) for i in range(60)]
    rows += [(5000 + i, "the same text") for i in range(hot)]
    rows += [(None, "no id"), (None, "no id"), (7000, "no id too"), (None, "no id too"), (rows[0][0], rows[0][1])]
    return rows


@pytest.mark.parametrize("hot,share", [(0, 1 / 1024), (400, 1 / 1024), (400, 0.2)])
def test_largest_id_stays(spark, hot, share):
    rows = rows_with_copies(hot)
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    got = exact_dedup(docs_frame(spark, rows), share=share).collect()
    seen = defaultdict(list)
    for r in got:
        seen[r.text_sha256].append(r)
    assert len(got) == len(rows) and len(seen) == len(groups)
    for text, ids in groups.items():
        found = seen[hashlib.sha256(text.encode()).hexdigest()]
        last = max((i for i in ids if i is not None), default=None)
        assert sorted(str(r.doc_id) for r in found) == sorted(map(str, ids))
        assert {(r.keep_id, r.group_size) for r in found} == {(last, len(ids))}
        assert [r.doc_id for r in found if r.kept] == [last]


def test_rows_that_stay(spark):
    rows = rows_with_copies(100)
    docs = docs_frame(spark, rows)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    last = {}
    for i, text in rows:
        best = last.get(text or "")
        last[text or ""] = i if best is None or (i is not None and i > best) else best
    got = [(r.doc_id, r.text or "") for r in kept.collect()]
    assert sorted(map(str, got)) == sorted(str((i, t)) for t, i in last.items())


def test_plan_has_no_python(spark):
    df = exact_dedup(docs_frame(spark, documents(20)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, digest string")
    assert exact_dedup(empty).collect() == [] and keep_one(empty).collect() == []
