"""Shards of equal bytes, places without gaps, maps by version, and no Python in the plan."""

import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import docs_frame, documents
from tickloom.llm import sharding
from tickloom.llm.queries import op11_virtual_slots


def by_shard(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.shard].append(r)
    return out


def check(rows, got, shards=8):
    """Every row once, with its size, and a place of its own in its shard."""
    def line(i, size, crc):
        return str((i, size, crc))

    want = [line(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows]
    assert sorted(line(r.doc_id, r.size, r.text_crc32) for r in got) == sorted(want)
    for shard, held in by_shard(got).items():
        assert 0 <= shard < shards
        assert sorted(r.slot for r in held) == list(range(len(held)))


def test_shards_of_nearly_equal_bytes(spark):
    rows = documents(1500, seed=4)
    rows += [(None, "no id"), (None, "no id"), (rows[5][0], "id again"), (rows[5][0], rows[5][1])]
    got = sharding.shard_rows(docs_frame(spark, rows)).collect()
    check(rows, got)
    sizes = [sum(r.size for r in held) for held in by_shard(got).values()]
    largest = max(r.size for r in got)
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 0.01 * sum(sizes) / 8 < largest
    assert len({(r.doc_id, r.virtual_slot) for r in got}) == len({r.doc_id for r in got})


def test_one_id_on_a_third_of_the_rows_is_spread(spark):
    rows = [(i, f"text {i}") for i in range(2000)] + [(7, "the same text")] * 1000
    got = sharding.shard_rows(docs_frame(spark, rows)).collect()
    check(rows, got)
    sizes = [sum(r.size for r in held) for held in by_shard(got).values()]
    assert max(sizes) < 1.02 * min(sizes)
    assert len({r.part for r in got if r.doc_id == 7}) > 100


@pytest.mark.parametrize("texts", [[], [None], ["one"], ["", None, "x" * 300_000]])
def test_few_rows(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    frame = docs_frame(spark, rows) if rows else spark.createDataFrame([], "doc_id long, text string, shard int")
    check(rows, sharding.shard_rows(frame).collect())


def slots_frame(spark, n=512):
    rows = [(1, s, 0, 1 + (s * 7919) % 1000, s * 4 // n) for s in range(n)]
    return spark.createDataFrame(rows, sharding.MAP)


def shard_of(held):
    return {(r.slot, r.part): r.shard for r in held.collect()}


def test_a_map_is_edited_and_older_versions_stay(spark, tmp_path):
    path = str(tmp_path / "maps")
    sharding.store(slots_frame(spark), path)
    sharding.store(sharding.rebalanced(sharding.stored(spark, path, 1), 4), path)
    sharding.store(sharding.rebalanced(sharding.stored(spark, path, 2), 6), path)
    maps = {v: sharding.stored(spark, path, v) for v in (1, 2, 3)}
    assert shard_of(maps[1]) == shard_of(slots_frame(spark))
    for version, shards in ((2, 4), (3, 6)):
        assert sorted(shard_of(maps[version])) == sorted(shard_of(maps[1]))
        sums = [r.n for r in maps[version].groupBy("shard").agg(F.sum("bytes").alias("n")).collect()]
        assert len(sums) == shards and max(sums) - min(sums) <= 1000
    before, after = shard_of(maps[1]), shard_of(maps[2])
    assert sum(before[k] != after[k] for k in before) < 0.1 * len(before)
    again = shard_of(sharding.rebalanced(maps[2], 4))
    assert sum(again[k] != after[k] for k in after) <= 4  # the one slot of a shard that straddles its share


def test_one_more_shard_takes_slots_only_into_itself(spark):
    held = sharding.rebalanced(slots_frame(spark), 4)
    before, after = shard_of(held), shard_of(sharding.grown(held, 4))
    assert {after[k] for k in before if after[k] != before[k]} == {4}
    weight = {(r.slot, r.part): r.bytes for r in held.collect()}
    assert sum(weight[k] for k in after if after[k] == 4) < 1.1 * sum(weight.values()) / 5 + 4000


def test_plan_has_no_python(spark):
    plan = sharding.shard_rows(docs_frame(spark, documents(20)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_query(spark):
    got = op11_virtual_slots(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    check([(d.doc_id, d.text) for d in docs], got)
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    sizes = [sum(r.size for r in held) for held in by_shard(got).values()]
    assert max(sizes) < 1.01 * min(sizes)
