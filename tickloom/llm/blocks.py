"""Rows packed into blocks of a few megabytes, so that keys meet once per block instead of once per row.

A block is one row: its number and its rows as a compressed Arrow stream. The table is bucketed by
block number: what other stages find out about a block is shuffled to it, its rows never move again.
"""

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.words import give_back, let_go
from tickloom.session import shared_path

BLOCK = 4 << 20
MOST = 100_000  # buckets that Spark allows


def pack_rows(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    with pa.ipc.new_stream(sink, batch.schema, options=options) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack_rows(payload: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(payload).read_next_batch()


def _cuts(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, int]]:
    """Stretches of rows of about `size` bytes by the length of the text, the second column."""
    first = held = 0
    for i, n in enumerate(pc.binary_length(batch.column(1)).fill_null(0).to_pylist()):
        if i > first and held + n > size:
            yield first, i
            first, held = i, 0
        held += n + 64
    yield first, batch.num_rows


def in_blocks(batches: Iterator[pa.RecordBatch], size: int = BLOCK) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows of a task in batches of about `size` bytes of text (the second column), each with a number."""
    number = TaskContext.get().partitionId() << 32
    held: list[pa.RecordBatch] = []
    room = size
    for batch in batches:
        for first, stop in _cuts(batch, size):
            part = batch.slice(first, stop - first)
            n = pc.sum(pc.binary_length(part.column(1))).as_py() or 0
            if held and n > room:
                yield number, _one(held)
                number, held, room = number + 1, [], size
            held.append(part)
            room -= n + 64 * part.num_rows
    if sum(x.num_rows for x in held):
        yield number, _one(held)


def _one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def bucketed(rows: DataFrame) -> DataFrame:
    """Written to the shared folder as a table bucketed by its column `block`."""
    spark, name = rows.sparkSession, f"tickloom_blocks_{uuid.uuid4().hex}"
    path = shared_path(spark, "blocks")
    (
        rows.write.bucketBy(min(int(spark.conf.get("spark.sql.shuffle.partitions")), MOST), "block")
        .option("path", path)
        .option("compression", "none")
        .saveAsTable(name)
    )
    return spark.table(name)


def write_blocks(docs: DataFrame, doc_id: Column, text: Column, rest: list[str], size: int = BLOCK) -> DataFrame:
    """(block, payload) of a written table; payloads hold doc_id, text and the struct `rest`."""
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)] or [F.lit(0).alias("c0")]
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"), F.struct(*others).alias("rest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for number, batch in in_blocks(batches, size):
            yield pa.record_batch(
                [pa.array([number]), pa.array([pack_rows(batch)], pa.binary())], ["block", "payload"]
            )
            del batch
            give_back()

    return bucketed(rows.mapInArrow(run, "block long, payload binary"))
