"""Repeated word windows by de Bruijn compaction.

A window of 20 words is an edge of the de Bruijn graph. Its anchor is the smallest hash among the
8-word sequences in it, so equal windows have equal anchors, and consecutive windows mostly share
one: a run. Blocks of documents report their anchors; those that one block only has can't repeat
elsewhere and go no further. For the others, blocks report a digest of the whole run. Where all
blocks have one and the same run around an anchor, the path through it doesn't branch: it is one row
with its first document, however many windows and copies it has. Where runs differ, at ends of
repeated passages, their windows are reported one by one. The joined results go back to the blocks,
whose own coordinates then say which windows start earlier elsewhere, in an earlier document of the
block or earlier in the document.

Everything is reported once per block, so a passage that a third of all documents share is as many
rows as there are blocks.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.blocks import unpack_rows, write_blocks
from tickloom.llm.words import Words, give_back, let_go, mix, polynomial, running, word_runs
from tickloom.session import cut_lineage

WINDOW = 20
ANCHOR = 8
LAST = 2**63 - 1
#: Bytes of a block's text whose windows a worker looks at together. It bounds memory, not results.
CHUNK = 1 << 20
_OTHER = np.uint64(0xA0761D6478BD642F)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i:i + width]) for every i, by doubling."""
    part, done = x, 1
    while 2 * done <= width:
        part = np.minimum(part[: len(part) - done], part[done:])
        done *= 2
    return np.minimum(part[: len(x) - width + 1], part[width - done :])


@dataclass
class Windows:
    """All windows of some rows of a block in text order, and the runs of windows that share an anchor."""

    words: Words
    doc: np.ndarray  # of each row; rows without an id come after all
    begin: np.ndarray  # index of each window's first word
    hash: np.ndarray
    anchor: np.ndarray
    head: np.ndarray  # index of each run's first window
    digest: np.ndarray  # of each run's words, by another hash than the anchor's

    @property
    def of_row(self) -> np.ndarray:
        return self.words.row[self.begin]


def parts_of(rows: pa.RecordBatch, window: int, anchor: int) -> Iterator[Windows]:
    """The windows of a block's rows, of about CHUNK bytes of text at a time. No window spans two rows."""
    doc = _starts(rows)
    for words in word_runs(rows.column(1), chunk=CHUNK):
        yield windows_of(words, doc[words.first : words.first + words.rows], window, anchor)


def _starts(rows: pa.RecordBatch) -> np.ndarray:
    return rows.column(0).fill_null(LAST).to_numpy(zero_copy_only=False)


def windows_of(words: Words, doc: np.ndarray, window: int, anchor: int) -> Windows:
    hashes, n = words.hashes(), len(words.begin)
    none = np.zeros(0, np.int64)
    if n < window:
        empty = np.zeros(0, np.uint64)
        return Windows(words, doc, none, empty, empty, none, empty)
    begin = np.flatnonzero(words.row[: n - window + 1] == words.row[window - 1 :])
    small = mix(polynomial(hashes, anchor))
    least = sliding_min(small, window - anchor + 1)[begin]
    new = np.ones(len(begin), bool)
    new[1:] = (least[1:] != least[:-1]) | (begin[1:] != begin[:-1] + 1)
    head = np.flatnonzero(new)
    ends = np.append(head[1:], len(begin)) - 1
    # Words of a run: from its first window's first word to its last window's last one.
    other = running(mix(hashes + _OTHER) * _weights(n))
    low, high = begin[head], begin[ends] + window if len(head) else none
    digest = mix((other[high] - other[low]) * _weights(n, inverse=True)[low] + (high - low).astype(np.uint64))
    return Windows(words, doc, begin, mix(polynomial(hashes, window))[begin], least, head, digest)


def _weights(n: int, inverse: bool = False) -> np.ndarray:
    base = 0x9FB21C651E98DF25
    factor = np.full(max(n, 1), pow(base, -1, 1 << 64) if inverse else base, np.uint64)
    factor[0] = 1
    return np.cumprod(factor, dtype=np.uint64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _groups(order_key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts the key (stable), and where each group of equal keys begins in it."""
    order = np.argsort(order_key, kind="stable")
    key = order_key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return order, np.flatnonzero(new)


RUN = (np.minimum, np.maximum, np.minimum)
EDGE = (np.minimum,)


def _extremes(keys: np.ndarray, values: tuple, least: tuple) -> tuple[np.ndarray, tuple]:
    """The different keys, sorted, and of each one's values the extremes that `least` names."""
    order, cut = _groups(keys)
    if len(cut) == 0:
        return keys, values
    return keys[order][cut], tuple(f.reduceat(x[order], cut) for f, x in zip(least, values))


def _together(found: list[tuple[np.ndarray, tuple]], least: tuple) -> tuple[np.ndarray, tuple]:
    """Extremes of a block from those of its parts."""
    keys = np.concatenate([x for x, _ in found])
    return _extremes(keys, tuple(map(np.concatenate, zip(*[x for _, x in found]))), least)


def _members(column: pa.Array, i: int) -> np.ndarray:
    if not column.is_valid()[i].as_py():
        return np.zeros(0, np.int64)
    return column[i].values.to_numpy(zero_copy_only=False)


def _found_in(values: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value whether it is among the sorted ones, and where."""
    at = np.searchsorted(among, values)
    at[at == len(among)] = 0
    return (among[at] == values) if len(among) else np.zeros(len(values), bool), at


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key other blocks have too: at most one row per key and block comes in."""
    several = F.count(F.lit(1)).over(Window.partitionBy(key)) > 1
    return rows.withColumn("several", several).filter("several").drop("several")


def substring_dedup(
    docs: DataFrame,
    window: int = WINDOW,
    anchor: int = ANCHOR,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_removed, kept_text, spans, text, rest.

    Every word covered by a window whose word sequence also starts earlier (in a document with a
    smaller id, or earlier in the same row) is removed; kept_text has the others joined by one
    space. `spans` lists the removed stretches as (start, n_words), `text` is the text as it came,
    `rest` the other columns of `docs` as a struct with fields c0, c1, ... in their order.

    A null text has no words. Texts shorter than a window lose nothing. Rows that repeat an id are
    documents that start at the same time: neither's windows are earlier than the other's. Rows
    without an id come after all others. An empty table gives no rows.
    """
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    doc_id, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    table = write_blocks(docs, doc_id, text, rest)
    of_block = Window.partitionBy("block")

    def anchors(batches):
        for number, payload, _ in _blocks(batches):
            found = [np.unique(w.anchor[w.head]) for w in parts_of(unpack_rows(payload), window, anchor)]
            yield _reported(number, anchor=np.unique(np.concatenate(found)))

    def per_block(rows: DataFrame, *columns: str) -> DataFrame:
        """One row per block with its reports as arrays: a block's size bounds them."""
        return rows.groupBy("block").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("r")).select(
            "block", *[F.col(f"r.{c}").alias(c) for c in columns]
        )

    met = _shared(table.mapInArrow(anchors, "block long, anchor long"), "anchor")
    met = cut_lineage(per_block(met, "anchor"))

    def runs(batches):
        for number, payload, (known,) in _blocks(batches, 1):
            found = []
            for w in parts_of(unpack_rows(payload), window, anchor):
                of_run = w.anchor[w.head].view(np.int64)
                take, _ = _found_in(of_run, known)
                digest, doc = w.digest[take].view(np.int64), w.doc[w.of_row[w.head[take]]]
                found.append(_extremes(of_run[take], (digest, digest, doc), RUN))
            of_run, (low, high, first) = _together(found, RUN)
            if len(of_run):
                yield _reported(number, anchor=of_run, low=low, high=high, first=first)

    ran = table.join(met, "block").select("block", "payload", "anchor").mapInArrow(
        runs, "block long, anchor long, low long, high long, first long"
    )
    all_of = Window.partitionBy("anchor")
    paths = ran.select(
        "block", "anchor", F.min("first").over(all_of).alias("first"),
        (F.min("low").over(all_of) < F.max("high").over(all_of)).alias("branches"),
    )
    paths = cut_lineage(per_block(paths, "anchor", "first", "branches"))

    def single(batches):
        for number, payload, (known, _, branches) in _blocks(batches, 3):
            found = []
            for w in parts_of(unpack_rows(payload), window, anchor):
                take, _ = _found_in(w.anchor.view(np.int64), known[branches.astype(bool)])
                doc = w.doc[w.of_row[take]]
                found.append(_extremes(w.hash[take].view(np.int64), (doc,), EDGE))
            edge, (first,) = _together(found, EDGE)
            if len(edge):
                yield _reported(number, edge=edge, first=first)

    edges = table.join(paths, "block").select("block", "payload", "anchor", "first", "branches").mapInArrow(
        single, "block long, edge long, first long"
    )
    same = Window.partitionBy("edge")
    edges = edges.select(
        "block", "edge", F.min("first").over(same).alias("first"),
        F.count(F.lit(1)).over(same).alias("n"),
    ).filter("n > 1")
    edges = cut_lineage(per_block(edges, "edge", "first"))

    def finish(batches):
        for _, payload, found in _blocks(batches, 5):
            yield from _kept(unpack_rows(payload), window, anchor, *found)

    schema = T._parse_datatype_string(
        "doc_id long, n_words long, n_removed long, kept_text string, "
        "spans array<struct<start:int,n_words:int>>, text string"
    )
    others = [T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(rest)]
    schema = schema.add("rest", T.StructType(others or [T.StructField("c0", T.IntegerType())]))
    joined = (
        table.join(paths, "block", "left")
        .join(edges.withColumnRenamed("first", "edge_first"), "block", "left")
        .select("block", "payload", "anchor", "first", "branches", "edge", "edge_first")
    )
    return joined.mapInArrow(finish, schema)


def _blocks(batches: Iterator[pa.RecordBatch], arrays: int = 0):
    """Block number, payload and the arrays that were found out about the block."""
    let_go()
    for batch in batches:
        for i in range(batch.num_rows):
            found = [_members(batch.column(2 + k), i) for k in range(arrays)]
            yield batch.column(0)[i].as_py(), batch.column(1)[i].as_buffer(), found
            give_back()


def _reported(number: int, **columns: np.ndarray) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    arrays = [pa.array(np.full(n, number, np.int64)), *(_signed(x) for x in columns.values())]
    return pa.RecordBatch.from_arrays(arrays, ["block", *columns])


def _kept(
    rows: pa.RecordBatch, window: int, anchor: int, known, first, branches, edge, edge_first
) -> Iterator[pa.RecordBatch]:
    """The block's rows without the words that earlier windows cover."""
    parts = []  # (words, begin, gone) of each
    hashes, row = [], []  # of all windows of the block
    for w in parts_of(rows, window, anchor):
        of_row = w.of_row
        gone = _earlier_elsewhere(w, w.doc[of_row], known, first, branches, edge, edge_first)
        parts.append((w.words, w.begin, gone))
        hashes.append(w.hash)
        row.append(of_row + w.words.first)
    again = _again(np.concatenate(hashes), np.concatenate(row), _starts(rows))
    del hashes, row
    done = 0
    for words, begin, gone in parts:
        gone |= again[done : done + len(gone)]
        done += len(gone)
        yield _without(rows.slice(words.first, words.rows), words, begin[gone], window)


def _earlier_elsewhere(w: Windows, doc, known, first, branches, edge, edge_first) -> np.ndarray:
    """Which windows an earlier document has; `doc` is the windows' own."""
    earliest = np.full(len(w.begin), LAST)
    there, at = _found_in(w.anchor.view(np.int64), known)
    settled = there & ~branches.astype(bool)[at] if len(known) else there
    earliest[settled] = first[at[settled]]
    there, at = _found_in(w.hash.view(np.int64), edge)
    there &= ~settled
    earliest[there] = edge_first[at[there]]
    return earliest < doc


def _again(hashes: np.ndarray, row: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which windows start earlier in the same block. `row`: of each window; `doc`: of each row."""
    out = np.zeros(len(hashes), bool)
    order, cut = _groups(hashes)
    size = np.diff(np.append(cut, len(hashes)))
    several = np.repeat(size > 1, size)
    if several.any():
        of_group = np.repeat(np.arange(len(cut)), size)[several]
        places = order[several]  # in text order within a group
        of_row = row[places]
        before = np.zeros(len(places), bool)
        before[1:] = (of_group[1:] == of_group[:-1]) & (of_row[1:] == of_row[:-1])
        low = np.minimum.reduceat(doc[row[order]], cut)[of_group]
        out[places] = before | (low < doc[of_row])
    return out


def _without(rows: pa.RecordBatch, words: Words, begin: np.ndarray, window: int) -> pa.RecordBatch:
    """The rows without the words that windows beginning at `begin` cover."""
    cover = np.zeros(len(words.begin) + 1, np.int64)
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + window, -1)
    removed = np.cumsum(cover)[:-1] > 0
    n_words = np.bincount(words.row, minlength=words.rows)
    n_removed = np.bincount(words.row[removed], minlength=words.rows)
    data, offsets = _joined(words, ~removed)
    text = pa.LargeStringArray.from_buffers(words.rows, pa.py_buffer(offsets), pa.py_buffer(data))
    return pa.RecordBatch.from_arrays(
        [
            rows.column(0), pa.array(n_words.astype(np.int64)), pa.array(n_removed.astype(np.int64)),
            text.cast(pa.string()), _spans(words, removed), rows.column(1), rows.column(2),
        ],
        ["doc_id", "n_words", "n_removed", "kept_text", "spans", "text", "rest"],
    )


def _joined(words: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kept words of every row joined by one space: bytes and offsets."""
    begin, end, row = words.begin[keep], words.end[keep], words.row[keep]
    size = end - begin + 1  # with a space behind
    total = int(size.sum())
    starts = np.cumsum(size) - size
    out = words.data[np.minimum(np.repeat(begin - starts, size) + np.arange(total), len(words.data) - 1)] \
        if total else np.zeros(0, np.uint8)
    out[starts + size - 1] = 0x20
    last = np.ones(len(row), bool)
    last[:-1] = row[1:] != row[:-1]
    solid = np.ones(total, bool)
    solid[(starts + size - 1)[last]] = False  # no space behind a row's last word
    per_row = np.bincount(row, weights=size, minlength=words.rows).astype(np.int64)
    per_row -= per_row > 0
    return out[solid], running(per_row)


def _spans(words: Words, removed: np.ndarray) -> pa.Array:
    """Removed stretches of every row as (start, n_words)."""
    cut, row = words.cut, words.row
    first, last = removed.copy(), removed.copy()
    same = row[1:] == row[:-1] if len(row) else np.zeros(0, bool)
    first[1:] &= ~(removed[:-1] & same)
    last[:-1] &= ~(removed[1:] & same)
    begins, ends = np.flatnonzero(first), np.flatnonzero(last)
    counts = np.bincount(row[begins], minlength=words.rows)
    spans = pa.StructArray.from_arrays(
        [
            pa.array((begins - cut[row[begins]]).astype(np.int32)),
            pa.array((ends - begins + 1).astype(np.int32)),
        ],
        ["start", "n_words"],
    )
    edges = running(counts).astype(np.int32)
    return pa.ListArray.from_arrays(edges, spans)
