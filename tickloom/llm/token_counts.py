"""Token counts of fields and sections from one encoding of the whole document.

A document's fields are joined with a line end between them and encoded once. Token lengths give
each token's place in the text; places are joined with the sections' places as sorted intervals. A
token that crosses a boundary is counted once, by a rule: "largest" gives it to the section that has
most of its bytes, the earlier of equals, "first" to the section in which it starts.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.byte_bpe import ByteBpe, byte_bpe
from tickloom.llm.words import running, text_runs

RULES = ("largest", "first")
_COLUMNS = "field int, section int, start_char long, end_char long, n_tokens long, n_crossing long"


def section_of(start: np.ndarray, end: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token [start, end), and whether it crosses a boundary.

    Section i is [bounds[i], bounds[i + 1]); tokens are not empty and lie within the bounds.
    """
    first = np.searchsorted(bounds, start, "right") - 1
    last = np.searchsorted(bounds, end, "left") - 1
    crossing = last > first
    if rule == "first" or not crossing.any():
        return first, crossing
    token = np.flatnonzero(crossing)
    n = (last - first)[token] + 1
    of = np.repeat(token, n)
    section = first[of] + np.arange(len(of)) - np.repeat(running(n)[:-1], n)
    shared = np.minimum(end[of], bounds[section + 1]) - np.maximum(start[of], bounds[section])
    order = np.lexsort((section, -shared, of))
    best = order[np.searchsorted(of[order], token)]
    out = first.copy()
    out[token] = section[best]
    return out, crossing


def token_counts(
    docs: DataFrame,
    tokenizer: str,
    fields: tuple[str, ...] = ("text",),
    id_col: str = "doc_id",
    rule: str = "largest",
) -> DataFrame:
    """One row per line of every field: doc_id, field, section, start_char, end_char, n_tokens, n_crossing.

    `field` is the field's place in `fields`, `section` the line's within it; a line ends behind its
    line end, which for a field's last line is the one that joins it to the next field. Characters
    are counted in the joined text. n_tokens of all rows of a document add up to its tokens,
    n_crossing counts those that some other section has a share of. A null or empty field is one
    section without a character but the joining line end. Rows that repeat an id are counted each; a
    null id stays null; an empty table gives no rows; other columns are not looked at.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in fields]
    joined = F.concat_ws("\n", *parts) if len(parts) > 1 else parts[0]
    sizes = F.array(*[F.octet_length(p) + (1 if i + 1 < len(parts) else 0) for i, p in enumerate(parts)])
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), joined.alias("text"), sizes.alias("sizes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(tokenizer)
        for batch in batches:
            for first, data, offsets in text_runs(batch.column(1)):
                part = batch.slice(first, len(offsets) - 1)
                yield _counted(part, data, offsets, encoder, len(fields), rule)

    key = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {key}, {_COLUMNS}")


def _counted(part: pa.RecordBatch, data, offsets, encoder: ByteBpe, fields: int, rule: str) -> pa.RecordBatch:
    ids, _ = encoder.encode(data, offsets)
    end = np.cumsum(encoder.n_bytes[ids])
    start = end - encoder.n_bytes[ids]
    column = part.column(2)
    sizes = column.flatten().to_numpy().reshape(-1, fields).astype(np.int64)
    field_at = (offsets[:-1, None] + np.cumsum(sizes, axis=1) - sizes).ravel()
    # Lines begin with their fields and behind line ends that are not the field's last byte.
    lines = np.flatnonzero(data == 0x0A) + 1
    field_end = field_at + sizes.ravel()
    lines = lines[~np.isin(lines, field_end)]
    begin = np.concatenate([field_at, lines])
    # A line's field: the last one that begins before it.
    field = np.concatenate([np.arange(len(field_at)), np.searchsorted(field_at, lines, "left") - 1])
    order = np.lexsort((field, begin))
    begin, field = begin[order], field[order]
    bounds = np.append(begin, len(data))
    section, crossing = section_of(start, end, bounds, rule)
    chars = running(((data & 0xC0) != 0x80).astype(np.int64))
    row = field // fields
    text_start = chars[offsets[:-1]][row]
    head = np.searchsorted(field, field, "left")
    numbers = [
        (field % fields).astype(np.int32),
        (np.arange(len(field)) - head).astype(np.int32),
        chars[begin] - text_start,
        chars[bounds[1:]] - text_start,
        np.bincount(section, minlength=len(begin)).astype(np.int64),
        np.bincount(section, crossing, len(begin)).astype(np.int64),
    ]
    names = ["field", "section", "start_char", "end_char", "n_tokens", "n_crossing"]
    return pa.RecordBatch.from_arrays(
        [part.column(0).take(pa.array(row)), *map(pa.array, numbers)], ["doc_id", *names]
    )
