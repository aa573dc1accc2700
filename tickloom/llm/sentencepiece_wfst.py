"""SentencePiece encoding and decoding by shortest paths through a transducer.

The model is compiled into three machines. The normaliser maps spaces to the mark U+2581 and puts
one in front. The piece machine reads marked text and writes ids, a piece per arc; a character that
no piece covers goes through the byte arcs of its UTF-8 bytes. The context machine knows which two
pieces may follow each other: merging by priority leaves a and b side by side just if it does so in
the text ab. A pair that it would have cut otherwise has weight infinity, all others weight 0.

Composed with an input, the machine has a state per position and last piece. The shortest path to a
position is unique in it, because every beginning of a text has exactly one segmentation without a
forbidden pair; so the tropical shortest distance is taken position by position, and it is the
result of the model's own merges. (Piece scores as arc weights would be the segmentation of a
unigram model, which this vocabulary isn't.)

Two characters that stand side by side in no piece are never merged, a mark behind another character
among them. Texts are cut there, and each distinct part is composed once.
"""

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.parts import Parts
from tickloom.llm.words import give_back, running, text_runs

MARK = "▁"
#: Pairs of pieces whose compatibility is kept; a bound on memory, not on results.
PAIRS = 250_000
#: Parts of texts whose ids a worker keeps; also a bound on memory only.
PARTS = 400_000
#: Bytes of text that a worker encodes together; a bound on memory as well.
CHUNK = 1 << 19
#: Above all symbols: pieces and characters.
SYMBOLS = 1 << 32
#: Ids decoded at once.
DECODED = 1 << 17

#: Field numbers of the model file's protocol buffer that are read here.
PIECE, TRAINER, NORMALISER = 1, 2, 3
MODEL_TYPE, BPE = 3, 2
CHARSMAP, DUMMY_PREFIX, REMOVE_EXTRA, ESCAPE = 2, 3, 4, 5


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of every field of a serialised message, nested ones as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


class Transducer(Parts):
    """The compiled model of a SentencePiece file with byte fallback, merges and plain normaliser."""

    def __init__(self, path: str, kept: int = PARTS):
        import sentencepiece

        super().__init__(kept)
        with open(path, "rb") as file:
            message = list(_fields(file.read()))
        trainer, rule = (dict(_fields(b"".join(v for k, v in message if k == n))) for n in (TRAINER, NORMALISER))
        plain = not rule.get(CHARSMAP) and not rule.get(REMOVE_EXTRA, 1) and rule.get(ESCAPE, 1)
        if trainer.get(MODEL_TYPE, 1) != BPE or not plain:
            raise ValueError(f"{path}: only merge models with an identity normaliser are compiled")
        self.prefix = bool(rule.get(DUMMY_PREFIX, 1))
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = (model.is_control, model.is_unknown, model.is_byte)
        n = model.get_piece_size()
        self.ids = {model.id_to_piece(i): i for i in range(n) if not any(f(i) for f in special)}
        self.rank = {piece: -model.get_score(i) for piece, i in self.ids.items()}
        self.pieces = {i: piece for piece, i in self.ids.items()}
        self.beyond = n  # numbers of characters that no piece is begin here
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(model.is_byte(i) for i in self.byte_ids):
            raise ValueError(f"{path}: the model has no byte fallback")
        if any(MARK in piece.lstrip(MARK) for piece in self.ids):
            raise ValueError(f"{path}: a piece has a space behind another character")
        self.longest = max(map(len, self.ids))
        #: ASCII characters (a space for the mark) that stand side by side in some piece.
        self.joined = np.zeros((128, 128), bool)
        for piece in self.ids:
            codes = [ord(c) for c in piece.replace(MARK, " ")]
            for a, b in zip(codes, codes[1:]):
                if a < 128 and b < 128:
                    self.joined[a, b] = True
        #: What an id writes when decoded; control and unknown ids write nothing.
        self.written = [b""] * n
        for piece, i in self.ids.items():
            self.written[i] = piece.replace(MARK, " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.written[i] = bytes([b])
        self.pairs: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces that merging by priority leaves of `text`, the leftmost of equals first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.rank.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def symbol(self, text: str) -> int | None:
        """The number of a piece, or of a character that no piece is; else none."""
        found = self.ids.get(text)
        return self.beyond + ord(text) if found is None and len(text) == 1 else found

    def text_of(self, symbol: int) -> str:
        return "" if symbol < 0 else chr(symbol - self.beyond) if symbol >= self.beyond else self.pieces[symbol]

    def follows(self, left: int, right: int) -> bool:
        """Weight 0 (true) or infinity of the symbol `right` after `left`; -1 is a text's beginning."""
        pair = left * SYMBOLS + right
        found = self.pairs.get(pair)
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            before, after = self.text_of(left), self.text_of(right)
            found = self.merged(before + after) == ([before, after] if before else [after])
            self.pairs[pair] = found
        return found

    def shortest(self, text: str) -> list[str]:
        """Pieces and uncovered characters on the shortest path through `text` (with marks)."""
        n, ids, longest, follows, beyond = len(text), self.ids, self.longest, self.follows, self.beyond
        last = [-1] * (n + 1)  # the symbol on the shortest path's last arc to each position
        begin = [0] * (n + 1)  # and where that arc begins
        for stop in range(1, n + 1):
            for start in range(max(0, stop - longest), stop):
                symbol = ids.get(text[start:stop])
                if symbol is None:
                    if stop - start > 1:
                        continue
                    symbol = beyond + ord(text[start])
                if follows(last[start], symbol):
                    last[stop], begin[stop] = symbol, start
                    break
        out = []
        while n:
            out.append(text[begin[n] : n])
            n = begin[n]
        return out[::-1]

    def begins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts, spaces that follow neither a space nor the mark itself, and whatever no piece joins."""
        cut = np.zeros(len(data), bool)
        marked = data == 0x20
        mark = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
        marked[2:] |= mark
        cut[1:] = (data[1:] == 0x20) & ~marked[:-1]
        left, right = data[:-1], data[1:]
        cut[1:] |= (left < 128) & (right < 128) & ~self.joined[left & 127, right & 127]
        cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        return np.flatnonzero(cut)

    def fresh(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out: list[int] = []
        lengths = np.empty(len(begin), np.int64)
        for k, (b, e) in enumerate(zip(begin.tolist(), end.tolist())):
            before = len(out)
            for piece in self.shortest(data[b:e].tobytes().decode("utf-8", "replace").replace(" ", MARK)):
                number = self.ids.get(piece)
                if number is None:
                    out += [self.byte_ids[x] for x in piece.encode()]
                else:
                    out.append(number)
            lengths[k] = len(out) - before
        return np.array(out, np.uint32), lengths

    def encoded(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As encode(), of texts before normalisation."""
        if self.prefix:
            filled = np.diff(offsets) > 0
            data = np.insert(data, offsets[:-1][filled], 0x20)
            offsets = offsets + running(filled.astype(np.int64))
        return self.encode(data, offsets)

    def decoded(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts end to end, and where each begins."""
        if not hasattr(self, "_flat"):
            self._size = np.array([len(x) for x in self.written])
            self._flat = np.frombuffer(b"".join(self.written), np.uint8)
            self._start = running(self._size)[:-1]
        if len(ids) == 0:
            return np.zeros(0, np.uint8), np.zeros(len(at), np.int64)
        size = self._size[ids]
        sums = running(size)
        data = self._flat[np.repeat(self._start[ids] - sums[:-1], size) + np.arange(sums[-1])]
        offsets = sums[at]
        if self.prefix:  # one leading space is the normaliser's
            first = offsets[:-1][offsets[:-1] < offsets[1:]]
            first = first[data[first] == 0x20]
            keep = np.ones(len(data), bool)
            keep[first] = False
            offsets = offsets - running((~keep).astype(np.int64))[offsets]
            data = data[keep]
        return data, offsets


@lru_cache(2)
def transducer(path: str) -> Transducer:
    """The worker's machine for the file."""
    return Transducer(path)


def _encoded(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    machine = transducer(model)
    for batch in batches:
        for first, data, offsets in text_runs(batch.column(1), CHUNK):
            ids, at = machine.encoded(data, offsets)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.view(np.int32)))
            part = batch.slice(first, len(offsets) - 1)
            yield pa.RecordBatch.from_arrays([*part.columns, lists], ["doc_id", "text", "ids"])
            del ids, at, lists, part
            give_back()


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, ids) of every row, as the model file at `model` has them.

    A null text has no ids, as an empty one. Rows that repeat an id are encoded each; a null id stays
    null; an empty table gives no rows; other columns are not looked at.
    """

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    key = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda batches: _encoded(batches, model), f"doc_id {key}, text string, ids array<int>")


def _runs_of_ids(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of about DECODED ids: what decoding needs per byte follows the slice and the longest text."""
    at = pc.list_value_length(batch.column(column)).fill_null(0).to_numpy()
    ends, first = np.cumsum(at, dtype=np.int64), 0
    while first < batch.num_rows:
        before = int(ends[first - 1]) if first else 0
        stop = max(first + 1, int(np.searchsorted(ends, before + DECODED, "right")))
        yield batch.slice(first, stop - first)
        first = stop


def decode(rows: DataFrame, model: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """`rows` with the text of their ids in a column `text_col` behind the others.

    Control ids and ids that the model doesn't have write nothing, null ids an empty text. Bytes
    that are no UTF-8 become U+FFFD.
    """
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model)
        top = len(machine.written)
        for batch in batches:
            for part in _runs_of_ids(batch, names.index(ids_col)):
                column = part.column(names.index(ids_col)).fill_null([])
                ids, at = column.values.fill_null(0).to_numpy(zero_copy_only=False), column.offsets.to_numpy()
                ids, at = ids[at[0] : at[-1]], (at - at[0]).astype(np.int64)
                data, offsets = machine.decoded(np.where((ids >= 0) & (ids < top), ids, 0), at)
                raw, edges = data.tobytes(), offsets.tolist()
                texts = [raw[b:e].decode("utf-8", "replace") for b, e in zip(edges[:-1], edges[1:])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*names, text_col])
                del column, ids, at, data, offsets, raw, edges, texts
            give_back()

    return rows.mapInArrow(run, rows.select("*", F.lit("").alias(text_col)).schema)
