"""Words of whole Arrow text columns, found and hashed with NumPy.

A word is a maximal run of bytes other than space and \\t \\n \\v \\f \\r, as bytes.split() has it.
Texts are handled in runs of rows of about CHUNK bytes, so memory follows the run and the longest
single text, not the batch.
"""

import ctypes
from collections.abc import Callable, Hashable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa

CHUNK = 2 << 20
#: Bytes that the tables of powers reach at least; they grow with the runs that a worker has seen.
LEAST = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**64, 256, np.uint64)


def running(x: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, ... len(x) numbers, in the array's own type."""
    out = np.zeros(len(x) + 1, x.dtype)
    np.cumsum(x, dtype=x.dtype, out=out[1:])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


def give_back() -> None:
    """Returns what freed arrays have left with this process to the system.

    Workers live on from stage to stage, and what one stage's arrays have taken would stay with them.
    """
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


_kept: dict[Hashable, Any] = {}


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """What a worker keeps from task to task under `key`. It keeps one thing at a time."""
    if key not in _kept:
        let_go()
        _kept[key] = make()
    return _kept[key]


def let_go() -> None:
    """Ends what a worker has kept for other stages. Tasks that keep nothing begin with it."""
    _kept.clear()
    give_back()


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, mod 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, LEAST) + (max(n, LEAST) >> 2)
        inverse = pow(_BASE, -1, 1 << 64)
        tables = []
        for factor in (_BASE, inverse):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        _powers[:] = tables
    return _powers


#: Spans of up to so many bytes are told apart by powers of one base. Over longer ones that would take for
#: one what alternates by a rule: of 2^k bytes, the differences between two such spans have some k^2 / 2
#: factors of two, all of the 64 from k = 10 on, and 35 at this length.
SHORT = 128
_weights = np.zeros(0, np.uint64)


def _weighted(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of long spans, each byte weighted by an odd number of its place; the numbers follow no rule.

    Two given spans of a length meet with a chance of 2^-56 at most, whatever they are.
    """
    global _weights
    if len(_weights) < size.max():
        place = np.arange(max(int(size.max()), 1 << 12), dtype=np.uint64)
        _weights = mix(place * np.uint64(_BASE) + np.uint64(0x51ED270B)) | np.uint64(1)
    at = running(size)
    place = np.arange(at[-1]) - np.repeat(at[:-1], size)
    terms = _BYTE[data[np.repeat(begin, size) + place]] * _weights[place]
    return mix(np.add.reduceat(terms, at[:-1]) ^ mix(size.astype(np.uint64)))


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[begin:end]; the spans are in order and don't overlap."""
    out = np.empty(len(begin), np.uint64)
    i = 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(end, begin[i] + CHUNK, "right")))
        low, high = int(begin[i]), int(end[j - 1])
        power, inverse = _power_tables(high - low + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTE[data[low:high]] * power[: high - low], dtype=np.uint64, out=sums[1:])
        b, e = begin[i:j] - low, end[i:j] - low
        out[i:j] = mix((sums[e] - sums[b]) * inverse[b] + (e - b).astype(np.uint64))
        long = np.flatnonzero(e - b > SHORT)
        if len(long):
            out[i + long] = _weighted(data, begin[i + long], (e - b)[long])
        i = j
    return out


@dataclass
class Words:
    """Words of a run of rows. `row` counts from the run's first row, `cut` has rows + 1 entries."""

    first: int  # the run's first row in its column
    rows: int
    data: np.ndarray  # bytes of all texts, end to end
    offsets: np.ndarray  # where each text begins in data, and the end
    begin: np.ndarray
    end: np.ndarray
    row: np.ndarray

    @property
    def cut(self) -> np.ndarray:
        """Words cut[i]:cut[i + 1] are those of row i."""
        return np.searchsorted(self.row, np.arange(self.rows + 1))

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.begin, self.end)


def text_runs(column: pa.Array, chunk: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of rows of about `chunk` bytes: first row, bytes, offsets. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, at, content = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        stop = max(first + 1, int(np.searchsorted(offsets, offsets[first] + chunk, "right")) - 1)
        low = offsets[first]
        yield first, data[low : offsets[stop]], offsets[first : stop + 1] - low
        first = stop


def words_of(data: np.ndarray, offsets: np.ndarray, first: int = 0) -> Words:
    word = ~SPACE[data]
    begin, stop = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    stop[:-1] &= ~word[1:]
    filled = offsets[:-1] < offsets[1:]
    heads, tails = offsets[:-1][filled], offsets[1:][filled] - 1
    begin[heads] = word[heads]
    stop[tails] = word[tails]
    begins = np.flatnonzero(begin)
    row = np.searchsorted(offsets, begins, "right") - 1
    return Words(first, len(offsets) - 1, data, offsets, begins, np.flatnonzero(stop) + 1, row)


def word_runs(column: pa.Array, lower: bool = False, chunk: int = CHUNK) -> Iterator[Words]:
    for first, data, offsets in text_runs(column, chunk):
        yield words_of(LOWER[data] if lower else data, offsets, first)


def windows(words: Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every `size` consecutive words of one row, and the index of their first words."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(words.row[: n - size + 1] == words.row[size - 1 :])
    return mix(polynomial(hashes, size)[at]), at


def polynomial(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sum of hashes[i + k] * base^k for every i, mod 2^64, by doubling."""
    n = len(hashes)
    total, done = np.zeros(n - size + 1, np.uint64), 0
    part, width = hashes.astype(np.uint64), 1  # part[i]: the sum over `width` items from i
    step, left = _BASE, size
    while left:
        if left & 1:
            total += part[done : done + n - size + 1] * np.uint64(pow(_BASE, done, 1 << 64))
            done += width
        left >>= 1
        if left:
            part = part[: len(part) - width] + part[width:] * np.uint64(step)
            step = step * step % (1 << 64)
            width *= 2
    return total
