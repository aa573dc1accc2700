"""Periodic runs of words, found on a grammar instead of on the text.

A run is a stretch of words with smallest period q that is at least LEAST and POWER * q words long and
can't be extended. The texts of a task are taken a few megabytes at a time:

1. Words become ids, by their bytes.
2. Re-Pair: pairs of neighbouring symbols that repeat become nonterminals, many in a round (those that
   are more frequent than both pairs they overlap with), over all texts at hand. What is left of a text
   is folded in pairs, level by level, so that every boundary between two words belongs to one node.
3. A run lies whole within the topmost node whose boundary it crosses. So the runs that cross a
   nonterminal's boundary are computed once, at its first occurrence, and
4. translated to the positions of all its derivations, where
5. equal periods that overlap by a period are merged to maximal intervals.

Periods are looked for at a boundary by comparing pairs of words, then lengths of a period by a hash of
prefix sums, then by binary search. Every interval found is compared word by word before it counts, and
a node where a hash was wrong is computed anew without.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.words import Words, mix, word_runs

LEAST = 6
POWER = 4
#: Re-Pair ends with the round that replaces less than this share of the symbols; the pairs it leaves
#: are folded like those that don't repeat.
FADING = 0.01
#: Boundaries and periods compared at once.
SLICE = 1 << 20
PRIME = np.uint64((1 << 31) - 1)
BASE = 1_103_515_245

RUNS = "array<struct<start: long, length: long, period: long>>"


@dataclass
class Grammar:
    """Nonterminals from `words` on; `begins` has the first of each round, and the end."""

    words: int
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray  # of all symbols, words included
    first: np.ndarray  # of each nonterminal, the word where it is first derived
    begins: list[int]
    symbols: np.ndarray  # what is left of the texts
    at: np.ndarray  # word where each begins
    row: np.ndarray


def _choose(pairs: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Places of pairs to replace: repeated, not overlapping, more frequent than their neighbours."""
    codes, _ = pd.factorize(pairs[same])
    times = np.bincount(codes)[codes]
    weight = np.zeros(len(pairs) + 2, np.uint64)
    # Equal counts are told apart by the pair, alike wherever it stands.
    tie = mix(pairs[same]) >> np.uint64(34)
    weight[1:-1][same] = np.where(times > 1, (times.astype(np.uint64) << np.uint64(30)) | tie, 0)
    here = weight[1:-1]
    peak = (here > 0) & (here >= weight[:-2]) & (here >= weight[2:])
    place = np.flatnonzero(peak)
    if len(place) == 0:
        return place
    # Neighbouring peaks are a symbol's own repetition: every other one.
    starts = np.flatnonzero(np.diff(place, prepend=-2) != 1)
    offset = np.arange(len(place)) - np.repeat(starts, np.diff(starts, append=len(place)))
    return place[offset % 2 == 0]


def re_pair(ids: np.ndarray, row: np.ndarray, words: int) -> Grammar:
    symbols, at, rows = ids.astype(np.uint64), np.arange(len(ids)), row
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    first: list[np.ndarray] = []
    length, begins = np.ones(words, np.int64), [words]
    while len(symbols) > 1:
        same = rows[1:] == rows[:-1]
        pairs = (symbols[:-1] << np.uint64(32)) | symbols[1:]
        place = _choose(pairs, same)
        codes, kinds = pd.factorize(pairs[place])
        times = np.bincount(codes, minlength=len(kinds)) if len(codes) else np.zeros(0, np.int64)
        place, codes = place[times[codes] > 1], codes[times[codes] > 1]
        if len(place) <= FADING * len(symbols):
            break
        codes, kept = pd.factorize(codes)
        kinds = kinds[kept]
        new_left, new_right = kinds >> np.uint64(32), kinds & np.uint64(0xFFFFFFFF)
        left.append(new_left)
        right.append(new_right)
        first.append(at[place[np.unique(codes, return_index=True)[1]]])
        length = np.concatenate([length, length[new_left.astype(np.int64)] + length[new_right.astype(np.int64)]])
        symbols[place] = (codes + begins[-1]).astype(np.uint64)
        begins.append(begins[-1] + len(kinds))
        stay = np.ones(len(symbols), bool)
        stay[place + 1] = False
        symbols, at, rows = symbols[stay], at[stay], rows[stay]

    def joined(parts: list[np.ndarray]) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *(x.astype(np.int64) for x in parts)])

    return Grammar(
        words, joined(left), joined(right), length, joined(first), begins, symbols.astype(np.int64), at, rows
    )


def _folded(at: np.ndarray, row: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Nodes (low, middle, high) that fold what is left of each text in pairs, level by level."""
    while len(at):
        heads = np.flatnonzero(np.diff(row, prepend=-1))
        size = np.diff(heads, append=len(at))
        if size.max() == 1:
            return
        offset = np.arange(len(at)) - np.repeat(heads, size)
        stop = np.append(at[1:], 0)
        last = heads + size - 1
        stop[last] = end[row[last]]
        right = offset % 2 == 1
        node = np.flatnonzero(right)
        yield at[node - 1], at[node], stop[node]
        at, row = at[~right], row[~right]


_powers = np.ones(1, np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    while len(_powers) < n:
        step = np.uint64(pow(BASE, len(_powers), int(PRIME)))
        _powers = np.concatenate([_powers, _powers * step % PRIME])
    return _powers


class Text:
    """Word ids with comparisons of stretches that lie q words apart."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        self.power = _power_table(len(ids) + 1)
        code = mix(ids.astype(np.uint64) + np.uint64(1)) % PRIME
        self.sums = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(code * self.power[: len(ids)] % PRIME, out=self.sums[1:])
        self.sums %= PRIME

    def alike(self, i: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
        """If the n words from i and from i + q hash alike."""
        here = (self.sums[i + n] + PRIME - self.sums[i]) % PRIME
        there = (self.sums[i + q + n] + PRIME - self.sums[i + q]) % PRIME
        return here * self.power[q] % PRIME == there

    def reach(self, i: np.ndarray, q: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words from i on (or before i) are like those q words further, `most` at most."""
        n = np.zeros(len(i), np.int64)
        step = 1 << max(int(most.max(initial=0)).bit_length(), 1)
        while step:
            where = np.flatnonzero(n + step <= most)
            begin = i[where] - n[where] - step if back else i[where] + n[where]
            n[where[self.alike(begin, q[where], np.full(len(where), step))]] += step
            step >>= 1
        return n

    def same(self, begin: np.ndarray, end: np.ndarray, q: np.ndarray) -> np.ndarray:
        """If each begin:end truly has period q, word by word."""
        out = np.ones(len(begin), bool)
        size = end - begin - q
        cuts = np.searchsorted(np.cumsum(size), np.arange(SLICE, size.sum() + SLICE, SLICE), "right")
        for a, b in zip([0, *cuts], [*cuts, len(size)]):
            if a < b:
                n = size[a:b]
                which = np.repeat(np.arange(a, b), n)
                place = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + begin[which]
                out[which[self.ids[place] != self.ids[place + q[which]]]] = False
        return out


def _periods(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Largest period that a run within low:high can have; 0 if none."""
    size = high - low
    return np.where(size < LEAST, 0, np.maximum(size // POWER, int(LEAST >= POWER)))


def crossing_runs(
    text: Text, low: np.ndarray, middle: np.ndarray, high: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node, begin, end, period) of the runs in each low:high, cut there, that cross `middle`."""
    most = _periods(low, high)
    node = np.flatnonzero(most)
    total = np.cumsum(most[node])
    found = []
    begin = 0
    while begin < len(node):
        done = total[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(total, done + SLICE, "right")))
        part = node[begin:stop]
        which = np.repeat(part, most[part])
        q = np.arange(len(which)) - np.repeat(np.cumsum(most[part]) - most[part], most[part]) + 1
        found.append(_smallest_periods(*_candidates(text, low, middle, high, which, q)))
        begin = stop
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    which, s, e, q = (np.concatenate(x) for x in zip(*found))
    true = text.same(s, e, q)
    if not true.all():
        wrong = np.unique(which[~true])
        stay = ~np.isin(which, wrong)
        plain = [_plain(text.ids, x, int(low[x]), int(middle[x]), int(high[x])) for x in wrong]
        anew = _smallest_periods(*np.array([r for rows in plain for r in rows], np.int64).reshape(-1, 4).T)
        which, s, e, q = (np.concatenate([x[stay], y]) for x, y in zip((which, s, e, q), anew))
    return which, s, e, q


def _candidates(text, low, middle, high, which, q):
    """Of nodes and periods, the stretches that reach over the middle and are long enough.

    A run has at least two periods (and three words) on one side of the middle; there two
    neighbouring words have their like a period away, and so has the whole period next to the middle.
    """
    ids, out = text.ids, []
    lo, mid, hi = low[which], middle[which], high[which]
    for left in (True, False):
        far = mid - 2 - q if left else mid
        room = far >= lo if left else far + q + 1 < hi
        i = np.flatnonzero(room)
        i = i[(ids[far[i]] == ids[far[i] + q[i]]) & (ids[far[i] + 1] == ids[far[i] + 1 + q[i]])]
        i = i[(mid[i] - 2 * q[i] >= lo[i]) if left else (mid[i] + 2 * q[i] <= hi[i])]
        i = i[text.alike(mid[i] - 2 * q[i] if left else mid[i], q[i], q[i])]
        pivot = mid[i] - q[i] if left else mid[i]
        s = pivot - text.reach(pivot, q[i], pivot - lo[i], back=True)
        e = pivot + q[i] + text.reach(pivot, q[i], hi[i] - pivot - q[i])
        i, s, e = (x[(e - s >= np.maximum(LEAST, POWER * q[i])) & (s < mid[i]) & (e > mid[i])] for x in (i, s, e))
        out.append((which[i], s, e, q[i]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _least_factors(n: int) -> np.ndarray:
    """The smallest prime factor of each number below n."""
    out = np.arange(n)
    for p in range(2, int(n**0.5) + 1):
        if out[p] == p:
            multiples = out[p * p :: p]
            multiples[multiples == np.arange(p * p, n, p)] = p
    return out


def _smallest_periods(which, s, e, q):
    """Without repetitions and without stretches that have a smaller period.

    A stretch of at least 2q words with period q and a smaller one has a period q / r for a prime r,
    and the stretch of that period reaches over the same middle and is at least as long.
    """
    order = np.lexsort((s, q, which))
    which, s, e, q = (x[order] for x in (which, s, e, q))
    if len(q) == 0:
        return which, s, e, q
    new = np.ones(len(q), bool)
    new[1:] = (np.diff(which) != 0) | (np.diff(q) != 0) | (np.diff(s) != 0) | (np.diff(e) != 0)
    which, s, e, q = (x[new] for x in (which, s, e, q))
    wide = int(q.max()) + 1
    keys = which * wide + q
    larger = np.zeros(len(q), bool)
    prime, rest = _least_factors(wide), q.copy()
    while len(hit := np.flatnonzero(rest > 1)):
        factor = prime[rest[hit]]
        look = which[hit] * wide + q[hit] // factor
        at = np.searchsorted(keys, look)
        for k in (at, at + 1):  # two stretches of a period can cross a middle
            k = np.minimum(k, len(keys) - 1)
            larger[hit] |= (keys[k] == look) & (s[k] <= s[hit]) & (e[k] >= e[hit])
        rest[hit] //= factor
    return tuple(x[~larger] for x in (which, s, e, q))


def _plain(ids: np.ndarray, node: int, low: int, middle: int, high: int) -> list[tuple[int, int, int, int]]:
    """The runs of one node that cross its middle, for every period, without hashes."""
    out = []
    for q in range(1, int(_periods(np.array([low]), np.array([high]))[0]) + 1):
        differ = np.flatnonzero(ids[low : high - q] != ids[low + q : high]) + low
        edges = np.concatenate([[low - 1], differ, [high - q]])
        s, e = edges[:-1] + 1, edges[1:] + q
        good = (e - s >= max(LEAST, POWER * q)) & (s < middle) & (e > middle)
        out += [(node, int(a), int(b), q) for a, b in zip(s[good], e[good])]
    return out


def _derived(g: Grammar, node: np.ndarray, s: np.ndarray, e: np.ndarray, q: np.ndarray):
    """(begin, end, period) at all derivations of nonterminals; s and e count from the nonterminal's begin."""
    total = len(g.length)
    own = np.bincount(node, minlength=total - g.words)
    order = np.argsort(node, kind="stable")
    s, e, q = s[order], e[order], q[order]
    starts = np.cumsum(own) - own
    has = np.zeros(total, bool)
    has[g.words :] = own > 0
    for a, b in zip(g.begins, g.begins[1:]):
        x = slice(a - g.words, b - g.words)
        has[a:b] |= has[g.left[x]] | has[g.right[x]]
    wanted = has[g.symbols]
    symbol, at = g.symbols[wanted], g.at[wanted]
    out = []
    for a in reversed(g.begins[:-1]):
        now = symbol >= a
        rule, place = symbol[now] - g.words, at[now]
        symbol, at = symbol[~now], at[~now]
        n = own[rule]
        k = np.repeat(starts[rule], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        shift = np.repeat(place, n)
        out.append((s[k] + shift, e[k] + shift, q[k]))
        below = np.concatenate([g.left[rule], g.right[rule]])
        where = np.concatenate([place, place + g.length[g.left[rule]]])
        wanted = has[below]
        symbol, at = np.concatenate([symbol, below[wanted]]), np.concatenate([at, where[wanted]])
    return out


def _merged(s: np.ndarray, e: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches of one period that overlap by it as one; by begin, then period."""
    order = np.lexsort((s, q))
    s, e, q = s[order], e[order], q[order]
    if len(s):
        wide = int(e.max()) + 1
        reach = np.maximum.accumulate(q * wide + e) - q * wide
        new = np.ones(len(s), bool)
        new[1:] = (np.diff(q) != 0) | (s[1:] > reach[:-1] - q[1:])
        heads = np.flatnonzero(new)
        s, q, e = s[heads], q[heads], np.maximum.reduceat(e, heads)
        order = np.lexsort((q, s))
        s, e, q = s[order], e[order], q[order]
    return s, e, q


def runs_of(ids: np.ndarray, row: np.ndarray, cut: np.ndarray, words: int) -> tuple[np.ndarray, ...]:
    """(begin, end, period) of all runs, by begin and period; rows are cut[i]:cut[i + 1] of `ids`."""
    g = re_pair(ids, row, words)
    text = Text(ids)
    rules = len(g.left)
    middle = g.first + g.length[g.left]
    nodes = [(g.first, middle, g.first + g.length[g.words :])]
    nodes += _folded(g.at, g.row, cut[1:])
    low, mid, high = (np.concatenate(x) for x in zip(*nodes))
    node, s, e, q = crossing_runs(text, low, mid, high)
    rule = node < rules
    found = [(s[~rule], e[~rule], q[~rule])]
    origin = g.first[node[rule]]
    found += _derived(g, node[rule], s[rule] - origin, e[rule] - origin, q[rule])
    return _merged(*(np.concatenate(x) for x in zip(*found)))


def _word_array(words: Words) -> pa.Array:
    """The words' bytes as an Arrow column."""
    size = words.end - words.begin
    inside = np.zeros(len(words.data) + 1, np.int8)
    inside[words.begin] += 1
    inside[words.end] -= 1
    letters = words.data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]
    )


def _rows(words: Words) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Word counts, runs and collapsed texts of a few rows."""
    column, cut = _word_array(words), words.cut
    coded = column.dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    s, e, q = runs_of(ids, words.row, cut, len(coded.dictionary))
    gone = np.bincount(s + q, minlength=len(ids) + 1) - np.bincount(e, minlength=len(ids) + 1)
    stays = np.cumsum(gone[:-1]) == 0
    kept = coded.dictionary.take(pa.array(ids[stays])).cast(pa.binary())
    edges = np.concatenate([[0], np.cumsum(stays)])[cut]
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), kept), pa.scalar(b" ", pa.binary()))
    row = words.row[s]
    fields = [s - cut[row], e - s, q]
    each = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in fields], ["start", "length", "period"])
    bounds = pa.array(np.searchsorted(row, np.arange(words.rows + 1)), pa.int32())
    return pa.array(np.diff(cut), pa.int64()), pa.ListArray.from_arrays(bounds, each), texts


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, runs (start, length, period), collapsed.

    Runs are ordered by their first word, then period; words are counted from 0. `collapsed` are the
    words that no run contains after its first period, joined by one space. Null, empty and blank texts
    have no words, no runs and an empty collapsed text. Ids are not looked at: null and repeated ones
    have a row each. No rows give none; other columns of `docs` are left out, whatever their names.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in word_runs(batch.column(1)):
                ids = batch.column(0).slice(words.first, words.rows)
                yield pa.record_batch([ids, *_rows(words)], ["doc_id", "n_words", "runs", "collapsed"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"doc_id {kind}, n_words long, runs {RUNS}, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def with_repeats(text: Column, number: Column) -> Column:
    """`text` whose words from a = number % n on repeat the first 1 + (n - a) div (3 + number % 8) of them.

    The words are joined by one space; a text without words stays as it is.
    """
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = number % F.greatest(n, F.lit(1))
        p = F.floor((n - a) / (number % 8 + 3)) + 1
        times = F.ceil((n - a) / p).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(w, (a + 1).cast("int"), p.cast("int")), times))
        changed = F.slice(F.concat(F.slice(w, F.lit(1), a.cast("int")), tail), F.lit(1), n.cast("int"))
        return F.when(n > 0, F.concat_ws(" ", changed)).otherwise(text)

    return F.element_at(F.transform(F.array(words), repeated), 1)
