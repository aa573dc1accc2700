"""Ids of parts of texts, each distinct part looked at once."""

from abc import ABC, abstractmethod

import numpy as np

from tickloom.llm.words import running, span_hashes

#: Parts kept; with more, those met once only are forgotten. It bounds memory, not results.
KEPT = 600_000


def spans_joined(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> bytes:
    """The bytes of all spans end to end."""
    size = end - begin
    at = running(size)
    return data[np.repeat(begin - at[:-1], size) + np.arange(at[-1])].tobytes()


class Parts(ABC):
    """Keeps the ids of parts met before, found by their hashes. A worker keeps it from task to task.

    Most distinct parts of a text never come again. A full store forgets those that have not been met
    again since they were learned or since it was full before.
    """

    def __init__(self, kept: int = KEPT):
        self.kept = kept
        self._reset()

    def _reset(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted hashes of parts
        self.start = np.zeros(0, np.int64)  # of their ids in the pool
        self.length = np.zeros(0, np.int64)
        self.again = np.zeros(0, bool)  # whether met again
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0

    @abstractmethod
    def begins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where parts of the texts begin; the first byte of a text that has any is among them."""

    @abstractmethod
    def fresh(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new parts end to end, and how many each part has."""

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's ids begin (rows + 1 entries)."""
        begin = self.begins(data, offsets)
        if len(begin) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        end = np.append(begin[1:], len(data))
        hashes, first, place = np.unique(
            span_hashes(data, begin, end), return_index=True, return_inverse=True
        )
        at, new = self._look(hashes)
        if len(self.known) + np.count_nonzero(new) > self.kept:
            self._forget()
            at, new = self._look(hashes)
        if new.any():
            ids, lengths = self.fresh(data, begin[first[new]], end[first[new]])
            self._learn(hashes[new], at[new], ids, lengths)
            at += running(new.astype(np.int64))[:-1]
        start, length = self.start[at][place], self.length[at][place]
        sums = running(length)
        ids = self.pool[np.repeat(start - sums[:-1], length) + np.arange(sums[-1])]
        return ids, sums[np.searchsorted(begin, offsets)]

    def _look(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where sorted hashes are or would be among the known ones, and which are new."""
        at = np.searchsorted(self.known, hashes)
        new = at == len(self.known)
        new[~new] = self.known[at[~new]] != hashes[~new]
        self.again[at[~new]] = True
        return at, new

    def _forget(self) -> None:
        """Parts met once only, or all, if the others alone fill more than half of the store."""
        stay = np.flatnonzero(self.again)
        if len(stay) > self.kept // 2:
            self._reset()
            return
        start, length = self.start[stay], self.length[stay]
        sums = running(length)
        ids = self.pool[np.repeat(start - sums[:-1], length) + np.arange(sums[-1])]
        known = self.known[stay]
        self._reset()
        self._learn(known, np.zeros(len(known), np.int64), ids, length)

    def _learn(self, hashes: np.ndarray, at: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Sorted new hashes, `at` their places among the known ones."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        starts = self.used + running(lengths)[:-1]
        self.used += len(ids)
        place = at + np.arange(len(at))
        old = np.ones(len(self.known) + len(at), bool)
        old[place] = False

        def merged(before: np.ndarray, added: np.ndarray | bool) -> np.ndarray:
            out = np.empty(len(old), before.dtype)
            out[old], out[place] = before, added
            return out

        self.known, self.again = merged(self.known, hashes), merged(self.again, False)
        self.start, self.length = merged(self.start, starts), merged(self.length, lengths)
