"""Token ids of whole texts under a byte-level BPE, each distinct stretch encoded once.

The vocabulary's pattern never lets a token run over a space or line end that follows a character
other than white space, from a letter into a mark, or from a line end into a letter. Nor does one run
into a line end that a letter follows: a run of white space leaves its last character to itself while
what is behind it is seen. So a text may be cut there and the parts encoded alone. Parts repeat (mostly they are words): each distinct part of a
run is encoded once and kept for later runs.
"""

import json
import os

import numpy as np

from tickloom.llm.parts import KEPT, Parts, spans_joined
from tickloom.llm.words import SPACE, kept


#: Bytes of joined parts that the tokenizer takes as one text; it is slower on longer ones.
STRETCH = 1 << 12

#: ASCII letters 1, ASCII marks 2.
_KIND = np.array(
    [1 if chr(b).isalpha() else 2 if 0x20 < b < 0x7F and not chr(b).isdigit() else 0 for b in range(128)]
    + [0] * 128,
    np.uint8,
)


def part_begins(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where parts begin: texts, white space after another character, marks after letters, lines."""
    n = len(data)
    cut = np.zeros(n, bool)
    if n == 0:
        return np.zeros(0, np.int64)
    solid = ~SPACE[data] & (data > 0x20)
    # White space beyond ASCII: U+0085, U+00A0, U+1680, U+2000-200A, U+2028, U+2029, U+202F,
    # U+205F, U+3000, by its last byte.
    for lead in np.flatnonzero(data == 0xC2):
        if lead + 1 < n and data[lead + 1] in (0x85, 0xA0):
            solid[lead + 1] = False
    if (data >= 0xE1).any():
        third = data[2:]
        e1 = (data[:-2] == 0xE1) & (data[1:-1] == 0x9A) & (third == 0x80)
        e2 = (data[:-2] == 0xE2) & (data[1:-1] == 0x80)
        e2 &= (third <= 0x8A) | (third == 0xA8) | (third == 0xA9) | (third == 0xAF)
        math = (data[:-2] == 0xE2) & (data[1:-1] == 0x81) & (third == 0x9F)
        wide = (data[:-2] == 0xE3) & (data[1:-1] == 0x80) & (third == 0x80)
        solid[2:][e1 | e2 | math | wide] = False
    cut[1:] = ((data[1:] == 0x20) | (data[1:] == 0x0A)) & solid[:-1]
    # A run of letters ends before a mark, white space but for the space before a letter.
    kind = _KIND[data]
    letter = kind == 1
    cut[1:] |= letter[:-1] & (kind[1:] == 2)
    line = (data[:-1] == 0x0A) & letter[1:]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    line[heads[heads > 0] - 1] = False
    cut[1:] |= line
    # The run's other white space would take the line end with it if the letter were not seen.
    cut[:-1] |= line
    cut[heads] = True
    return np.flatnonzero(cut)


class ByteBpe(Parts):
    """Encodes runs of texts with the `tokenizers` file at `path`; nothing is added to the ids.

    Strings of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str, kept: int = KEPT):
        from tokenizers import Tokenizer

        super().__init__(kept)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = json.loads(self.tokenizer.to_str())["model"]["vocab"]
        #: Bytes of each id: the vocabulary writes each byte as one character.
        self.n_bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, number in vocabulary.items():
            self.n_bytes[number] = len(token)

    def begins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return part_begins(data, offsets)

    def fresh(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts like words, between two spaces, are encoded together as one text."""
        last = data[end - 1]
        # An ASCII letter, digit or mark ends the part: the next part's space is a cut.
        together = (data[begin] == 0x20) & (last > 0x20) & (last < 0x7F)
        text = spans_joined(data, begin[together], end[together])
        ends = np.cumsum((end - begin)[together])
        cuts = [0, *ends[np.flatnonzero(np.diff(ends // STRETCH, append=-1))].tolist()]
        ids = np.array([i for x in self._ids([text[b:e] for b, e in zip(cuts, cuts[1:])]) for i in x], np.uint32)
        stops = np.searchsorted(np.cumsum(self.n_bytes[ids]), ends, "left") + 1
        alone = self._ids([data[b:e].tobytes() for b, e in zip(begin[~together], end[~together])])
        lengths = np.empty(len(begin), np.int64)
        lengths[together], lengths[~together] = np.diff(stops, prepend=0), [len(x) for x in alone]
        out = np.empty(lengths.sum(), np.uint32)
        of_joined = np.repeat(together, lengths)
        out[of_joined] = ids
        out[~of_joined] = [i for x in alone for i in x]
        return out, lengths

    def _ids(self, parts: list[bytes]) -> list[list[int]]:
        texts = [x.decode("utf-8", "replace") for x in parts]
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def byte_bpe(path: str) -> ByteBpe:
    """The worker's encoder for the file.

    Tasks run side by side already: threads of the library's own in each worker take time from them, and
    the memory that they have used stays with the worker.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return kept(("byte_bpe", path), lambda: ByteBpe(path))
