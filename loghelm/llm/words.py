"""Words of many texts as NumPy arrays: places, 64-bit codes, shapes.

A word is a run of bytes other than space and 09-0D. A code is a polynomial
over the word's bytes with random byte values, computed for all words at once
from running sums; two codes of different seeds make 128 bits.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
BLOCK = 1 << 18
_MULTIPLIERS = {0: 0x9E3779B97F4A7C15, 1: 0xD1342543DE82EF95}
_TABLES: dict[int, np.ndarray] = {}
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit number over the others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _table(seed: int) -> np.ndarray:
    if seed not in _TABLES:
        _TABLES[seed] = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(seed * 7919 + 1))
    return _TABLES[seed]


def _powers(seed: int, n: int, inverse: bool) -> np.ndarray:
    have = _POWERS.get((seed, inverse))
    if have is None or len(have) < n:
        base = _MULTIPLIERS[seed]
        base = pow(base, -1, 1 << 64) if inverse else base
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _POWERS[seed, inverse] = np.multiply.accumulate(steps)
    return have


class Texts:
    """Concatenated texts with the places of their words.

    ``buf`` holds the bytes with a line feed after every text, ``starts`` and
    ``ends`` the words, ``first`` the number of words before each text (one
    entry more than texts), ``doc`` the text of each word.
    """

    def __init__(self, texts: list[bytes]):
        self.n = len(texts)
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, self.n)
        self.text_at = np.concatenate([[0], np.cumsum(sizes)])
        space = SPACE[self.buf]
        edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1)))
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.starts, self.text_at)
        self.doc = np.repeat(np.arange(self.n), np.diff(self.first))
        self.space = space

    def count_by_text(self, flags: np.ndarray) -> np.ndarray:
        """Per text, how many of its bytes are flagged."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.text_at[1:]] - total[self.text_at[:-1]]

    def codes(
        self, seed: int = 0, values: np.ndarray | None = None, keep: np.ndarray | None = None,
        spans: tuple[np.ndarray, np.ndarray] | None = None,
    ) -> np.ndarray:
        """A code for each word; ``values`` replaces the bytes, ``keep`` names those that count, ``spans`` replaces
        starts and ends, one span in each word."""
        starts, ends = spans or (self.starts, self.ends)
        out = np.empty(len(starts), np.uint64)
        raw = self.buf if values is None else values
        at = 0
        while at < len(out):
            low = starts[at]
            to = max(at + 1, int(np.searchsorted(ends, low + BLOCK, "right")))
            high = ends[to - 1]
            if high - low > 2 * BLOCK:  # one very long word: no tables of its length
                word = raw[low:high] if keep is None else raw[low:high][keep[low:high]]
                out[at] = int.from_bytes(blake2b(word.tobytes(), digest_size=8, person=bytes([seed])).digest(), "little")
                at = to
                continue
            part = _table(seed)[raw[low:high]]
            s, e = starts[at:to] - low, ends[at:to] - low
            if keep is None:
                part = part * _powers(seed, high - low, False)[: high - low]
                begun, ended = s, e
            else:
                place = np.concatenate([[0], np.cumsum(keep[low:high], dtype=np.int64)])
                part = np.where(keep[low:high], part * _powers(seed, high - low + 1, False)[place[:-1]], np.uint64(0))
                begun, ended = place[s], place[e]
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part, dtype=np.uint64)])
            out[at:to] = (total[e] - total[s]) * _powers(seed, high - low + 1, True)[begun] + (ended - begun).astype(np.uint64)
            at = to
        return mix(out)


def windows(code: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows of ``length`` words inside one text, and the windows' codes."""
    n = len(code) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(length):
        total = total * np.uint64(0x9E3779B97F4A7C15) + code[j : n + j]
    at = np.flatnonzero(doc[:n] == doc[length - 1 :])
    return at, mix(total[at])
