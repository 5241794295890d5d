"""The words of many texts at once: where they stand, their hashes, lines and variable fields, by array operations.

A word is a maximal run of bytes other than space and 9 to 13. Its hash is a
polynomial in its bytes modulo 2^64, mixed with its length: prefix sums give it
for all words of a buffer, without a Python object per word.
"""

from __future__ import annotations

import numpy as np

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93  # odd, so that its powers can be undone
_UNDO = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def _within(b: np.ndarray, first: int, last: int) -> np.ndarray:
    """Which bytes lie between the two, compared without a table."""
    return b - np.uint8(first) <= np.uint8(last - first)


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _UNDO)):
            steps = np.full(max(n, 1 << 18), base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers


class Words:
    """``begin``, ``end`` (places in ``buffer``) of all words of some texts; ``starts``: where each text begins; ``text``: its first word, and their number."""

    def __init__(self, texts: list[bytes]):
        self.buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        space = _within(self.buffer, 9, 13) | (self.buffer == 32)
        edge = np.flatnonzero(np.diff(space, prepend=True))
        self.begin, self.end = edge[::2], edge[1::2]
        self.starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
        self.text = np.searchsorted(self.begin, self.starts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """64-bit hashes of the words, of A-Z as a-z if asked."""
        of = self.buffer + (_within(self.buffer, 65, 90).view(np.uint8) << np.uint8(5)) if lower else self.buffer
        up, down = _power_tables(len(of) + 1)
        sums = np.zeros(len(of) + 1, np.uint64)
        np.cumsum((of.astype(np.uint64) + np.uint64(1)) * up[: len(of)], out=sums[1:])
        word = (sums[self.end] - sums[self.begin]) * down[self.begin]
        return mix(word + (self.end - self.begin).astype(np.uint64) * _STEP)

    def fields(self) -> np.ndarray:
        """Whether a word holds a digit, an @ or a ``://``."""
        b = self.buffer
        at = _within(b, 48, 57) | (b == 64)
        at[:-2] |= (b[:-2] == 58) & (b[1:-1] == 47) & (b[2:] == 47)
        out = np.zeros(len(self.begin), bool)
        out[np.searchsorted(self.begin, np.flatnonzero(at), side="right") - 1] = True
        return out

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word of each line that has words, its number in its text, and the first such line of each text with their number)."""
        breaks = np.zeros(len(self.buffer) + 1, np.int64)
        np.cumsum(self.buffer == 10, out=breaks[1:])
        line = breaks[self.begin]
        first = np.flatnonzero(np.diff(line, prepend=-1))
        text = np.searchsorted(first, self.text)
        return first, line[first] - np.repeat(breaks[self.starts[:-1]], np.diff(text)), text


def word_hash(word: bytes) -> int:
    return int(Words([word]).hashes()[0])


def in_order(h: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The hashes with their places in their lines mixed in, so that sums of them tell the order."""
    place = np.arange(len(h)) - np.repeat(first, n) + 1
    return mix(h + place.astype(np.uint64) * _STEP)
