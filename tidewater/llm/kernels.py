"""Vectorised text kernels: words, word hashes, shingles and sentences of many documents at once."""

from __future__ import annotations

import numpy as np

from tidewater.llm.common import caches

U = np.uint64
BYTES, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd multipliers of hashes of bytes and of sequences
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = caches["powers"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 one)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = 1 << max(16, n.bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, U)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        have = _powers[base] = (out[0], out[1])
    return have


def range_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _Q) -> np.ndarray:
    """Position-free polynomial hashes of the ranges values[start:end], mixed with their lengths."""
    up, down = powers(base, len(values))
    cum = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=cum[1:])
    return mix((cum[end] - cum[start]) * down[start] + (end - start).astype(U) * U(0xC2B2AE3D27D4EB4F))


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of documents laid end to end, A-Z lower-cased.

    ``start``/``end`` are byte positions, ``hash`` 64-bit values, ``of`` the word offsets of each document.
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        n = len(data)
        upper = (data >= 65) & (data <= 90)
        self.data = np.where(upper, data + np.uint8(32), data) if upper.any() else data
        inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
        cut = np.zeros(n + 1, bool)
        cut[offs] = True
        before = np.zeros(n, bool)
        after = np.zeros(n, bool)
        if n:
            before[1:] = inside[:-1]
            after[:-1] = inside[1:]
        self.start = np.flatnonzero(inside & (~before | cut[:n]))
        self.end = np.flatnonzero(inside & (~after | cut[1:])) + 1
        self.of = np.searchsorted(self.start, offs)
        self.hash = range_hash(self.data.astype(U) + U(1), self.start, self.end, BYTES) if n else np.zeros(0, U)

    def shingles(self, width: int, base: int = _Q) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of ``width`` words of each document and their offsets; fewer words make one run of all."""
        count = np.diff(self.of)
        many = np.where(count >= width, count - width + 1, (count > 0).astype(count.dtype))
        offs = np.zeros(len(many) + 1, np.int64)
        np.cumsum(many, out=offs[1:])
        doc = np.repeat(np.arange(len(many)), many)
        start = self.of[:-1][doc] + (np.arange(offs[-1]) - offs[:-1][doc])
        end = np.minimum(start + width, self.of[1:][doc])
        return range_hash(self.hash, start, end, base), offs

    def sentences(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word and end word of each sentence, and the documents' sentence offsets.

        A sentence ends after a word that ends in ``.``, ``!`` or ``?``, before a newline, and at the end of the text.
        """
        n = len(self.start)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(self.of), np.int64)
        last = self.data[self.end - 1]
        closes = (last == 46) | (last == 33) | (last == 63)
        lines = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data == 10) | (self.data == 13), out=lines[1:])
        closes[:-1] |= lines[self.start[1:]] > lines[self.end[:-1]]
        closes[self.of[1:][self.of[1:] > 0] - 1] = True
        end = np.flatnonzero(closes) + 1
        start = np.concatenate([[0], end[:-1]])
        return start, end, np.searchsorted(start, self.of)
