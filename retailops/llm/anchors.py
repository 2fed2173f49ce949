"""Cutting sequences into anchored segments, so that equal windows meet.

A window is W consecutive symbols of one sequence. Its anchor is the K-gram in it with the least hash (the leftmost of equal
ones), so equal windows have equal anchors at equal places. The consecutive windows of a sequence that share an anchor form
a segment; every window lies in exactly one. Two windows of different segments can be equal only if the anchors are.

All of this is vectorised over a batch of sequences; a sequence of any length is worked on in overlapping pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

U = np.uint64
_PLACE = 24
_LOW = U((1 << _PLACE) - 1)
#: Symbols worked on at a time: bounds the memory of a task.
BATCH = 1 << 18
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTES = mix(np.arange(1, 257, dtype=U))


class Powers:
    """Powers of a base and of its inverse modulo 2**64, for hashes of substrings in constant time."""

    def __init__(self, base: int):
        self.base, self.inverse = U(base), U(pow(base, -1, 1 << 64))
        self.up = self.down = np.zeros(0, U)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (np.cumprod(np.full(n + 1024, b, U)) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


POWERS = tuple(Powers(b) for b in _BASES)


class Hashes:
    """Hashes of any substring of a sequence of symbols; which: one of two independent bases."""

    def __init__(self, symbols: np.ndarray, which: int = 0):
        up, self.down = POWERS[which].of(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, U)
        np.cumsum(symbols * up[: len(symbols)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def word_symbols(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts given as one byte array: (symbols, words of each text, first byte, end byte).

    Words are runs of bytes other than 20 and 09-0D; a text's end ends its last word.
    """
    space = (data == 32) | ((data >= 9) & (data <= 13))
    word = ~space
    first = word.copy()
    ends = np.cumsum(sizes)
    starts = ends - sizes
    first[1:] &= space[:-1]
    cut = starts[(sizes > 0)]
    first[cut] = word[cut]
    begin = np.flatnonzero(first)
    last = word.copy()
    last[:-1] &= space[1:]
    cut = ends[(sizes > 0)] - 1
    last[cut] = word[cut]
    end = np.flatnonzero(last) + 1
    h = Hashes(BYTES[data])
    symbols = h.of(begin, end) + (end - begin).astype(U)
    counts = np.searchsorted(begin, ends) - np.searchsorted(begin, starts)
    return symbols, counts, begin, end


_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def symbols_of(text: bytes) -> np.ndarray:
    """The words of one text of any length, worked on in pieces that end at white space."""
    parts, start = [], 0
    while start < len(text):
        gap = _SPACE.search(text, start + BATCH)
        end = gap.start() if gap else len(text)
        parts.append(word_symbols(np.frombuffer(text, np.uint8, end - start, start), np.array([end - start]))[0])
        start = end
    return np.concatenate([np.zeros(0, U), *parts])


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Minima over every w consecutive elements."""
    k = 1
    while 2 * k <= w:
        x = np.minimum(x[: len(x) - k], x[k:])
        k *= 2
    r = w - k
    return np.minimum(x[: len(x) - r], x[r:]) if r else x


def segments(symbols: np.ndarray, sizes: np.ndarray, w: int, k: int) -> dict[str, np.ndarray]:
    """The segments of consecutive sequences: seq, lo and hi (first and last window start), off (anchor's place), anchor, seg (hash of the content)."""
    n = len(symbols)
    out = {x: np.zeros(0, np.int64) for x in ("seq", "lo", "hi", "off")} | {x: np.zeros(0, U) for x in ("anchor", "seg")}
    if n < w:
        return out
    ends = np.cumsum(sizes)
    starts = ends - sizes
    h = Hashes(symbols)
    gram = h.of(np.arange(n - k + 1), np.arange(k, n + 1))
    at = (_least((gram & ~_LOW) | np.arange(n - k + 1, dtype=U), w - k + 1) & _LOW).astype(np.int64)  # by window start
    seq = np.repeat(np.arange(len(sizes)), sizes)
    inside = seq[: n - w + 1] == seq[w - 1 :]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (seq[1 : len(at)] != seq[: len(at) - 1]) | ~inside[:-1]
    lo = np.flatnonzero(new & inside)
    if not len(lo):
        return out
    # a segment ends before the next that begins, or where windows leave the sequence
    stop = np.minimum(np.append(lo[1:], len(at)), ends[seq[lo]] - w + 1)
    hi = stop - 1
    other = Hashes(mix(symbols), 1)
    seg = mix(other.of(lo, hi + w) ^ ((hi - lo).astype(U) << U(32)) ^ (at[lo] - lo).astype(U))
    base = starts[seq[lo]]
    return {"seq": seq[lo], "lo": lo - base, "hi": hi - base, "off": at[lo] - base, "anchor": gram[at[lo]], "seg": seg}


def pieces(sizes: list[int], w: int) -> Iterator[tuple[list[int], int]]:
    """Groups of sequences of BATCH symbols together at most, as (their numbers, 0), or pieces of a longer one, as ([number], first symbol)."""
    group: list[int] = []
    total = 0
    for i, n in enumerate(sizes):
        if n > BATCH:
            yield from (([i], s) for s in range(0, max(n - w + 1, 1), BATCH - w + 1))
            continue
        if total + n > BATCH and group:
            yield group, 0
            group, total = [], 0
        group.append(i)
        total += n
    if group:
        yield group, 0
