"""Hashes of the words of many texts at once, in numpy.

Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return.  A word's
hash is a polynomial in its bytes, taken from running sums over the whole buffer, and then mixed to 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        out = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        _POWERS[:] = out
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts`` in order, and the number of words of each text;
    ``lower`` lower-cases A-Z."""
    buf = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    buf = LOWER[buf] if lower else buf
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, dtype=np.int64)
    inside = ~SPACE[buf]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0))
    first, last = edge[::2], edge[1::2]
    up, down = _powers(len(buf))
    sums = np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up)
    before = np.where(first > 0, sums[first - 1], np.uint64(0))
    hashes = mix((sums[last - 1] - before) * down[first] + (last - first).astype(np.uint64))
    upto = np.searchsorted(first, ends)
    return hashes, np.diff(upto, prepend=0)


def in_rounds(texts: Iterable[bytes | None], size: int = 1_000_000) -> Iterator[list[bytes]]:
    """The texts in lists of together about ``size`` bytes; null is the empty text."""
    held, total = [], 0
    for text in texts:
        held.append(text or b"")
        total += len(held[-1])
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the runs of ``words`` words of each text, one text after another, and their
    number for each text.  A shorter text has the one run of all its words, and a text without words none."""
    hashes, counts = word_hashes(texts)
    lone = (counts > 0) & (counts < words)
    runs = np.where(lone, 1, np.maximum(counts - words + 1, 0))
    starts = np.cumsum(counts) - counts
    text_of = np.repeat(np.arange(len(texts)), runs)
    at = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(starts, runs)
    padded = np.concatenate([hashes, np.zeros(words, dtype=np.uint64)])
    length = np.minimum(counts, words)[text_of]
    value = np.zeros(len(at), dtype=np.uint64)
    for k in range(words):
        value = np.where(k < length, value * np.uint64(BASE) + padded[at + k] + np.uint64(k + 1), value)
    value = mix(value)
    order = np.lexsort((value, text_of))
    value, text_of = value[order], text_of[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (text_of[1:] != text_of[:-1])
    return value[new], np.bincount(text_of[new], minlength=len(texts))
