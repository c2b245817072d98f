"""Words of UTF-8 texts as arrays: spans, 64-bit hashes, and hashes of windows of words.

A word is a run of bytes other than space and 0x09-0x0D, which in UTF-8 is the same as a run of such
characters. Hashes are of fixed functions, alike on every machine. Work arrays cover a bounded piece of
a text at a time, whatever its length.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes each output bit about half the time."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


STEP = np.uint64(0x9E3779B97F4A7C15)
BYTES = np.where(SPACE, np.uint64(0), mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * STEP))
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd number, by which a byte counts for its place in a word."""
    global _powers
    if len(_powers) < n:
        base = np.full(max(n, 1024), np.uint64(0xD1342543DE82EF95))
        base[0] = 1
        with np.errstate(over="ignore"):
            _powers = np.multiply.accumulate(base)
    return _powers[:n]


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text's bytes."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = SPACE[data]
    change = np.flatnonzero(space[1:] != space[:-1]) + 1
    edges = np.concatenate(([0] if not space[0] else [], change, [len(data)] if not space[-1] else [])).astype(np.int64)
    return edges[::2], edges[1::2]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    if ends[-1] - starts[0] > PIECE and len(starts) > 1:  # a piece of some words at a time
        cuts, at = [], 0
        while at < len(starts):
            end = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE)))
            cuts.append((at, end))
            at = end
        if len(cuts) > 1:
            return np.concatenate([hashes(data, starts[i:j], ends[i:j]) for i, j in cuts])
    size = ends - starts
    # Between words there are spaces, which count nothing; places run on from each word's start through them.
    a, b = int(starts[0]), int(ends[-1])
    length = np.empty_like(starts)
    length[:-1], length[-1] = starts[1:] - starts[:-1], b - starts[-1]
    place = np.arange(b - a) - np.repeat(starts - a, length)
    values = BYTES[data[a:b]]
    with np.errstate(over="ignore"):
        values *= powers(int(length.max()))[place]
        return mix(np.add.reduceat(values, starts - a) + size.astype(np.uint64) * STEP)


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n words in a row."""
    k = len(words) - n + 1
    if k <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = words[:k].copy()
        for i in range(1, n):
            out *= STEP
            out += words[i : i + k]
    return mix(out)


def text_words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A text's bytes and the spans of its words."""
    data = np.frombuffer(text, np.uint8)
    return (data, *spans(data))


def shingles(text: bytes, n: int) -> np.ndarray:
    """The sorted distinct hashes of n words in a row, A-Z in lower case; fewer words are one shingle."""
    data, starts, ends = text_words(text.translate(LOWER))
    words = hashes(data, starts, ends)
    if not len(words):
        return words
    return np.unique(windows(words, min(n, len(words))))
