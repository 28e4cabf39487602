"""Word shingles and MinHash signatures of many texts at once, in numpy over the bytes of an Arrow batch.

A word is a run of bytes above the space, ASCII letters lower-cased. A text of fewer than `width` words has one shingle
of all its words; a text without a word has none, and a signature of all ones.
"""

from __future__ import annotations

import numpy as np

from .common import AT_END, mix64

RADIX = np.uint64(0x9E3779B97F4A7C15)
BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * RADIX)
BYTE[65:91] = BYTE[97:123]
STEP = [np.uint64(pow(0xD1B54A32D192ED03, k, 1 << 64)) for k in range(64)]
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """RADIX and its inverse modulo 2**64, to the powers 0 to n - 1."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for i, base in enumerate((int(RADIX), pow(int(RADIX), -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def without_powers() -> None:
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


AT_END.append(without_powers)


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of each text, in order, and the number of words of each text."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(off) - 1, np.int64)
    black = raw > 32
    start = black.copy()
    start[1:] &= ~black[:-1]
    fresh = off[:-1][off[:-1] < off[1:]]
    start[fresh] = black[fresh]
    at = np.flatnonzero(start)
    up, down = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(np.where(black, BYTE[raw] * up, np.uint64(0)), out=sums[1:])
    ends = np.append(at[1:], n)
    return mix64((sums[ends] - sums[at]) * down[at]), np.diff(np.searchsorted(at, off))


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each shingle of each text, in order, and the number of shingles of each text."""
    owner = np.repeat(np.arange(len(counts)), counts)
    total = words.copy()
    for k in range(1, width):
        same = owner[k:] == owner[:-k]
        total[: len(total) - k][same] += words[k:][same] * STEP[k]
    got = np.maximum(counts - (width - 1), np.minimum(counts, 1))
    place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    return mix64(total[place < np.repeat(got, counts)]), got


def distinct(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted set of hashes of each text, and its size."""
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[keep], np.bincount(o[keep], minlength=len(counts)).astype(np.int64)


class MinHash:
    """`size` hashes of a strongly universal family, from a seed: the upper 32 bits of a x + b modulo 2**64, x of 32 bits and a
    odd, so that each is a permutation of 64 bits. The first ones of a larger size are those of a smaller one."""

    def __init__(self, size: int, seed: int = 11):
        drawn = np.random.default_rng(seed).integers(0, 1 << 64, (size, 2), dtype=np.uint64)
        self.a, self.b = drawn[:, 0] | np.uint64(1), drawn[:, 1]

    def signatures(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """(texts, size) of uint32."""
        out = np.full((len(counts), len(self.a)), 0xFFFFFFFF, np.uint32)
        full = np.flatnonzero(counts)
        if not len(full):
            return out
        starts = (np.cumsum(counts) - counts)[full]
        x = hashes >> np.uint64(32)
        least, h = np.empty((len(self.a), len(full)), np.uint64), np.empty_like(x)
        for i, (a, b) in enumerate(zip(self.a, self.b)):
            np.multiply(x, a, out=h)
            np.add(h, b, out=h)
            np.minimum.reduceat(h, starts, out=least[i])
        out[full] = (least >> np.uint64(32)).T
        return out


def bands_for(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows a band with which at most `most` hashes find a pair of similarity `threshold` with
    probability `recall`, and the fewest bands for it. Recall is of the banding alone; ties in a bucket cost none."""
    best = (most, 1)
    for rows in range(1, most + 1):
        bands = next((b for b in range(1, most // rows + 1) if (1 - threshold**rows) ** b <= 1 - recall), None)
        if bands:
            best = (bands, rows)
    return best
