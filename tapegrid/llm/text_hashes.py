"""Word and shingle hashes of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes hashed at once, so that intermediate arrays stay in the CPU's caches.
SEGMENT = 1 << 17
_M = np.uint64(0x9E3779B97F4A7C15)
_M_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's powers 0 .. n - 1, and those of its inverse."""
    if len(_powers[0]) < n:
        for k, m in enumerate((_M, _M_INVERSE)):
            _powers[k] = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n - 1, m, np.uint64))))
    return _powers[0][:n], _powers[1][:n]


def _segments(buffer: np.ndarray, space: np.ndarray) -> Iterator[tuple[int, int]]:
    """Parts of about SEGMENT bytes that end at white space."""
    start, n = 0, len(buffer)
    while start < n:
        end = min(start + SEGMENT, n)
        while end < n:
            last = np.flatnonzero(space[start:end])
            if len(last):
                end = start + int(last[-1]) + 1
                break
            end = min(end + SEGMENT, n)
        yield start, end
        start = end


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hash, start and length of every word (A-Z in lower case), and the first word of each text and of the end."""
    joined = np.frombuffer(b" ".join(texts), np.uint8)
    if not len(joined):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(texts) + 1, np.int64)
    space = _SPACE[joined]
    hashes, starts, lengths = [], [], []
    for a, b in _segments(joined, space):
        word = np.r_[False, ~space[a:b], False]
        edge = np.flatnonzero(word[1:] != word[:-1])
        s, e = edge[::2], edge[1::2]
        up, down = powers(b - a + 1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((_LOWER[joined[a:b]].astype(np.uint64) + np.uint64(1)) * up[:-1])))
        hashes.append(mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        starts.append(s + a)
        lengths.append(e - s)
    at = np.concatenate(starts)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    first = np.searchsorted(at, np.r_[0, np.cumsum(sizes)])
    return np.concatenate(hashes), at, np.concatenate(lengths), first


def shingle_sets(texts: list[bytes], words: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; with fewer words the whole sequence is one; without words none."""
    h, _, _, first = word_hashes(texts)
    n = max(0, len(h) - words + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(words):
        rolled = rolled * _M + h[k : k + n]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            part = np.sort(rolled[a : b - words + 1])
            out.append(part[np.r_[True, part[1:] != part[:-1]]])
        elif b > a:
            one = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                one = mix(one * _M + h[k : k + 1])
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
