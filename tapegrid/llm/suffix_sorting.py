"""Two-stage suffix sorting in numpy, to a stated depth."""

from __future__ import annotations

import numpy as np


def heads(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as one number in the same order; zeros after the end."""
    padded = np.concatenate((text, np.zeros(8, np.uint8))).astype(np.uint64)
    two = (padded[:-1] << np.uint64(8)) | padded[1:]
    four = (two[:-2] << np.uint64(16)) | two[2:]
    return ((four[:-4] << np.uint64(32)) | four[4:])[: len(text)]


def rising(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor. Zeros (separators) count as such."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])
    # The next place with another byte decides; behind the last there is nothing, which is smaller.
    nxt = np.searchsorted(change, np.arange(n))
    after = np.full(n, -1, np.int16)
    inside = nxt < len(change)
    after[inside] = text[change[nxt[inside]] + 1]
    return (text < after) | (text == 0)


def sorted_directly(head: np.ndarray, rows: np.ndarray, depth: int) -> np.ndarray:
    """rows (positions) by their suffixes' first `depth` bytes; ties by position."""
    padded = np.concatenate((head, np.zeros(depth, np.uint64)))
    key = padded[rows]
    order = np.argsort(key, kind="stable")
    rows, key = rows[order], key[order]
    group = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1 if len(rows) else np.zeros(0, np.int64)
    open_rows = np.arange(len(rows))
    for at in range(8, depth, 8):
        size = np.bincount(group[open_rows], minlength=len(rows) + 1)
        open_rows = open_rows[size[group[open_rows]] > 1]
        if not len(open_rows):
            break
        key = padded[rows[open_rows] + at]
        order = np.lexsort((key, group[open_rows]))
        rows[open_rows] = rows[open_rows][order]
        key, own = key[order], group[open_rows]  # groups stay in their places
        new = np.r_[True, (key[1:] != key[:-1]) | (own[1:] != own[:-1])]
        # Groups get the number of their first row, so that they stay in order and apart.
        group[open_rows] = open_rows[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
    return rows


def suffix_array(text: np.ndarray, head: np.ndarray, depth: int) -> np.ndarray:
    """All positions of text, which ends with a zero, by their suffixes' first `depth` bytes at least.

    Suffixes smaller than their successors are sorted directly. Going through the
    buckets of first bytes from the smallest on, each bucket is complete when its turn
    comes: the larger ones, found from smaller buckets, stand before the smaller ones;
    and each of its suffixes tells the place of its predecessor, if that one is larger.
    """
    up = rising(text)
    direct = sorted_directly(head, np.flatnonzero(up), depth)
    first = text[direct]
    bound = np.searchsorted(first, np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in np.flatnonzero(np.bincount(text, minlength=256)).tolist():
        layer = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        bucket = [layer]
        while len(layer) and c:  # runs of one byte: each is behind those with a smaller second byte
            layer = layer[layer > 0] - 1
            layer = layer[text[layer] == c]
            bucket.append(layer)
        bucket.append(direct[bound[c] : bound[c + 1]])
        own = np.concatenate(bucket)
        out.append(own)
        before = own[own > 0] - 1
        byte = text[before]
        larger = byte > c
        before, byte = before[larger], byte[larger]
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        cut = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]]) if len(byte) else np.zeros(0, np.int64)
        for k, part in zip(byte[cut].tolist(), np.split(before, cut[1:]) if len(byte) else [], strict=True):
            induced[k].append(part)
    return np.concatenate(out)


def adjacent_prefixes(head: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each suffix of order but the first: whether it shares its first `length` (8 or more) bytes with the one before."""
    padded = np.concatenate((head, np.zeros(length, np.uint64)))
    same = np.ones(max(0, len(order) - 1), bool)
    for at in [*range(0, length - 8, 8), length - 8]:
        key = padded[order + at]
        same &= key[1:] == key[:-1]
    return same
