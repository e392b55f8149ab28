"""Anchors of fixed-length windows: the rightmost smallest k-gram hash inside each window.

Equal windows have their anchor at the same place, so windows that occur twice meet at a k-gram that
occurs twice. The windows with the same anchor start one after the other; one row stands for them all.
"""

from __future__ import annotations

import numpy as np

from sozgar.llm.words import RunHasher

KGRAM = 20
_LOW = 20
_MASK = np.uint64((1 << _LOW) - 1)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` consecutive values, from running minima of blocks in both directions."""
    n = len(values)
    if n < width:
        return values[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def rightmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """Of each ``width`` consecutive values: the place of the smallest (by its upper 44 bits), of equal ones the last."""
    found = []
    step = (1 << _LOW) - width  # places inside a piece fit in the lower bits
    for start in range(0, len(values) - width + 1, step):
        part = values[start : start + step + width - 1]
        packed = (part >> np.uint64(_LOW) << np.uint64(_LOW)) | (_MASK - np.arange(len(part), dtype=np.uint64))
        found.append(start + (_MASK - (sliding_min(packed, width) & _MASK)).astype(np.int64))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def anchors(buffer: np.ndarray, starts: np.ndarray, window: int, kgram: int = KGRAM, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, its hash, first window, last window) for each run of windows; all are places in ``buffer``.

    ``starts``: where texts begin (one more at the end); the byte before each next text belongs to none.
    ``bits``: of the hash; fewer make more windows meet, nothing else.
    """
    none = np.zeros(0, np.int64)
    n = len(buffer)
    if n < window:
        return none, none.astype(np.uint64), none, none
    at = np.arange(n - kgram + 1)
    hashes = RunHasher(buffer)(at, at + kgram) >> np.uint64(64 - bits) << np.uint64(64 - bits)
    whole = np.zeros(n + 1, np.int64)
    lengths = np.diff(starts) - 1
    keep = lengths >= window
    np.add.at(whole, starts[:-1][keep], 1)
    np.add.at(whole, starts[:-1][keep] + lengths[keep] - window + 1, -1)
    least = rightmost_least(hashes, window - kgram + 1)
    first = np.flatnonzero(np.cumsum(whole)[: len(least)] > 0)
    if not len(first):
        return none, none.astype(np.uint64), none, none
    anchor = least[first]
    begins = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(first, prepend=-2) != 1))
    ends = np.append(begins[1:], len(first)) - 1
    return anchor[begins], hashes[anchor[begins]], first[begins], first[ends]
