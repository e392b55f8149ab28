"""Sets of word shingles of whole texts as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np

from sozgar.llm.common import mix64
from sozgar.llm.words import CHUNK, word_hashes

SHINGLE = 5
_ODD = [np.uint64(x | 1) for x in mix64(np.arange(101, 101 + 64, dtype=np.uint64)).tolist()]


def _together(words: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    total = np.full(len(starts), width, np.uint64)
    for k in range(width):
        total += words[starts + k] * _ODD[k]
    return mix64(total)


def _chunk(texts: list[bytes], width: int) -> list[np.ndarray]:
    words, first = word_hashes(texts)
    counts = np.diff(first)
    whole = np.maximum(counts - width + 1, 0)
    at = np.repeat(first[:-1] - (np.cumsum(whole) - whole), whole) + np.arange(whole.sum())
    cut = np.concatenate([[0], np.cumsum(whole)]).tolist()
    hashes = _together(words, at, width)
    out = [np.unique(hashes[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
    for i in np.flatnonzero((counts > 0) & (counts < width)).tolist():
        out[i] = _together(words, first[i : i + 1], int(counts[i]))
    return out


def shingle_sets(texts: list[bytes], width: int = SHINGLE) -> list[np.ndarray]:
    """The distinct shingles of each text; with fewer words the whole sequence is one; without words the set is empty."""
    found, some, held = [], [], 0
    for t in texts:
        some.append(t)
        held += len(t)
        if held >= CHUNK:
            found += _chunk(some, width)
            some, held = [], 0
    return found + (_chunk(some, width) if some else [])
