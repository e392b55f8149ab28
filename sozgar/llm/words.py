"""Byte-level work on whole texts with numpy: classes of bytes, runs of letters or non-blanks, hashes of runs.

Texts are laid end to end, each followed by a line feed, so no run crosses texts. A run's hash is a
polynomial over a table of random 64-bit values, taken from running sums, so all runs of a chunk are
hashed at once.
"""

from __future__ import annotations

import numpy as np

from sozgar.llm.common import mix64, worker_cache

#: Texts are worked on in chunks of about so many bytes.
CHUNK = 1 << 19
_P = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_P, -1, 1 << 64)
BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64))

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i below n; kept per worker and doubled when too short."""
    kept = worker_cache("powers", dict)
    if kept.get("n", 0) < n:
        size = max(n, 2 * kept.get("n", CHUNK))
        for name, base in (("up", _P), ("down", _INVERSE)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            kept[name] = np.multiply.accumulate(a)
        kept["n"] = size
    return kept["up"], kept["down"]


def lay(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, a line feed after each, and where each text begins (one more at the end)."""
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8) if texts else np.zeros(0, np.uint8)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return buffer, starts


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true."""
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    return edge[0::2], edge[1::2]


class RunHasher:
    """64-bit hashes of runs of bytes; equal runs have equal hashes wherever they stand."""

    def __init__(self, values: np.ndarray):
        up, self.down = _powers(len(values) + 1)
        self.total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[values] * up[: len(values)], out=self.total[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.total[ends] - self.total[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def hash_runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return RunHasher(values)(starts, ends)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of non-blanks, A-Z lower-cased) of all texts, and where each text's begin."""
    buffer, at = lay(texts)
    starts, ends = runs(~BLANK[buffer])
    return hash_runs(LOWER[buffer], starts, ends), np.searchsorted(starts, at)


def hash_word(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(hash_runs(raw, np.array([0]), np.array([len(raw)]))[0])
