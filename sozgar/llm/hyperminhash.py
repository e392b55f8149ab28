"""HyperMinHash sketches: per bucket the leading zeros of the smallest hash and its next bits.

A sketch holds ``2**P`` registers of 16 bits: 6 bits of leading zeros, 10 bits of mantissa. Registers
that two sets share estimate their Jaccard similarity, less the matches that chance alone makes. For
banding, empty registers borrow from others in an order that depends on the register alone, so equal
sets borrow alike.
"""

from __future__ import annotations

import numpy as np

from sozgar.llm.common import mix64

P, MANTISSA = 8, 10
REGISTERS = 1 << P
EMPTY = 0xFFFF
#: Registers in a band. Of pairs at 0.85, 0.623**42 (2e-9) share no band; at 0.3, 0.03 share one.
ROWS = 6
BANDS = REGISTERS // ROWS
#: The constant of the expected number of chance matches for equal sizes (published with the sketch).
CHANCE = 0.169919487159739
_ODD = mix64(np.arange(51, 51 + ROWS, dtype=np.uint64)) | np.uint64(1)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, registers) of unsigned 16-bit; the sets are sorted, so a bucket's smallest hash is its first."""
    out = np.full((len(sets), REGISTERS), EMPTY, np.uint16)
    if not sets:
        return out
    hashes = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    place = row * REGISTERS + (hashes >> np.uint64(64 - P)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    rest = (hashes[first] << np.uint64(P)) >> np.uint64(11)
    part, exponent = np.frexp(rest.astype(np.float64))
    zeros = np.minimum(53 - exponent, 62)
    mantissa = np.where(rest > 0, (part * 2 - 1) * (1 << MANTISSA), 0).astype(np.int64)
    out.reshape(-1)[place[first]] = (zeros << MANTISSA | mantissa).astype(np.uint16)
    return out


def _probes(step: int) -> np.ndarray:
    return (mix64(np.arange(REGISTERS, dtype=np.uint64) + np.uint64(1 + step * REGISTERS)) >> np.uint64(20)).astype(np.int64) % REGISTERS


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """(sketches, BANDS) of signed 64-bit: a hash of each band's registers; empty registers are filled by borrowing."""
    full = sketches.copy()
    held = (sketches != EMPTY).sum(1)
    single = np.flatnonzero(held == 1)
    if len(single):
        full[single] = sketches[single].min(1)[:, None]
    row, column = np.nonzero((full == EMPTY) & (held > 0)[:, None])
    step = 0
    while len(row):
        value = sketches[row, _probes(step)[column]]
        found = value != EMPTY
        full[row[found], column[found]] = value[found]
        row, column, step = row[~found], column[~found], step + 1
    bands = full[:, : BANDS * ROWS].reshape(len(full), BANDS, ROWS).astype(np.uint64)
    return mix64((bands * _ODD).sum(axis=2, dtype=np.uint64)).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated Jaccard similarities of rows, corrected for chance matches, and the registers they rest on."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(1)
    same = ((a == b) & (a != EMPTY)).sum(1)
    large, small = np.maximum(size_a, size_b).astype(float), np.maximum(np.minimum(size_a, size_b), 1).astype(float)
    ratio = large / small
    chance = CHANCE * 2.0 ** (P - MANTISSA) * 4 * ratio / (1 + ratio) ** 2 * (used / REGISTERS)
    return np.clip((same - chance) / np.maximum(used, 1), 0, 1), used
