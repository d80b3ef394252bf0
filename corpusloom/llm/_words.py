"""Words of UTF-8 texts in numpy: a block of texts is one array of bytes, and words are ranges in it."""

from __future__ import annotations

import numpy as np

R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(R, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Not an ASCII white space.
BLANK_SPLIT = np.ones(256, bool)
BLANK_SPLIT[[0x20, *range(0x09, 0x0E)]] = False

#: ASCII letters and digits after lower-casing, and every byte of a character beyond ASCII.
ALNUM_SPLIT = np.zeros(256, bool)
ALNUM_SPLIT[0x30:0x3A] = ALNUM_SPLIT[0x61:0x7B] = ALNUM_SPLIT[0x80:] = True


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base squared, ... modulo 2**64; kept for later calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 12), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if len(have) <= 1 << 21:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_ranges(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of words, and the index of each text's first word (one more than texts). No word crosses texts."""
    inside = table[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    begins, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begins, ends, np.searchsorted(begins, offsets)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) * R**position modulo 2**64 before each position."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(R, len(data)), out=out[1:])
    return out


def range_hashes(sums: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of bytes; equal bytes have equal hashes wherever they stand."""
    return mix((sums[ends] - sums[begins]) * powers(_RINV, len(sums))[begins] + (ends - begins).astype(np.uint64))
