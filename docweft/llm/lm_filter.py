"""A log-frequency Bloom filter: quantised counts as members (key, 1), ..., (key, level), read by repeated membership probes.

A filter is sized by its members, so no count is ever left out; a corpus has many filters, one for each shard of its keys,
and their number follows the input while the size of each has a bound.
"""

from __future__ import annotations

import numpy as np

PROBES, BITS_A_MEMBER = 6, 12
#: The least count of each level: whole numbers nearest above the half powers of two, each once.
LEAST = np.unique(np.ceil(2 ** (np.arange(0, 124) / 2) - 1e-9).astype(np.int64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; x is uint64."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def level_of(counts: np.ndarray) -> np.ndarray:
    """The level of each count: 1, 2, 3 and 4 for 1, 2, 3 and 4 to 5, then two for each power of two; 0 for no count."""
    return np.searchsorted(LEAST, counts, "right")


def count_of(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts that have a level; 0 for level 0."""
    at = np.maximum(levels, 1)
    return np.where(levels > 0, (LEAST[at - 1] + LEAST[at] - 1) / 2, 0.0)


class Filter:
    """The bits of one shard's keys (distinct, uint64) of levels above 0."""

    def __init__(self, keys: np.ndarray, levels: np.ndarray, bits_a_member: int = BITS_A_MEMBER):
        self.size = np.uint64(max(64, int(levels.sum()) * bits_a_member))
        bits = np.zeros(int(self.size), bool)
        for level in range(1, int(levels.max(initial=0)) + 1):
            one, two = _steps(keys[levels >= level], level)
            for p in range(PROBES):
                bits[(one + np.uint64(p) * two) % self.size] = True
        self.bits = np.packbits(bits, bitorder="little")

    def has(self, keys: np.ndarray, level: int) -> np.ndarray:
        """The places of the keys that are members at a level, but for false positives (0.4 % of the others)."""
        alive = np.arange(len(keys))
        one, two = _steps(keys, level)
        for p in range(PROBES):
            at = (one[alive] + np.uint64(p) * two[alive]) % self.size
            alive = alive[(self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        return alive

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key: probe 1, 2, ... until one isn't a member."""
        out, alive, level = np.zeros(len(keys), np.uint8), np.arange(len(keys)), 0
        while len(alive) and level < len(LEAST) - 1:
            level += 1
            alive = alive[self.has(keys[alive], level)]
            out[alive] = level
        return out


def _steps(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    one = mix(keys + np.uint64((level * 0x9E3779B97F4A7C15) & (2**64 - 1)))
    return one, mix(one ^ np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
