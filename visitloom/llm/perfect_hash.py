"""A minimal perfect hash of distinct 64-bit keys, in numpy: levels of bits with ranks.

At each level the keys that are left take a place in a bit array of ``GAMMA`` bits a key; those
alone in their place set its bit and are settled, the rest go on to the next level. A key's slot is
the number of bits set before its own. A key that was never given may find some slot: whoever
asks compares the key stored there.
"""

from __future__ import annotations

import numpy as np

GAMMA = 2.0
_WORD = np.uint64(64)


def scrambled(keys: np.ndarray, salt: int) -> np.ndarray:
    """Well-mixed 64-bit values of 64-bit keys."""
    x = keys.astype(np.uint64, copy=True)
    x ^= np.uint64((salt * 0x9E3779B97F4A7C15 + 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (((scrambled(keys, level + 1) >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)).astype(np.int64)


class PerfectHash:
    """Slots 0 to n - 1 of n distinct keys."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []  # (bits, packed bits, slots before each word)
        left, settled = np.asarray(keys).astype(np.uint64), 0
        if len(np.unique(left)) != len(left):
            raise ValueError("keys are not distinct")
        while len(left):
            size = max(64, int(GAMMA * len(left)))
            at = _place(left, len(self.levels), size)
            alone = np.bincount(at, minlength=-(-size // 64) * 64) == 1
            packed = np.packbits(alone, bitorder="little").view(np.uint64)
            ranks = settled + np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]])
            self.levels.append((size, packed, ranks))
            settled += int(alone.sum())
            left = left[~alone[at]]
        self.size = settled

    def slots(self, asked: np.ndarray) -> np.ndarray:
        """A slot of each asked key, -1 for keys that no level knows."""
        asked = np.asarray(asked).astype(np.uint64)
        out = np.full(len(asked), -1, dtype=np.int64)
        open_ = np.arange(len(asked))
        for level, (size, packed, ranks) in enumerate(self.levels):
            if not len(open_):
                break
            at = _place(asked[open_], level, size)
            word, bit = packed[at >> 6], (at & 63).astype(np.uint64)
            hit = ((word >> bit) & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[hit]] = (ranks[at >> 6] + below)[hit]
            open_ = open_[~hit]
        return out
