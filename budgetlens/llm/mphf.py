"""Minimal perfect hash over 128-bit digests, built level by level with bit arrays and ranks.

Each level hashes the keys that are left into ``gamma * keys`` slots; keys alone in their slot
stay there, the others go on to the next level. A key's index is the rank of its slot among
all occupied slots, so n keys get the indexes 0..n-1 and the structure itself takes a few bits a key.
"""

from __future__ import annotations

import numpy as np

from budgetlens.llm.common import mix64

GAMMA = 2.0


def _slot(lo: np.ndarray, hi: np.ndarray, level: int, slots: int) -> np.ndarray:
    return mix64(lo + hi * np.uint64(2 * level + 1) + np.uint64((level * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)) % np.uint64(slots)


class PerfectHash:
    """Levels are (slots, occupied bits, keys before each 512-bit block)."""

    def __init__(self, levels: list[tuple[int, np.ndarray]]):
        self.levels = []
        before = 0
        for slots, bits in levels:
            ones = np.bitwise_count(bits.view(np.uint64)).astype(np.int64)
            rank = before + np.concatenate(([0], np.cumsum(ones)))
            self.levels.append((slots, bits, bits.view(np.uint64), rank))
            before = int(rank[-1])
        self.n = before

    @classmethod
    def build(cls, lo: np.ndarray, hi: np.ndarray) -> PerfectHash:
        """``lo``/``hi``: distinct digests as uint64 halves."""
        levels, level = [], 0
        while len(lo):
            slots = max(64, int(GAMMA * len(lo)))
            at = _slot(lo, hi, level, slots)
            used = np.bincount(at.astype(np.int64), minlength=slots)
            alone = used[at.astype(np.int64)] == 1
            flags = np.zeros(-(-slots // 64) * 64, dtype=np.uint8)
            flags[at[alone].astype(np.int64)] = 1
            levels.append((slots, np.packbits(flags, bitorder="little")))
            lo, hi, level = lo[~alone], hi[~alone], level + 1
        return cls(levels)

    def index(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Index of each key; an alien key gets any index or -1 (the caller compares fingerprints)."""
        out = np.full(len(lo), -1, dtype=np.int64)
        left = np.arange(len(lo))
        for level, (slots, _, words, rank) in enumerate(self.levels):
            if not len(left):
                break
            at = _slot(lo[left], hi[left], level, slots)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (words[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[hit]] = rank[word[hit]] + below[hit]
            left = left[~hit]
        return out

    def pack(self) -> bytes:
        head = np.array([len(self.levels), *(s for s, *_ in self.levels)], dtype=np.int64)
        return head.tobytes() + b"".join(bits.tobytes() for _, bits, _, _ in self.levels)

    @classmethod
    def unpack(cls, blob: bytes) -> PerfectHash:
        k = int(np.frombuffer(blob, np.int64, 1)[0])
        slots = np.frombuffer(blob, np.int64, k, 8).tolist()
        at, levels = 8 * (k + 1), []
        for s in slots:
            size = -(-s // 64) * 8
            levels.append((s, np.frombuffer(blob, np.uint8, size, at)))
            at += size
        return cls(levels)
