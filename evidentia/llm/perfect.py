"""Minimal perfect hashing of integers: levels of bits, a key's place is the rank of its bit."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from evidentia.llm.common import mixed
from evidentia.llm.features import BASE

#: Bits of a level for each key that is left.
LOAD = 1.5


def level_bits(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """The bit of each key in a level of ``size`` bits."""
    h = mixed(keys.astype(np.uint64) ^ np.uint64((level + 1) * int(BASE) % (1 << 64)))
    return (((h >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)).astype(np.int64)


@dataclass
class MinimalHash:
    """A bijection of ``count`` keys to the numbers below ``count``.

    In each level, keys whose bit no other key takes have found their place; the rest goes on to the next level. The
    place is the number of bits set before. A key that is not among the built ones gets some place: compare the key.
    """

    levels: list[bytes]
    count: int

    @staticmethod
    def build(keys: np.ndarray) -> MinimalHash:
        left, levels, placed = keys.astype(np.int64), [], 0
        while len(left):
            size = max(64, -(-int(len(left) * LOAD) // 64) * 64)
            bit = level_bits(left, len(levels), size)
            taken = np.bincount(bit, minlength=size)
            levels.append(np.packbits(taken == 1, bitorder="little").tobytes())
            alone = taken[bit] == 1
            placed += int(alone.sum())
            left = left[~alone]
            if len(levels) > 200:
                raise ValueError("keys repeat")
        return MinimalHash(levels, placed)

    def ready(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each level, its bits as words of 64 and the number of bits set before each word."""
        out, before = [], 0
        for level in self.levels:
            words = np.frombuffer(level, dtype="<u8")
            ones = np.bitwise_count(words).astype(np.int64)
            out.append((words, before + np.concatenate(([0], np.cumsum(ones)[:-1]))))
            before += int(ones.sum())
        return out


def places(ready: list[tuple[np.ndarray, np.ndarray]], keys: np.ndarray) -> np.ndarray:
    at, left = np.zeros(len(keys), dtype=np.int64), np.arange(len(keys))
    for level, (words, ranks) in enumerate(ready):
        if not len(left):
            break
        bit = level_bits(keys[left], level, len(words) * 64)
        word, low = words[bit >> 6], (bit & 63).astype(np.uint64)
        hit = (word >> low) & np.uint64(1) == 1
        before = np.bitwise_count(word & ((np.uint64(1) << low) - np.uint64(1)))
        at[left[hit]] = ranks[bit[hit] >> 6] + before[hit]
        left = left[~hit]
    return at


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (((mixed(keys ^ np.int64(-1)) >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


class ShardedHash:
    """One hash made of a hash for each shard: the places of a shard follow those of the shards before it."""

    def __init__(self, shards: list[MinimalHash]):
        self.shards = shards
        self.first = np.concatenate(([0], np.cumsum([s.count for s in shards]))).astype(np.int64)
        self._ready: dict[int, list] = {}

    def places(self, keys: np.ndarray) -> np.ndarray:
        shard, at = shard_of(keys, len(self.shards)), np.zeros(len(keys), dtype=np.int64)
        for i in np.unique(shard).tolist():
            if i not in self._ready:
                self._ready[i] = self.shards[i].ready()
            own = np.flatnonzero(shard == i)
            at[own] = self.first[i] + places(self._ready[i], keys[own])
        return at
