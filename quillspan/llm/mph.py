"""A minimal perfect hash over 64-bit keys, in numpy: levels of bits, the rank of a key's bit is its slot."""

from __future__ import annotations

import numpy as np

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(keys: np.ndarray, level: int) -> np.ndarray:
    """Another 64-bit hash of the keys for each level (the finalizer of the published splitmix64 generator)."""
    with np.errstate(over="ignore"):
        x = keys + _GOLD * np.uint64(level + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class MinimalPerfectHash:
    """About 3 bits a key. A key that was not built in may get any slot or -1: callers compare a fingerprint."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # 64-bit words of each level's bits
        counts = [np.bitwise_count(x).astype(np.int64) for x in levels]
        bases = np.concatenate(([0], np.cumsum([c.sum() for c in counts])))[:-1] if levels else []
        self.ranks = [b + np.concatenate(([0], np.cumsum(c)[:-1])) for b, c in zip(bases, counts, strict=True)]

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> MinimalPerfectHash:
        """Of distinct keys. Keys alone at their bit stay in a level, the others go on to the next."""
        levels, rest, level = [], keys.astype(np.uint64), 0
        while len(rest):
            words = int(len(rest) * gamma) // 64 + 1
            at = (mix(rest, level) % np.uint64(words * 64)).astype(np.int64)
            alone = np.bincount(at, minlength=words * 64) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            rest, level = rest[~alone[at]], level + 1
            if level > 200:
                raise ValueError("the keys are not distinct")
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        found = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (words, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(open_):
                break
            at = mix(keys[open_], level) % np.uint64(len(words) * 64)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            value = words[word]
            hit = (value >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(value & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            found[open_[hit]] = (ranks[word] + below)[hit]
            open_ = open_[~hit]
        return found

    def to_bytes(self) -> bytes:
        head = np.array([len(self.levels), *(len(x) for x in self.levels)], np.int64)
        return head.tobytes() + b"".join(x.tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> MinimalPerfectHash:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        sizes = np.frombuffer(data, np.int64, n, 8)
        words = np.frombuffer(data, np.uint64, offset=8 * (n + 1))
        return cls(np.split(words, np.cumsum(sizes)[:-1]) if n else [])
