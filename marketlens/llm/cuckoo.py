"""Cuckoo filters over 128-bit digests, one per shard, with exact deletion of inserted keys."""

from __future__ import annotations

import numpy as np

SLOTS = 4  # fingerprints per bucket
LOAD = 0.80
KICKS = 500


def _print(h2):
    """16-bit fingerprint, never 0."""
    return (h2 % np.uint64(65535)).astype(np.uint16) + np.uint16(1)


def _other(bucket, fp, mask):
    """The partner bucket; applying it twice gives the bucket back."""
    with np.errstate(over="ignore"):  # wraps modulo 2**64
        return (bucket ^ ((fp.astype(np.uint64) * np.uint64(0x5BD1E995C6A4A793)) >> np.uint64(20))) & mask


class Cuckoo:
    """``insert`` / ``remove`` / ``contains`` of keys (h1, h2) given as uint64 arrays."""

    def __init__(self, capacity: int = 0, table: np.ndarray | None = None):
        if table is None:
            buckets = 1 << max(2, int(np.ceil(np.log2(max(1, capacity) / (SLOTS * LOAD)))))
            table = np.zeros((buckets, SLOTS), np.uint16)
        self.table = table
        self.mask = np.uint64(len(table) - 1)

    @classmethod
    def of(cls, h1: np.ndarray, h2: np.ndarray) -> Cuckoo:
        """A filter that holds all keys; it grows until every insertion finds room."""
        capacity = max(1, len(h1))
        while True:
            f = cls(capacity)
            if f.insert(h1, h2):
                return f
            capacity *= 2

    def insert(self, h1: np.ndarray, h2: np.ndarray) -> bool:
        fps = _print(h2)
        first = h1 & self.mask
        second = _other(first, fps, self.mask)
        t = self.table
        for fp, a, b in zip(fps, first, second, strict=True):
            for at in (a, b):
                free = np.flatnonzero(t[at] == 0)
                if len(free):
                    t[at, free[0]] = fp
                    break
            else:
                at = b
                for kick in range(KICKS):
                    slot = kick % SLOTS
                    fp, t[at, slot] = t[at, slot], fp
                    at = _other(at, fp, self.mask)
                    free = np.flatnonzero(t[at] == 0)
                    if len(free):
                        t[at, free[0]] = fp
                        break
                else:
                    return False
        return True

    def remove(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Only keys that were inserted may be removed (the exact table decides which)."""
        fps = _print(h2)
        first = h1 & self.mask
        second = _other(first, fps, self.mask)
        for fp, a, b in zip(fps, first, second, strict=True):
            for at in (a, b):
                held = np.flatnonzero(self.table[at] == fp)
                if len(held):
                    self.table[at, held[0]] = 0
                    break

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        fps = _print(h2)
        a = h1 & self.mask
        b = _other(a, fps, self.mask)
        return (self.table[a] == fps[:, None]).any(1) | (self.table[b] == fps[:, None]).any(1)

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Cuckoo:
        return cls(table=np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())


class Shards:
    """All shards' filters stacked in one table, for one vectorised probe (read only)."""

    def __init__(self, filters: dict[int, bytes], n_shards: int):
        self.n = np.uint64(n_shards)
        tables = [np.frombuffer(filters.get(i, b"\0" * (2 * SLOTS)), np.uint16).reshape(-1, SLOTS) for i in range(n_shards)]
        self.base = np.concatenate([[0], np.cumsum([len(t) for t in tables])[:-1]]).astype(np.uint64)
        self.mask = np.array([len(t) - 1 for t in tables], np.uint64)
        self.table = np.concatenate(tables)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        shard = shard_of(h1, self.n)
        mask, base = self.mask[shard], self.base[shard]
        fps = _print(h2)
        a = h1 & mask
        b = _other(a, fps, mask)
        return (self.table[base + a] == fps[:, None]).any(1) | (self.table[base + b] == fps[:, None]).any(1)


def shard_of(h1: np.ndarray, n_shards) -> np.ndarray:
    return ((h1 >> np.uint64(40)) % np.uint64(n_shards)).astype(np.int64)
