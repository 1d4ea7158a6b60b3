"""Cuckoo filters: sets of 128-bit keys with deletion, one per shard.

A key is two 64-bit numbers. A filter answers "absent" with certainty and
"present" with a small chance of error, so whoever asks looks up what is present
in an exact table. When a table fills, a larger one is chained behind it.
"""

from __future__ import annotations

import numpy as np

SLOTS = 4
_MIX = 0x9E3779B97F4A7C15
_FULL = 2**64 - 1


def _print_of(h2: np.ndarray) -> np.ndarray:
    """16-bit fingerprints, never 0, as that marks an empty slot."""
    return np.maximum((h2.view(np.uint64) >> np.uint64(48)).astype(np.uint16), np.uint16(1))


def _other(bucket, fingerprint, mask):
    with np.errstate(over="ignore"):
        return bucket ^ ((np.uint64(fingerprint) if np.isscalar(fingerprint) else fingerprint.astype(np.uint64)) * np.uint64(_MIX) >> np.uint64(20)) & mask


class CuckooFilter:
    """Buckets are taken from the low bits of the first number: keys that share those fill few of them."""

    def __init__(self, capacity: int = 1024):
        buckets = 1 << max(4, int(np.ceil(np.log2(max(1, capacity) / (0.85 * SLOTS)))))
        self.tables: list[np.ndarray] = [np.zeros((buckets, SLOTS), np.uint16)]
        self.held: list[int] = [0]

    # one table ---------------------------------------------------------------
    @staticmethod
    def _places(table: np.ndarray, h1: np.ndarray, h2: np.ndarray):
        mask = np.uint64(len(table) - 1)
        prints = _print_of(h2)
        one = h1.view(np.uint64) & mask
        return prints, one.astype(np.int64), _other(one, prints, mask).astype(np.int64)

    def _put(self, table: np.ndarray, fingerprint: int, one: int, two: int, kicks: int = 400) -> tuple[int, int] | None:
        """Place a fingerprint; if none gives way, what is left over and its bucket."""
        mask = len(table) - 1
        for at in (one, two):
            for slot in range(SLOTS):
                if table[at, slot] == 0:
                    table[at, slot] = fingerprint
                    return None
        at = two
        for turn in range(kicks):
            slot = (turn * 7 + fingerprint) % SLOTS
            fingerprint, table[at, slot] = int(table[at, slot]), fingerprint
            at = at ^ (((fingerprint * _MIX) & _FULL) >> 20) & mask
            for slot in range(SLOTS):
                if table[at, slot] == 0:
                    table[at, slot] = fingerprint
                    return None
        return fingerprint, at

    # the chain ---------------------------------------------------------------
    def insert(self, h1: np.ndarray, h2: np.ndarray) -> None:
        if not len(h1):
            return
        if self.held[-1] + len(h1) > 0.9 * self.tables[-1].size:
            grown = CuckooFilter(max(2 * self.tables[-1].size, len(h1)))
            self.tables.append(grown.tables[0])
            self.held.append(0)
        table = self.tables[-1]
        prints, one, two = (x.tolist() for x in self._places(table, h1, h2))
        for fingerprint, a, b in zip(prints, one, two):
            left = self._put(table, fingerprint, a, b)
            if left is not None:
                # the overflow's own keys are unknown; keep its pair of buckets exact in a small list
                self.stash.append((len(self.tables) - 1, *left))
            self.held[-1] += 1

    @property
    def stash(self) -> list[tuple[int, int, int]]:
        if not hasattr(self, "_stash"):
            self._stash: list[tuple[int, int, int]] = []
        return self._stash

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        found = np.zeros(len(h1), bool)
        for number, table in enumerate(self.tables):
            prints, one, two = self._places(table, h1, h2)
            found |= (table[one] == prints[:, None]).any(1) | (table[two] == prints[:, None]).any(1)
            for at_table, fingerprint, bucket in self.stash:
                if at_table == number:
                    found |= (prints == fingerprint) & ((one == bucket) | (two == bucket))
        return found

    def delete(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Remove keys that were inserted."""
        for k in range(len(h1)):
            for number in range(len(self.tables) - 1, -1, -1):
                table = self.tables[number]
                prints, one, two = self._places(table, h1[k : k + 1], h2[k : k + 1])
                hits = [(at, slot) for at in (int(one[0]), int(two[0])) for slot in range(SLOTS) if table[at, slot] == prints[0]]
                if hits:
                    table[hits[0]] = 0
                    self.held[number] -= 1
                    break
                kept = [x for x in self.stash if x[0] == number and x[1] == int(prints[0]) and x[2] in (int(one[0]), int(two[0]))]
                if kept:
                    self.stash.remove(kept[0])
                    self.held[number] -= 1
                    break

    # as bytes ----------------------------------------------------------------
    def to_bytes(self) -> bytes:
        stash = np.array(self.stash, "<i8").reshape(-1, 3)
        head = np.array([len(self.tables), len(stash), *[len(t) for t in self.tables], *self.held], "<i8")
        return b"".join([head.tobytes(), stash.tobytes(), *[t.astype("<u2").tobytes() for t in self.tables]])

    @staticmethod
    def from_bytes(data: bytes) -> CuckooFilter:
        tables, stashed = np.frombuffer(data, "<i8", 2).tolist()
        sizes = np.frombuffer(data, "<i8", 2 * tables, 16).tolist()
        out, at = CuckooFilter(1), 16 + 16 * tables
        out._stash = [tuple(x) for x in np.frombuffer(data, "<i8", 3 * stashed, at).reshape(-1, 3).tolist()]
        at += 24 * stashed
        out.tables, out.held = [], sizes[tables:]
        for n in sizes[:tables]:
            out.tables.append(np.frombuffer(data, "<u2", n * SLOTS, at).reshape(n, SLOTS).astype(np.uint16))
            at += 2 * n * SLOTS
        return out
