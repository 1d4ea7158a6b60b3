"""BagMinHash signatures of word-shingle multisets, many texts at a time.

A shingle that occurs c times has weight c. Its weight axis is cut into dyadic
intervals (0,1], (1,2], (2,4], ...; each interval of each shingle is a Poisson
process of its own, seeded by the two alone: points come in order of time, each
with a signature slot and a place in the interval. A text keeps the points whose
place its weight reaches, and each slot keeps its earliest point. Two texts agree
in a slot with probability equal to their weighted Jaccard similarity. A process
stops once it is later than every slot's earliest point so far.
"""

from __future__ import annotations

import numpy as np
import xxhash

_G = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Fixed odd numbers, one for each word of a shingle.
_WORD = np.array([0xD6E8FEB86659FD93, 0xA5A3564E27F88695, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
_KNOWN = 200_000
_ROUND = 16


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit depends on every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _A
        x = (x ^ (x >> np.uint64(27))) * _B
        return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts to shingles of five words (all words, if a text has fewer), lower-cased, split at white space."""

    def __init__(self, words: int = 5):
        self.words, self.known = words, {}

    def hashes(self, words: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.array([known[w] for w in words], np.uint64)
        except KeyError:
            if len(known) > _KNOWN:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            return np.array([known[w] for w in words], np.uint64)

    def shingles(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.empty(0, np.uint64)
        h, k = self.hashes(words), min(self.words, len(words))
        n = len(h) - k + 1
        with np.errstate(over="ignore"):
            out = np.full(n, np.uint64(k))
            for i in range(k):
                out += h[i : i + n] * _WORD[i % 5]
        return mixed(out)

    @staticmethod
    def counted(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(shingles, return_counts=True)

    @staticmethod
    def items(shingles: np.ndarray) -> np.ndarray:
        """The multiset as a sorted set: the k-th occurrence of a shingle is an item of its own."""
        if not len(shingles):
            return shingles
        s = np.sort(shingles)
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        number = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
        with np.errstate(over="ignore"):
            return np.sort(np.where(number > 0, mixed(s + number.astype(np.uint64) * _G), s))


def signatures(texts: list[np.ndarray], slots: int) -> np.ndarray:
    """A row of ``slots`` for each array of shingles; rows of empty arrays are all infinite."""
    first = np.full((len(texts), slots), np.inf)
    flat = first.reshape(-1)
    owners, seeds, lengths, starts, weights = [], [], [], [], []
    for number, shingles in enumerate(texts):
        if not len(shingles):
            continue
        h, c = Shingler.counted(shingles)
        level, low, high = 0, 0, 1
        while True:
            inside = c > low
            if not inside.any():
                break
            own = h[inside]
            with np.errstate(over="ignore"):
                seeds.append(mixed(own + np.uint64(level) * _B))
            owners.append(np.full(len(own), number))
            lengths.append(np.full(len(own), high - low, float))
            starts.append(np.full(len(own), low))
            weights.append(c[inside])
            level, low, high = level + 1, high, high * 2
    if not owners:
        return first
    owner, seed, length = np.concatenate(owners), np.concatenate(seeds), np.concatenate(lengths)
    start, weight = np.concatenate(starts), np.concatenate(weights)
    now, turn = np.zeros(len(owner)), 0
    while len(owner):
        # one point each at first; later the few processes left take several at once
        take = 1 if turn < 4 else _ROUND
        with np.errstate(over="ignore"):
            steps = np.arange(turn + 1, turn + take + 1, dtype=np.uint64) * _G
            u = mixed(seed[:, None] + steps[None, :])
        gap = -np.log(((u >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / length[:, None]
        at = now[:, None] + np.cumsum(gap, 1)
        slot = ((mixed(u ^ _G) >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)
        index = owner[:, None] * slots + slot.astype(np.int64)
        partly = start + length > weight
        if partly.any():
            place = start[:, None] + 1 + (((mixed(u + _A) >> np.uint64(32)) * length[:, None].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
            keep = place <= weight[:, None]
            np.minimum.at(flat, index[keep], at[keep])
        else:
            np.minimum.at(flat, index.ravel(), at.ravel())
        now, turn = at[:, -1], turn + take
        active = now < first.max(1)[owner]
        if not active.all():
            owner, seed, length, start, weight, now = (x[active] for x in (owner, seed, length, start, weight, now))
    return first


def bands(first: np.ndarray, rows: int) -> np.ndarray:
    """A hash for each band of ``rows`` slots; bands of different numbers never share one."""
    bits = np.ascontiguousarray(first).view(np.uint64).reshape(len(first), -1, rows)
    with np.errstate(over="ignore"):
        out = np.arange(bits.shape[1], dtype=np.uint64)[None, :] * _A
        for i in range(rows):
            out = mixed(out + bits[:, :, i] * _WORD[i % 5])
    return out.view(np.int64)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """How many items two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0
