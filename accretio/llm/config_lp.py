"""Bin packing over a length histogram: a configuration linear program.

A configuration says how many items of each length share one bin. The program
covers every length's count by as few configurations as possible. It is solved
by multiplicative weights: each length has a weight, lowered as the length gets
covered; a knapsack dynamic program prices configurations, that is finds those
of the largest total weight that fit a bin. The fractional solution is rounded
down, the rest is solved again, and what is left is placed best-fit.

The work depends on the bin's size and the number of rounds, never on how many
items there are.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np

Config = tuple[tuple[int, int], ...]  # (length, copies), longest first


def knapsack(weights: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Best total weight for each capacity, and the length to take first there (0: none).

    weights[l] is the weight of length l, or -inf where there is no such item.
    """
    best, first = np.zeros(size + 1), np.zeros(size + 1, np.int32)
    own = weights[1 : size + 1]
    for room in range(1, size + 1):
        value = own[:room] + best[room - 1 :: -1]
        at = room - 1 - int(value[::-1].argmax())  # of equals the longest
        if value[at] > best[room - 1]:
            best[room], first[room] = value[at], at + 1
        else:
            best[room] = best[room - 1]
    return best, first


def _filled(first: np.ndarray, room: int, counts: dict[int, int]) -> None:
    while room > 0:
        length = first[room]
        if length == 0:
            room -= 1
            continue
        counts[int(length)] += 1
        room -= int(length)


def fractional(count: np.ndarray, size: int, phases: int = 80, prices: int = 3, slack: float = 0.05, rate: float = 0.1) -> dict[Config, float]:
    """A fractional solution in which no length is used beyond its count.

    In phase p every length should come to p / phases of its count. A length's
    weight falls exponentially as it gets ahead of that and rises as it falls
    behind. A price is one knapsack: it gives, for every length that is behind,
    the best configuration that holds it; those within ``slack`` of the best of all
    are used, as far as none of their lengths gets more than a phase ahead.
    """
    lengths = np.flatnonzero(count)
    # of equal fills the one with longer items: short ones are wanted for gaps
    base = lengths / size * (1 + 1e-7 * lengths / size)
    weights, used, chosen = np.full(size + 1, -np.inf), np.zeros(size + 1), defaultdict(float)
    for phase in range(1, phases + 1):
        target, most = phase / phases, min(1.0, (phase + 1) / phases)
        for _ in range(prices):
            share = used[lengths] / count[lengths]
            weights[lengths] = base * np.exp(-rate * phases * np.clip(share - target, -2 / phases, 2 / phases))
            best, first = knapsack(weights, size)
            moved = False
            for length in lengths[::-1].tolist():
                lack = target * count[length] - used[length]
                if lack <= 0 or weights[length] + best[size - length] < (1 - slack) * best[size]:
                    continue
                counts: dict[int, int] = defaultdict(int)
                counts[length] = 1
                _filled(first, size - length, counts)
                amount = min(lack / counts[length], *((most * count[k] - used[k]) / n for k, n in counts.items()))
                if amount > 0:
                    chosen[tuple(sorted(counts.items(), reverse=True))] += amount
                    moved = True
                    for k, n in counts.items():
                        used[k] += amount * n
            if not moved:
                break
    return dict(chosen)


def best_fit(count: np.ndarray, size: int) -> dict[Config, int]:
    """Best-fit decreasing on the histogram: bins that are alike are filled at once.

    An item goes where the least room is left, so a bin that takes one takes as
    many of its length as fit.
    """
    open_bins: dict[int, dict[Config, int]] = defaultdict(dict)
    rooms = np.zeros(size + 1, bool)
    for length in np.flatnonzero(count)[::-1].tolist():
        left = int(count[length])
        if not length:
            continue
        while left:
            fits = np.flatnonzero(rooms[length:])
            room = int(fits[0]) + length if len(fits) else size
            each = room // length
            if len(fits):
                group = open_bins[room]
                config, bins = next(iter(group.items()))
                if bins * each <= left:
                    del group[config]
                    rooms[room] = bool(group)
                else:
                    bins = max(1, left // each)
                    group[config] -= bins
                    if not group[config]:
                        del group[config]
                        rooms[room] = bool(group)
            else:
                config, bins = (), max(1, left // each)
            taken = min(each, left)
            left -= bins * taken
            now = room - taken * length
            made = (*config, (length, taken))
            open_bins[now][made] = open_bins[now].get(made, 0) + bins
            rooms[now] = True
    out: dict[Config, int] = defaultdict(int)
    for group in open_bins.values():
        for config, bins in group.items():
            out[config] += bins
    return dict(out)


def pack(count: np.ndarray, size: int, rounds: int = 3) -> dict[Config, int]:
    """Configurations and how often to use each; together they hold every item once.

    count[l] is the number of items of length l, for l from 0 to size; count[0] is ignored.
    After each round of the program the rest is placed best-fit, and the round with
    the fewest bins in all stays.
    """
    left = np.array(count, dtype=np.int64)
    left[0] = 0
    out: dict[Config, int] = defaultdict(int)
    best: dict[Config, int] = {}
    fewest, worse = -1, 0
    for _ in range(rounds):
        before = int(left.sum())
        for config, amount in sorted(fractional(left.astype(float), size).items(), key=lambda x: -x[1]):
            times = min([int(amount + 1e-9), *(int(left[k]) // n for k, n in config)])
            if times:
                out[config] += times
                for k, n in config:
                    left[k] -= times * n
        rest = best_fit(left, size)
        bins = sum(out.values()) + sum(rest.values())
        if fewest < 0 or bins < fewest:
            fewest, worse, best = bins, 0, dict(out)
            for config, n in rest.items():
                best[config] = best.get(config, 0) + n
        else:
            worse += 1
        if worse == 2 or left.sum() in (0, before):
            break
    return best
