"""The plan of a packing, made from counts of lengths alone: at most as many numbers as a sequence has tokens.

Large lengths are sorted and cut into groups of equal cardinality, and each is rounded up
to its group's largest, which leaves few sizes. Which combinations of these sizes
(configurations) to use, and how often, is a linear program over configurations, solved
by column generation: a knapsack finds the configuration that is worth most at the
current prices. Whole uses of each configuration are taken, and actual lengths put in place of the rounded
ones, each slot passing on to the next what rounding had added. What is left of the large
lengths and all small ones are packed best-fit, longest first, into the room that remains.
How long `large` is, is tried for a few shares of a sequence.

Sequences filled alike are one row with a count, so that work and memory depend on the
number of different lengths, not on that of documents.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Filling(NamedTuple):
    """`count` sequences that hold `copies` pieces of each length, in this order."""

    count: int
    parts: tuple[tuple[int, int], ...]


def grouped(counts: np.ndarray, large: int, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes that lengths above `large` are rounded up to, descending, and how many lengths go to each; `groups` of them at most."""
    lengths = np.flatnonzero(counts)[::-1]
    lengths = lengths[lengths > large]
    if not len(lengths):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # the longest of each group of equal cardinality; groups that begin with one length are one
    before = np.cumsum(counts[lengths]) - counts[lengths]
    each = -(-int(counts[lengths].sum()) // groups)
    begins = np.searchsorted(before, np.arange(0, int(counts[lengths].sum()), each), "right") - 1
    begins, shared = np.unique(begins, return_counts=True)
    total = np.r_[before, int(counts[lengths].sum())]
    firsts = np.arange(0, total[-1], each)
    ends = np.r_[firsts[np.cumsum(shared)[:-1]], total[-1]]
    return lengths[begins], np.diff(np.r_[0, ends])


def _best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The combination of sizes within capacity that is worth most; sizes are few to a sequence, so rounds add one item each."""
    room = np.arange(capacity + 1) - sizes[:, None]
    fits, room = room >= 0, np.maximum(room, 0)
    best, choices = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        value = np.where(fits, best[room] + worth[:, None], -1.0)
        pick = value.argmax(0)
        value = value[pick, np.arange(capacity + 1)]
        better = value > best + 1e-12
        if not better.any():
            break
        best = np.where(better, value, best)
        choices.append(np.where(better, pick, -1))
    used, at = np.zeros(len(sizes), np.int64), capacity
    for choice in reversed(choices):
        if choice[at] >= 0:
            used[choice[at]] += 1
            at -= int(sizes[choice[at]])
    return float(best[capacity]), used


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """Configurations (a column each) and how often to use them so that all demand is met with the least sequences, as fractions.

    Every state of the column generation meets the demand; `rounds` bounds it, should it go round in circles.
    """
    columns = np.diag(capacity // sizes)
    inverse = np.diag(1.0 / (capacity // sizes))
    uses = inverse @ demand
    for i in range(rounds):
        value, column = _best_configuration(sizes, np.maximum(inverse.sum(0), 0.0), capacity)
        if value <= 1 + 1e-6:
            break
        step = inverse @ column
        ratio = np.where(step > 1e-9, uses / np.where(step > 1e-9, step, 1.0), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        columns[:, out] = column
        uses = np.maximum(uses - ratio[out] * step, 0.0)
        uses[out] = max(ratio[out], 0.0)
        if i % 64 == 63:
            inverse = np.linalg.inv(columns.astype(float))
            uses = np.maximum(inverse @ demand, 0.0)
        else:
            inverse[out] /= step[out]
            rest = step.copy()
            rest[out] = 0.0
            inverse -= np.outer(rest, inverse[out])
    return columns, uses


def _substituted(counts: np.ndarray, large: int, sizes: np.ndarray, columns: np.ndarray, whole: np.ndarray, capacity: int) -> list[Filling]:
    """Whole uses of each configuration with actual lengths in place of the rounded sizes; what goes in is taken out of counts.

    A slot takes the longest length there still is that fits beside the rounded sizes of
    the slots after it, so that what rounding up had added goes to the next slot.
    """
    out = []
    for column, times in zip(columns.T.tolist(), whole.tolist(), strict=True):
        slots = [int(sizes[g]) for g in np.argsort(-sizes, kind="stable").tolist() for _ in range(column[g])]
        while times:
            used, reserved, parts = 0, sum(slots), {}
            for size in slots:
                reserved -= size
                room = capacity - used - reserved
                held = np.flatnonzero(counts[large + 1 : room + 1] > 0)
                # the same length again only if there is one more of it
                for at in held[::-1].tolist():
                    length = large + 1 + at
                    if counts[length] > parts.get(length, 0):
                        parts[length] = parts.get(length, 0) + 1
                        used += length
                        break
            if not parts:
                break
            now = min([times, *(int(counts[length]) // many for length, many in parts.items())])
            for length, many in parts.items():
                counts[length] -= now * many
            times -= now
            out.append(Filling(now, tuple(parts.items())))
    return out


def _best_fit(fillings: list[Filling], counts: np.ndarray, capacity: int) -> list[Filling]:
    """All lengths counted, longest first, each into the fullest sequence that has room."""
    by_room: list[list[Filling]] = [[] for _ in range(capacity + 1)]
    for f in fillings:
        by_room[capacity - sum(length * many for length, many in f.parts)].append(f)
    for length in np.flatnonzero(counts)[::-1].tolist():
        left, room = int(counts[length]), length
        while left and room <= capacity:
            if not by_room[room]:
                room += 1
                continue
            f = by_room[room].pop()
            # the sequence just used is the fullest one with room, as long as it has room for another
            many = min(room // length, left)
            now = min(f.count, left // many)
            by_room[room - many * length].append(Filling(now, (*f.parts, (length, many))))
            left -= now * many
            if f.count > now:
                by_room[room].append(Filling(f.count - now, f.parts))
        each = capacity // length
        if left >= each:
            by_room[capacity - each * length].append(Filling(left // each, ((length, each),)))
        if left % each:
            by_room[capacity - left % each * length].append(Filling(1, ((length, left % each),)))
    return [f for held in by_room for f in held]


def scheme(counts: np.ndarray, capacity: int, groups: int, large: int) -> list[Filling]:
    """Fillings that hold exactly counts[length] pieces of each length (index 0 unused); lengths above `large` go by configurations."""
    left = counts.astype(np.int64)
    sizes, demand = grouped(left, large, groups)
    fillings: list[Filling] = []
    if len(sizes):
        columns, uses = configurations(sizes, demand.astype(float), capacity)
        fillings = _substituted(left, large, sizes, columns, np.floor(uses + 1e-6).astype(np.int64), capacity)
    return _best_fit(fillings, left, capacity)


def plan(counts: np.ndarray, capacity: int, groups: int = 64, shares: tuple[int, ...] = (4, 3, 2)) -> list[Filling]:
    """The scheme with the fewest sequences of those that call lengths above a half, a third or a quarter of a sequence large."""
    return min((scheme(counts, capacity, groups, capacity // k) for k in shares), key=lambda made: sum(f.count for f in made))
