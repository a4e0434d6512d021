"""Cutting texts into a tokenizer's pieces with array operations, and a cache of the pieces' ids."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np

from .arrays import byte_codes, span_hashes

SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3
# The code points with Unicode's White_Space property.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# The endings that are pieces together with the apostrophe before them.
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


#: Code points whose classes are found at once, so that a process looks up no more than the scripts it meets.
_RANGE_BITS = 12


@lru_cache(maxsize=None)
def _range_classes(k: int) -> np.ndarray:
    """Space, letter, digit or other for the code points of the k-th range."""
    kinds, first = {"L": LETTER, "N": DIGIT}, k << _RANGE_BITS
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(first, first + (1 << _RANGE_BITS))), np.uint8, 1 << _RANGE_BITS)
    table[[c - first for c in _WHITE if c >> _RANGE_BITS == k]] = SPACE
    return table


def classes(points: np.ndarray) -> np.ndarray:
    """Space, letter, digit or other for each of some code points."""
    met = np.flatnonzero(np.bincount(points >> np.uint32(_RANGE_BITS)))
    if len(met) == 1 and not met[0]:
        return _range_classes(0)[points]
    table = np.zeros((int(met[-1]) + 1) << _RANGE_BITS, np.uint8)
    for k in met.tolist():
        table[k << _RANGE_BITS : (k + 1) << _RANGE_BITS] = _range_classes(k)
    return table[points]


def piece_bounds(points: np.ndarray, offsets: np.ndarray, joined: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of texts given as code points and row offsets.

    joined: white space belongs to pieces, a blank joins the run after it and digits
    form runs (byte-level vocabularies); else white space is dropped and each digit
    is a piece (vocabularies with word ends).
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes(points)
    fresh = np.ones(n, bool)
    np.not_equal(kind[1:], kind[:-1], out=fresh[1:])
    fresh[offsets[:-1][offsets[:-1] < n]] = True
    if not joined:
        fresh |= kind == DIGIT
    first = np.flatnonzero(fresh)
    last = np.r_[first[1:], n]
    of = kind[first]
    ends_row = np.isin(last, offsets[1:])
    start, end = first.copy(), last.copy()
    held = np.zeros(len(first), bool)
    if joined:
        gap = np.flatnonzero((of == SPACE) & ~ends_row)  # another run of the same row follows
        blank = points[last[gap] - 1] == 0x20
        give = gap[blank]
        end[give] -= 1
        start[give + 1] -= 1
        held[give + 1] = True
        # what is left of a longer run before its last character is one piece, and a last character other than a blank another
        split = gap[~blank]
        split = split[last[split] - first[split] > 1]
        extra = last[split] - 1
        end[split] -= 1
    else:
        extra = np.zeros(0, np.int64)
    mark = np.flatnonzero((of == OTHER) & (last - first == 1) & ~held & ~ends_row & (points[first] == 0x27))
    if len(mark):
        mark = mark[of[mark + 1] == LETTER]
        room = last[mark + 1] - first[mark + 1]
        taken = np.zeros(len(mark), np.int64)
        one = points[first[mark + 1]]
        two = np.where(room > 1, points[np.minimum(first[mark + 1] + 1, n - 1)], 0)
        for ending in _ENDINGS:
            hit = one == ord(ending[0])
            if len(ending) == 2:
                hit &= two == ord(ending[1])
            taken[hit & (taken == 0)] = len(ending)
        end[mark] += taken
        start[mark + 1] += taken
    keep = end > start
    if not joined:
        keep &= of != SPACE
    start, end = start[keep], end[keep]
    if len(extra):
        start, end = np.r_[start, extra], np.r_[end, extra + 1]
        order = np.argsort(start, kind="stable")
        start, end = start[order], end[order]
    return start, end


#: Bits of a hash that choose the cell of a piece.
_CELL_BITS = 21


class PieceCache:
    """Ids of pieces by the hash of their bytes; emptied beyond `most` pieces, so that its memory is bounded.

    A table of cells finds most pieces by array operations; only those whose cell
    another piece has are kept in a dictionary and looked up one by one.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], most: int = 1_000_000) -> None:
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.slot: dict[int, int] = {}
        self.cell_key = np.zeros(1 << _CELL_BITS, np.uint64)
        self.cell_slot = np.full(1 << _CELL_BITS, -1, np.int32)
        self.ids = np.zeros(1 << 16, np.int32)
        self.start = np.zeros(1 << 15, np.int64)
        self.size = np.zeros(1 << 15, np.int32)
        self.known = self.used = 0

    def _add(self, pieces: list[bytes]) -> np.ndarray:
        """The slots of new pieces."""
        found = self.encode(pieces)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))
        k, end = self.known, self.used + len(flat)
        if end > len(self.ids):
            self.ids = np.r_[self.ids[: self.used], np.zeros(max(end, 2 * len(self.ids)) - self.used, np.int32)]
        if k + len(found) > len(self.start):
            more = max(k + len(found), 2 * len(self.start)) - k
            self.start, self.size = np.r_[self.start[:k], np.zeros(more, np.int64)], np.r_[self.size[:k], np.zeros(more, np.int32)]
        self.ids[self.used : end] = flat
        self.start[k : k + len(found)] = self.used + np.cumsum(sizes) - sizes
        self.size[k : k + len(found)] = sizes
        self.known, self.used = k + len(found), end
        return np.arange(k, self.known, dtype=np.int32)

    def _slots(self, distinct: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Slots of distinct pieces that stand in no cell."""
        found = np.fromiter((self.slot.get(k, -1) for k in distinct.tolist()), np.int32, len(distinct))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            raw = data.tobytes()
            fresh, slots = distinct[missing], self._add([raw[a:b] for a, b in zip(starts[missing].tolist(), ends[missing].tolist(), strict=True)])
            found[missing] = slots
            # the first of a free cell has it
            cell, one = np.unique(fresh >> np.uint64(64 - _CELL_BITS), return_index=True)
            free = self.cell_slot[cell] < 0
            cell, one = cell[free], one[free]
            self.cell_key[cell], self.cell_slot[cell] = fresh[one], slots[one]
            rest = np.ones(len(fresh), bool)
            rest[one] = False
            self.slot.update(zip(fresh[rest].tolist(), slots[rest].tolist(), strict=True))
        return found

    def tokens(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces (byte spans of data) in order, and how many each piece has."""
        hashes = span_hashes(byte_codes(data), starts, ends)
        cell = (hashes >> np.uint64(64 - _CELL_BITS)).astype(np.int64)
        slot = np.where(self.cell_key[cell] == hashes, self.cell_slot[cell], -1)
        unmet = np.flatnonzero(slot < 0)
        if len(unmet):
            distinct, at, back = np.unique(hashes[unmet], return_index=True, return_inverse=True)
            if self.known and self.known + len(distinct) > self.most:
                self.clear()
                return self.tokens(data, starts, ends)
            slot[unmet] = self._slots(distinct, data, starts[unmet[at]], ends[unmet[at]])[back]
        size = self.size[slot]
        total = int(size.sum())
        begin = np.cumsum(size) - size
        return self.ids[np.repeat(self.start[slot] - begin, size) + np.arange(total)], size
