"""Suffix arrays of many short texts, in numpy."""

from __future__ import annotations

import numpy as np

from .arrays import spread


def joined(symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts with a 0 after each (symbols go up by one), the text of each place, and the place of each text's 0."""
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    close = np.cumsum(sizes + 1) - 1
    text = np.zeros(len(owner), np.int64)
    inner = np.ones(len(owner), bool)
    inner[close] = False
    text[inner] = symbols.astype(np.int64) + 1
    return text, owner, close


def suffix_array(text: np.ndarray, owner: np.ndarray, close: np.ndarray) -> np.ndarray:
    """Larsson-Sadakane refinement: suffixes end with their text's 0; equal ones stand in order of place.

    Suffixes are first sorted by as many symbols as fit in 63 bits. Each round doubles
    the depth by sorting the groups not yet told apart by the rank of the suffix that
    starts that much further on.
    """
    n = len(text)
    bits = max(1, int(text.max(initial=0)).bit_length())
    depth = max(1, 63 // bits)
    left = close[owner] - np.arange(n) + 1
    key = np.zeros(n, np.int64)
    for k in range(depth):
        key <<= bits
        if k < n:
            key[: n - k] |= np.where(left[: n - k] > k, text[k:], 0)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    fresh = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    most = int(left.max(initial=0))
    while depth < most:
        # places of the array whose suffixes still share their rank with a neighbour's
        single = fresh & np.r_[fresh[1:], True]
        slots = np.flatnonzero(~single)
        if not len(slots):
            break
        own = order[slots]
        further = np.where(left[own] > depth, rank[np.minimum(own + depth, n - 1)] + 1, 0)
        key = rank[own] * (n + 1) + further
        sub = np.argsort(key, kind="stable")
        order[slots] = own[sub]
        key = key[sub]
        new = np.r_[True, key[1:] != key[:-1]]
        fresh[slots] = new
        rank[order[slots]] = np.maximum.accumulate(np.where(new, slots, 0))
        depth *= 2
    return order


def common_prefixes(text: np.ndarray, owner: np.ndarray, close: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Kasai's common prefixes with the suffix before, all texts side by side.

    Within a text, the prefix shared by the next suffix is at most one shorter; each
    text keeps its own place and length, and all of them take one step at a time.
    """
    n = len(text)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    out = np.zeros(n, np.int64)
    at = np.r_[0, close[:-1] + 1]
    stop, size = close.copy(), np.zeros(len(at), np.int64)
    while len(at):
        slot = place[at]
        other = order[np.maximum(slot - 1, 0)]
        more = (slot > 0) & (at + size < stop) & (other + size < close[owner[other]])
        more[more] = text[at[more] + size[more]] == text[other[more] + size[more]]
        ends = ~more
        out[slot[ends]] = size[ends]
        at = at + ends
        size = np.where(ends, np.maximum(size - 1, 0), size + 1)
        live = at < stop
        if not live.all():
            at, stop, size = at[live], stop[live], size[live]
    return out


def windows(offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (in the joined texts) of the windows of all texts, and where each text's begin among them."""
    sizes = np.diff(offsets)
    counts = np.maximum(sizes - length + 1, 0)
    return spread(offsets[:-1] + np.arange(len(sizes)), counts), np.r_[0, np.cumsum(counts)]
