"""Benchmark decontamination by greedy string tiling, which also catches reordered passages.

Tokens are runs of letters and digits in lower case. The hashes of every run of
`seed` tokens of the benchmark items, taken by a running Karp-Rabin hash, meet those
of the documents. For each document and item that share one, matches are grown along
their diagonals; then the longest match among unmarked tokens is marked again and
again until none of `seed` tokens is left. Texts that repeat what they share so often that
pairs of places would be too many are tiled length by length, in memory linear in the text. The marked share of the item's tokens is
its coverage; a document that covers half of an item, in whatever order, is
contaminated.

The benchmark goes to the executors in blocks of bounded size, one at a time. Where one
block holds it, that is one pass without a shuffle. Else each block takes a pass of its
own, which writes what it finds for the texts that share a seed with it, and the best of
all blocks is joined to the documents by two hashes of their text.

Edge cases: a null or empty text matches nothing, nor does an item without tokens; an
item shorter than a seed must be found whole; among items of equal coverage the
smallest id counts; repeated documents are judged each on its own, of repeated items
any is as good; an empty benchmark leaves all documents clean; extra columns are kept.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Block, blocks, spread, text_bytes, window_hashes, within
from .tables import aside, materialize, text_size

#: Tokens of the shortest tile, and the covered share of an item from which a document is contaminated.
SEED, COVERAGE = 5, 0.5
#: Bytes of benchmark text sent to the executors at once.
BLOCK = 8 << 20
#: Pairs of places listed at once; a text with more is tiled without listing them.
PAIRS = 1 << 19
_BITS = 20


class Seeds:
    """The tokens of some items, and their seeds in order of their hashes."""

    def __init__(self, items: list[tuple[int, str]], seed: int) -> None:
        items = sorted((i, t.lower()) for i, t in items if i is not None and t)
        data, offsets = text_bytes(pa.array([t for _, t in items], pa.string()))
        _, _, hashes, first = Block(data, offsets, 0).words(lower=True, letters=True)
        self.seed, self.ids = seed, np.array([i for i, _ in items], np.int64)
        self.tokens, self.first = hashes, first
        sizes = np.diff(first)
        self.by_length: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for k in sorted({min(seed, int(n)) for n in sizes if n}):
            at = within(first, k) if len(hashes) >= k else np.zeros(0, np.int64)
            item = np.searchsorted(first, at, "right") - 1
            at = at[(sizes[item] == k) if k < seed else (sizes[item] >= seed)]
            keys = window_hashes(hashes, k)[at]
            order = np.argsort(keys, kind="stable")
            bits = np.zeros(1 << _BITS, bool)
            bits[keys >> np.uint64(64 - _BITS)] = True
            self.by_length.append((k, keys[order], at[order], bits))

    def met(self, words: np.ndarray, first: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each seed length: it, the document tokens where a shared seed begins, which of the index's places (from, to) have it, and those places."""
        out = []
        for k, keys, places, bits in self.by_length:
            if len(words) < k:
                continue
            found = window_hashes(words, k)
            likely = np.flatnonzero(bits[found >> np.uint64(64 - _BITS)])
            inside = np.searchsorted(first, likely, "right") == np.searchsorted(first, likely + k - 1, "right")
            likely = likely[inside]
            a, b = np.searchsorted(keys, found[likely], "left"), np.searchsorted(keys, found[likely], "right")
            out.append((k, likely[b > a], a[b > a], b[b > a], places))
        return out


def listed(met: list, chosen: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document token, item token and length of all pairs of places of the chosen shared seeds."""
    none = np.zeros(0, np.int64)
    left, right, size = [none], [none], [none]
    for (k, at, a, b, places), keep in zip(met, chosen, strict=True):
        n = (b - a)[keep]
        left.append(np.repeat(at[keep], n))
        right.append(places[spread(a[keep], n)])
        size.append(np.full(len(left[-1]), k))
    return np.concatenate(left), np.concatenate(right), np.concatenate(size)


def _free(tokens: np.ndarray, used: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of n unmarked tokens begin, and their hashes."""
    marks = np.r_[0, np.cumsum(used)]
    at = np.flatnonzero(marks[n:] == marks[:-n]) if n <= len(tokens) else np.zeros(0, np.int64)
    return at, window_hashes(tokens, n)[at] if len(at) else np.zeros(0, np.uint64)


def tiled_by_length(document: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """The same tiles without listing pairs of places: memory is linear in the tokens of the two, however they repeat.

    For the greatest length at which unmarked runs of both are equal, found by bisection
    over running hashes, all tiles of that length are marked from the left; as no longer
    one is left by then, these are the next ones of the greedy order.
    """
    used_left, used_right = np.zeros(len(document), bool), np.zeros(len(item), bool)
    tiles: list[tuple[int, int, int]] = []
    common = lambda n: bool(np.isin(_free(item, used_right, n)[1], _free(document, used_left, n)[1]).any())
    most = min(len(document), len(item))
    while most >= least and common(least):
        low, high = least, most
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if common(middle) else (low, middle - 1)
        at, keys = _free(document, used_left, low)
        places, names = _free(item, used_right, low)
        waiting: dict[int, list[int]] = {}
        for j, name in zip(places[::-1].tolist(), names[::-1].tolist(), strict=True):
            waiting.setdefault(name, []).append(j)
        shared = np.isin(keys, names)
        free_from = 0
        for i, key in zip(at[shared].tolist(), keys[shared].tolist(), strict=True):
            spots = waiting.get(key)
            if i < free_from or not spots:
                continue
            # a place once covered stays so
            while spots and used_right[spots[-1] : spots[-1] + low].any():
                spots.pop()
            if spots:
                j = spots.pop()
                tiles.append((i, j, low))
                used_left[i : i + low] = used_right[j : j + low] = True
                free_from = i + low
            if not spots:
                del waiting[key]
                if not waiting:
                    break
        most = low - 1
    return tiles


def tiled(left: np.ndarray, right: np.ndarray, size: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (document token, item token, tokens) of one document and item from their shared seeds."""
    order = np.lexsort((left, left - right))
    left, right, size = left[order], right[order], size[order]
    # seeds of one diagonal that overlap or touch grow into one match
    fresh = np.ones(len(left), bool)
    fresh[1:] = ((left - right)[1:] != (left - right)[:-1]) | (left[1:] > left[:-1] + 1)
    begin = np.flatnonzero(fresh)
    last = np.r_[begin[1:], len(left)] - 1
    heap = [(-(int(left[e]) + int(size[e]) - int(left[b])), int(left[b]), int(right[b])) for b, e in zip(begin, last, strict=True)]
    heapq.heapify(heap)
    used_left: set[int] = set()
    used_right: set[int] = set()
    tiles = []
    while heap:
        n, i, j = heapq.heappop(heap)
        runs, start = [], None
        for x in range(-n + 1):
            free = x < -n and i + x not in used_left and j + x not in used_right
            if free and start is None:
                start = x
            elif not free and start is not None:
                runs.append((start, x - start))
                start = None
        if runs == [(0, -n)]:
            tiles.append((i, j, -n))
            used_left.update(range(i, i - n))
            used_right.update(range(j, j - n))
        else:
            for x, m in runs:
                if m >= least:
                    heapq.heappush(heap, (-m, i + x, j + x))
    return tiles


def _best(block: Block, seeds: Seeds) -> dict[int, tuple[float, int, int, int]]:
    """Per row with shared seeds: coverage, item id, tiled tokens, and items at or above COVERAGE."""
    _, _, words, first = block.words(lower=True, letters=True)
    met = seeds.met(words, first)
    rows = [np.searchsorted(first, at, "right") - 1 for _, at, *_ in met]
    pairs = np.zeros(len(block), np.int64)
    for row, (_, _, a, b, _) in zip(rows, met, strict=True):
        np.add.at(pairs, row, b - a)
    out: dict[int, tuple[float, int, int, int]] = {}

    def count(r: int, k: int, tiles: list[tuple[int, int, int]]) -> None:
        n, tokens = int(seeds.first[k + 1] - seeds.first[k]), sum(t[2] for t in tiles)
        before = out.get(r, (-1.0, 0, 0, 0))
        best = max((tokens / n, -int(seeds.ids[k]), tokens), (before[0], -before[1], before[2]))
        out[r] = (best[0], -best[1], best[2], before[3] + (tokens / n >= COVERAGE))

    least = lambda k: min(seeds.seed, int(seeds.first[k + 1] - seeds.first[k]))
    light = np.flatnonzero((pairs > 0) & (pairs <= PAIRS))
    # as many rows at once as have PAIRS pairs together
    group = np.cumsum(pairs[light]) // PAIRS
    for g in np.unique(group).tolist():
        own = np.zeros(len(block), bool)
        own[light[group == g]] = True
        left, right, size = listed(met, [own[row] for row in rows])
        row, item = np.searchsorted(first, left, "right") - 1, np.searchsorted(seeds.first, right, "right") - 1
        order = np.lexsort((item, row))
        left, right, size, row, item = left[order], right[order], size[order], row[order], item[order]
        cuts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (item[1:] != item[:-1])])
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(row)], strict=True):
            k = int(item[a])
            count(int(row[a]), k, tiled(left[a:b], right[a:b], size[a:b], least(k)))
    for r in np.flatnonzero(pairs > PAIRS).tolist():
        document, items = words[first[r] : first[r + 1]], []
        for row, (_, _, a, b, places) in zip(rows, met, strict=True):
            # each shared seed once, however often the text has it
            begin, at = np.unique(a[row == r], return_index=True)
            items.append(np.unique(np.searchsorted(seeds.first, places[spread(begin, b[row == r][at] - begin)], "right") - 1))
        for k in np.unique(np.concatenate(items)).tolist():
            count(r, k, tiled_by_length(document, seeds.tokens[seeds.first[k] : seeds.first[k + 1]], least(k)))
    return out


_ADDED = ["coverage", "item_id", "n_tiled", "n_items"]


def cover(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """docs with the coverage, id and tiled tokens of the item each text covers most, and how many items it covers by half."""
    own = docs.drop(*_ADDED)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text"))
    n = max(1, -(-text_size(items, "text") // block))
    context = docs.sparkSession.sparkContext
    if n == 1:
        return _pass(own, context.broadcast(Seeds([tuple(r) for r in items.collect()], seed)), True)
    keyed, names = aside(own, "text")
    keyed = keyed.withColumns({"_a": F.xxhash64("text"), "_b": F.xxhash64(F.lit(1), "text")})
    texts, found = keyed.select("_a", "_b", "text"), None
    for part in range(n):
        # one block of the benchmark comes to the driver and goes out to the executors, and is gone when its finds are written
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == part)
        seeds = context.broadcast(Seeds([tuple(r) for r in mine.collect()], seed))
        hits = materialize(_pass(texts, seeds, False).drop("text").dropDuplicates(["_a", "_b"]))
        seeds.destroy()
        found = hits if found is None else found.unionByName(hits)
    best = F.max(F.struct("coverage", (-F.col("item_id")).alias("rank"), "n_tiled"))
    # written first, so that the join of a text with very many copies can be split
    most = materialize(found.groupBy("_a", "_b").agg(best.alias("best"), F.sum("n_items").alias("n_items")))
    joined = keyed.join(most, ["_a", "_b"], "left")
    values = {"coverage": F.coalesce("best.coverage", F.lit(0.0)), "item_id": -F.col("best.rank"), "n_tiled": F.coalesce("best.n_tiled", F.lit(0)), "n_items": F.coalesce("n_items", F.lit(0))}
    return joined.select(*(F.col(n).alias(c) for c, n in names.items()), *(v.alias(k) for k, v in values.items()))


def _pass(docs: DataFrame, seeds, whole: bool) -> DataFrame:
    """docs with what their texts cover of one block's items; without whole only the rows that share a seed with it."""
    names = docs.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "coverage double, item_id long, n_tiled long, n_items long"])
    fresh = "_".join(["lowered", *names])
    lowered = docs.select(*(F.col(f"`{c}`") for c in names), F.lower("text").alias(fresh))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = seeds.value
        for batch in batches:
            for block in blocks(batch.column(len(names))):
                best = _best(block, own)
                part = batch.slice(block.first, len(block)).select(list(range(len(names))))
                rows = list(range(len(block)) if whole else sorted(best))
                if not rows:
                    continue
                part = part if whole else part.take(pa.array(rows, pa.int32()))
                none = (0.0, None, 0, 0)
                found = zip(*(best.get(r, none) for r in rows), strict=True)
                added = [pa.array(v, kind) for v, kind in zip(found, (pa.float64(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], names=[*names, *_ADDED])

    return lowered.mapInArrow(run, schema)


def judge(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, least: float = COVERAGE) -> DataFrame:
    """cover(), and `contaminated` where the coverage reaches `least`."""
    return cover(docs, benchmark, seed).withColumn("contaminated", F.col("coverage") >= least)
