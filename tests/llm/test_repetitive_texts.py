"""Greedy tiling of texts that repeat themselves, in bounded memory."""

import random

import subprocess
import sys

import numpy as np
import pytest
from plain import frame

from skein.llm import contamination
from skein.llm.contamination import Seeds, listed, tiled, tiled_by_length


def _codes(words):
    names = {w: np.uint64(hash_) for w, hash_ in zip("abcdef", np.random.default_rng(5).integers(1, 1 << 62, 6), strict=True)}
    return np.array([names[w] for w in words], np.uint64)


@pytest.mark.parametrize("seed", range(12))
def test_both_ways_give_the_same_tiles(seed):
    rnd = random.Random(seed)
    letters = "ab" if seed % 3 == 0 else "abc" if seed % 3 == 1 else "abcdef"
    document, item = ([rnd.choice(letters) for _ in range(rnd.randint(1, 90))] for _ in range(2))
    least = rnd.randint(1, 5)
    d, i = _codes(document), _codes(item)
    at = [(x, y) for x in range(len(d) - least + 1) for y in range(len(i) - least + 1) if document[x : x + least] == item[y : y + least]]
    wanted = tiled(np.array([x for x, _ in at], np.int64), np.array([y for _, y in at], np.int64), np.full(len(at), least), least) if at else []
    assert sorted(tiled_by_length(d, i, least)) == sorted(wanted)


def test_listing_and_lengths_judge_alike(spark, monkeypatch):
    rnd = random.Random(8)
    item = "the same words over and over " * 6
    rows = [(k, " ".join(rnd.choice(item.split()) for _ in range(rnd.randint(0, 120))) + " " + item[: rnd.randint(0, 150)]) for k in range(40)] + [(50, None), (51, ""), (52, "over " * 3000)]
    items = spark.createDataFrame([(1, item), (2, "over and"), (3, "over " * 40), (4, None)], "item_id long, text string")
    columns = ("doc_id", "coverage", "item_id", "n_tiled", "n_items")
    one = sorted(map(tuple, contamination.judge(frame(spark, rows), items).select(*columns).collect()))
    from skein.llm.arrays import blocks
    import pyarrow as pa

    seeds = Seeds([(1, item), (2, "over and"), (3, "over " * 40)], contamination.SEED)
    for limit in (1, 300):
        monkeypatch.setattr(contamination, "PAIRS", limit)
        got = [r for b in blocks(pa.array([(t or "").lower() for _, t in rows])) for r in _rows(b, seeds, rows)]
        assert sorted(got) == one
    assert listed([], [])[0].size == 0


def _rows(block, seeds, rows):
    best = contamination._best(block, seeds)
    return [(rows[block.first + r][0], *best.get(r, (0.0, None, 0, 0))) for r in range(len(block))]


def test_a_megabyte_of_one_word_stays_below_a_gigabyte():
    code = (
        "import resource, sys; sys.path.insert(0, '.')\n"
        "import pyarrow as pa\n"
        "from skein.llm import contamination as c\nfrom skein.llm.arrays import blocks\n"
        "seeds = c.Seeds([(1, 'word ' * 1000), (2, 'word and ' * 300)], c.SEED)\n"
        "out = [c._best(b, seeds) for b in blocks(pa.array(['word ' * 210_000, 'word and ' * 40_000]))]\n"
        "best = {i: v for i, o in enumerate(out) for v in o.values()}\n"
        "assert [v[0] for o in out for v in o.values()] == [1.0, 1.0], out\n"
        "print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)\n"
    )
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) < 1000
