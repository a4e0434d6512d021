"""Many equal rows, and many copies of long texts."""

import numpy as np
from plain import frame, repeated_bytes

from skein.llm import chat, fm_dedup, suffix_dedup, token_files


def test_rows_that_are_equal_in_id_and_text(spark):
    text = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(700)) + "A" * 450
    rows = [(7, text)] * 3000 + [(8, "own words " * 3), (9, text[:500])]
    got = suffix_dedup.dedup(frame(spark, rows), length=400, content=False).collect()
    assert len(got) == len(rows) and {(r.n_removed, r.n_spans) for r in got if r.doc_id == 7} == {(1150, 1)}
    assert {(r.doc_id, r.n_removed) for r in got if r.doc_id != 7} == {(8, 0), (9, 500)}
    words = " ".join(f"w{i % 40}" for i in range(90))
    rows = [(7, words)] * 3000 + [(3, words), (5, "none of it")]
    got = fm_dedup.dedup(frame(spark, rows), length=13, content=False).collect()
    assert len(got) == len(rows) and {r.n_removed for r in got if r.doc_id == 7} == {90} and {r.n_removed for r in got if r.doc_id != 7} == {0}


def test_equal_rows_give_what_brute_force_gives(spark):
    text = " ".join(f"word{i % 25}" for i in range(100))
    rows = [(1, text)] * 5 + [(2, text + " more"), (None, text)] + [(3, "short")] * 3
    keyed = [(i if i is not None else -1, t) for i, t in rows]
    got = {(r.doc_id, r.n_removed) for r in suffix_dedup.dedup(frame(spark, keyed), length=50, k=8, content=False).collect()}
    assert got == {(i, v[1]) for i, v in _by_row(keyed, lambda r: repeated_bytes(r, 50))}


def _by_row(rows, plain):
    """Brute force needs ids of its own: rows are numbered, and named back."""
    out = plain(list(enumerate(t for _, t in rows)))
    return [(rows[k][0], v) for k, v in out.items()]


def test_copies_of_a_long_text_get_wide_symbols():
    rnd = np.random.default_rng(1)
    run = rnd.integers(0, 50_000, 60_000).astype(np.int32)
    ids, ends = np.tile(run, 20), np.arange(1, 21) * len(run)
    bits, rules, seq, bounds = token_files.compressed(ids, ends, 50_257)
    assert bits == 32 and len(seq) == 20 and 12 * len(rules) + 4 * len(seq) < 2 * len(ids) / 3
    sizes = token_files.expanded_lengths(rules.astype(np.int64), 50_257)
    assert (token_files.expand(seq.astype(np.int64), rules.astype(np.int64), 50_257, sizes) == ids).all()
    shard = token_files._shard(0, 0, [ids], [np.full(20, len(run))], list(range(20)), 50_257)
    row = dict(zip([f.split()[0] for f in token_files.SHARD_SCHEMA.split(", ")], shard, strict=True))
    assert all((token_files.read_document(row, k) == run).all() for k in (0, 7, 19))


def test_a_pair_is_replaced_as_soon_as_it_pays():
    ids = np.array([1, 2, 3] * 5 + [4] * 3, np.int32)
    rules, seq, _ = token_files.repair(ids, np.array([len(ids)]), 100)
    assert len(rules) == 2 and len(seq) == 8
    assert len(token_files.repair(ids[3:], np.array([len(ids) - 3]), 100)[0]) == 0


def test_long_chains_of_calls_take_few_rounds(spark, monkeypatch):
    chain = [("a", f"c{i}", [f"c{i - 1}"] if i else None) for i in range(300)]
    # two that wait for several, one of them at the end of the chain; a cycle with a tail; and a call that waits for the tail and the chain
    rest = [("a", "j", ["c299", "c10"]), ("a", "k", ["j", "c0", "j"]), ("a", "x", ["y"]), ("a", "y", ["x"]), ("a", "z", ["y"]), ("a", "v", ["z", "c1"]), ("a", "s", ["s"]), ("b", "c5", None), ("b", "m", ["c5", "gone"])]
    made, real = [], chat.materialize
    monkeypatch.setattr(chat, "materialize", lambda df: made.append(1) or real(df))
    calls = spark.createDataFrame(chain + rest, "conv string, call_id string, after array<string>")
    got = {(r.conv, r.call_id): r.level for r in chat.levels(calls).collect()}
    assert got == {("a", f"c{i}"): i for i in range(300)} | {("a", "j"): 300, ("a", "k"): 301, ("b", "c5"): 0, ("b", "m"): 1}
    assert len(made) < 25
