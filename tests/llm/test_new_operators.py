"""Spelling variants, fill-in-middle and packing against brute force, over nulls, ties, repeated rows, long texts, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from plain import frame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skein.llm import bpe, configurations, infill, packing, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelled(rows):
    counts = {}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if _near(w, v)] for w in words}
    form = {w: min(vs, key=lambda v: (-words[v], v)) if vs else None for w, vs in near.items()}
    form = {w: v if v and words[v] >= 2 * words[w] else None for w, v in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def _spellings(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_spelling_variants(spark):
    rnd = random.Random(4)
    base = ["aaaaa", "aaaaaa", "abcde", "abcdf", "münze", "münzen", "straße", "Ébène", "ébène", "ÿÿÿÿÿ", "banana", "×÷×÷×"]
    base += ["".join(rnd.choice("ab") for _ in range(rnd.randint(4, 8))) for _ in range(60)]
    rows = []
    for i in range(400):
        text = " ".join(rnd.choice(base[: rnd.randint(1, len(base))]) for _ in range(40))
        rows.append((rnd.choice([None, i, i, i // 2]), text.upper() if i % 7 == 0 and text.isascii() else text))
    rows += [(1, None), (2, ""), (3, "1 2 3 !?"), (4, "short ones no"), (5, "tie1 " * 3), *[(6, "x" * 3000 + " " + "x" * 2999 + "y")] * 4]
    got = _spellings(spelling.variants(frame(spark, rows)))
    assert got == spelled(rows)
    assert any(v[1] not in (w, v[0]) for w, v in got.items())  # a chain of forms


def test_spelling_of_a_word_that_most_texts_have(spark):
    rows = [(i, "letter " * 200 + "lettre") for i in range(300)] + [(i, "latter later lettter") for i in range(300, 600)]
    assert _spellings(spelling.variants(frame(spark, rows))) == spelled(rows)


def test_spelling_without_rows(spark):
    assert spelling.variants(frame(spark, [(1, "words")]).limit(0)).collect() == []
    assert spelling.variants(frame(spark, [(1, "words seen once")])).collect() == []


@pytest.mark.parametrize(("seed", "pattern"), [(7, infill.LINES), (3, r"\w+\W*|\W+")])
def test_fill_in_middle(spark, seed, pattern):
    rnd = random.Random(seed)
    rows = [(i, "".join(rnd.choice(["one\n", "é ", "<", "P", "\n", "two words\r\n", "<S", ">"]) for _ in range(rnd.randint(0, 12)))) for i in range(300)]
    rows += [(1, None), (2, ""), (2, "\n"), (2, "\n"), (None, "a\nb\nc"), (5, "has <M> in it\n"), (6, "line\n" * 50_000), (7, "no line end " * 20_000)]
    docs = frame(spark, rows).withColumn("n", F.lit("clash")).withColumn("form", F.lit(1)).withColumn("more", F.lit("kept"))
    made = infill.transform(docs, pattern, seed=seed, share=80 if seed == 3 else 100)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "", r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back, r.more) for r in made.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect())
    wanted = []
    for doc_id, text in rows:
        text, h = text or "", hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
        units = re.findall(pattern, text)
        n = len(units)
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= (80 if seed == 3 else 100):
            row = (n, "plain", None, None, text)
        elif h4 % 100 < 50:
            row = (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
        else:
            row = (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")
        wanted.append((doc_id if doc_id is not None else -1, text, *row, text, "kept"))
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(wanted, key=key)
    assert {r[3] for r in got} == {"plain", "spm", "psm"}
    assert infill.transform(docs.limit(0)).collect() == []


def test_markers_that_overlap():
    for bad in (("", "b", "c"), ("aba", "x", "y"), ("ab", "bc", "z"), ("a", "xay", "z")):
        with pytest.raises(ValueError):
            infill.Markers(*bad).checked()


def _packed(spark, rows, capacity=2048, **k):
    path = bpe.vocabulary_path(spark, "byte_bpe_50k.json")
    return packing.pack(frame(spark, rows).withColumn("length", F.lit("clash")), path, capacity, **k)


@pytest.mark.parametrize("capacity", [2048, 64, 7])
def test_packing(spark, capacity):
    t = Tokenizer.from_file(bpe.vocabulary_path(spark, "byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    rnd = random.Random(capacity)
    rows = [(i, "word and more, " * rnd.randint(0, 40)) for i in range(250)] + [(1, None), (2, ""), (None, "no id"), (None, "no id"), (9, "same"), (9, "same"), (1010, "tokens of a long text " * 3000), (11, "<|endoftext|> 汉字\n")]
    got = _packed(spark, rows, capacity).collect()
    expected = sorted(str((d, [*t.encode(x or "", add_special_tokens=False).ids, 0])) for d, x in rows)
    # pieces of one row stand together: rows that share an id are told apart by where the pieces of each begin
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
        assert zlib.crc32(np.array(r.token_ids, "<u4").tobytes()) == r.ids_crc32 and len(r.token_ids) == r.length <= capacity
        assert r.length == capacity or r.piece == 0
    whole = []
    for doc_id, ps in by_id.items():
        many = sum(p.piece == 0 for p in ps)
        if many == 1:
            ps.sort(key=lambda p: p.piece)
            assert [p.start for p in ps] == [sum(q.length for q in ps[:i]) for i in range(len(ps))]
            whole.append(str((doc_id, [x for p in ps for x in p.token_ids])))
        elif capacity == 2048:
            whole += [str((doc_id, p.token_ids)) for p in ps]
    if capacity == 2048:
        assert sorted(whole) == expected
    assert sum(r.length for r in got) == sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in rows)
    filled = {}
    for r in got:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in filled.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= capacity
    assert set(filled) == set(range(len(filled)))
    # no worse than best fit with all lengths in one place
    assert len(filled) <= best_fit([r.length for r in got], capacity)


def best_fit(lengths, capacity):
    rooms = []
    for length in sorted(lengths, reverse=True):
        fitting = [r for r in rooms if r >= length]
        if fitting:
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - length)
        else:
            rooms.append(capacity - length)
    return len(rooms)


def test_packing_is_the_same_work_over_partitions_and_without_rows(spark):
    rows = [(i, "equal length") for i in range(5000)]
    path = bpe.vocabulary_path(spark, "byte_bpe_50k.json")
    got = packing.pack(frame(spark, rows).repartition(7), path, 10, ids=False).collect()
    each = got[0].length
    assert len({(r.sequence_id, r.offset) for r in got}) == 5000 and len({r.sequence_id for r in got}) == -(-5000 // (10 // each))
    assert packing.pack(frame(spark, rows).limit(0), path).collect() == []


def test_sequences_hold_their_pieces(spark):
    rows = [(i, "some text " * (i % 9)) for i in range(60)]
    packed = _packed(spark, rows, 32)
    made = packing.sequences(packed).collect()
    assert sum(len(r.doc_ids) for r in made) == packed.count()
    assert all(len(r.token_ids) == sum(r.lengths) <= 32 for r in made)
    assert sum(r.token_ids.count(0) for r in made) == 60


@pytest.mark.parametrize("seed", range(6))
def test_plans_hold_each_length_once(seed):
    rnd = np.random.default_rng(seed)
    for _ in range(40):
        capacity = int(rnd.integers(1, 80))
        lengths = rnd.integers(1, capacity + 1, int(rnd.integers(0, 300)))
        if seed % 2:
            lengths = np.repeat(lengths, int(rnd.integers(1, 500)))
        counts, got = np.bincount(lengths, minlength=capacity + 1), np.zeros(capacity + 1, np.int64)
        plan = configurations.plan(counts, capacity, groups=int(rnd.integers(1, 12)))
        for f in plan:
            assert f.count > 0 and sum(length * many for length, many in f.parts) <= capacity
            for length, many in f.parts:
                got[length] += f.count * many
        assert (got == counts).all()
        if not seed % 2:
            assert sum(f.count for f in plan) <= best_fit(lengths.tolist(), capacity)


def test_configurations_beat_best_fit_where_three_large_lengths_fill_a_sequence():
    counts = np.zeros(101, np.int64)
    counts[[26, 27, 47, 48]] = 300
    counts[[35, 40, 25]] = 200
    lengths = [i for i, n in enumerate(counts.tolist()) for _ in range(n)]
    made = sum(f.count for f in configurations.plan(counts, 100))
    assert -(-sum(lengths) // 100) <= made <= best_fit(lengths, 100)
