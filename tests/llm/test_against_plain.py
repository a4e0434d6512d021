"""The pipeline, linked chats, tries and grammars against plain versions, queries against their SQL, and odd tables."""

import json
import os
import random
import re
from collections import defaultdict

import corpus_pipeline
import duckdb
import numpy as np
import pandas as pd
import pytest
from plain import WORD, base_counts, corpus, coverage, frame, near_groups, sha
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skein.llm import bpe, chat, contamination, fm_dedup, line_dedup, ngram_join, quality, queries, suffix_dedup, token_files, url_filters

SF = "/root/testdata/sf0.001"


def _rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or (isinstance(v, float) and pd.isna(v)):
            return ""
        return v if isinstance(v, str) else str(v) if isinstance(v, (bool, np.bool_)) else f"{float(v):.6f}"

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    assert _rows(queries.queries()[name](spark, SF).toPandas()) == _rows(con.sql(queries.oracle_sql()[name]).df())


def _folded(line: str) -> str:
    return re.sub("[ \t\x0b\f\r]+", " ", line.lower()).strip(" ")


def _without_earlier_lines(rows: list[tuple[int, str]], least: int = 3, fuzzy: int = 8) -> list[tuple[int, str]]:
    """Lines compared by folded words; a row that loses every line with enough words goes if its shorter lines stand earlier."""
    from plain import _one_apart

    spots = sorted((i, k, _folded(x)) for i, t in rows for k, x in enumerate(t.split("\n")))
    enough = lambda x: bool(x) and (len(x.split(" ")) >= least or len(re.findall("[一-鿿぀-ヿ]", x)) >= least)
    gone, first = defaultdict(set), {}
    for at, (i, k, x) in enumerate(spots):
        if not enough(x):
            first.setdefault(x, (i, k))
            continue
        words = x.split(" ")
        if any(y == x or (len(words) >= fuzzy and len(y.split(" ")) >= fuzzy and _one_apart(words, y.split(" "))) for _, _, y in spots[:at] if enough(y)):
            gone[i].add(k)
    out = []
    for i, t in rows:
        lines = t.split("\n")
        long = {k for k, x in enumerate(lines) if enough(_folded(x))}
        short = [(k, _folded(x)) for k, x in enumerate(lines) if not enough(_folded(x)) and _folded(x)]
        if long and long == gone[i] and all(first[x] != (i, k) for k, x in short):
            continue
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone[i])))
    return out


def test_pipeline(spark, tmp_path):
    rows = corpus(91, 90)
    item = " ".join(f"item{i}" for i in range(40))
    rows += [(9_000, "before " * 3 + "word word2 word3 " * 4 + item + " " + " ".join(f"own{i}" for i in range(60))), (9_001, " ".join(f"clean{i}" for i in range(80)) + "\nHaanth.")]
    rows += [(9_002, rows[-1][1]), (9_003, " ".join(f"clean{i}" for i in range(80)).replace("clean7 ", "x y z ") + " \nHaanth.")]
    frame(spark, rows, more=False).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(rows[0][0], 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    # with a single label no rule is certified
    kept = [(i, t) for i, t in rows if not (base_counts(t)[0] < 50 or 100 * base_counts(t)[4] > 50 * base_counts(t)[0])]
    assert 9_000 in dict(kept) and 9_002 in dict(kept)
    kept = _without_earlier_lines(kept)
    assert 9_002 not in dict(kept)
    groups = near_groups(kept, 5, 80, 100)
    kept = [(i, t) for i, t in kept if groups[i][1] == i]
    kept = [(i, t) for i, t in kept if coverage(t, item)[0] < 0.5]
    assert 9_000 not in dict(kept) and 9_001 in dict(kept)
    t = Tokenizer.from_file(bpe.vocabulary_path(spark, "word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    ids = {i: t.encode(x, add_special_tokens=False).ids for i, x in kept}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.token_ids, r.n_tokens, r.decoded_sha256) for r in got} == {i: (x, len(x), sha(t.decode(x, skip_special_tokens=False))) for i, x in ids.items()}
    assert len(got) == len(ids)


def _linked(rows: list[tuple]) -> list[tuple]:
    """kind, conversation, turn, call number, id, turns of call and result, level and problem, by walking each conversation."""
    out = []
    for conv in {r[0] for r in rows}:
        calls, results = [], []
        for _, turn, role, text in sorted((r for r in rows if r[0] == conv), key=lambda r: r[1]):
            data = json.loads(text) if role in ("assistant", "tool") and text.startswith("{") else {}
            if role == "assistant" and "tool_calls" in data:
                calls += [(turn, k, c) for k, c in enumerate(data["tool_calls"])]
            elif role == "tool" and "tool_call_id" in data:
                results.append((turn, data["tool_call_id"]))
            else:
                out.append(("message", conv, turn, None, None, None, None, 0, None))
        first = {}
        for turn, k, c in calls:
            first.setdefault(c["id"], (turn, k, c))
        waits = {i: {a for a in c.get("after", []) if a in first} for i, (_, _, c) in first.items()}
        level = {i: 0 for i in waits if not waits[i]}
        while more := {i: 1 + max(level[a] for a in waits[i]) for i in waits if i not in level and all(a in level for a in waits[i])}:
            level |= more
        answered = {}
        for turn, i in results:
            answered.setdefault(i, turn)
        for turn, k, c in calls:
            i, second = c["id"], first[c["id"]][:2] != (turn, k)
            given, tool = c["arguments"], chat.TOOLS.get(c["name"])
            kinds = {"string": str, "integer": int, "boolean": bool}
            if second:
                problem = "duplicate id"
            elif i not in level:
                problem = "cycle"
            elif any(a not in first for a in c.get("after", [])):
                problem = "unknown call awaited"
            elif tool is None:
                problem = "unknown tool"
            elif not isinstance(given, dict):
                problem = "not an object"
            elif any(a not in given for a in chat.REQUIRED[c["name"]]):
                problem = "missing argument"
            elif any(a not in tool for a in given):
                problem = "unknown argument"
            elif any(type(v) is not kinds[tool[a]] for a, v in given.items()):
                problem = "wrong type"
            else:
                problem = None
            out.append(("call", conv, turn, k, i, first[i][0], None if second else answered.get(i), level.get(i, 0), problem))
        for turn, i in results:
            known = first.get(i)
            problem = "no call" if known is None else "second result" if answered[i] != turn else None
            out.append(("result", conv, turn, known and known[1], i, known and known[0], answered[i], level.get(i, 0), problem))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_linked_chats(spark, seed):
    rnd = random.Random(seed)
    arguments = [{"query": "q"}, {"query": "q", "limit": 3}, {"query": 1}, {"limit": 2}, {"query": "q", "more": 1}, [1], "x", {"expression": "1"}, {"place": "p", "metric": True}, {"place": "p", "metric": 1}]
    rows = []
    for conv in [None, 1, 2, 3, 4]:
        for turn in range(12):
            name = lambda: f"c{rnd.randrange(9)}"
            kind = rnd.randrange(4)
            if kind < 2:
                calls = [{"id": name(), "name": rnd.choice([*chat.TOOLS, "other"]), "arguments": rnd.choice(arguments), "after": [name() for _ in range(rnd.choice([0, 0, 1, 2]))]} for _ in range(rnd.randint(1, 3))]
                rows.append((conv, turn, "assistant", json.dumps({"tool_calls": calls})))
            elif kind == 2:
                rows.append((conv, turn, "tool", json.dumps({"tool_call_id": name(), "content": rnd.choice([1, "x", None])})))
            else:
                rows.append((conv, turn, rnd.choice(["user", "assistant"]), "plain"))
    got = chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), chat.tool_schemas(spark, chat.TOOLS, chat.REQUIRED))
    found = [tuple(r) for r in got.select("kind", "conv_id", "turn", "call_no", "call_id", "call_turn", "result_turn", "level", "problem").collect()]
    assert sorted(found, key=str) == sorted(_linked(rows), key=str)


def test_repeated_messages_are_duplicates(spark):
    text = json.dumps({"tool_calls": [{"id": "a", "name": "calculator", "arguments": {"expression": "1"}}]})
    rows = [(c, 0, "assistant", text) for c in (None, None, 1, 1)] + [(None, 1, "tool", json.dumps({"tool_call_id": "a", "content": 1}))] * 2
    got = chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), chat.tool_schemas(spark, chat.TOOLS, chat.REQUIRED)).collect()
    assert sorted((r.conv_id or 0, r.kind, r.problem or "") for r in got) == [(0, "call", ""), (0, "call", "duplicate id"), (0, "result", ""), (0, "result", "second result"), (1, "call", ""), (1, "call", "duplicate id")]


@pytest.mark.parametrize(("seed", "p"), [(1, 85), (2, 50), (3, 70)])
def test_trie_finds_every_link(seed, p):
    rnd = random.Random(seed)
    rule = ngram_join.Jaccard(p, 100)
    base = [sorted(rnd.sample(range(1 << 48), rnd.randint(1, 400))) for _ in range(4)]
    sets = []
    for _ in range(60):
        own = set(rnd.choice(base))
        for x in rnd.sample(sorted(own), min(len(own) - 1, rnd.randint(0, 30))):
            own.remove(x)
        sets.append(tuple(sorted(own | {rnd.randrange(1 << 48) for _ in range(rnd.randint(0, 20))})))
    sets = sorted(set(sets))
    packed = [np.array(s, np.uint64) for s in sets]
    for x in range(len(sets)):
        alone = np.arange(len(sets))
        found = ngram_join.Trie(packed).similar(packed[x], x, alone, rule).tolist() if x % 7 == 0 else None
        if found is not None:
            linked = [y for y in range(len(sets)) if y != x and 100 * len(set(sets[x]) & set(sets[y])) >= p * len(set(sets[x]) | set(sets[y]))]
            assert sorted(found) == linked
    assert sorted(ngram_join.Trie(packed[:1]).similar(packed[0], 0, np.zeros(1, np.int64), rule).tolist()) == []


@pytest.mark.parametrize("first_rule", [300, 60_000, 70_000])
def test_grammars_expand_to_what_they_were_made_of(first_rule):
    rnd = np.random.default_rng(4)
    runs = [rnd.integers(first_rule - 250, first_rule, rnd.integers(1, 30)) for _ in range(12)]
    docs = [np.concatenate([runs[k] for k in rnd.integers(0, 12, rnd.integers(0, 40))] or [np.zeros(0, np.int64)]) for _ in range(60)] + [np.full(500, first_rule - 1)]
    docs = [np.r_[d, 0] for d in docs]
    flat, ends = np.concatenate(docs), np.cumsum([len(d) for d in docs])
    rules, seq, bounds = token_files.repair(flat, ends, first_rule, least=2)
    sizes = token_files.expanded_lengths(rules, first_rule)
    assert (token_files.expand(seq, rules, first_rule, sizes) == flat).all() and len(seq) < len(flat) / 4
    for k, d in enumerate(docs):
        own = seq[bounds[k - 1] if k else 0 : bounds[k]]
        assert (token_files.expand(own, rules, first_rule, sizes) == d).all()
    # nothing frequent is left, within documents
    cut = set(bounds.tolist())
    left = [(a, b) for i, (a, b) in enumerate(zip(seq[:-1].tolist(), seq[1:].tolist(), strict=True), 1) if i not in cut]
    counts = defaultdict(int)
    for pair in left:
        counts[pair] += 1
    assert first_rule + len(rules) == 1 << token_files.symbol_bits(first_rule) or max(counts.values()) < 2 or all(a == b for (a, b), n in counts.items() if n > 1)


def test_empty_tables_and_columns_that_clash(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    path = bpe.vocabulary_path(spark, "word_bpe_49k.json")
    for made in (
        quality.judge(docs, labels, joint=True), contamination.judge(docs, items), url_filters.judge(pages), chat.link(chat.from_turns(turns), chat.tool_schemas(spark, chat.TOOLS, chat.REQUIRED)),
        bpe.encode(docs.select("doc_id", "text"), path), corpus_pipeline.one_of_each_group(spark, docs, ""), corpus_pipeline.deduplicated_lines(spark, docs, ""),
    ):
        assert made.collect() == []
    clash = frame(spark, [(1, "same line once more\nown text here"), (2, "same line once more\nnothing of that kind"), (3, None), (4, "")], more=False)
    clash = clash.withColumns({c: F.lit("odd") for c in ("_gone", "_row", "_id", "_copy", "_parts", "_empty", "_lowered", "_a", "_b", "failed", "base_failed", "_stratum", "n_words", "most_long_words", "kept")})
    lines = {r.doc_id: r for r in line_dedup.dedup(clash, drop_copies=True).collect()}
    assert [lines[i].n_lines_removed for i in (1, 2, 3, 4)] == [0, 1, 0, 0] and all(r[c] == "odd" for r in lines.values() for c in ("_gone", "_row", "_id", "_copy", "_parts", "_empty"))
    item = spark.createDataFrame([(i, f"own text here number {i}") for i in range(40)], "item_id long, text string")
    for block in (contamination.BLOCK, 100):
        found = contamination.cover(clash, item, seed=3, block=block).collect()
        assert {r.doc_id: r.n_tiled for r in found} == {1: 3, 2: 0, 3: 0, 4: 0} and all(r["_lowered"] == r["_a"] == "odd" for r in found)
    long = " ".join(f"w{i}" for i in range(60))
    held = quality.keep(clash.unionByName(clash.limit(1).withColumns({"doc_id": F.lit(9).cast("long"), "text": F.lit(long)})), labels).collect()
    assert [(r.doc_id, r.failed, r.n_words) for r in held] == [(9, "odd", "odd")]


def test_texts_without_words(spark):
    rows = [(1, None), (2, ""), (3, " \t\n\r "), (4, "\n\n"), (None, None)]
    docs = frame(spark, rows)
    assert {(r.doc_id, r.n_removed) for r in suffix_dedup.dedup(docs).collect()} == {(i, 0) for i, _ in rows}
    assert {(r.doc_id, r.n_words, r.n_removed) for r in fm_dedup.dedup(docs).collect()} == {(i, 0, 0) for i, _ in rows}
    assert {(r.doc_id, r.component_id) for r in ngram_join.groups(docs).collect()} == {(i, i) for i, _ in rows}
    assert all(not WORD.findall(t or "") for _, t in rows)
    judged = quality.judge(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), joint=True).collect()
    assert all(r.base_failed and not r.kept for r in judged) and len(judged) == 5
