"""The ten operators against plain versions, over texts with nulls, ties, copies and clashing columns."""

import json
import random

import pytest
from plain import base_counts, corpus, coverage, crc, deduplicated_lines, earlier_passages, frame, ids_sha, kept_by_quality, near_groups, repeated_bytes, sha
from tokenizers import Tokenizer

from skein.llm import bpe, chat, contamination, fm_dedup, line_dedup, ngram_join, quality, suffix_dedup, token_files, url_filters
from skein.llm.components import components


def _by_id(df, *columns):
    rows = df.select("doc_id", *columns).collect()
    out = {r[0]: tuple(r[1:]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize(("seed", "n", "p"), [(1, 4, 85), (2, 5, 80), (3, 2, 60)])
def test_ngram_join(spark, seed, n, p):
    rows = corpus(seed)
    assert _by_id(ngram_join.groups(frame(spark, rows), n=n, p=p, q=100), "n_shingles", "component_id") == near_groups(rows, n, p, 100)


def test_ngram_join_without_ids_and_rows(spark):
    assert ngram_join.groups(frame(spark, [(1, "a b")]).limit(0)).collect() == []
    same = ngram_join.groups(frame(spark, [(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (9, None)]), n=2)
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in same.collect()) == [(0, 4, 0), (7, 4, 7), (7, 4, 7), (9, 0, 9)]


def test_components(spark):
    rnd = random.Random(5)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)]
    links = [(a, b) for a, b in links if a != b]
    least = {x: x for e in links for x in e}
    while True:
        before = dict(least)
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
        if before == least:
            break
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    groups = lambda m: {frozenset(x for x in m if m[x] == v) for v in m.values()}
    assert groups(got) == groups(least)


@pytest.mark.parametrize("seed", [11, 12])
def test_bpe(spark, seed):
    path = bpe.vocabulary_path(spark, "word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    rows = corpus(seed) + [(-1, "Don't STOP!!! e\u0301 ½ ﬁ İ 12,345 <|startoftext|>"), (-2, "a" * 5000), (-3, "汉字 🙂🙂 \x00 \u200d")]
    expected = {}
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        expected[i] = (len(ids), ids_sha(ids), sha(t.decode(ids, skip_special_tokens=False)))
    docs = frame(spark, rows)
    assert _by_id(bpe.digests(docs, path), "n_tokens", "ids_sha256", "decoded_sha256") == expected
    coded = bpe.decode(bpe.encode(docs.select("doc_id", "text"), path), path)
    assert {r.doc_id: (len(r.token_ids), ids_sha(r.token_ids), sha(r.decoded)) for r in coded.collect()} == expected


@pytest.mark.parametrize(("seed", "length", "k"), [(21, 400, 64), (22, 60, 16)])
def test_suffix_array_dedup(spark, seed, length, k):
    rows = corpus(seed)
    got = suffix_dedup.dedup(frame(spark, rows), length=length, k=k)
    expected = repeated_bytes(rows, length)
    assert _by_id(got, "n_bytes", "n_removed", "n_spans", "kept_sha256") == expected
    assert {i: sha(bytes(k[0])) for i, k in _by_id(got, "kept").items()} == {i: e[3] for i, e in expected.items()}


def test_suffix_arrays_of_a_shard_meet():
    import numpy as np

    rnd = random.Random(3)
    texts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 60))) for _ in range(40)]
    symbols, offsets = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    whole = suffix_dedup.repeated_windows(symbols, offsets, np.ones(40, np.int64), 9)
    for most in (50, 200):
        split = suffix_dedup.repeated_windows(symbols, offsets, np.ones(40, np.int64), 9, most)
        assert all((a == b).all() for a, b in zip(whole, split, strict=True))


@pytest.mark.parametrize(("seed", "length", "k"), [(31, 13, 5), (32, 4, 2)])
def test_fm_index_dedup(spark, seed, length, k):
    rows = corpus(seed)
    assert _by_id(fm_dedup.dedup(frame(spark, rows), length=length, k=k), "n_words", "n_removed", "kept_sha256") == earlier_passages(rows, length)


def test_dedup_of_a_passage_that_most_documents_have(spark):
    rnd = random.Random(33)
    passage = " ".join(f"common{i}" for i in range(60))
    rows = [(i, f"start{i} {passage} end{rnd.random()}" if i % 3 else f"lone{i} text{i} of{i} its{i} own{i}") for i in range(600)]
    split = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
    }
    for k, v in split.items():
        spark.conf.set(k, v)
    try:
        docs = frame(spark, rows).repartition(16)
        assert _by_id(suffix_dedup.dedup(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256") == repeated_bytes(rows, 400)
        assert _by_id(fm_dedup.dedup(docs), "n_words", "n_removed", "kept_sha256") == earlier_passages(rows, 13)
    finally:
        for k in split:
            spark.conf.unset(k)


def test_dedup_of_no_rows(spark):
    none = frame(spark, [(1, "x")]).limit(0)
    for run in (suffix_dedup.dedup, fm_dedup.dedup, line_dedup.dedup, lambda d: bpe.digests(d, bpe.vocabulary_path(spark, "word_bpe_49k.json"))):
        assert run(none).collect() == []


PAGES = [
    ("http://WWW.Example.org/es/1?q#f", 0), ("https://example.org/en/17", 0), ("http://example.org/en/2", 0), ("http://a.com/fr/x", 0), ("http://b.com/de/", 0), ("http://b.com", 0),
    ("http://c.net/", 0), ("http://d.net/a", 0), ("no scheme", 0), (None, 0), ("http://notexample.org/es/", 0), ("x://A.ORG:80/p#z", 0), ("http://e.net?a/b", 0), ("://h/p", 0), ("http://b.com/de/2", 0),
]
LINKS = {6: ["http://B.com/1", "//b.com/2", "/local"], 7: ["http://a.com/"], 3: ["https://e.net/x", "http://u@d.net:8080/"], 12: ["http://b.com"], 4: ["http://c.net"]}


def test_url_filters(spark):
    pages = [(i, u, "".join(f'<a HREF="{x}">' for x in LINKS.get(i, [])) if i != 9 else None) for i, (u, _) in enumerate(PAGES)]

    def parts(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        tail = rest[cut:]
        return rest[:cut].lower(), tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]

    rules = {}
    for i, url, _ in pages:
        host, path = parts(url)
        fits = [r for r in url_filters.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        rules[i] = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    edges: dict = {}
    for i, url, _ in pages:
        for x in LINKS.get(i, []):
            to = parts(x if "://" in x else "http:" + x if x.startswith("//") else None)[0].split("@")[-1].split(":")[0]
            if to and to != parts(url)[0]:
                edges[parts(url)[0], to] = edges.get((parts(url)[0], to), 0) + 1

    def rank(verdict, along):
        seeds: dict = {}
        for i, url, _ in pages:
            if rules[i] and rules[i][2] == verdict:
                seeds[parts(url)[0]] = seeds.get(parts(url)[0], 0) + 1 / sum(r is not None for r in rules.values())
        base = {h: s * (1 - url_filters.DAMPING) for h, s in seeds.items()}
        now = dict(base)
        for _ in range(url_filters.ROUNDS):
            then = dict(base)
            for (a, b), n in along.items():
                then[b] = then.get(b, 0) + url_filters.DAMPING * now.get(a, 0) * n / sum(m for (c, _), m in along.items() if c == a)
            now = then
        return now

    trust, distrust = rank("allow", edges), rank("block", {(b, a): n for (a, b), n in edges.items()})
    expected = {}
    for i, url, _ in pages:
        host, path = parts(url)
        bad = distrust.get(host, 0) > url_filters.RATIO * trust.get(host, 0)
        expected[i] = (host, path, "".join(rules[i][:2]) if rules[i] else None, rules[i][2] if rules[i] else "block" if bad else "allow")
    got = url_filters.judge(spark.createDataFrame([(*p, "odd") for p in pages], "page_id long, url string, html string, host string"))
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()} == expected
    assert {v for _, _, rule, v in expected.values() if rule is None} == {"allow", "block"}


def test_quality_rules(spark):
    rnd = random.Random(8)
    letters = lambda k: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 7))) for _ in range(k))
    rows = corpus(41) + [(10_000 + i, letters(60)) for i in range(4000)] + [(20_000 + i, letters(60) + " ##" * 30) for i in range(20)]
    good = {i for i, _ in rows if 10_000 <= i < 20_000}
    labels = spark.createDataFrame([(i, 1, 0) for i in good] + [(i, 0, 0) for i, _ in rows if i not in good] + [(None, 1, 0), (-5, 1, 0), (10_000, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.judge(frame(spark, rows), labels)
    counts = {i: base_counts(t) for i, t in rows}
    assert _by_id(got, *quality.COUNTS) == counts
    kept = kept_by_quality(rows, good, quality.LADDERS, quality.FALSE_REJECTIONS, quality.RISK)
    assert _by_id(got, "base_failed", "kept") == kept
    assert not any(kept[20_000 + i][1] for i in range(20))
    held = quality.keep(frame(spark, rows), labels)
    assert {r.doc_id for r in held.collect()} == {i for i, k in kept.items() if k[1]}
    without = _by_id(quality.judge(frame(spark, rows[:90]), labels.limit(0)), "base_failed", "kept")
    assert all(failed != kept for failed, kept in without.values())


def test_binomial_tail_is_exact():
    from plain import tail

    for k, n, p in [(0, 1, 0.5), (3, 40, 0.02), (7, 900, 0.01), (0, 2000, 0.002)]:
        assert quality.binomial_tail(k, n, p) == pytest.approx(tail(k, n, p), rel=1e-9)


def test_token_files(spark, tmp_path):
    path = bpe.vocabulary_path(spark, "byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    rows = corpus(51) + [(-9, "the same words again and again " * 400), (-8, "aaaa" * 900), (-7, "  two  blanks\n\n\ttab 's\u3000x")]
    token_files.write(frame(spark, rows), str(tmp_path / "files"), path)
    start, expected, ids_of = 0, {}, {}
    for i, text in sorted(rows):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        expected[i], ids_of[i] = (start, len(ids), crc(ids)), ids
        start += len(ids)
    got = token_files.read(spark, str(tmp_path / "files"))
    assert _by_id(got, "start", "n_tokens", "ids_crc32") == expected
    shards = [r.asDict() for r in spark.read.parquet(str(tmp_path / "files")).collect()]
    assert sum(len(s["symbols"]) // 2 for s in shards) < start
    for s in shards:
        for k, doc in enumerate(s["doc_ids"]):
            assert token_files.read_document(s, k).tolist() == ids_of[doc]


def test_chat(spark):
    call = lambda *calls: json.dumps({"tool_calls": list(calls)})
    result = lambda i, c: json.dumps({"content": c, "tool_call_id": i})
    rows = [
        (1, 0, "user", 'say "hi"\n'), (1, 1, "assistant", call({"id": "a", "name": "search", "arguments": {"query": "q", "limit": 3}, "after": ["b"]}, {"id": "b", "name": "weather", "arguments": {"place": "Rome", "days": "two"}})),
        (1, 2, "tool", result("b", {"z": 1, "a": [True, None]})), (1, 3, "tool", result("a", "done")), (1, 4, "tool", result("a", "again")), (1, 5, "tool", result("none", 1)),
        (2, 0, "assistant", call({"id": "a", "name": "nothing", "arguments": {}}, {"id": "c", "name": "calculator", "arguments": {}}, {"id": "c", "name": "calculator", "arguments": {"expression": "1", "more": 2}})),
        (3, 0, "assistant", call({"id": "p", "name": "calculator", "arguments": {"expression": "1"}, "after": ["q"]}, {"id": "q", "name": "calculator", "arguments": [1], "after": ["p"]})),
        (4, None, "user", None), (None, 1, None, ""), (5, 0, "assistant", "{not json"), (5, 1, "assistant", call({"id": "r", "name": "calculator", "arguments": 5})),
    ]
    got = chat.link(spark.createDataFrame([(*r, "odd") for r in rows], "conv_id long, turn long, role string, text string, level string"), chat.tool_schemas(spark, chat.TOOLS, chat.REQUIRED)).collect()
    calls = {(r.conv_id, r.turn, r.call_no): (r.call_id, r.result_turn, r.level, r.problem) for r in got if r.kind == "call"}
    assert calls == {
        (1, 1, 0): ("a", 3, 1, None), (1, 1, 1): ("b", 2, 0, "wrong type"), (2, 0, 0): ("a", None, 0, "unknown tool"), (2, 0, 1): ("c", None, 0, "missing argument"),
        (2, 0, 2): ("c", None, 0, "duplicate id"), (3, 0, 0): ("p", None, 0, "cycle"), (3, 0, 1): ("q", None, 0, "cycle"), (5, 1, 0): ("r", None, 0, "not an object"),
    }
    results = {r.turn: (r.call_id, r.call_turn, r.problem, r.json) for r in got if r.kind == "result"}
    assert results[2] == ("b", 1, None, '{"content":{"a":[true,null],"z":1},"role":"tool","tool_call_id":"b"}')
    assert [results[k][2] for k in (3, 4, 5)] == [None, "second result", "no call"]
    texts = {(r.conv_id, r.turn): r.json for r in got if r.kind == "message"}
    assert texts == {(1, 0): '{"content":"say \\"hi\\"\\n","role":"user"}', (4, None): '{"content":"","role":"user"}', (None, 1): '{"content":"","role":""}', (5, 0): '{"content":"{not json","role":"assistant"}'}
    assert next(r.json for r in got if r.kind == "call" and r.call_id == "b") == '{"arguments":{"days":"two","place":"Rome"},"id":"b","name":"weather","role":"assistant"}'


@pytest.mark.parametrize("seed", [61, 62])
def test_line_dedup(spark, seed):
    rnd = random.Random(seed)
    base = [[rnd.choice("abcdefg") for _ in range(rnd.randint(6, 13))] for _ in range(10)]
    rows = corpus(seed, 40)
    for i in range(60):
        lines = []
        for _ in range(rnd.randint(1, 5)):
            words, at = list(rnd.choice(base)), rnd.randrange(6)
            change = rnd.randrange(5)
            if change == 0:
                words[at] = rnd.choice("hij")
            elif change == 1:
                words.insert(at, rnd.choice("hij"))
            elif change == 2:
                del words[at]
            elif change == 3:
                words[at], words[at - 3] = "k", "l"
            lines.append(" ".join(words))
        rows.append((50_000 + i, "\n".join(lines)))
    got = line_dedup.dedup(frame(spark, rows))
    assert "component" in got.columns
    assert _by_id(got, "text", "n_lines_removed") == deduplicated_lines(rows)


@pytest.mark.parametrize("block", [contamination.BLOCK, 300])
def test_decontamination(spark, block):
    rnd = random.Random(71)
    words = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 40)))) for i in range(12)] + [(90, None), (91, ""), (92, "W1, w2! w3"), (93, "w5 w5 w5 w5 w5 w5 w5 w5")]
    rows = [(1, None), (2, ""), (3, "w1 w2 w3"), (4, "w5 " * 30), (5, "nothing of it")]
    for i in range(40):
        item = rnd.choice(items[:12])[1].split(" ")
        cut = rnd.randrange(len(item) + 1)
        rows.append((10 + i, " ".join([*(rnd.choice(words) for _ in range(rnd.randint(0, 30))), *item[cut:], "--", *item[:cut]])))
    expected = {}
    for i, text in rows:
        found = [(*coverage(text, t), k) for k, t in items]
        best = max(found, key=lambda f: (f[0], -f[2]))
        expected[i] = (best[0], best[2] if best[0] else None, best[1], sum(f[0] >= 0.5 for f in found))
    benchmark = spark.createDataFrame([(*x, "odd") for x in items], "item_id long, text string, coverage string")
    got = contamination.cover(frame(spark, rows), benchmark, block=block)
    assert {i: (pytest.approx(c), *rest) for i, (c, *rest) in _by_id(got, "coverage", "item_id", "n_tiled", "n_items").items()} == expected
    assert contamination.judge(frame(spark, rows), benchmark.limit(0)).where("contaminated").count() == 0
