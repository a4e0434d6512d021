"""Cases that operators once left out."""

import json

import corpus_pipeline
from plain import frame

from skein.llm import chat, line_dedup, quality


def test_lines_are_compared_by_folded_words(spark):
    tabs, han = "one\ttwo\tthree\tfour", "今日はとても良い天気です"
    long = "The quick brown fox jumps over the lazy dog today"
    rows = [
        (1, f"Alpha beta gamma\n{tabs}\n{han}\n{long}\nab cd"),
        (2, "  ALPHA  beta\tgamma \r\nends here alone"),
        (3, f"{tabs}\n{han}\nanother line of two"),
        (4, f"{long.upper()}\r\n\tthe  quick brown cat jumps over the LAZY dog today\nAB CD\n日本"),
        (5, "ab cd\n日本"),
    ]
    got = {r.doc_id: (r.text, r.n_lines_removed) for r in line_dedup.dedup(frame(spark, rows), fold=True).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("ends here alone", 1), 3: ("another line of two", 2), 4: ("AB CD\n日本", 2), 5: ("ab cd\n日本", 0)}


def test_lines_of_rows_that_share_an_id_or_have_none(spark):
    rows = [
        (None, "same line once more\nunique to the first row"), (None, "another line stands here\nsame line once more"), (None, "short\nnothing else like this"),
        (5, "unlike all other lines\nsame line once more"), (5, "wholly its own line\nalso only found here"), (6, "one two three four\nx"), (6, "one two three four\nx"),
    ]
    got = sorted((r.doc_id or 0, r.text, r.n_lines_removed) for r in line_dedup.dedup(frame(spark, rows)).collect())
    kept = {t for _, t, _ in got}
    assert {"short\nnothing else like this", "wholly its own line\nalso only found here", "unlike all other lines"} <= kept
    assert sorted(n for i, _, n in got if i == 0) == [0, 0, 1] and sum(t.count("same line once more") for t in kept) == 1
    assert [(t, n) for i, t, n in got if i == 6] == [("one two three four\nx", 0), ("x", 1)]


def test_groups_of_rows_that_share_an_id_or_have_none(spark):
    prose = lambda name: " ".join(f"{name}{i}" for i in range(40))
    rows = [(None, prose("a")), (None, prose("a") + " x"), (None, prose("b")), (3, prose("c")), (7, prose("c") + " x"), (7, prose("d")), (8, prose("e")), (8, prose("e")), (9, None), (9, None)]
    got = corpus_pipeline.one_of_each_group(spark, frame(spark, rows), "").collect()
    ids = sorted((r.doc_id or 0, (r.text or "-")[0]) for r in got)
    assert ids == [(0, "a"), (0, "b"), (3, "c"), (7, "d"), (8, "e"), (9, "-"), (9, "-")]


def test_exact_copies_leave_no_stub(spark):
    text = "Haanth.\nthe first long line here\n\nAnd ornd."
    rows = [
        (1, text), (2, text), (3, "the first long line here\n\n"), (4, "the first long line here\nHaanth.\nonly here"), (5, "the first long line here\nnew new\nnew new"),
        (6, "the first long line here\nnew new"), (7, "Haanth."), (8, ""), (9, None), (None, text), (None, text),
    ]
    got = {r.doc_id: r.text for r in corpus_pipeline.deduplicated_lines(spark, frame(spark, rows), "").collect()}
    assert got == {None: text, 4: "Haanth.\nonly here", 5: "new new\nnew new", 7: "Haanth.", 8: "", 9: None}


def test_messages_with_calls_keep_what_stands_beside_them(spark):
    call = lambda i, **more: {"id": i, "name": "calculator", "arguments": {"expression": "1"}, **more}
    rows = [
        (1, 0, "assistant", json.dumps({"z": {"b": None, "a": 1}, "content": "let me \"see\"", "tool_calls": [call("a", after=["b"]), call("b")]})),
        (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": 1})), (1, 2, "tool", json.dumps({"tool_call_id": "b", "content": 2})),
        (2, 0, "assistant", json.dumps({"content": "no calls", "tool_calls": []})), (2, 1, "assistant", '{"tool_calls": []}'), (2, 2, "assistant", json.dumps({"tool_calls": [call("c")]})),
    ]
    got = chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), chat.tool_schemas(spark, chat.TOOLS, chat.REQUIRED))
    in_order = got.orderBy("conv_id", "order_turn", "order_call", "order_kind", "turn").collect()
    assert [(r.conv_id, r.turn, r.kind, r.call_id) for r in in_order] == [
        (1, 0, "message", None), (1, 0, "call", "b"), (1, 2, "result", "b"), (1, 0, "call", "a"), (1, 1, "result", "a"),
        (2, 0, "message", None), (2, 1, "message", None), (2, 2, "call", "c"),
    ]
    assert [r.json for r in in_order if r.kind == "message"] == [
        '{"content":"let me \\"see\\"","role":"assistant","z":{"a":1,"b":null}}', '{"content":"no calls","role":"assistant"}', '{"role":"assistant"}',
    ]
    plain = chat.link(spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string"), chat.tool_schemas(spark, chat.TOOLS, chat.REQUIRED))
    assert plain.columns == got.columns


def test_rules_are_certified_on_a_few_hundred_good_labels(spark):
    rows = [(i, " ".join(f"word{chr(97 + (i * k) % 26)}{k}" for k in range(60))) for i in range(500)] + [(1000 + i, " ".join(f"word{k} ##" for k in range(60))) for i in range(5)]
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in quality.judge(frame(spark, rows), labels, joint=True).collect()}
    assert kept == {i: i < 1000 for i, _ in rows}
    few = {r.doc_id: r.kept for r in quality.judge(frame(spark, rows), labels.where("doc_id >= 250"), joint=True).collect()}
    assert all(few.values())
