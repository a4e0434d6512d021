"""Workspaces, rule files and settings."""

import json

import pytest
from pyspark.sql import functions as F

from skein import cli, tools
from skein.functions.text import extract_topics
from skein.sources import readers, rules


def _write(root, files):
    for name, content in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())


def test_workspace(spark, tmp_path):
    root = tmp_path / "work"
    _write(root, {
        "Shop_API/service.yaml": "name: Orders_Svc\nexclude:\n  - gen/*\n  - '*.tmp.js'\n", "Shop_API/src/A.java": b"class A {} \xff", "Shop_API/gen/B.java": "x", "Shop_API/x.tmp.js": "x",
        "Shop_API/src/test/T.java": "x", "Shop_API/node_modules/m.js": "x", "web/package.json": '{"name": "@org/Web_App"}', "web/a.spec.ts": "x", "web/a.ts": "x",
        "tested/service.yaml": "include_test_paths: true\n", "tested/tests/t.js": "x", "notes/readme.md": "x", ".hidden/a.java": "x", "top.java": "x",
    })
    got = {(r.service, r.file): r.content for r in readers.workspace(spark, str(root)).collect()}
    assert set(got) == {("orders-svc", "service.yaml"), ("orders-svc", "src/A.java"), ("web-app", "package.json"), ("web-app", "a.ts"), ("tested", "service.yaml"), ("tested", "tests/t.js")}
    assert got["orders-svc", "src/A.java"] == "class A {} "
    bare = tmp_path / "bare"
    _write(bare, {"docs/readme.md": "x", "b.txt": "y"})
    assert {(r.service, r.file) for r in readers.workspace(spark, str(bare)).collect()} == {("bare", "docs/readme.md"), ("bare", "b.txt")}


def test_settings():
    assert rules.settings("a: 1\n# no\n\nb:\n  c: 'x'\n  d:\n    - 1\n    - true\n  e: [p, \"q\"]\nbare\nf: True") == {"a": "1", "b": {"c": "x", "d": ["1", True], "e": ["p", "q"]}, "f": True}
    assert rules.settings("") == {} == rules.settings("- a\n- b")


def test_rule_files_and_layers(spark, tmp_path):
    rule = lambda name, label: {"name": name, "scope": "source", "match": {"files": ["*"]}, "emit": {"label": label}}
    _write(tmp_path, {"b.json": json.dumps(rule("two", "B")), "a.json": json.dumps([rule("one", "A"), {"name": "r", "scope": "resolve", "match": {}, "set": {}}]), "c.txt": "no"})
    found = rules.rule_files(spark, str(tmp_path))
    assert [r["name"] for r in found] == ["one", "r", "two"]
    assert [(r["name"], r["emit"]["label"]) for r in rules.overlaid_rules(found[:1] + found[2:], [rule("one", "C"), rule("new", "D")])] == [("two", "B"), ("one", "C"), ("new", "D")]
    for bad in ({}, {"name": "x", "scope": "other"}, {"name": "x", "scope": "graph", "match": {}, "emit": {}}, {"name": "x", "match": {"files": "*"}, "emit": {"label": "L"}}, {"name": "x", "match": {"files": []}, "emit": {}}, {"name": "x", "scope": "resolve", "match": {}}):
        with pytest.raises(ValueError):
            rules.checked_rule(bad)


def test_merged():
    base = {"a": {"x": 1, "y": [1, 2]}, "b": [{"name": "p", "v": 1}, {"name": "q"}], "c": 1}
    over = {"a": {"y": [2, 3], "z": 4}, "b": [{"name": "r"}, {"name": "p", "w": 2}], "d": [1]}
    assert rules.merged(base, over) == {"a": {"x": 1, "y": [1, 2, 3], "z": 4}, "b": [{"name": "p", "v": 1, "w": 2}, {"name": "q"}, {"name": "r"}], "c": 1, "d": [1]}
    assert base["a"] == {"x": 1, "y": [1, 2]}


def test_topics_without_any_literal(spark):
    assert spark.range(1).select(extract_topics(F.lit("nothing"))).first()[0] == ["{unknown}"]


def test_stored_queries_are_checked():
    good = {"a": {"kind": "query", "query": ["MATCH (n)", "RETURN n"], "returns": {"n": "X"}, "params": {}}, "b": {"kind": "query", "query": "MATCH (n)\nRETURN n"}}
    assert rules.checked_specs(good) == good
    for bad in ([], {"a": {"kind": "nodes"}}, {"a": {"kind": "query", "query": []}}, {"a": {"kind": "query", "query": ["", "x"]}}, {"a": {"kind": "query", "query": "x", "returns": {"n": ""}}}, {"a": {"kind": "query", "query": "x", "language": "sql"}}, {"a": {"kind": "query", "query": "x", "params": []}}):
        with pytest.raises(ValueError):
            rules.checked_specs(bad)


def test_tools_answer_or_say_that_they_do_not(spark):
    graph = readers.from_rows(spark, [{"id": "a", "label": "Endpoint", "name": "pay", "file": "f.java", "service": "s"}, {"id": "b", "label": "X", "name": "other", "service": "s"}], [{"type": "HANDLES", "from": "a", "to": "b"}])
    ids = lambda name, column, **k: [r[column] for r in tools.tool(graph, name, k).collect()]
    assert ids(tools.DEFINITION, "id", symbol="pay") == ["a"] and ids(tools.DEFINITION, "id", symbol="nothing here") == []
    assert ids(tools.REFERENCES, "src", symbol="other") == ["a"] and ids(tools.CALLEES, "dst", symbol="pay") == ["b"]
    assert ids(tools.SYMBOLS, "id", file_path="f.java") == ["a"] and sorted(ids(tools.DEPENDENCIES, "id", symbol="pay")) == ["a", "b"]
    assert ids("other.tool", "error") == ["not_supported"]


def test_command_line_from_workspace_to_answers(spark, tmp_path, capsys):
    shop = tmp_path / "work" / "shop"
    shop.mkdir(parents=True)
    (shop / "package.json").write_text('{"name": "@x/shop"}')
    (shop / "Pay.java").write_text('@RestController\nclass Pay extends Base<Order> {\n  @GetMapping("/pay")\n  String pay() { bus.to("paid"); }\n}\n')
    (tmp_path / "rules").mkdir()
    emit = {"label": "Endpoint", "source": "pack:r", "values": {"path": "{{path}}", "http_method": "{{http_method}}", "handler": "{{class_name}}.{{method_name}}"}}
    (tmp_path / "rules" / "r.json").write_text(json.dumps([
        {"name": "e", "match": {"files": ["*.java"], "strategy": "tree-sitter", "tree_sitter": {"extractor": "annotation-method"}, "class_annotations": ["@RestController"], "method_annotations": {"Get": "GET"}}, "emit": emit},
        {"name": "p", "match": {"files": ["*.java"], "strategy": "tree-sitter", "tree_sitter": {"extractor": "method-call", "method_name": "to", "capture_as": "t"}}, "emit": {"label": "Producer", "values": {"topic": "{{t}}", "message_role": "producer"}}},
        {"name": "k", "scope": "resolve", "match": {"label": "Producer", "from": "topic", "patterns": [{"regex": "^(?P<x>p.*)"}]}, "set": {"kind": "was-{{x}}"}},
    ]))
    out = str(tmp_path / "graph")
    cli.main([out, "index", "--workspace", str(tmp_path / "work"), "--rules", str(tmp_path / "rules")])
    said = lambda *args: (cli.main([out, *args]), [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")])[1]
    assert [(r["path"], r["handler"], r["line"]) for r in said("endpoints", "--service", "shop")] == [("/pay", "Pay.pay", 3)]
    assert [(r["topic"], r["kind"]) for r in said("search", "--query", "paid")] == [("paid", "was-paid")]
    assert said("tool", "--name", "none")[0]["error"] == "not_supported"
    (tmp_path / "trace.json").write_text('{"batch":[{"service":"shop","spans":[{"name":"x","attributes":{"http.route":"/new","peer.service":"bank"}}]}]}')
    more = str(tmp_path / "more")
    cli.main([more, "import-trace", "--graph", out, "--input", str(tmp_path / "trace.json")])
    assert [r["service"] for r in (cli.main([more, "endpoints", "--service", "bank"]), [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")])[1]] == ["bank"]
    assert {r["value"] for r in (cli.main([out, "discover", "--workspace", str(tmp_path / "work")]), [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")])[1]} == {"@RestController"}
