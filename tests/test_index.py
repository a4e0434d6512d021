"""The text index against scans, and snapshots against whole graphs."""

import random

import pytest

from skein import snapshots
from skein.graph import Graph, version
from skein.operators import postings, search, traverse
from skein.sources.readers import from_rows


@pytest.fixture(scope="module")
def world(spark):
    rnd = random.Random(3)
    word = lambda: rnd.choice(["loan", "Loans", "permit", "mötor", "vehicle", "a", "日本語", "x.y", "/api/v1", "motor-home", "%_", "aaa", "aaaa"])
    nodes = [{"id": f"n{i}", "label": rnd.choice(["Endpoint", "HttpCall", "X"]), "service": rnd.choice(["a", "B", None]), "name": " ".join(word() for _ in range(rnd.randint(0, 3))) or None, "path": f"/{word()}/{word()}", "topics": [word()], "own": word()} for i in range(120)]
    edges = [{"type": rnd.choice(["T", "U"]), "from": f"n{rnd.randrange(130)}", "to": f"n{rnd.randrange(130)}"} for _ in range(200)]
    graph = from_rows(spark, nodes, edges)
    return graph, postings.build(graph, shards=7)


def _keys(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


@pytest.mark.parametrize("symbol", ["loan", "LOAN", "mötor", "日本語", "日本", "a", "", "aaaa", "r/l", "nowhere", "%_", "loan permit", "x.y", "n11"])
def test_the_index_finds_what_a_scan_finds(world, symbol):
    graph, index = world
    assert _keys(postings.matching(index, symbol), "id", "path") == _keys(traverse.match_nodes(graph, symbol), "id", "path")
    if symbol in ("loan", "日本", "nowhere", "n11"):
        for one, other in ((postings.callers, traverse.callers), (postings.callees, traverse.callees)):
            assert _keys(one(index, symbol), "type", "src", "dst") == _keys(other(graph, symbol), "type", "src", "dst")


@pytest.mark.parametrize("query", ["loan", "motor-home", "permit vehicle car", "zzz", "日本語", "automobile licence"])
def test_ranked_search_through_the_index(world, query):
    graph, index = world
    rows = lambda df: [tuple(r) for r in df.select("id", "score", "mode").collect()]
    assert rows(postings.search(index, query, 7)) == rows(search.search(graph, query, 7))
    assert rows(postings.search(index, query, 3, "Endpoint")) == rows(search.search(graph, query, 3, "Endpoint"))


def test_an_index_of_nothing(spark, world):
    graph, _ = world
    index = postings.build(Graph(graph.nodes.limit(0), graph.edges.limit(0)), shards=2)
    assert postings.matching(index, "loan").count() == postings.callers(index, "a").count() == 0


def test_postings_are_read_by_bucket_and_nodes_by_shard(world):
    _, index = world
    plan = postings.matching(index, "vehicle")._jdf.queryExecution().executedPlan().toString()
    assert "SelectedBucketsCount" in plan and "dynamicpruning" in plan


def test_snapshots_grow_by_what_is_new(spark, world):
    graph, _ = world
    nodes, edges = graph.nodes, graph.edges
    path = snapshots.create(Graph(nodes.where("label = 'X'"), edges.where("type = 'T'")))
    snapshots.append(spark, path, Graph(nodes.unionByName(nodes.limit(5)), edges))
    snapshots.append(spark, path, Graph(nodes.limit(0), edges.limit(0)))
    assert snapshots.parts(spark, path) == [0, 1, 2]
    once = Graph(nodes, edges.dropDuplicates(["type", "src", "dst"]))
    assert snapshots.version(spark, path).first() == version(once).first() == version(snapshots.read(spark, path)).first()
    assert snapshots.read(spark, path).nodes.count() == 120
    # a part without a manifest row, as a failed run leaves it, is not there
    nodes.select("id").write.parquet(f"{path}/nodes/part-000003")
    assert snapshots.read(spark, path).nodes.count() == 120 and snapshots.parts(spark, path) == [0, 1, 2]
    snapshots.append(spark, path, Graph(from_rows(spark, [{"id": "new", "label": "X"}], []).nodes, edges.limit(0)))
    assert snapshots.read(spark, path).nodes.where("id = 'new'").count() == 1 and snapshots.version(spark, path).first() != version(once).first()


def test_parts_are_written_when_they_are_asked_for(world):
    graph, _ = world
    index = postings.build(graph, shards=3)
    assert not {"nodes", "grams", "tokens", "by_src", "by_dst"} & set(vars(index))
    assert postings.callers(index, "loan").count() == traverse.callers(graph, "loan").count()
    assert not {"tokens", "by_src"} & set(vars(index))


def test_frequent_grams_have_no_postings(world, monkeypatch):
    graph, _ = world
    monkeypatch.setattr(postings, "FEW", 8)
    index = postings.build(graph, shards=3)
    counted = index.gram_counts.groupBy().sum("n").first()[0]
    assert index.grams.count() < counted and max(r.n for r in index.gram_counts.collect()) > index.most
    for symbol in ("loan", "vehicle", "api", "n11", "motor-home vehicle", "nowhere"):
        assert _keys(postings.matching(index, symbol), "id") == _keys(traverse.match_nodes(graph, symbol), "id")


def test_callees_and_search_write_what_they_read(world):
    graph, _ = world
    index = postings.build(graph, shards=3)
    assert postings.callees(index, "loan").count() == traverse.callees(graph, "loan").count()
    assert not {"tokens", "by_dst"} & set(vars(index))
    index = postings.build(graph, shards=3)
    assert postings.search(index, "loan", 3).count() == 3 and not {"tokens", "by_src", "by_dst"} & set(vars(index))
