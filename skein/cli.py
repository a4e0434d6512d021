"""Command line: queries over a graph kept as Parquet, a row of JSON a line, and what makes such graphs.

python -m skein.cli GRAPH flow --anchor X | explain --anchor X | callers --symbol X | callees --symbol X | search --query X
| lens --name X | query --views FILE --name X [--param K=V] | endpoints --service X [--path P] | topics | coverage
| cross-service | tool --name X [--param K=V] | verify --suite FILE | report

GRAPH is written by: index --workspace DIR --rules DIR [--registry FILE] | import-graph --input FILE
| import-calls --input FILE | import-trace --graph OTHER --input DIR; discover --workspace DIR prints settings to review.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import tools
from .graph import Graph, as_edges
from .operators import aggregate, discover, extract, link, report, resolve, search, trace, traverse, verify
from .plans import lenses, views
from .sources import readers, rules
from .sources.readers import read_graph


def _suite(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def _params(given: list[str]) -> dict[str, str]:
    return dict(p.split("=", 1) for p in given)


def indexed(spark: SparkSession, workspace: str, rule_folder: str, registry: str = "") -> Graph:
    """The graph of a workspace: rules over its files, resolve rules, and links of messages and calls."""
    files, known = readers.workspace(spark, workspace), rules.rule_files(spark, rule_folder)
    of = lambda scope: [r for r in known if r.get("scope", "source") == scope]
    nodes = resolve.resolve(extract.extract(files, of("source")), of("resolve"))
    hosts = readers.service_registry(spark, registry) if registry else spark.createDataFrame([], "host string, service string")
    named = nodes.select("service").where("service <> ''").distinct().selectExpr("service AS name", "service")
    edges = link.producers_to_consumers(nodes)[0].unionByName(link.calls_to_endpoints(nodes, hosts, named)[0])
    return Graph(nodes, as_edges(edges))


def traced(spark: SparkSession, graph: Graph, path: str) -> Graph:
    texts = spark.read.text(path, wholetext=True).selectExpr("_metadata.file_path AS ordinal", "value")
    return trace.merged(graph, readers.spans(texts))


MAKERS: dict[str, Callable[[SparkSession, argparse.Namespace], Graph]] = {
    "index": lambda s, a: indexed(s, a.workspace, a.rules, a.registry),
    "import-graph": lambda s, a: readers.graph_json(s, a.input),
    "import-calls": lambda s, a: readers.call_graph(s, a.input),
    "import-trace": lambda s, a: traced(s, read_graph(s, a.other), a.input),
}
COMMANDS: dict[str, Callable[[Graph, argparse.Namespace], DataFrame]] = {
    "flow": lambda g, a: traverse.flow(g, a.anchor, a.depth)[0],
    "callers": lambda g, a: traverse.callers(g, a.symbol),
    "callees": lambda g, a: traverse.callees(g, a.symbol),
    "search": lambda g, a: search.search(g, a.query, a.limit),
    "lens": lambda g, a: lenses.lens(g, a.name),
    "lenses": lambda g, a: lenses.catalog(g),
    "topics": lambda g, a: aggregate.topics(g),
    "coverage": lambda g, a: aggregate.coverage(g.nodes),
    "cross-service": lambda g, a: traverse.cross_service(g),
    "explain": lambda g, a: traverse.explain(g, traverse.flow(g, a.anchor, a.depth)[1]),
    "endpoints": lambda g, a: traverse.endpoints_in_service(g, a.service, a.path or None),
    "query": lambda g, a: views.run_view(g, _suite(a.views)[a.name], _params(a.param)),
    "tool": lambda g, a: tools.tool(g, a.name, _params(a.param)),
    "verify": lambda g, a: verify.verify(g, _suite(a.suite)),
}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("graph")
    parser.add_argument("command", choices=[*COMMANDS, *MAKERS, "report", "discover"])
    for name in ("anchor", "symbol", "query", "name", "suite", "views", "service", "path", "workspace", "rules", "registry", "input"):
        parser.add_argument(f"--{name}", default="")
    parser.add_argument("--graph", dest="other", default="")
    parser.add_argument("--param", action="append", default=[])
    parser.add_argument("--limit", type=int, default=10)
    parser.add_argument("--depth", type=int, default=8)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("skein").getOrCreate()
    if args.command in MAKERS:
        readers.write_graph(MAKERS[args.command](spark, args), args.graph)
        return
    if args.command == "discover":
        rows = discover.overlay(discover.usage(discover.code_files(readers.listed(spark, args.workspace).withColumnRenamed("folder", "service"))))
    elif args.command == "report":
        print(report.render(read_graph(spark, args.graph)))
        return
    else:
        rows = COMMANDS[args.command](read_graph(spark, args.graph), args)
    for row in rows.toJSON().toLocalIterator():
        print(row)


if __name__ == "__main__":
    main()
