"""Checks of a graph against expectations; each gives rows (kind, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_test_path
from ..graph import Graph, materialize


def _errors(df: DataFrame, kind: str, detail) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), detail.alias("detail"))


def missing_services(graph: Graph, wanted: list[str]) -> DataFrame:
    want = graph.spark.createDataFrame([(s,) for s in wanted], "service string")
    return _errors(want.join(graph.nodes.select("service").distinct(), "service", "left_anti"), "missing service", F.col("service"))


def duplicate_ids(graph: Graph) -> DataFrame:
    return _errors(graph.nodes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1"), "duplicate node id", F.col("id"))


def test_edges(graph: Graph, types: tuple[str, ...] = ("KAFKA_DELIVERS", "CROSSES_TIER")) -> DataFrame:
    where = F.coalesce(F.nullif("file", F.lit("")), "path", F.lit(""))
    tests = graph.nodes.where(is_test_path(where)).select("id", where.alias("at"))
    ends = graph.edges.where(F.col("type").isin(*types)).select("type", F.explode(F.array("src", "dst")).alias("id"))
    return _errors(ends.join(tests, "id"), "edge touches test path", F.concat_ws(" ", "type", "at"))


def forbidden_labels(graph: Graph, labels: list[str]) -> DataFrame:
    return _errors(graph.nodes.where(F.col("label").isin(*labels)), "forbidden node label", F.concat_ws(" ", "label", "id"))


def min_counts(graph: Graph, wanted: dict[str, int]) -> DataFrame:
    """Labels and types with fewer nodes and edges than wanted; `nodes` and `edges` stand for all."""
    want = graph.spark.createDataFrame(list(wanted.items()), "key string, least long")
    counts = lambda df, column, total: df.groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n")).unionByName(df.agg(F.count("*").alias("n")).select(F.lit(total).alias("key"), "n"))
    have = counts(graph.nodes, "label", "nodes").unionByName(counts(graph.edges, "type", "edges")).groupBy("key").agg(F.sum("n").alias("n"))
    joined = want.join(have, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return _errors(joined.where("n < least"), "count", F.format_string("%s %d < %d", "key", "n", "least"))


def required_edges(graph: Graph, wanted: list[dict[str, str]]) -> DataFrame:
    """Requirements (type, from_service, to_service, topic, path; those left out hold for all) that no edge meets."""
    keys = ("type", "from_service", "to_service", "topic", "path")
    want = graph.spark.createDataFrame([(i, *(w.get(k) for k in keys)) for i, w in enumerate(wanted)], "i int, " + ", ".join(f"w_{k} string" for k in keys))
    # a wanted edge usually names its type: all others stay out of the joins
    types = {w.get("type") for w in wanted}
    edges = graph.edges.where(F.col("type").isin(*types)) if None not in types else graph.edges
    own = edges.select("type", "src", "dst", "from_service", "to_service").join(graph.nodes.select(F.col("id").alias("src"), "topic"), "src", "left").join(graph.nodes.select(F.col("id").alias("dst"), "path"), "dst", "left")
    kinds = own.select(*keys).distinct()
    fits = reduce(lambda a, b: a & b, ((F.col(f"w_{k}").isNull() | (F.col(f"w_{k}") == F.col(k))) for k in keys))
    lone = want.join(kinds, fits, "left_anti")  # the wanted ones are a handful: they are the side that is broadcast
    return _errors(lone, "missing required edge", F.concat_ws(" ", *(f"w_{k}" for k in keys)))


def unapproved_low(graph: Graph, allowed: list[str]) -> DataFrame:
    items = graph.nodes.select("confidence", F.coalesce("source", F.lit("")).alias("source"), F.col("id").alias("name")).unionByName(graph.edges.select("confidence", F.coalesce("source", "type").alias("source"), F.col("type").alias("name")))
    return _errors(items.where((F.col("confidence") == "low") & ~F.col("source").isin(*allowed)), "unapproved low confidence", F.col("name"))


def verify(graph: Graph, suite: dict) -> DataFrame:
    """All errors of a suite: services, no_duplicate_node_ids, no_test_path_edges, forbidden_labels, min_counts, required_edges, confidence."""
    # the graph is computed once for all checks, with the columns that they read
    have = graph.nodes.columns
    nodes = graph.nodes.select(*(c for c in ("id", "label", "service", "file", "path", "topic", "confidence", "source") if c in have))
    graph = Graph(materialize(nodes), materialize(graph.edges.select("type", "src", "dst", "from_service", "to_service", "confidence", "source")))
    parts = []
    if suite.get("services"):
        parts.append(missing_services(graph, suite["services"]))
    if suite.get("no_duplicate_node_ids"):
        parts.append(duplicate_ids(graph))
    if suite.get("no_test_path_edges"):
        parts.append(test_edges(graph))
    if suite.get("forbidden_labels"):
        parts.append(forbidden_labels(graph, suite["forbidden_labels"]))
    if suite.get("min_counts"):
        parts.append(min_counts(graph, suite["min_counts"]))
    if suite.get("required_edges"):
        parts.append(required_edges(graph, suite["required_edges"]))
    if (rules := suite.get("confidence", {})).get("no_unapproved_low"):
        parts.append(unapproved_low(graph, rules.get("allowed_low_sources", [])))
    empty = graph.spark.createDataFrame([], "kind string, detail string")
    return reduce(DataFrame.unionByName, parts, empty)
