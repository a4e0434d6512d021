"""Named lenses: stored pattern queries, kept lenses, fixed patterns, routes and domains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators import clusters, traverse
from .cypher import checked, from_text
from .views import run_view

_MESSAGES = "label in ('KafkaConsumer', 'KafkaProducer', 'MessageConsumer', 'MessageProducer') or message_role in ('producer', 'consumer')"


def run_spec(graph: Graph, spec: dict, params: dict[str, str] | None = None) -> DataFrame:
    """Rows of a stored lens: its query with its parameters, overridden by those given, and its contract checked."""
    rows = from_text(graph, spec["query"], {**spec.get("params", {}), **(params or {})})
    return checked(rows, spec.get("returns", {}))


def pattern(graph: Graph, name: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of one of the fixed patterns."""
    nodes, edges = graph.nodes, graph.edges
    labelled = {"pattern.endpoints": "label = 'Endpoint'", "pattern.controllers": "label = 'Service' and kind like '%controller%'", "pattern.components": "label = 'Component'"}
    if name in labelled:
        return nodes.where(labelled[name]), edges.limit(0)
    if name == "pattern.cross_tier_calls":
        own = edges.where("type = 'CROSSES_TIER'")
        return traverse.ends_of(graph, own), own
    if name in ("pattern.kafka_bus", "pattern.message_bus"):
        own = edges.where("type = 'KAFKA_DELIVERS'" if name.endswith("kafka_bus") else "type like '%DELIVERS'")
        return nodes.where(_MESSAGES), own
    raise KeyError(name)


def route(graph: Graph, name: str) -> tuple[DataFrame, DataFrame]:
    """route.<a>.<b>: endpoints whose path starts with /a/b, the edges at them and the nodes next to them."""
    prefix = "/" + "/".join(name.split(".")[1:])
    own = graph.nodes.where((F.col("label") == "Endpoint") & F.col("path").startswith(prefix)).select("id")
    edges = traverse.incident(graph, own)
    ids = own.unionByName(edges.select(F.col("src").alias("id"))).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return graph.nodes.join(ids, "id", "left_semi"), edges


def lens(graph: Graph, name: str, specs: dict[str, dict] | None = None, params: dict[str, str] | None = None) -> DataFrame:
    """The rows of a lens by name: a stored one, else one kept in the graph, else a pattern, a route or a domain."""
    spec = (specs or {}).get(name)
    if spec and spec.get("kind") in ("nodes", "edges", "group_edges"):
        return run_view(graph, spec, params)
    if spec:
        return run_spec(graph, spec, params)
    if not graph.nodes.where((F.col("label") == "Lens") & (F.col("name") == name)).isEmpty():
        return clusters.persisted_lens(graph, name)[0]
    if name.startswith("pattern."):
        return pattern(graph, name)[0]
    if name.startswith("route."):
        return route(graph, name)[0]
    if name.startswith("domain."):
        members = clusters.domains(graph).where(F.col("token") == name.removeprefix("domain."))
        return graph.nodes.join(members, "id", "left_semi")
    raise KeyError(f"no lens is called {name}")


def catalog(graph: Graph, specs: dict[str, dict] | None = None) -> DataFrame:
    """name and origin of all lenses; of equal names the one that counts first."""
    spark = graph.spark
    fixed = [("pattern.endpoints", "builtin", 1), ("pattern.controllers", "builtin", 1), ("pattern.components", "builtin", 1), ("pattern.cross_tier_calls", "builtin", 1), ("pattern.kafka_bus", "builtin", 1), ("pattern.message_bus", "builtin", 1)]
    stored = spark.createDataFrame(fixed + [(n, "configured", 3) for n in (specs or {})], "name string, origin string, rank int")
    kept = graph.nodes.where("label = 'Lens'").select("name", F.lit("persisted").alias("origin"), F.lit(2).alias("rank"))
    made = clusters.routes(graph.nodes).select("name").unionByName(clusters.domains(graph).select(F.concat(F.lit("domain."), "token").alias("name")).distinct()).select("name", F.lit("generated").alias("origin"), F.lit(0).alias("rank"))
    every = stored.unionByName(kept).unionByName(made)
    return every.groupBy("name").agg(F.max_by("origin", "rank").alias("origin"))
