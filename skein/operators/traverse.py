"""Neighbourhoods and bounded flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, bucketed, materialize

# The edge types that a flow follows.
FLOW_TYPES = ("HANDLES", "HANDLES_KAFKA", "HANDLES_MESSAGE", "CROSSES_TIER", "KAFKA_DELIVERS", "MESSAGE_DELIVERS", "EMITS")


def search_text(nodes: DataFrame) -> Column:
    """All string and list values of a node in lower case."""
    parts = [F.col(f.name) for f in nodes.schema if f.dataType.simpleString() in ("string", "array<string>")]
    extra = [F.map_values("props")] if "props" in nodes.columns else []
    return F.lower(F.concat_ws(" ", *parts, *extra))


def match_nodes(graph: Graph, symbol: str) -> DataFrame:
    """Nodes one of whose values contains the symbol in any case; the empty symbol matches all."""
    return graph.nodes.where(search_text(graph.nodes).contains(symbol.lower()))


def callers(graph: Graph, symbol: str) -> DataFrame:
    """Edges into the matched nodes."""
    return graph.edges.join(match_nodes(graph, symbol).select(F.col("id").alias("dst")), "dst", "left_semi")


def callees(graph: Graph, symbol: str) -> DataFrame:
    """Edges out of the matched nodes."""
    return graph.edges.join(match_nodes(graph, symbol).select(F.col("id").alias("src")), "src", "left_semi")


def ends_of(graph: Graph, edges: DataFrame) -> DataFrame:
    """The nodes at either end of the edges; none where there are no edges."""
    ids = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return graph.nodes.join(ids, "id", "left_semi")


def incident(graph: Graph, ids: DataFrame) -> DataFrame:
    """Edges with an end in ids (id)."""
    own = ids.select("id").distinct()
    marked = graph.edges.join(own.select(F.col("id").alias("src"), F.lit(True).alias("_s")), "src", "left").join(own.select(F.col("id").alias("dst"), F.lit(True).alias("_d")), "dst", "left")
    return marked.where("_s or _d").select(*graph.edges.columns)


def induced(graph: Graph, ids: DataFrame) -> DataFrame:
    """Edges with both ends in ids (id)."""
    own = ids.select("id").distinct()
    return graph.edges.join(own.select(F.col("id").alias("src")), "src", "left_semi").join(own.select(F.col("id").alias("dst")), "dst", "left_semi").select(*graph.edges.columns)


def cross_service(graph: Graph, filters: dict[str, str | None] | None = None) -> DataFrame:
    """Edges between services, with equality filters; a filter of None holds for all."""
    out = graph.edges.where(F.coalesce("cross_repo", F.col("from_service") != F.col("to_service")))
    for key, value in (filters or {}).items():
        if value is not None:
            out = out.where(F.col(key) == value)
    return out


def endpoints_in_service(graph: Graph, service: str, path: str | None = None, label: str = "Endpoint") -> DataFrame:
    out = graph.nodes.where((F.col("label") == label) & (F.col("service") == service))
    return out.where(F.col("path").contains(path)) if path else out


def flow_nodes(graph: Graph, anchors: DataFrame, depth: int = 8, types: tuple[str, ...] = FLOW_TYPES) -> DataFrame:
    """id and distance of all that the anchors (id) reach in at most `depth` steps.

    The sources of calls into the anchors start at distance 0 with them. A step goes
    along an edge of the given types, or from an endpoint or consumer to the producers
    of its service. Each level is one join of the last level's nodes, which are kept
    apart from those visited before; a level that finds nothing ends the walk. Edges are
    bucketed by their source once and stay there, as hubs by id and producers by service:
    a level moves only what the last one found.
    """
    steps = bucketed(graph.edges.where(F.col("type").isin(*types)).select("src", "dst"), "src")
    calls = graph.edges.where("type = 'CROSSES_TIER'").select("src", "dst")
    starts = anchors.select("id").distinct()
    before = calls.join(starts.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
    visited = materialize(starts.unionByName(before).distinct().withColumn("distance", F.lit(0)))
    hubs = bucketed(graph.nodes.where("label in ('Endpoint', 'KafkaConsumer', 'MessageConsumer') or message_role = 'consumer'").select("id", "service").where("service <> ''"), "id")
    producers = bucketed(graph.nodes.where("message_role = 'producer'").select("service", F.col("id").alias("next")), "service")
    found = visited
    for level in range(depth):
        frontier = found.select("id")
        along = frontier.join(steps, F.col("id") == F.col("src")).select(F.col("dst").alias("next"))
        # services first: a service's producers are found once however many of its endpoints were reached
        aside = hubs.join(frontier, "id", "left_semi").select("service").distinct().join(producers, "service").select("next")
        found = materialize(along.unionByName(aside).distinct().withColumnRenamed("next", "id").join(visited, "id", "left_anti").withColumn("distance", F.lit(level + 1)))
        if found.isEmpty():
            break
        visited = visited.unionByName(found)
    return visited


def flow(graph: Graph, anchor: str, depth: int = 8, types: tuple[str, ...] = FLOW_TYPES) -> tuple[DataFrame, DataFrame]:
    """Nodes with their distance, and edges, of the flow from all nodes that match the anchor."""
    anchors = match_nodes(graph, anchor).select("id")
    reached = flow_nodes(graph, anchors, depth, types)
    return graph.nodes.join(reached, "id"), flow_edges(graph, anchors, reached, depth, types)


def flow_edges(graph: Graph, anchors: DataFrame, reached: DataFrame, depth: int, types: tuple[str, ...] = FLOW_TYPES) -> DataFrame:
    """Edges that leave a node nearer than `depth`, and the calls into the anchors."""
    near = reached.where(F.col("distance") < depth).select(F.col("id").alias("src"))
    out = graph.edges.where(F.col("type").isin(*types)).join(near, "src", "left_semi")
    calls = graph.edges.where("type = 'CROSSES_TIER'").join(anchors.select(F.col("id").alias("dst")), "dst", "left_semi")
    both = out.select(*graph.edges.columns).unionByName(calls.select(*graph.edges.columns))
    return both.dropDuplicates(["type", "src", "dst"])


def node_display(n: str) -> Column:
    """A node's short form; n: the alias of its struct."""
    c = lambda name: F.col(f"{n}.{name}")
    return (
        F.when(c("label") == "Endpoint", F.concat_ws(" ", F.coalesce(c("http_method"), F.lit("GET")), c("path")))
        .when(c("topic") != "", F.concat(c("label"), F.lit("("), c("topic"), F.lit(")")))
        .when(F.size(c("topics")) > 0, F.concat(c("label"), F.lit("("), F.array_join(c("topics"), ", "), F.lit(")")))
        .otherwise(F.coalesce(F.nullif(c("handler"), F.lit("")), F.nullif(c("name"), F.lit("")), c("id"), F.lit("")))
    )


def explain(graph: Graph, edges: DataFrame) -> DataFrame:
    """hop, service, node and description of each edge of a flow: calls first, then deliveries, then the rest.

    Hops are numbered over one flow's edges, a result as small as a reader can take in.
    """
    from pyspark.sql import Window

    n = graph.nodes
    node = lambda a: n.select(F.col("id").alias(f"{a}_id"), F.struct(*n.columns).alias(a))
    own = edges.join(node("s"), F.col("src") == F.col("s_id"), "left").join(node("d"), F.col("dst") == F.col("d_id"), "left")
    rank = F.when(F.col("type") == "CROSSES_TIER", 0).when(F.col("type").endswith("DELIVERS"), 1).otherwise(2)
    detail = F.coalesce(F.nullif("s.topic", F.lit("")), F.nullif("s.path", F.lit("")), F.nullif("d.path", F.lit("")), F.nullif(F.array_join("d.topics", ", "), F.lit("")))
    text = (
        F.when(rank == 0, F.concat_ws(" ", "from_service", F.lit("calls"), "to_service", node_display("d")))
        .when(rank == 1, F.concat_ws(" ", "from_service", F.lit("publishes to"), "to_service", node_display("d")))
        .otherwise(F.concat_ws(" ", "from_service", F.lit("reaches"), "to_service", F.lit("via"), "type"))
    )
    order = Window.orderBy(rank, F.coalesce("from_service", F.lit("")), F.coalesce("to_service", F.lit("")), "src", "dst", "type")
    return own.select(F.row_number().over(order).alias("hop"), F.col("from_service").alias("service"), node_display("s").alias("node"), F.concat(text, F.when(detail.isNotNull(), F.concat(F.lit(" ("), detail, F.lit(")"))).otherwise("")).alias("description"))
