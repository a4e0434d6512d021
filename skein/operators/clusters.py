"""Generated lenses: endpoints by route, nodes by shared words, and lenses kept in the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..graph import Graph, as_edges

# Words that name no domain.
IGNORED = ("api", "src", "main", "java", "example", "controller", "resource", "service", "listener", "kafka", "http", "get", "post", "put", "delete", "patch")


def route_key(path: Column) -> Column:
    """route.<first segment>, or route.api.<second> behind api; placeholders do not count."""
    parts = F.filter(F.split(F.coalesce(path, F.lit("/")), "/"), lambda p: (p != "") & ~p.startswith("{"))
    return F.when((F.size(parts) >= 2) & (F.get(parts, 0) == "api"), F.concat(F.lit("route.api."), F.get(parts, 1))).when(F.size(parts) > 0, F.concat(F.lit("route."), F.get(parts, 0))).otherwise("route.root")


def routes(nodes: DataFrame, label: str = "Endpoint") -> DataFrame:
    """name, n_nodes and the shortest path of each route (of equal ones the first in order)."""
    own = nodes.where(F.col("label") == label).withColumn("name", route_key(F.col("path")))
    return own.groupBy("name").agg(F.count("*").alias("n_nodes"), F.min(F.struct(F.length(F.coalesce("path", F.lit(""))).alias("n"), "path")).alias("a")).select("name", "n_nodes", F.col("a.path").alias("anchor"))


def domain_words(nodes: DataFrame) -> Column:
    """Distinct words of a node's path, handler, topics and name that may name a domain."""
    values = [F.coalesce(F.col(c), F.lit("")) for c in ("path", "handler", "topic")] + [F.coalesce(F.array_join("topics", " "), F.lit("")), F.coalesce("name", F.lit(""))]
    return F.array_distinct(F.filter(tokens(F.concat_ws(" ", *values)), lambda t: (F.length(t) > 2) & ~t.isin(*IGNORED) & ~t.rlike("^[0-9]+$")))


def domains(graph: Graph, labels: tuple[str, ...] = ("Endpoint", "Component"), call: str = "CROSSES_TIER") -> DataFrame:
    """token and id: members of each domain with two or more.

    A call between services brings both its ends into every domain that one of them
    shares words with.
    """
    nodes = graph.nodes
    own = nodes.where(F.col("label").isin(*labels) | F.col("message_role").isin("producer", "consumer")).select("id", F.explode(domain_words(nodes)).alias("token"))
    words = nodes.select("id", F.explode(domain_words(nodes)).alias("token"))
    edges = graph.edges.where(F.col("type") == call).select("src", "dst")
    side = lambda key: edges.join(words.withColumnRenamed("id", key), key).select("token", F.explode(F.array("src", "dst")).alias("id"))
    pulled = side("src").unionByName(side("dst")).join(own.select("token").distinct(), "token", "left_semi")
    members = own.unionByName(pulled.select("id", "token")).distinct()
    big = members.groupBy("token").agg(F.count("*").alias("n")).where("n >= 2").select("token")
    return members.join(big, "token").select("token", "id")


def persisted(graph: Graph, members: DataFrame, prefix: str = "domain") -> Graph:
    """The graph with a Lens node and CONTAINS edges for each token of members; what is there already is not added again."""
    lens = members.select(F.concat(F.lit(f"lens:{prefix}."), "token").alias("id"), F.concat(F.lit(f"{prefix}."), "token").alias("name")).distinct()
    fresh = lens.join(graph.nodes.select("id"), "id", "left_anti").select("id", "name", F.lit("Lens").alias("label"), F.lit("lens").alias("source"), F.lit("medium").alias("confidence"))
    made = as_edges(members.select(F.lit("CONTAINS").alias("type"), F.concat(F.lit(f"lens:{prefix}."), "token").alias("src"), F.col("id").alias("dst"), F.lit(False).alias("cross_repo"), F.lit("medium").alias("confidence"), F.lit("lens").alias("source")))
    new = made.join(graph.edges.where("type = 'CONTAINS'").select("src", "dst"), ["src", "dst"], "left_anti")
    return Graph(graph.nodes.unionByName(fresh, allowMissingColumns=True), as_edges(graph.edges).unionByName(new.select(*made.columns)))


def persisted_lens(graph: Graph, name: str) -> tuple[DataFrame, DataFrame]:
    """Members of a kept lens, and the edges among them."""
    from .traverse import induced

    ids = graph.edges.where("type = 'CONTAINS'").join(graph.nodes.where((F.col("label") == "Lens") & (F.col("name") == name)).select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
    return graph.nodes.join(ids, "id", "left_semi"), induced(graph, ids).where("type <> 'CONTAINS'")
