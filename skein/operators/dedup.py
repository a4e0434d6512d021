"""First-wins deduplication of call sites and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph


def call_sites(graph: Graph) -> Graph:
    """Calls and producers once for each (label, service, file, line, topic or path); the first stays and gets `duplicate_count`.

    The first is picked by an aggregate and joined back, so that a place with very many
    repeats is summed before it moves. Edges of removed nodes go.
    """
    nodes = graph.nodes
    site = F.coalesce("message_role", F.lit("")).eqNullSafe("producer") | (F.col("label") == "HttpCall")
    what = F.coalesce(F.nullif("topic", F.lit("")), F.nullif("topic_var", F.lit("")), "path", F.lit(""))
    keys = [F.coalesce(c.cast("string"), F.lit("")).alias(k) for k, c in {"k1": F.col("label"), "k2": F.col("service"), "k3": F.col("file"), "k4": F.col("line"), "k5": what}.items()]
    sites = nodes.where(site).select("id", "ordinal", *keys)
    first = sites.groupBy("k1", "k2", "k3", "k4", "k5").agg(F.min(F.struct("ordinal", "id")).alias("f"), F.count("*").alias("n")).select(F.col("f.ordinal").alias("ordinal"), F.col("f.id").alias("id"), F.when(F.col("n") > 1, F.col("n")).alias("duplicate_count"))
    kept = nodes.where(site).join(first, ["id", "ordinal"]).unionByName(nodes.where(~site), allowMissingColumns=True)
    gone = sites.join(first, ["id", "ordinal"], "left_anti").select("id").distinct()
    edges = graph.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return Graph(kept, edges.select(*graph.edges.columns))


def edges_once(edges: DataFrame, order: str) -> DataFrame:
    """The first edge, by `order`, of each (type, src, dst)."""
    rest = [c for c in edges.columns if c not in ("type", "src", "dst")]
    return edges.groupBy("type", "src", "dst").agg(F.min_by(F.struct(*rest), order).alias("r")).select("type", "src", "dst", *(F.col(f"r.{c}").alias(c) for c in rest))
