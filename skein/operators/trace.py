"""Merging traces: spans become edges between the nodes they name, with stubs for targets unknown.

Spans have an ordinal (any type that can be ordered, unlike for every span), name, service, target_service, path and topic. A span's end is
looked up by topic, then path, then name, each first with the end's service, then with
any; of nodes with equal signatures the last counts. A source that is not found is any
first node of its service. A target that is not found becomes a stub; spans without a
target that share a topic (or path, or service and name) share the stub of the first
of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, as_edges, as_nodes

#: The ordinal of stubs, which come after all nodes that were there.
_LAST = 1 << 62

def signatures(nodes: DataFrame) -> DataFrame:
    """service ('' for any), key and the last node that has them, with its service and when the signature was first seen."""
    keys = F.array_compact(F.concat(F.array(F.nullif("path", F.lit("")), F.nullif("topic", F.lit(""))), F.coalesce("topics", F.array().cast("array<string>"))))
    own = nodes.select("id", F.coalesce("service", F.lit("")).alias("own"), "ordinal", F.explode(keys).alias("key"))
    spread = own.select("id", "own", "ordinal", "key", F.explode(F.array("own", F.lit(""))).alias("service"))
    return spread.groupBy("service", "key").agg(F.max_by(F.struct("id", "own"), F.struct("ordinal", "id")).alias("n"), F.min("ordinal").alias("first")).select("service", "key", F.col("n.id").alias("id"), F.col("n.own").alias("own"), "first")


def spares(sign: DataFrame) -> DataFrame:
    """service, the node that stands in for it where a source is not found, and what makes it the first: `first`, `of` and `key`."""
    at = F.struct("first", "service", "key")
    least = sign.where("own <> ''").groupBy(F.col("own").alias("service")).agg(F.min_by("id", at).alias("id"), F.min(at).alias("at"))
    return least.select("service", "id", "at.first", F.col("at.service").alias("of"), "at.key")


def asked(spans: DataFrame, service: str) -> DataFrame:
    """The signatures by which each span's end is looked up, one after another (`step`)."""
    tries = F.array(*(F.struct(s.alias("service"), F.col(k).alias("key")) for k in ("topic", "path", "name") for s in (F.coalesce(F.col(service), F.lit("")), F.lit(""))))
    return spans.select("ordinal", F.posexplode(tries).alias("step", "t")).select("ordinal", "step", F.col("t.service").alias("service"), F.col("t.key").alias("key")).where("key <> ''")


def _looked_up(spans: DataFrame, sign: DataFrame, service: str) -> DataFrame:
    return asked(spans, service).join(sign, ["service", "key"]).groupBy("ordinal").agg(F.min_by(F.struct("id", "own"), "step").alias("n")).select("ordinal", F.col("n.id").alias("id"), F.col("n.own").alias("own"))


def linked(spans: DataFrame, sign: DataFrame, spare: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stub nodes, edges, new or not, and the ordinals and names of spans whose source is unknown; sign and spare hold at least what the spans ask for."""
    spare = spare.select("service", F.col("id").alias("s2"))
    source = _looked_up(spans, sign, "service").select("ordinal", F.col("id").alias("s1"), F.col("own").alias("o1"))
    target = _looked_up(spans, sign, "target_service").select("ordinal", F.col("id").alias("t1"), F.col("own").alias("to1"))
    met = spans.join(source, "ordinal", "left").join(spare, "service", "left").join(target, "ordinal", "left")
    met = met.withColumns({"src": F.coalesce("s1", "s2"), "from_service": F.when(F.col("s1").isNotNull(), F.col("o1")).otherwise(F.col("service"))})
    stub_service = F.coalesce("target_service", "service", F.lit("unknown"))
    shared = F.when(F.col("topic") != "", F.concat(F.lit("t:"), "topic")).when(F.col("path") != "", F.concat(F.lit("p:"), "path")).otherwise(F.concat_ws(":", F.lit("n"), stub_service, "name"))
    open_ = met.where("t1 is null").withColumns({"share": shared, "stub_service": stub_service})
    first = open_.groupBy("share").agg(F.min_by(F.struct("stub_service", "topic", "path", "name"), "ordinal").alias("f"), F.min("ordinal").alias("ordinal"))
    what = F.coalesce(F.nullif("f.topic", F.lit("")), F.nullif("f.path", F.lit("")), F.col("f.name"))
    stub_id = F.concat(F.col("f.stub_service"), F.lit(":otel:"), F.substring(F.sha1(F.concat(F.col("f.stub_service"), F.lit(":"), what)), 1, 10))
    stubs = first.select("share", "ordinal", stub_id.alias("stub"), F.col("f.stub_service").alias("stub_at"), F.nullif("f.topic", F.lit("")).alias("topic"), F.nullif("f.path", F.lit("")).alias("path"))
    messaged = F.col("topic").isNotNull()
    nodes = as_nodes(stubs.select(F.col("stub").alias("id"), F.when(messaged, "KafkaConsumer").otherwise("Endpoint").alias("label"), F.col("stub_at").alias("service"), F.lit("otel-trace").alias("source"), F.lit("low").alias("confidence"), "path", F.when(messaged, F.array("topic")).alias("topics"), F.when(messaged, "consumer").alias("message_role"), F.when(messaged, "trace").alias("bus"), F.lit(_LAST).alias("ordinal")))
    nodes = nodes.dropDuplicates(["id"])
    ended = met.withColumn("share", F.when(F.col("t1").isNull(), shared)).join(stubs.select("share", "stub", "stub_at"), "share", "left")
    ended = ended.withColumns({"dst": F.coalesce("t1", "stub"), "to_service": F.coalesce("to1", "stub_at")}).where("src is not null and src <> dst")
    edge = ended.select(F.when(F.col("topic") != "", "KAFKA_DELIVERS").otherwise("CROSSES_TIER").alias("type"), "src", "dst", "from_service", "to_service", (F.col("from_service") != F.col("to_service")).alias("cross_repo"), F.when(F.col("t1").isNull(), "low").otherwise("medium").alias("confidence"), F.lit("otel-trace").alias("source"), "ordinal")
    once = edge.groupBy("type", "src", "dst").agg(F.min_by(F.struct("from_service", "to_service", "cross_repo", "confidence", "source"), "ordinal").alias("r")).select("type", "src", "dst", "r.*")
    return nodes, as_edges(once), met.where("src is null").select("ordinal", "name")


def unknown(nodes: DataFrame, edges: DataFrame, ids: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes whose id is not among ids, and edges whose type, src and dst are not among keys."""
    return as_nodes(nodes.join(ids.select("id"), "id", "left_anti")), as_edges(edges.join(keys.select("type", "src", "dst"), ["type", "src", "dst"], "left_anti"))


def merge(graph: Graph, spans: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New stub nodes, new edges, and the ordinals and names of spans whose source is unknown.

    Applied again to the graph with its results, it adds nothing.
    """
    sign = signatures(graph.nodes)
    nodes, edges, sourceless = linked(spans, sign, spares(sign))
    return *unknown(nodes, edges, graph.nodes, graph.edges), sourceless


def merged(graph: Graph, spans: DataFrame) -> Graph:
    nodes, edges, _ = merge(graph, spans)
    return Graph(as_nodes(graph.nodes).unionByName(nodes), as_edges(graph.edges).unionByName(edges))
