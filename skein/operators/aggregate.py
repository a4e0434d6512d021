"""Counts and groups over a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import source_family
from ..graph import Graph

TIERS = ("high", "medium", "low")


def confidence_summary(nodes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """One row: high, medium and low among the nodes and edges."""
    own = nodes.select("confidence")
    own = own if edges is None else own.unionByName(edges.select("confidence"))
    return own.agg(*(F.count_if(F.col("confidence") == t).alias(t) for t in TIERS))


def edge_stats(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count("*").alias("n_edges"), F.count_if(F.col("type") == "CROSSES_TIER").alias("n_cross_repo_http"), F.count_if(F.col("type") == "KAFKA_DELIVERS").alias("n_kafka_deliveries"), F.count_if(F.col("type").endswith("DELIVERS")).alias("n_message_deliveries"))


def result_stats(nodes: DataFrame) -> DataFrame:
    """n_nodes, n_services and the sorted list of services."""
    named = F.nullif("service", F.lit(""))
    return nodes.agg(F.count("*").alias("n_nodes"), F.countDistinct(named).alias("n_services"), F.array_join(F.array_sort(F.collect_set(named)), ",").alias("services"))


def topics(graph: Graph, producer_service: str | None = None, consumer_service: str | None = None, bus: str | None = None) -> DataFrame:
    """topic, bus, and sorted distinct producer and consumer services, and how many edges link them.

    The bus is the first seen: producers by ordinal, then consumers. Services and links
    are made distinct before they are gathered, so that a topic's rows are its services.
    """
    nodes = graph.nodes
    own_bus = F.coalesce("bus", F.lit("default"))
    made = nodes.where("message_role = 'producer' and topic is not null").select("topic", own_bus.alias("bus"), F.col("service").alias("producer"), F.lit(None).cast("string").alias("consumer"), F.struct(F.lit(0).alias("r"), F.col("ordinal").alias("o"), own_bus.alias("bus")).alias("seen"))
    used = nodes.where("message_role = 'consumer'").select(F.explode("topics").alias("topic"), own_bus.alias("bus"), F.lit(None).cast("string").alias("producer"), F.col("service").alias("consumer"), F.struct(F.lit(1).alias("r"), F.col("ordinal").alias("o"), own_bus.alias("bus")).alias("seen"))
    both = made.unionByName(used).groupBy("topic", "producer", "consumer").agg(F.min("seen").alias("seen"))
    links = graph.edges.where(F.col("type").endswith("DELIVERS")).join(nodes.select(F.col("id").alias("src"), "topic"), "src").groupBy("topic").agg(F.count("*").alias("n_links"))
    sides = both.groupBy("topic").agg(F.min("seen").alias("seen"), F.array_sort(F.collect_set("producer")).alias("producers"), F.array_sort(F.collect_set("consumer")).alias("consumers"))
    out = sides.join(links, "topic", "left").select("topic", F.col("seen.bus").alias("bus"), "producers", "consumers", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    if producer_service:
        out = out.where(F.array_contains("producers", producer_service))
    if consumer_service:
        out = out.where(F.array_contains("consumers", consumer_service))
    return out.where(F.col("bus") == bus) if bus else out


def coverage(nodes: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Per service: nodes, counts by source family and by confidence, shares from packs and models, and whether packs cover too little."""
    family = source_family(F.col("source"))
    cell = nodes.groupBy(F.coalesce("service", F.lit("unknown")).alias("service"), family.alias("family"), F.coalesce("confidence", F.lit("unknown")).alias("tier")).agg(F.count("*").alias("n"))
    listed = lambda key: F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", key, "n"))), ",")
    by_family = cell.groupBy("service", "family").agg(F.sum("n").alias("n")).groupBy("service").agg(listed("family").alias("sources"), F.sum("n").alias("total_nodes"), F.sum(F.when(F.col("family") == "pack", F.col("n")).otherwise(0)).alias("pack"), F.sum(F.when(F.col("family") == "llm", F.col("n")).otherwise(0)).alias("llm"))
    by_tier = cell.groupBy("service", "tier").agg(F.sum("n").alias("n")).groupBy("service").agg(listed("tier").alias("confidences"))
    share = F.col("pack") / F.col("total_nodes")
    return by_family.join(by_tier, "service").select("service", "total_nodes", "sources", "confidences", F.round(share, 4).alias("pack_coverage_ratio"), F.round(F.col("llm") / F.col("total_nodes"), 4).alias("llm_ratio"), (share < threshold).alias("below_threshold"))


def vocabulary(lines: DataFrame, pattern: str, k: int = 30, group: int = 1) -> DataFrame:
    """The k most frequent matches of a pattern over all texts (columns file, content); ties by first file, then by term."""
    found = lines.select("file", F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(group))).alias("term"))
    return found.groupBy("term").agg(F.count("*").alias("n"), F.min("file").alias("first_file")).orderBy(F.desc("n"), "first_file", "term").limit(k).select("term", "n")


def service_degrees(graph: Graph) -> DataFrame:
    """Edges into and out of each service."""
    ends = graph.edges.select(F.col("from_service").alias("service"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(graph.edges.select(F.col("to_service").alias("service"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("service").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def cross_service_weights(graph: Graph) -> DataFrame:
    """Per service, its cross-service edges that are not of high confidence."""
    risky = graph.edges.where("cross_repo and coalesce(confidence, '') <> 'high'")
    ends = risky.select(F.explode(F.array_distinct(F.array("from_service", "to_service"))).alias("service"))
    return ends.groupBy("service").agg(F.count("*").alias("risk"))


def cosine(a: str, b: str) -> Column:
    """Cosine of two map<string, number> columns of token counts."""
    dot = F.aggregate(F.map_entries(a), F.lit(0.0), lambda acc, e: acc + e["value"] * F.coalesce(F.try_element_at(F.col(b), e["key"]).cast("double"), F.lit(0.0)))
    norm = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda acc, v: acc + v * v))
    return F.when((norm(a) > 0) & (norm(b) > 0), dot / (norm(a) * norm(b))).otherwise(0.0)
