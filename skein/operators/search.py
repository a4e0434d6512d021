"""Ranked text search over nodes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph
from .traverse import incident, search_text

# Weights of the fields, what a label adds, and words that stand for others.
WEIGHTS = {"path": 5.0, "topic": 5.0, "handler": 4.0, "name": 3.0, "service": 2.0, "label": 1.5, "file": 1.0, "id": 1.0}
LABEL_BONUS = {"Endpoint": 0.5, "HttpCall": 0.3, "Component": 0.2, "Service": 0.1}
SYNONYMS = {"automobile": ["motor", "vehicle"], "car": ["motor", "vehicle"], "license": ["permit"], "licence": ["permit"], "queue": ["topic"], "event": ["topic"]}


def query_tokens(query: str, expand: bool = True) -> list[str]:
    """A query's tokens, repeats included, and the words they stand for."""
    own = [t.lower() for t in re.findall(r"[A-Za-z0-9]+", query)]
    return own + [s for t in own for s in SYNONYMS.get(t, [])] if expand else own


def _field(nodes: DataFrame, name: str) -> Column:
    if name == "topic" and "topics" in nodes.columns:
        return F.concat(F.coalesce("topic", F.lit("")), F.lit(" "), F.coalesce(F.array_join("topics", " "), F.lit("")))
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in nodes.columns else F.lit("")


def _hits(nodes: DataFrame, query: str, fields: dict[str, float]) -> Column:
    phrase = query.lower()
    return sum((F.when(F.lower(_field(nodes, f)).contains(phrase), 10 * w).otherwise(0.0) for f, w in fields.items()), F.lit(0.0)) if phrase else F.lit(0.0)


def _overlap(nodes: DataFrame, words: list[str], fields: dict[str, float]) -> Column:
    """How often each field has one of the words as a whole token, weighted; a word given twice counts twice."""
    often = [sorted({w for w in words if words.count(w) >= n}) for n in range(1, max(map(words.count, words), default=0) + 1)]
    counts = lambda f: sum((F.regexp_count(_field(nodes, f), F.lit(f"(?i)(?<![A-Za-z0-9])(?:{'|'.join(some)})(?![A-Za-z0-9])")) for some in often), F.lit(0))
    return sum((counts(f) * F.lit(w) for f, w in fields.items()), F.lit(0.0))


def _bonus() -> Column:
    out = F.lit(0.0)
    for label, more in LABEL_BONUS.items():
        out = F.when(F.col("label") == label, more).otherwise(out)
    return out


def search(graph: Graph, query: str, limit: int = 10, label: str | None = None, fallback: bool = True) -> DataFrame:
    """The best `limit` nodes with `score` and `mode`: exact phrase hits, or if there are none at all, token matches, or the first by id.

    One pass ranks exact hits before token matches before the rest, so that a top-k of
    each task is all that meets; of the `limit` rows found those of the best kind stay.
    """
    nodes = graph.nodes if label is None else graph.nodes.where(F.col("label") == label)
    scored = nodes.withColumn("_hits", _hits(nodes, query, WEIGHTS))
    # tokens are counted only in nodes without the phrase
    scored = scored.withColumn("_any", F.when(F.col("_hits") > 0, F.col("_hits")).otherwise(_overlap(nodes, query_tokens(query), WEIGHTS)) if fallback else F.col("_hits"))
    rank = F.when(F.col("_hits") > 0, 0).when(F.col("_any") > 0, 1).otherwise(2)
    ranked = scored.withColumn("_rank", rank).withColumn("score", F.when(F.col("_rank") < 2, F.round(F.col("_any") + _bonus(), 4)).otherwise(0.0))
    best = (ranked if fallback else ranked.where("_rank = 0")).orderBy("_rank", F.desc("score"), "id").limit(limit)
    # a window over the `limit` rows that are left
    kind = best.withColumn("_best", F.min("_rank").over(Window.partitionBy(F.lit(0)))).where("_rank = _best")
    mode = F.element_at(F.array(F.lit("exact"), F.lit("fallback"), F.lit("first")), F.col("_rank") + 1)
    exact = F.col("_rank") == 0
    named = kind.withColumns({"mode": mode, "confidence": F.when(exact, F.col("confidence")).otherwise("low"), "source": F.when(exact, F.col("source")).otherwise("deterministic-search")})
    return named.orderBy(F.desc("score"), "id").select(*nodes.columns, "score", "mode")


def search_edges(graph: Graph, found: DataFrame) -> DataFrame:
    """Edges at the nodes of an exact search."""
    return incident(graph, found.where("mode = 'exact'"))


def search_any(graph: Graph, query: str, limit: int = 10, label: str | None = None) -> DataFrame:
    """Nodes one of whose values contains the query, else by score without ids, labels' additions or synonyms, in order of arrival."""
    nodes = graph.nodes if label is None else graph.nodes.where(F.col("label") == label)
    hit = nodes.where(search_text(nodes).contains(query.lower())).withColumns({"score": F.lit(None).cast("double"), "mode": F.lit("exact")}).orderBy("ordinal", "id").limit(limit)
    fields = {k: w for k, w in WEIGHTS.items() if k != "id"}
    words = query_tokens(query, expand=False)
    score = _hits(nodes, query, fields) + _overlap(nodes, words, fields) if words else F.lit(0.0)
    near = nodes.withColumns({"score": score, "mode": F.lit("scored")}).where("score > 0").orderBy(F.desc("score"), "ordinal", "id").limit(limit)
    some = hit.select(F.lit(True).alias("_x")).limit(1)
    return hit.unionByName(near.join(F.broadcast(some), F.lit(True), "left_anti"))  # one row at most
