"""A written index of a graph's texts: anchors and searches read postings and the few nodes they name, not all nodes.

Every three characters that follow each other in a node's values (lower case) are a gram,
and every run of letters and digits a token. Postings (gram or token, id; both as hashes)
are bucketed by the gram or token, nodes are partitioned by a hash of their id, and edges,
twice, by that of either end. A text that contains a symbol has all of its grams; so the
ids that have the symbol's rarest grams are candidates, whose values are then compared.
What the index gives is what a scan gives: equal hashes add candidates and take none away.
Each part is written when it is first asked for.

Grams that more than a sixteenth of the nodes have, and more than 4,096, are counted but
have no postings, as they tell little. Symbols that have no other grams, or less than
three characters, are looked for by a scan. Null values are no text; nodes that share an
id are all found; an empty graph finds nothing. The driver sees a symbol's own grams with
their counts, and the frequent grams (sixteen times as many as a node has, at most), never ids.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, bucketed, parted
from . import search as ranked
from .traverse import match_nodes, search_text

#: Overlapping runs of three characters, and tokens.
_GRAM, _TOKEN = r"(?s)(?=(...))", "[a-z0-9]+"
#: How many of a symbol's grams are met with each other; more would rarely leave out more.
RAREST = 3


#: A gram is frequent that more than one in so many nodes has, and more nodes than FEW.
FREQUENT, FEW = 16, 4096


@dataclass(frozen=True)
class TextIndex:
    graph: Graph
    shards: int

    def _parted(self, df: DataFrame, key: str, name: str) -> DataFrame:
        return parted(df.withColumn("shard", _shard(_node(F.col(key)), self.shards)), "shard", name)

    @cached_property
    def nodes(self) -> DataFrame:
        return self._parted(self.graph.nodes, "id", "index-nodes")

    @cached_property
    def by_src(self) -> DataFrame:
        return self._parted(self.graph.edges, "src", "index-edges")

    @cached_property
    def by_dst(self) -> DataFrame:
        return self._parted(self.graph.edges, "dst", "index-edges")

    def _terms(self, pattern: str, group: int) -> DataFrame:
        """The terms of each node."""
        found = F.regexp_extract_all(search_text(self.graph.nodes), F.lit(pattern), F.lit(group))
        return self.nodes.select(_node(F.col("id")).alias("node"), F.array_distinct(F.transform(found, _node)).alias("terms"))

    @cached_property
    def gram_counts(self) -> DataFrame:
        """The number of nodes that have each gram."""
        each = self._terms(_GRAM, 1).select(F.explode("terms").alias("term"))
        return bucketed(each.groupBy("term").agg(F.count("*").alias("n")), "term")

    @cached_property
    def most(self) -> int:
        """The number of nodes that a gram with postings has at most."""
        return max(FEW, self.nodes.count() // FREQUENT)

    @cached_property
    def grams(self) -> DataFrame:
        some = self._terms(_GRAM, 1)
        # a node has a gram once, so that there are no more than FREQUENT times the grams of a mean node
        if left := [r["term"] for r in self.gram_counts.where(F.col("n") > self.most).select("term").collect()]:
            some = some.withColumn("terms", F.array_except("terms", F.array(*map(F.lit, left))))
        return bucketed(some.select(F.explode("terms").alias("term"), "node"), "term")

    @cached_property
    def tokens(self) -> DataFrame:
        return bucketed(self._terms(_TOKEN, 0).select(F.explode("terms").alias("term"), "node"), "term")


def _node(key: Column) -> Column:
    """What stands for an id or a term: 32 bits, whose equals are told apart by the values at the end."""
    return F.hash(key)


def _shard(node: Column, shards: int) -> Column:
    return F.pmod(node, F.lit(shards)).cast("int")


def build(graph: Graph, shards: int | None = None) -> TextIndex:
    """An index in the shared folder; shards: parts of nodes and edges that a lookup can leave out."""
    return TextIndex(graph, shards or 4 * int(graph.spark.conf.get("spark.sql.shuffle.partitions")))


def _hashed(index: TextIndex, terms: list[str]) -> dict[str, int]:
    row = index.graph.spark.range(1).select(*(_node(F.lit(t)).alias(f"t{i}") for i, t in enumerate(terms))).first()
    return dict(zip(terms, row, strict=True))


def _all_of(postings: DataFrame, terms: list[int]) -> DataFrame:
    """Nodes that have all terms."""
    met = postings.where(F.col("term").isin(terms)).groupBy("node").agg(F.count_distinct("term").alias("n"))
    return met.where(F.col("n") == len(terms)).select("node")


def candidates(index: TextIndex, symbol: str) -> DataFrame | None:
    """All nodes that may contain the symbol, or None if it is too short or its grams too frequent to tell."""
    grams = sorted(set(re.findall(_GRAM, symbol.lower())))
    if not grams:
        return None
    terms = sorted(set(_hashed(index, grams).values()))
    # one row a gram of the symbol
    counts = {r["term"]: r["n"] for r in index.gram_counts.where(F.col("term").isin(terms)).collect()}
    if len(counts) < len(terms):
        return index.gram_counts.select(F.col("term").alias("node")).limit(0)
    rare = sorted((t for t in terms if counts[t] <= index.most), key=lambda t: (counts[t], t))[:RAREST]
    return _all_of(index.grams, rare) if rare else None


def _at(index: TextIndex, table: DataFrame, key: str, nodes: DataFrame) -> DataFrame:
    """Rows of a table in shards whose key may be among nodes; only their shards are read."""
    own = nodes.select(F.col("node").alias("_node"), _shard(F.col("node"), index.shards).alias("shard")).distinct()
    return table.withColumn("_node", _node(F.col(key))).join(own, ["shard", "_node"], "left_semi").drop("shard", "_node")


def _ends(index: TextIndex, edges: DataFrame, key: str, symbol: str) -> DataFrame:
    """Edges of a table one of whose ends is a node that contains the symbol."""
    ids = matching(index, symbol).select(F.col("id").alias(key)).distinct()
    near = ids.withColumn("shard", _shard(_node(F.col(key)), index.shards))
    return edges.join(near, ["shard", key], "left_semi").select(*index.graph.edges.columns)


def matching(index: TextIndex, symbol: str) -> DataFrame:
    """Nodes one of whose values contains the symbol in any case, as `match_nodes` gives them."""
    ids = candidates(index, symbol)
    if ids is None:
        return match_nodes(index.graph, symbol)
    near = _at(index, index.nodes, "id", ids)
    return near.where(search_text(index.graph.nodes).contains(symbol.lower())).select(*index.graph.nodes.columns)


def callers(index: TextIndex, symbol: str) -> DataFrame:
    return _ends(index, index.by_dst, "dst", symbol)


def callees(index: TextIndex, symbol: str) -> DataFrame:
    return _ends(index, index.by_src, "src", symbol)


def search(index: TextIndex, query: str, limit: int = 10, label: str | None = None) -> DataFrame:
    """What `search` finds: exact hits among the nodes that have the phrase, else token matches among those that have a token, else the first by id."""
    some = ranked.search(Graph(matching(index, query), index.graph.edges), query, limit, label, fallback=False) if query else None
    if some is not None and not some.isEmpty():
        return some
    words = sorted(set(ranked.query_tokens(query)))
    some = None
    if words:
        ids = index.tokens.where(F.col("term").isin(*_hashed(index, words).values())).select("node").distinct()
        some = ranked.search(Graph(_at(index, index.nodes, "id", ids).select(*index.graph.nodes.columns), index.graph.edges), query, limit, label).where("mode <> 'first'")
    if some is not None and not some.isEmpty():
        return some
    return ranked.search(index.graph, query, limit, label)
