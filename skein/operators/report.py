"""A Markdown report of a graph: counts that are small whatever the graph's size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph, materialize
from ..plans.views import DEFAULT, run_view


#: Of each part's counts the report shows so many, most frequent first, and says how many more there are.
MOST = 200


def counts(graph: Graph) -> DataFrame:
    """part, key and n: nodes by service and label, edges by type, both by confidence."""
    one = lambda df, column, part: df.groupBy(F.coalesce(F.col(column), F.lit("")).alias("key")).agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "key", "n")
    both = graph.nodes.select("confidence").unionByName(graph.edges.select("confidence"))
    parts = [one(graph.nodes, "service", "service"), one(graph.nodes, "label", "label"), one(graph.edges, "type", "type"), one(both, "confidence", "confidence")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edge_list(graph: Graph) -> DataFrame:
    """A line for each edge: its type and the names of its ends."""
    name = lambda a: graph.nodes.select(F.col("id").alias(a), F.coalesce(F.nullif("name", F.lit("")), "id").alias(f"{a}_name"))
    own = graph.edges.select("type", "src", "dst").join(name("src"), "src", "left").join(name("dst"), "dst", "left")
    return own.select(F.concat(F.coalesce("src_name", "src"), F.lit(" -"), "type", F.lit("-> "), F.coalesce("dst_name", "dst")).alias("line"))


def render(graph: Graph, views: dict[str, dict] | None = None) -> str:
    """The report; a view that fails is named in it instead of ending it."""
    own = materialize(counts(graph))
    kinds = {r["part"]: r["kinds"] for r in own.groupBy("part").agg(F.count("*").alias("kinds")).collect()}
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("n"), "key"))
    rows = own.withColumn("place", place).where(F.col("place") <= MOST).orderBy("part", "place").collect()
    lines = ["# Graph report", ""]
    for part in ("service", "label", "type", "confidence"):
        shown = [f"- {r['key']}: {r['n']}" for r in rows if r["part"] == part]
        more = [f"- and {kinds[part] - MOST} more"] if kinds.get(part, 0) > MOST else []
        lines += [f"## By {part}", "", *shown, *more, ""]
    cross = graph.edges.where("cross_repo").count()
    lines += [f"Cross-service edges: {cross}", "", "## Views", ""]
    for name, view in (DEFAULT if views is None else views).items():
        try:
            lines.append(f"- {name}: {run_view(graph, view).count()}")
        except ValueError as e:
            lines.append(f"- {name}: failed ({e})")
    return "\n".join(lines) + "\n"
