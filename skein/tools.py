"""Questions of other tools answered over a graph, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import Graph
from .operators import search, traverse

# The names under which these tools are asked for.
DEFINITION, REFERENCES, CALLEES, SYMBOLS, DEPENDENCIES = "cgc.get_symbol_definition", "cgc.find_references", "cgc.get_callees", "cgc.get_file_symbols", "cgc.get_dependencies"


def tool(graph: Graph, name: str, params: dict[str, str] | None = None) -> DataFrame:
    """The rows a tool answers with: nodes of a definition, a file or a flow, edges of references or callees; for any other name one row that says it is not supported."""
    given = params or {}
    symbol = str(given.get("symbol", ""))
    if name == DEFINITION:
        return search.search(graph, symbol, limit=1, fallback=False)
    if name == REFERENCES:
        return traverse.callers(graph, symbol)
    if name == CALLEES:
        return traverse.callees(graph, symbol)
    if name == SYMBOLS:
        file = str(given.get("file_path", ""))
        return graph.nodes.where((F.col("file") == file) | (F.col("path") == file))
    if name == DEPENDENCIES:
        return traverse.flow(graph, symbol, depth=2)[0]
    return graph.spark.range(1).select(F.lit("not_supported").alias("error"), F.lit(name).alias("tool"), F.lit("search(query) or flow(anchor)").alias("instead"))
