"""Views: stored filters, sorts and groups over nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, prop

# The views that are always there.
DEFAULT = {
    "endpoints": {"kind": "nodes", "label": "Endpoint", "sort": ["service", "path"]},
    "cross-service-edges": {"kind": "edges", "cross_repo": True, "sort": ["from_service", "to_service", "type"]},
    "kafka-topics": {"kind": "group_edges", "edge_type": "KAFKA_DELIVERS", "group_by": {"side": "from", "property": "topic"}, "fields": {"producers": {"side": "from", "property": "service"}, "consumers": {"side": "to", "property": "service"}}},
}
_SIDE = {"from": "src", "to": "dst"}
_NAMES = {"from": "src", "to": "dst"}


def _filtered(df: DataFrame, filters: dict, params: dict) -> DataFrame:
    """Equality filters; None and parameters that are not given hold for all."""
    for key, value in filters.items():
        if isinstance(value, str) and value.startswith("$"):
            value = params.get(value[1:])
        if value is not None:
            df = df.where(prop(df, _NAMES.get(key, key)) == F.lit(value))
    return df


def _sorted(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.orderBy(*(F.coalesce(prop(df, _NAMES.get(k, k)).cast("string"), F.lit("")) for k in keys)) if keys else df


def run_view(graph: Graph, view: dict, params: dict | None = None) -> DataFrame:
    """The rows of a view of kind nodes, edges or group_edges."""
    params, kind = params or {}, view.get("kind")
    if kind == "nodes":
        df = graph.nodes if not view.get("label") else graph.nodes.where(F.col("label") == view["label"])
        return _sorted(_filtered(_filtered(df, view.get("where", {}), params), params, params), view.get("sort", []))
    if kind == "edges":
        return _sorted(_edges(graph, view, params), view.get("sort", []))
    if kind == "group_edges":
        return _groups(graph, view, params)
    raise ValueError(f"unsupported view kind: {kind}")


def _edges(graph: Graph, view: dict, params: dict) -> DataFrame:
    df = graph.edges if not view.get("edge_type") else graph.edges.where(F.col("type") == view["edge_type"])
    if "cross_repo" in view:
        df = df.where(F.col("cross_repo").eqNullSafe(view["cross_repo"]))
    df = _filtered(df, view.get("where", {}), params)
    return df.where(F.col("type") == params["type"]) if params.get("type") else df


def _groups(graph: Graph, view: dict, params: dict) -> DataFrame:
    """For each value of a property at one end of the edges, sorted distinct values of others.

    Each end of the edges meets the nodes once, with just the properties asked for; sets
    are gathered before they are shuffled.
    """
    edges = _edges(graph, {k: view[k] for k in ("edge_type", "where") if view.get(k)}, params)
    by = view["group_by"]
    asked = {"group_key": by, **view.get("fields", {})}
    own = edges.select("src", "dst")
    for end in ("from", "to"):
        wanted = {name: spec["property"] for name, spec in asked.items() if spec["side"] == end}
        if wanted:
            values = graph.nodes.select(F.col("id").alias(_SIDE[end]), *(prop(graph.nodes, p).cast("string").alias(f"_{i}_{end}") for i, p in enumerate(wanted.values())))
            own = own.join(values, _SIDE[end], "inner" if by["side"] == end else "left").withColumnsRenamed({f"_{i}_{end}": f"_v_{name}" for i, name in enumerate(wanted)})
    sets = [F.array_sort(F.collect_set(f"`_v_{name}`")).alias(name) for name in view.get("fields", {})]
    named = own.where("_v_group_key is not null").groupBy(F.col("_v_group_key").alias("group_key"))
    return (named.agg(*sets) if sets else named.agg(F.count("*")).select("group_key")).orderBy("group_key")


def checked_views(specs: dict[str, dict]) -> dict[str, dict]:
    """specs, if each is a view that can run."""
    for name, view in specs.items():
        if view.get("kind") not in ("nodes", "edges", "group_edges"):
            raise ValueError(f"{name}: unsupported view kind: {view.get('kind')}")
        if view["kind"] == "group_edges" and not {"side", "property"} <= set(view.get("group_by", {})):
            raise ValueError(f"{name}: group_by needs side and property")
        for f in [view.get("group_by", {"side": "from"}), *view.get("fields", {}).values()]:
            if f.get("side") not in _SIDE:
                raise ValueError(f"{name}: a side is from or to")
    return specs


def overlaid(*layers: dict[str, dict]) -> dict[str, dict]:
    """The default views and the layers over them; of equal names the last counts."""
    out = dict(DEFAULT)
    for layer in layers:
        out |= checked_views(layer)
    return out
