"""Plugins: registered functions (graph, args) -> DataFrame, run only where plugins are allowed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .graph import Graph
from .operators.aggregate import cross_service_weights

Plugin = Callable[[Graph, dict], DataFrame]
_known: dict[str, Plugin] = {"service_risk": lambda graph, args: cross_service_weights(graph)}


def register(name: str, plugin: Plugin) -> None:
    _known[name] = plugin


def run(name: str, graph: Graph, args: dict | None = None, allowed: bool = False) -> DataFrame:
    """The plugin's rows; every way to it passes this one gate."""
    if not allowed:
        raise PermissionError("plugins are not allowed here; pass allowed=True")
    return _known[name](graph, args or {})
