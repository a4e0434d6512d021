"""Pattern queries as DataFrame plans: each clause is a join, each condition a filter.

    PatternQuery(graph).match("(c:Customer)-[p:PLACED]->(o:Order)").where("o.status = 'F'").returns("c.id", "o")

`from_text` reads the same clauses from the lines of a stored lens. Properties are
flat columns `var__prop` until the end, so that Catalyst prunes and pushes down.

Clauses are kept until rows are asked for. MATCH clauses that follow each other are a
graph whose edges are shared variables: connected ones are joined along it, whatever
order they are written in, and only what is truly apart is crossed, each part joined
first. A MATCH never moves over an optional clause, whose outcome it would change.

An optional clause applies as a whole: if any binding matches, those that do not are
dropped; if none does, all go on with its variables unbound. Conditions hold after all
clauses, whatever line they stand on, and compare strings; a missing value is '', and
booleans are 'True' and 'False'.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, prop

_NODE = re.compile(r"^\((\w+)(?::(\w+))?\)$")
_HOP = re.compile(r"^\((\w+)(?::(\w+))?\)\s*(<)?-\[(\w+)?(?::(\w+))?\]-(>)?\s*\((\w+)(?::(\w+))?\)$")
_TEST = re.compile(r"^(\w+)\.(\w+)\s+(CONTAINS|STARTS WITH|ENDS WITH|=)\s+(.+)$", re.I | re.S)
_EDGE_COLUMNS = ("type", "src", "dst", "from_service", "to_service", "cross_repo", "confidence", "source")


class PatternQuery:
    def __init__(self, graph: Graph, params: dict[str, str] | None = None) -> None:
        self.graph, self.params = graph, params or {}
        self.steps: list[tuple[str, DataFrame, dict[str, str]]] = []
        self.done: tuple[int, DataFrame | None] = (0, None)
        self.kinds: dict[str, str] = {}
        self.tests: list[str] = []
        self.labels: set[str] = set()
        self.types: set[str] = set()

    def _nodes(self, var: str, label: str | None) -> DataFrame:
        nodes = self.graph.nodes if label is None else self.graph.nodes.where(F.col("label") == label)
        if label:
            self.labels.add(label)
        return nodes.select(*(F.col(c).alias(f"{var}__{c}") for c in nodes.columns))

    def _hop(self, found: re.Match) -> tuple[DataFrame, dict[str, str]]:
        left, left_label, back, rel, kind, _, right, right_label = found.groups()
        rel = rel or f"_edge{len(self.kinds)}"
        if kind:
            self.types.add(kind)
        edges = self.graph.edges if kind is None else self.graph.edges.where(F.col("type") == kind)
        flat = edges.select(*(F.col(c).alias(f"{rel}__{c}") for c in _EDGE_COLUMNS if c in edges.columns))

        def ends(a: str, b: str) -> DataFrame:
            one = self._nodes(left, left_label)
            out = flat.join(one, F.col(f"{rel}__{a}") == F.col(f"{left}__id"))
            if left == right:
                return out.where(F.col(f"{rel}__{b}") == F.col(f"{left}__id"))
            return out.join(self._nodes(right, right_label), F.col(f"{rel}__{b}") == F.col(f"{right}__id"))

        arrow = found.group(6)
        if back:
            made = ends("dst", "src")
        elif arrow:
            made = ends("src", "dst")
        else:
            made = ends("src", "dst").unionByName(ends("dst", "src"))
        return made, {left: "node", right: "node", rel: "edge"}

    def _clause(self, pattern: str) -> tuple[DataFrame, dict[str, str]]:
        text = pattern.strip()
        if found := _NODE.match(text):
            var, label = found.groups()
            return self._nodes(var, label), {var: "node"}
        if found := _HOP.match(text):
            return self._hop(found)
        raise ValueError(f"unsupported pattern: {pattern}")

    def _take(self, how: str, pattern: str) -> PatternQuery:
        made, kinds = self._clause(pattern)
        self.steps.append((how, made, kinds))
        self.kinds |= kinds
        return self

    def match(self, pattern: str) -> PatternQuery:
        return self._take("all", pattern)

    def optional_match(self, pattern: str, strict: bool = False) -> PatternQuery:
        """The clause as a whole, or with strict a left join row by row (without a shared variable both are the same)."""
        return self._take("strict" if strict else "some", pattern)

    @property
    def rows(self) -> DataFrame | None:
        """All bindings of the clauses so far."""
        if self.done[0] != len(self.steps):
            rows, bound, at = None, {}, 0
            while at < len(self.steps):
                to = at
                while to < len(self.steps) and self.steps[to][0] == "all":
                    to += 1
                if to > at:
                    rows = _all_joined(rows, bound, [(made, kinds) for _, made, kinds in self.steps[at:to]])
                else:
                    to += 1
                    rows = _with_optional(rows, bound, *self.steps[at])
                for _, _, kinds in self.steps[at:to]:
                    bound |= kinds
                at = to
            self.done = (len(self.steps), rows)
        return self.done[1]

    def where(self, *conditions: str) -> PatternQuery:
        for text in conditions:
            self.tests += [t.strip() for t in re.split(r"\s+AND\s+", text, flags=re.I)]
        return self

    def _value(self, var: str, name: str) -> Column:
        if var not in self.kinds:
            return F.lit("")
        flat = {c.removeprefix(f"{var}__") for c in self.rows.columns if c.startswith(f"{var}__")}
        if name in flat:
            return F.col(f"{var}__{name}")
        return F.try_element_at(f"{var}__props", F.lit(name)) if "props" in flat else F.lit(None).cast("string")

    def _test(self, text: str) -> Column:
        found = _TEST.match(text)
        if not found:
            raise ValueError(f"unsupported condition: {text}")
        var, name, how, raw = found.groups()
        wanted = str(self.params.get(raw.strip()[1:])) if raw.strip().startswith("$") else raw.strip().strip("'\"")
        value = self._value(var, name)
        truth = self.rows.schema[f"{var}__{name}"].dataType.simpleString() == "boolean" if f"{var}__{name}" in self.rows.columns else False
        value = F.coalesce(F.initcap(value.cast("string")) if truth else value.cast("string"), F.lit(""))
        return {"CONTAINS": value.contains, "STARTS WITH": value.startswith, "ENDS WITH": value.endswith, "=": lambda x: value == x}[how.upper()](wanted)

    def validate(self) -> PatternQuery:
        """Every label and type named, in optional clauses too, must be in the graph."""
        for what, names, column, df in (("label", self.labels, "label", self.graph.nodes), ("edge type", self.types, "type", self.graph.edges)):
            # one row of each is enough, and only the tables that can hold it are looked at
            if missing := [n for n in sorted(names) if df.where(F.col(column) == n).isEmpty()]:
                raise ValueError(f"unknown {what}: {', '.join(missing)}")
        return self

    def bindings(self) -> DataFrame:
        rows = self.rows
        for text in self.tests:
            rows = rows.where(self._test(text))
        return rows

    def returns(self, *items: str) -> DataFrame:
        """A column for each item: `v.prop` as a value, `v` as a struct."""
        rows, out = self.bindings(), []
        for item in (i.strip() for i in items):
            if "." in item:
                var, name = item.split(".", 1)
                out.append(self._value(var, name).alias(item))
            else:
                own = [c for c in rows.columns if c.startswith(f"{item}__")]
                out.append(F.when(F.coalesce(*(F.col(c).cast("string") for c in own if c.endswith(("__id", "__type")))).isNotNull(), F.struct(*(F.col(c).alias(c.removeprefix(f"{item}__")) for c in own))).alias(item) if own else F.lit(None).cast("string").alias(item))
        return rows.select(*out)

    def subgraph(self, *variables: str) -> Graph:
        """The distinct nodes and edges bound to the variables."""
        rows = self.bindings()
        pick = lambda v: rows.select(*(F.col(c).alias(c.removeprefix(f"{v}__")) for c in rows.columns if c.startswith(f"{v}__")))
        nodes, edges = None, None
        for v in variables:
            if self.kinds.get(v) == "node":
                own = pick(v).where("id is not null")
                nodes = own if nodes is None else nodes.unionByName(own)
            elif self.kinds.get(v) == "edge":
                own = pick(v).where("type is not null")
                edges = own if edges is None else edges.unionByName(own)
        nodes = self.graph.nodes.limit(0) if nodes is None else nodes.dropDuplicates(["id"])
        edges = self.graph.edges.limit(0) if edges is None else edges.dropDuplicates(["type", "src", "dst"])
        return Graph(nodes, edges)


def _joined(rows: DataFrame | None, bound: dict[str, str], made: DataFrame, kinds: dict[str, str]) -> DataFrame:
    if rows is None:
        return made
    shared = [v for v, kind in kinds.items() if kind == "node" and v in bound]
    again = [v for v, kind in kinds.items() if kind == "edge" and v in bound]
    rows = rows.drop(*(c for c in rows.columns for v in again if c.startswith(f"{v}__")))  # the later clause's edge counts
    if not shared:
        return rows.crossJoin(made)
    keyed = made.drop(*(c for c in made.columns for v in shared if c.startswith(f"{v}__") and c != f"{v}__id"))
    return rows.join(keyed, [f"{v}__id" for v in shared])


def _all_joined(rows: DataFrame | None, bound: dict[str, str], clauses: list[tuple[DataFrame, dict[str, str]]]) -> DataFrame:
    """The clauses' bindings together: each connected part of them is joined by itself, and parts are crossed last."""
    edges = [v for _, kinds in clauses for v, kind in kinds.items() if kind == "edge"]
    if len(set(edges)) < len(edges) or any(v in bound for v in edges):
        # an edge variable bound anew depends on the written order
        for made, kinds in clauses:
            rows, bound = _joined(rows, bound, made, kinds), bound | kinds
        return rows
    left, parts = list(clauses), []
    seed, known = rows, dict(bound)
    while left:
        near = next((c for c in left if any(kind == "node" and v in known for v, kind in c[1].items())), None)
        if near is None:
            if seed is not None:
                parts.append(seed)
            near, seed, known = left[0], None, {}
        left.remove(near)
        seed, known = _joined(seed, known, *near), known | near[1]
    parts.append(seed)
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(part)
    return out


def _with_optional(before: DataFrame | None, bound: dict[str, str], how: str, made: DataFrame, kinds: dict[str, str]) -> DataFrame:
    inner = _joined(before, bound, made, kinds)
    if before is None:
        return inner
    keys = [f"{v}__id" for v, kind in kinds.items() if kind == "node" and v in bound]
    if how == "strict" and keys:
        return inner.unionByName(before.join(inner.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)
    some = inner.select(F.lit(True).alias("_some")).limit(1)
    return inner.unionByName(before.join(F.broadcast(some), F.lit(True), "left_anti"), allowMissingColumns=True)  # one row at most


def from_text(graph: Graph, text: str | list[str], params: dict[str, str] | None = None) -> DataFrame:
    """Run a stored lens: one clause a line, `MATCH`, `OPTIONAL MATCH`, `WHERE` or `RETURN`, which must be there."""
    query, items = PatternQuery(graph, params), None
    for line in (text if isinstance(text, list) else text.splitlines()):
        line = line.strip()
        if not line:
            continue
        word = next((w for w in ("OPTIONAL MATCH", "MATCH", "WHERE", "RETURN") if line.upper().startswith(w + " ")), None)
        rest = line[len(word) :] if word else line
        if word == "MATCH":
            query.match(rest)
        elif word == "OPTIONAL MATCH":
            query.optional_match(rest)
        elif word == "WHERE":
            query.where(rest)
        elif word == "RETURN":
            items = rest.split(",")
        else:
            raise ValueError(f"unsupported clause: {line}")
    if items is None:
        raise ValueError("RETURN is missing")
    return query.validate().returns(*items)


def checked(rows: DataFrame, contract: dict[str, str]) -> DataFrame:
    """rows, after no returned node or edge was found with another label or type than the contract says."""
    for name, wanted in contract.items():
        field = "label" if "label" in rows.schema[name].dataType.names else "type"
        if not rows.where(F.col(f"{name}.{field}") != wanted).isEmpty():
            raise ValueError(f"{name} is not always {wanted}")
    return rows


__all__ = ["PatternQuery", "checked", "from_text", "prop"]
