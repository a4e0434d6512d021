"""Row transforms after extraction: resolve rules, constants and hints."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import template
from ..graph import prop
from .extract import positional


def with_prop(nodes: DataFrame, name: str, value: Column) -> DataFrame:
    """nodes with a property set: the column if there is one, else an entry of `props`."""
    if name in nodes.columns:
        return nodes.withColumn(name, value)
    entry = F.create_map(F.lit(name), value)
    return nodes.withColumn("props", F.when(value.isNull(), F.col("props")).otherwise(F.map_concat(F.map_filter(F.coalesce("props", F.create_map().cast("map<string,string>")), lambda k, _: k != name), entry)))


def _patterns(match: dict) -> list[str]:
    given = match.get("patterns") or [match.get("pattern")]
    return [x for x in (p.get("regex") if isinstance(p, dict) else p for p in given) if x]


def strata(rules: list[dict]) -> list[list[dict]]:
    """The rules in layers: of those with its label, a rule stands in a later layer than all before it that set what it reads.

    A layer's rules all read what the layers before have left. So a rule may share a
    layer with earlier ones that read or set what it sets (of those that set the same,
    the first that gives something counts), but must not stand before them. Rules of
    different labels never meet in a node.
    """
    level: dict[tuple[str, str], int] = {}
    read: dict[tuple[str, str], int] = {}
    layers: list[list[dict]] = []
    for rule in rules:
        match = rule["match"]
        label, reads = match["label"], {match.get("from") or match.get("field", ""), *match.get("where", {})}
        sets = rule.get("set", {})
        at = max([level.get((label, k), -1) + 1 for k in reads] + [max(level.get((label, k), 0), read.get((label, k), 0)) for k in sets])
        level |= {(label, k): at for k in sets}
        read |= {(label, k): max(at, read.get((label, k), 0)) for k in reads}
        layers.extend([] for _ in range(at + 1 - len(layers)))
        layers[at].append(rule)
    return layers


def _offers(nodes: DataFrame, rule: dict) -> dict[str, Column]:
    """What a rule would set, by property; null where it does not hold or gives nothing."""
    match = rule["match"]
    source = F.coalesce(prop(nodes, match.get("from") or match.get("field", "")).cast("string"), F.lit(""))
    holds = source != ""
    for k, v in match.get("where", {}).items():
        holds = holds & prop(nodes, k).eqNullSafe(F.lit(v))
    forms = [positional(p) for p in _patterns(match)]
    out = {}
    for key, text in rule.get("set", {}).items():
        value = F.lit(None).cast("string")
        for plain, groups in reversed(forms):
            value = F.when(source.rlike(plain), template(text, {n: F.regexp_extract(source, plain, i) for n, i in groups.items()})).otherwise(value)
        out[key] = F.when(holds, F.nullif(value, F.lit("")))
    return out


def resolve(nodes: DataFrame, rules: list[dict]) -> DataFrame:
    """Ordered rules: where the label and conditions hold and a pattern is found in a property, empty properties are filled from its groups.

    A later rule sees what earlier ones have set. The first pattern found counts. Rules
    are applied in layers (see `strata`), one projection each, in which a node meets the
    rules of its own label alone: the plan grows with the rules, not with their products.
    """
    for layer in strata(rules):
        offers: dict[str, dict[str, list[Column]]] = {}
        for rule in layer:
            for key, value in _offers(nodes, rule).items():
                offers.setdefault(key, {}).setdefault(rule["match"]["label"], []).append(value)
        columns, entries = {}, []
        for key, by_label in offers.items():
            old, new = prop(nodes, key), F.lit(None).cast("string")
            for label, values in by_label.items():
                new = F.when(F.col("label") == label, F.coalesce(*values)).otherwise(new)
            filled = F.when(F.coalesce(old.cast("string"), F.lit("")) == "", new)
            if key in nodes.columns:
                columns[key] = F.coalesce(filled, old)
            else:
                entries.append(F.struct(F.lit(key).alias("key"), filled.alias("value")))
        if entries:
            given = F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))
            kept = F.coalesce("props", F.create_map().cast("map<string,string>"))
            # what is filled was null or empty, so its old entry goes
            columns["props"] = F.map_concat(F.map_filter(kept, lambda k, _: ~F.map_contains_key(F.col("_given"), k)), F.col("_given"))
            nodes = nodes.withColumn("_given", given)
        nodes = nodes.withColumns(columns).drop("_given")
    return nodes


def substitute_constants(nodes: DataFrame, constants: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """For each pair (property naming a constant: property it fills), the constant's value from the same file, by full name, then by its last part."""
    own = constants.select("service", "file", F.col("name").alias("_name"), F.col("value").alias("_value"))
    for raw, target in pairs.items():
        ask = nodes.where((prop(nodes, raw) != "") & (F.coalesce(prop(nodes, target), F.lit("")) == "")).select("id", "service", "file", F.posexplode(F.array(prop(nodes, raw), F.substring_index(prop(nodes, raw), ".", -1))).alias("step", "_name"))
        found = ask.join(own, ["service", "file", "_name"]).groupBy("id").agg(F.min_by("_value", "step").alias("_found"))
        nodes = nodes.join(found, "id", "left")
        nodes = with_prop(nodes, target, F.coalesce(F.col("_found"), prop(nodes, target)))
        if target == "topic" and "topics" in nodes.columns:
            vague = F.coalesce(F.size("topics"), F.lit(0)).isin(0, -1) | F.array_contains("topics", "{unknown}")
            nodes = nodes.withColumn("topics", F.when(F.col("_found").isNotNull() & F.coalesce(vague, F.lit(True)), F.array("_found")).otherwise(F.col("topics")))
        nodes = nodes.drop("_found")
    return nodes


def apply_hints(nodes: DataFrame, hints: list[dict]) -> DataFrame:
    """Each hint in turn: nodes equal in all of `match` get the properties of `set`, whatever they had."""
    for hint in hints:
        holds = F.lit(True)
        for k, v in hint.get("match", {}).items():
            holds = holds & prop(nodes, k).cast("string").eqNullSafe(F.lit(v))
        for k, v in hint.get("set", {}).items():
            nodes = with_prop(nodes, k, F.when(holds, F.lit(v)).otherwise(prop(nodes, k)))
    return nodes


def named_groups(pattern: str) -> list[str]:
    return list(re.compile(pattern).groupindex)
