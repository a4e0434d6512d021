"""Rule files: loading, checking and layering of extraction and resolve rules, and service settings.

Rules and settings are small texts; they are read by Spark, so that they may lie in any
store that it reads, and worked on where the plan is made.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import slug

# What a rule may work on, and the settings that name paths to leave out.
# Fixed value: the language of stored queries.
LANGUAGE = "kuzu-cypher"
SCOPES = ("source", "graph", "resolve")
EXCLUDES = ("exclude", "excludes", "additional_excludes")


def checked_rule(rule: dict) -> dict:
    """rule, if it has what its scope needs; else a ValueError that says what is missing."""
    if not isinstance(rule, dict) or not rule.get("name"):
        raise ValueError("a rule is an object with a name")
    name, scope = rule["name"], rule.get("scope", "source")
    wants = {"source": {"match": dict, "emit": dict}, "graph": {"match": dict, "emit": dict}, "resolve": {"match": dict, "set": dict}}
    if scope not in SCOPES:
        raise ValueError(f"{name}: scope is one of {', '.join(SCOPES)}, not {scope}")
    for key, kind in wants[scope].items():
        if not isinstance(rule.get(key), kind):
            raise ValueError(f"{name}: {key} must be an object")
    if scope == "source":
        if not isinstance(rule["match"].get("files"), list):
            raise ValueError(f"{name}: match.files must be a list")
        if not rule["emit"].get("label"):
            raise ValueError(f"{name}: emit.label is missing")
        for key in ("schema", "values"):
            if not isinstance(rule["emit"].get(key, {}), dict):
                raise ValueError(f"{name}: emit.{key} must be an object")
    elif scope == "graph" and not rule["match"].get("query"):
        raise ValueError(f"{name}: match.query is missing")
    return rule


def checked_specs(specs: object) -> dict[str, dict]:
    """Stored pattern queries by name, if each has a query (a text or lines that are not empty) and, where given, returns and params as objects."""
    if not isinstance(specs, dict):
        raise ValueError("specs are an object of named queries")
    for name, spec in specs.items():
        if not isinstance(spec, dict) or spec.get("kind") != "query":
            raise ValueError(f"{name}: a spec is an object of kind query")
        query = spec.get("query")
        lines = [query] if isinstance(query, str) else query
        if not isinstance(lines, list) or not lines or not all(isinstance(x, str) and x for x in lines):
            raise ValueError(f"{name}: query is a text or a list of lines, none of them empty")
        if spec.get("language", LANGUAGE) != LANGUAGE:
            raise ValueError(f"{name}: language must be {LANGUAGE}")
        for key in ("returns", "params"):
            if not isinstance(spec.get(key, {}), dict):
                raise ValueError(f"{name}: {key} must be an object")
        if not all(isinstance(x, str) and x for pair in spec.get("returns", {}).items() for x in pair):
            raise ValueError(f"{name}: returns names variables and their labels or types")
    return specs


def rule_files(spark: SparkSession, path: str) -> list[dict]:
    """The rules of all JSON files below path, in the order of the files' names; a file holds a rule or a list of them."""
    texts = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).select("path", F.decode("content", "UTF-8").alias("text"))
    parsed = (json.loads(r["text"]) for r in sorted(texts.collect(), key=lambda r: r["path"]))  # rules are configuration: a handful of small files
    return [checked_rule(rule) for found in parsed for rule in (found if isinstance(found, list) else [found])]


def overlaid_rules(*layers: Iterable[dict]) -> list[dict]:
    """All layers' rules; one with the name of an earlier one takes its place at the end."""
    out: dict[str, dict] = {}
    for layer in layers:
        for rule in layer:
            out.pop(rule["name"], None)
            out[rule["name"]] = rule
    return list(out.values())


def merged(base: object, over: object) -> object:
    """over laid on base: objects key by key; lists of named objects name by name, other lists with what is new; else over."""
    if isinstance(base, dict) and isinstance(over, dict):
        return {k: merged(base[k], over[k]) if k in base and k in over else over.get(k, base.get(k)) for k in [*base, *(k for k in over if k not in base)]}
    if isinstance(base, list) and isinstance(over, list):
        if all(isinstance(x, dict) and "name" in x for x in base + over):
            names = dict.fromkeys(x["name"] for x in base + over)
            first, last = ({x["name"]: x for x in side} for side in (base, over))
            return [merged(first[n], last[n]) if n in first and n in last else dict(last.get(n) or first[n]) for n in names]
        return [*base, *(x for i, x in enumerate(over) if x not in base and x not in over[:i])]
    return over


def _plain(text: str) -> object:
    """A setting's value: true, false, a list in brackets, or the text without quotes around it."""
    bare = text.strip().strip("'\"")
    if bare.startswith("[") and bare.endswith("]"):
        return [_plain(x) for x in bare[1:-1].split(",") if x.strip()]
    return {"true": True, "false": False}.get(bare.lower(), bare)


def settings(text: str) -> dict:
    """Settings from indented `key: value` lines: nested objects by indentation, lists of `- value` lines below a key.

    Blank lines and lines that start with # are left out, as is what has no colon.
    """
    rows = [(len(r) - len(r.lstrip(" ")), r.strip()) for r in text.splitlines() if r.strip() and not r.lstrip().startswith("#")]

    def block(at: int, outer: int) -> tuple[object, int]:
        """What stands deeper than `outer` from row `at` on, and the row after it."""
        listed: list = []
        named: dict = {}
        while at < len(rows) and rows[at][0] > outer:
            depth, line = rows[at]
            at += 1
            key, colon, value = line.partition(":")
            if line.startswith("- "):
                listed.append(_plain(line[2:]))
            elif colon and value.strip():
                named[key.strip()] = _plain(value)
            elif colon:
                named[key.strip()], at = block(at, depth)
        return (listed or named), at

    found, _ = block(0, -1)
    return found if isinstance(found, dict) else {}


def service_settings(files: DataFrame, name: str = "service.yaml") -> DataFrame:
    """folder, name, exclude and include_tests from the settings files at the top of the folders; files: folder, file, content."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for folder, content in frame.itertuples(index=False):
                own = settings(content or "")
                given = (own.get(k) for k in EXCLUDES)
                exclude = [str(x) for v in given if v for x in (v if isinstance(v, list) else [v])]
                rows.append((folder, str(own["name"]) if own.get("name") else None, exclude, own.get("include_test_paths") is True))
            yield pd.DataFrame(rows, columns=["folder", "name", "exclude", "include_tests"])

    return files.where(F.col("file") == name).select("folder", "content").mapInPandas(run, "folder string, name string, exclude array<string>, include_tests boolean")


def service_names(files: DataFrame, config: str = "service.yaml") -> DataFrame:
    """folder and service: the name in the settings, else the last part of that in package.json, else the folder's, as a slug."""
    folders = files.select("folder").distinct()
    set_ = service_settings(files, config).select("folder", F.col("name").alias("set_name"))
    package = files.where("file = 'package.json'").select("folder", F.substring_index(F.get_json_object("content", "$.name"), "/", -1).alias("package_name"))
    found = folders.join(set_, "folder", "left").join(package, "folder", "left")
    named = F.coalesce(F.nullif("set_name", F.lit("")), F.nullif("package_name", F.lit("")), F.col("folder"))
    return found.select("folder", slug(named).alias("service"))
