"""Readers: source trees, graph files, call graphs, traces and registries."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import slug
from ..graph import EDGE, NODE, Graph, as_edges, as_nodes, materialize
from ..operators.extract import glob_regex
from .rules import service_names, service_settings

# Folders that are never read, patterns of tests, what marks a folder as a service, and the endings of source files.
EXCLUDED = ("node_modules", "target", "build", "dist", ".git", "__pycache__")
TESTS = ("src/test/*", "tests/*", "__tests__/*", "*Tests.java", "*.test.js", "*.test.ts", "*.test.tsx", "*.spec.js", "*.spec.ts", "*.spec.tsx")
MARKERS = ("package.json", "pom.xml")
ENDINGS = (".java", ".js", ".jsx", ".ts", ".tsx", ".yml", ".yaml", ".properties", ".xml", ".jsp", ".jspx", ".tag", ".tld", ".sql", ".json")


def listed(spark: SparkSession, path: str, globs: str = "*") -> DataFrame:
    """folder (the first below path, '' for files that lie in it), file (the path below that) and content of all files; what is not UTF-8 is dropped."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", globs).load(path)
    root = re.escape(path.rstrip("/").rsplit("/", 1)[-1])
    below = F.regexp_extract("path", rf"/{root}/(.*)$", 1)
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit(""))
    return raw.select(F.regexp_extract(below, "^([^/]*)/", 1).alias("folder"), F.regexp_replace(below, "^[^/]*/", "").alias("file"), text.alias("content"))


def service_roots(files: DataFrame, config: str = "service.yaml") -> DataFrame:
    """The folders that are services: they have a marker file at their top or a source file anywhere, and no dot before their name."""
    marked = F.col("file").isin(config, *MARKERS)
    source = F.regexp_extract("file", r"(\.[^./]+)$", 1).isin(*ENDINGS)
    return files.where((F.col("folder") != "") & ~F.startswith("folder", F.lit(".")) & (marked | source)).select("folder").distinct()


def workspace(spark: SparkSession, path: str, globs: str = "*", excluded: tuple[str, ...] = EXCLUDED, patterns: tuple[str, ...] = TESTS, config: str = "service.yaml") -> DataFrame:
    """service, file (the path below the service) and content of the files of a workspace.

    Each folder that looks like a service is one, named by its settings; if none does,
    the workspace itself is the service. Folders in `excluded`, files that fit `patterns`
    (but for services that include their tests) and those a service leaves out itself
    are not read.
    """
    files = listed(spark, path, globs)
    roots = service_roots(files, config)
    if roots.isEmpty():
        files = files.select(F.lit(path.rstrip("/").rsplit("/", 1)[-1]).alias("folder"), F.concat_ws("/", F.nullif("folder", F.lit("")), "file").alias("file"), "content")
    else:
        files = files.join(roots, "folder", "left_semi")
    out = files.where(~F.exists(F.split("file", "/"), lambda p: p.isin(*excluded)))
    own = service_settings(files, config).select("folder", "exclude", "include_tests")
    out = out.join(service_names(files, config), "folder").join(own, "folder", "left")
    tests = F.coalesce(F.col("include_tests"), F.lit(False))
    for p in patterns:
        out = out.where(tests | ~F.col("file").rlike(glob_regex(p)))
    # a service's own patterns are globs: escaped, with * for anything
    fits = lambda p: F.regexp_like(F.col("file"), F.concat(F.lit("^(?:.*/)?"), F.regexp_replace(F.regexp_replace(p, r"([.+(){}|^$\\\[\]?])", r"\\$1"), r"\*+", ".*"), F.lit("$")))
    out = out.where(~F.coalesce(F.exists("exclude", fits), F.lit(False)))
    return out.select("service", "file", "content")


def graph_json(spark: SparkSession, path: str) -> Graph:
    """A graph from one JSON document with `nodes` and `edges`; properties without a column go to `props`."""
    raw = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    every = lambda key: raw.select(F.posexplode(F.variant_get("v", f"$.{key}", "array<variant>")).alias("ordinal", "n"))
    return Graph(as_nodes(_flat(every("nodes"), NODE)), as_edges(_flat(every("edges"), EDGE, {"src": "from", "dst": "to"})))


def _flat(rows: DataFrame, schema: dict[str, str], renamed: dict[str, str] | None = None) -> DataFrame:
    renamed = renamed or {}
    known = [c for c in schema if c not in ("props", "ordinal")]
    cols = [F.try_variant_get("n", f"$.{renamed.get(c, c)}", schema[c]).alias(c) for c in known]
    names = [renamed.get(c, c) for c in known]
    rest = F.map_filter(F.variant_get("n", "$", "map<string,variant>"), lambda k, _: ~k.isin(*names))
    text = F.transform_values(rest, lambda _, v: F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)))
    return rows.select(F.col("ordinal").cast("long"), *cols, text.alias("props"))


def call_graph(spark: SparkSession, path: str) -> Graph:
    """A call graph (service, nodes, edges): functions with a path are endpoints, others components; edges whose ends are missing are dropped."""
    raw = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    service = F.coalesce(F.try_variant_get("v", "$.service", "string"), F.lit("unknown"))
    n = raw.select(service.alias("service"), F.posexplode(F.variant_get("v", "$.nodes", "array<variant>")).alias("ordinal", "n"))
    get = lambda k: F.try_variant_get("n", f"$.{k}", "string")
    label = F.when((get("label") == "Function") & get("path").isNotNull(), "Endpoint").when(get("label") == "Function", "Component").when(get("label") == "Class", "Service").when(get("label") == "File", "File").otherwise("CgcNode")
    own = n.select(get("id").alias("old"), F.concat_ws(":", "service", F.lit("cgc"), get("id")).alias("id"), label.alias("label"), "service", get("name").alias("name"), get("path").alias("path"), get("http_method").alias("http_method"), F.lit("cgc-import").alias("source"), F.lit("medium").alias("confidence"), F.col("ordinal").cast("long"))
    e = raw.select(F.explode(F.variant_get("v", "$.edges", "array<struct<from:string,to:string,type:string>>")).alias("e")).select("e.*")
    side = lambda k, a: own.select(F.col("old").alias(k), F.col("id").alias(a), F.col("service").alias(f"{'from' if a == 'src' else 'to'}_service"))
    edges = e.join(side("from", "src"), "from").join(side("to", "dst"), "to").select(F.when(F.col("type") == "CallEdge", "CROSSES_TIER").otherwise(F.col("type")).alias("type"), "src", "dst", "from_service", "to_service", (F.col("from_service") != F.col("to_service")).alias("cross_repo"), F.lit("medium").alias("confidence"), F.lit("cgc-import").alias("source"))
    return Graph(as_nodes(own), as_edges(edges))


_SCALAR = "stringValue:string,intValue:string,doubleValue:string,boolValue:string"
_LIST = f"arrayValue:struct<values:array<struct<{_SCALAR}>>>,kvlistValue:struct<values:array<struct<key:string,value:struct<{_SCALAR}>>>>"
_VALUE = f"struct<{_SCALAR},{_LIST}>"
_ATTRS = f"array<struct<key:string,value:{_VALUE}>>"
_SPANS = f"array<struct<name:string,service:string,serviceName:string,attributes:{_ATTRS}>>"
_SCOPES = f"array<struct<spans:{_SPANS}>>"
OTLP = f"struct<resourceSpans:array<struct<resource:struct<attributes:{_ATTRS}>,scopeSpans:{_SCOPES},instrumentationLibrarySpans:{_SCOPES}>>>"
_PLAIN = "struct<service:string,spans:array<struct<name:string,service:string,serviceName:string,attributes:ATTRIBUTES>>>"


def attributes(attrs: Column) -> Column:
    """OTLP attributes as a map of strings; of repeated keys the last counts.

    Lists and key-value lists of scalars are JSON texts; what is nested deeper is null in them.
    """
    scalar = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"], v["boolValue"])
    listed = lambda v: F.to_json(F.transform(v["arrayValue"]["values"], scalar))
    pairs = lambda v: F.to_json(F.map_from_entries(F.transform(v["kvlistValue"]["values"], lambda e: F.struct(e["key"], scalar(e["value"])))))
    value = lambda v: F.coalesce(scalar(v), listed(v), pairs(v))
    return F.aggregate(F.coalesce(attrs, F.array().cast(_ATTRS)), F.create_map().cast("map<string,string>"), lambda m, a: F.map_concat(F.map_filter(m, lambda k, _: k != a["key"]), F.create_map(a["key"], value(a["value"]))))


def _kind(v: Column | str) -> Column:
    """object, array or scalar, of a variant."""
    return F.lower(F.regexp_extract(F.schema_of_variant(v), "^(OBJECT|ARRAY)", 1))


def spans(texts: DataFrame) -> DataFrame:
    """Spans of trace documents (ordinal, value), wherever they stand in them.

    An object with `resourceSpans` gives those and is not looked into any further. Any other
    gives its `spans`, if they are a list, and is then searched like every list: all that
    it holds is a document of its own. The search goes down level by level until no object
    or list with such a name in it is left, so a document takes as many rounds as it is
    deep. A value that is no JSON has no spans.

    A span's ordinal is its document's with its places in it: no two spans share one if
    the documents' ordinals differ, and spans come in the order of a walk that gives an
    object's own spans first and then goes into its values, in the order of their names.
    """
    inner = lambda v: F.to_json(v).rlike('"(?:resourceSpans|spans)" ?:')
    level = texts.select("ordinal", F.array().cast("array<int>").alias("at"), F.try_parse_json("value").alias("v")).where("v IS NOT NULL").where(inner("v"))
    deep: DataFrame | None = None
    while True:
        level = materialize(level)
        if level.isEmpty():
            break
        own = level.withColumns({"kind": _kind("v"), "otlp": F.try_variant_get("v", "$.resourceSpans", "variant"), "text": F.to_json("v")})
        found = _resource_spans(own.where("otlp IS NOT NULL")).unionByName(_plain_spans(own.where("kind = 'object' AND otlp IS NULL")))
        deep = found if deep is None else deep.unionByName(found)
        below = own.where("otlp IS NULL").lateralJoin(texts.sparkSession.tvf.variant_explode(F.col("v").outer()))
        level = below.select("ordinal", F.concat("at", F.array("pos")).alias("at"), F.col("value").alias("v")).where(_kind("v") != "").where(inner("v"))
    if deep is None:
        deep = _plain_spans(texts.limit(0).select("ordinal", F.array().cast("array<int>").alias("at"), F.col("value").cast("string").alias("text")))
    return normalized(deep)


def _resource_spans(objects: DataFrame) -> DataFrame:
    otlp = objects.select("ordinal", "at", F.from_json("text", OTLP).alias("t"))
    res = otlp.select("ordinal", "at", F.posexplode("t.resourceSpans").alias("i", "r"))
    scopes = res.select("ordinal", "at", "i", attributes(F.col("r.resource.attributes")).alias("res"), F.posexplode(F.concat(F.coalesce("r.scopeSpans", F.array().cast(_SCOPES)), F.coalesce("r.instrumentationLibrarySpans", F.array().cast(_SCOPES)))).alias("j", "s"))
    each = scopes.select("ordinal", "at", "i", "j", "res", F.posexplode("s.spans").alias("k", "s"))
    return each.select("ordinal", "at", "i", "j", "k", "s.name", F.coalesce("s.service", "s.serviceName", F.try_element_at("res", F.lit("service.name"))).alias("hint"), attributes(F.col("s.attributes")).alias("attrs"))


def _plain_spans(objects: DataFrame) -> DataFrame:
    """An object's own `spans`; their attributes are a map or a list of OTLP attributes."""
    listed = _PLAIN.replace("ATTRIBUTES", _ATTRS)
    t = objects.select("ordinal", "at", F.from_json("text", _PLAIN.replace("ATTRIBUTES", "map<string,string>")).alias("m"), F.from_json("text", listed).alias("l"))
    each = t.select("ordinal", "at", F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("m.service").alias("all"), F.posexplode(F.arrays_zip(F.col("m.spans").alias("m"), F.col("l.spans").alias("l"))).alias("k", "s"))
    s = lambda f: F.coalesce(F.col(f"s.m.{f}"), F.col(f"s.l.{f}"))
    given = F.when(F.size("s.l.attributes") > 0, attributes(F.col("s.l.attributes"))).otherwise(F.col("s.m.attributes"))
    return each.select("ordinal", "at", "i", "j", "k", s("name").alias("name"), F.coalesce(s("service"), s("serviceName"), "all").alias("hint"), given.alias("attrs"))


def normalized(raw: DataFrame) -> DataFrame:
    """ordinal, name, service, target_service, path and topic from rows (ordinal, at, i, j, k, name, hint, attrs)."""
    a = lambda *keys: F.coalesce(*(F.nullif(F.try_element_at("attrs", F.lit(k)), F.lit("")) for k in keys))
    place = F.struct(F.col("ordinal").alias("document"), "at", "i", "j", "k")
    named = F.nullif(F.regexp_extract(F.coalesce("name", F.lit("")), r"(?:^|\W)(/[A-Za-z0-9_./{}-]+)", 1), F.lit(""))
    return raw.select(place.alias("ordinal"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce("hint", a("service.name")).alias("service"), a("peer.service", "server.address", "net.peer.name").alias("target_service"), F.coalesce(a("http.route", "http.target", "url.path"), named).alias("path"), a("messaging.destination.name", "messaging.destination", "messaging.kafka.topic").alias("topic"))


def service_registry(spark: SparkSession, path: str) -> DataFrame:
    """host and service from lines `host: service`; what follows # is not read."""
    line = r"^\s*([^:#]+?)\s*:\s*([^#]+)"
    own = spark.read.text(path).where(F.col("value").rlike(line))
    return own.select(slug(F.regexp_extract("value", line, 1)).alias("host"), slug(F.regexp_extract("value", line, 2)).alias("service"))


def write_graph(graph: Graph, path: str) -> None:
    """Parquet below path: nodes by label, edges by type."""
    graph.nodes.write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
    graph.edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> Graph:
    # read by its own schema: a graph without edges has no files to tell one from
    fixed = lambda part, schema: spark.read.schema(", ".join(f"`{c}` {t}" for c, t in schema.items())).parquet(f"{path}/{part}")
    return Graph(as_nodes(fixed("nodes", NODE)), as_edges(fixed("edges", EDGE)))


def write_json_lines(graph: Graph, path: str) -> None:
    """One JSON object a line for nodes and for edges, written by the executors."""
    graph.nodes.write.mode("overwrite").json(f"{path}/nodes")
    graph.edges.write.mode("overwrite").json(f"{path}/edges")


def from_rows(spark: SparkSession, nodes: list[dict], edges: list[dict]) -> Graph:
    """A small graph from dicts, for tests and hand-made overlays."""
    def frame(rows: list[dict], schema: dict[str, str], renamed: dict[str, str]) -> DataFrame:
        texts = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], T.StructType([T.StructField("ordinal", T.LongType()), T.StructField("value", T.StringType())]))
        return _flat(texts.select("ordinal", F.parse_json("value").alias("n")), schema, renamed)

    return Graph(as_nodes(frame(nodes, NODE, {})), as_edges(frame(edges, EDGE, {"src": "from", "dst": "to"})))
