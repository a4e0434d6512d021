"""Registered queries of readers, rules over files and scalars, and the same in SQL.

The files that these read are made of the business tables: source texts from nations and
parts, traces from events, and small documents written to the shared folder and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import estate
from .functions import text
from .graph import Graph, as_edges, as_nodes, shared_folder
from .operators import aggregate, discover, extract, link, report, resolve, search, verify
from .sources import readers, rules

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def _query(sql: str) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _queries[f.__name__], _sql[f.__name__] = f, sql
        return f

    return keep


def _said(template: str, **parts: Column | str) -> Column:
    """A text with {name} parts from columns."""
    out = [F.lit(template)]
    for name, value in parts.items():
        out = [F.replace(out[0], F.lit("{" + name + "}"), (F.col(value) if isinstance(value, str) else value).cast("string"))]
    return out[0]


def _nations(spark: SparkSession, sf: str, ending: str, template: Column) -> DataFrame:
    """A source file for each nation."""
    return estate.table(spark, sf, "nation").select(F.lit("web").alias("service"), F.concat(F.lit("src/F"), "n_nationkey", F.lit(ending)).alias("file"), template.alias("content"))


# Extraction


@_query("""WITH f AS (SELECT 'src/F' || n_nationkey || '.xml' AS file, n_name, n_nationkey FROM nation WHERE n_regionkey <> 0)
SELECT file, n_name || '-' || n_nationkey AS name, 2::INT AS line FROM f UNION ALL SELECT file, '-x', 4 FROM f""")
def extract_xml_query(spark: SparkSession, sf: str) -> DataFrame:
    """Elements by selector; the files of one region are not XML and give nothing."""
    whole = _said('<?xml version="1.0"?><web xmlns="u">\n<servlet id="{n}"><name>{name}</name>\n</servlet>\n<servlet id="x"/></web>', n="n_nationkey", name="n_name")
    rule = {"name": "s", "match": {"files": ["*.xml"], "strategy": "xml-query", "select": ".//servlet", "captures": {"n": "name", "i": "@id"}}, "emit": {"label": "Servlet", "values": {"name": "{{n}}-{{i}}"}}}
    return extract.extract(_nations(spark, sf, ".xml", F.when(F.col("n_regionkey") == 0, "<a><b>").otherwise(whole)), [rule]).select("file", "name", "line")


@_query("SELECT 'src/F' || n_nationkey || '.properties' AS file, 'k' || n_nationkey AS name, 'v' || n_nationkey AS kind, 2::INT AS line FROM nation")
def extract_config(spark: SparkSession, sf: str) -> DataFrame:
    rule = {"name": "k", "match": {"files": ["*.properties"], "strategy": "config-key", "key_pattern": r"^(?P<key>\w+)\.topic\s*=\s*(?P<v>\S+)"}, "emit": {"label": "ConfigProperty", "values": {"name": "{{key}}", "kind": "{{v|none}}"}}}
    return extract.extract(_nations(spark, sf, ".properties", _said("# settings\nk{n}.topic = v{n}\nother=1", n="n_nationkey")), [rule]).select("file", "name", "kind", "line")


_JAVA = '@RestController\n@RequestMapping("/api/{n}")\nclass C{n} {\n  @GetMapping("/one")\n  public String one(String x) {\n  }\n  @PostMapping("/two")\n  void two() {\n}\n  public static final String NAME = "topic-{n}";\n}\n'


@_query("""WITH f AS (SELECT 'src/F' || n_nationkey || '.java' AS file, n_nationkey AS n FROM nation)
SELECT file, '/api/' || n || '/one' AS path, 'GET' AS http_method, 'C' || n || '.one' AS handler, 4::INT AS line FROM f
UNION ALL SELECT file, '/api/' || n || '/two', 'POST', 'C' || n || '.two', 7 FROM f""")
def extract_annotated(spark: SparkSession, sf: str) -> DataFrame:
    rule = {"name": "e", "match": {"files": ["*.java"], "strategy": "annotation-method", "class_annotations": ["@RestController"], "base_path_annotation": "@RequestMapping", "method_annotations": {"Get": "GET", "Post": "POST"}}, "emit": {"label": "Endpoint", "values": {"path": "{{path}}", "http_method": "{{http_method}}", "handler": "{{class_name}}.{{method_name}}"}}}
    return extract.extract(_nations(spark, sf, ".java", _said(_JAVA, n="n_nationkey")), [rule]).select("file", "path", "http_method", "handler", "line")


@_query(r"""WITH lines AS (SELECT doc_id || '.' || lang AS file, generate_subscripts(p, 1) AS line, unnest(p) AS text FROM (SELECT *, string_split(text, chr(10)) AS p FROM documents))
SELECT file, line::INT AS line, unnest(regexp_extract_all(text, 'Licensed under ([A-Za-z0-9 .-]+)', 1)) AS name FROM lines""")
def extract_whole_file(spark: SparkSession, sf: str) -> DataFrame:
    rule = {"name": "l", "match": {"strategy": "regex", "patterns": [{"regex": r"Licensed under (?P<name>[A-Za-z0-9 .-]+)"}]}, "emit": {"label": "License", "values": {"name": "{{name}}"}}}
    return extract.extract(estate.files(spark, sf), [rule]).select("file", "line", "name")


@_query("""SELECT 'P:' || n_nationkey AS id, CASE n_nationkey % 3 WHEN 2 THEN NULL ELSE 'topic-' || n_nationkey END AS topic FROM nation""")
def constants_substituted(spark: SparkSession, sf: str) -> DataFrame:
    """Producers that name a constant by its full name, by its own, or one that is not there."""
    n = F.col("n_nationkey")
    const = F.when(n % 3 == 0, F.concat(F.lit("C"), n, F.lit(".NAME"))).when(n % 3 == 1, "NAME").otherwise("OTHER")
    nodes = as_nodes(estate.table(spark, sf, "nation").select(F.concat(F.lit("P:"), n).alias("id"), F.lit("Producer").alias("label"), F.lit("web").alias("service"), F.concat(F.lit("src/F"), n, F.lit(".java")).alias("file"), F.create_map(F.lit("topic_const"), const).alias("props")))
    constants = extract.string_constants(_nations(spark, sf, ".java", _said(_JAVA, n="n_nationkey")))
    return resolve.substitute_constants(nodes, constants, {"topic_const": "topic"}).select("id", "topic")


@_query("SELECT 'Customer:' || c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 'second' ELSE 'first' END AS status FROM customer")
def hints_applied(spark: SparkSession, sf: str) -> DataFrame:
    hints = [{"match": {"label": "Customer"}, "set": {"status": "first"}}, {"match": {"label": "Customer", "segment": "BUILDING"}, "set": {"status": "second"}}, {"match": {"label": "Part"}, "set": {"status": "third"}}]
    return resolve.apply_hints(estate.nodes(spark, sf).where("label = 'Customer'"), hints).select("id", "status")


@_query("SELECT 'Q:' || n_nationkey AS src, 'C:' || n_nationkey AS dst, CASE n_nationkey % 2 WHEN 0 THEN 'high' ELSE 'medium' END AS confidence FROM nation WHERE n_regionkey <> 1 OR n_nationkey % 2 = 0")
def topics_by_setting(spark: SparkSession, sf: str) -> DataFrame:
    """Producers with a literal topic, or a variable that a setting of their service ends with; in one region the settings are missing."""
    n, odd = F.col("n_nationkey"), F.col("n_nationkey") % 2 == 1
    nation = estate.table(spark, sf, "nation")
    name = lambda p: F.concat(F.lit(p), n)
    made = nation.select(name("Q:").alias("id"), F.lit("Producer").alias("label"), name("s").alias("service"), F.lit("producer").alias("message_role"), F.when(~odd, name("t")).alias("topic"), F.when(odd, name("var")).alias("topic_var"))
    read = nation.select(name("C:").alias("id"), F.lit("Consumer").alias("label"), F.lit("sink").alias("service"), F.lit("consumer").alias("message_role"), F.array(name("t")).alias("topics"))
    set_ = nation.where("n_regionkey <> 1").select(name("S:").alias("id"), F.lit("ConfigProperty").alias("label"), name("s").alias("service"), F.create_map(F.lit("key"), F.concat(F.lit("app."), name("var")), F.lit("default_value"), name("t")).alias("props"), n.cast("long").alias("ordinal"))
    nodes = as_nodes(made).unionByName(as_nodes(read)).unionByName(as_nodes(set_))
    return link.producers_to_consumers(nodes)[0].select("src", "dst", "confidence")


_USED = r"""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS x FROM documents),
u AS (SELECT 'annotation' AS what, unnest(regexp_extract_all(x, '@\w+')) AS term FROM l UNION ALL SELECT 'call', unnest(regexp_extract_all(x, '\.(\w+)\s*\(', 1)) FROM l
  UNION ALL SELECT 'import', string_split(regexp_extract(x, '^\s*import\s+([\w.]+)', 1), '.')[1] FROM l WHERE regexp_matches(x, '^\s*import\s+[\w.]+')),
c AS (SELECT what, term, count(*) AS n FROM u GROUP BY what, term) """


@_query(_USED + "SELECT * FROM c")
def code_usage(spark: SparkSession, sf: str) -> DataFrame:
    return discover.usage(estate.files(spark, sf))


@_query("""SELECT 'spring.http_clients' AS section, 'tokens' AS key, '.' || c || '(' AS value FROM (VALUES ('retrieve'), ('Uri')) AS t(c)
UNION ALL SELECT 'spring.rest', 'controller_annotations', '@My' || regexp_replace(n_name, '\\W', '_', 'g') || 'Controller' FROM nation UNION ALL SELECT 'spring.rest', 'controller_annotations', '@RestController'
UNION ALL SELECT 'spring.message_buses', 'kafka', '@KafkaListener' UNION ALL SELECT 'javascript.express', 'app_tokens', v FROM (VALUES ('express()'), ('Router()')) AS t(v)""")
def suggested_settings(spark: SparkSession, sf: str) -> DataFrame:
    """Settings suggested by code of nations; what a build folder or another kind of file holds counts for nothing."""
    name = F.regexp_replace("n_name", r"\W", "_")
    code = _said("import org.x.Y;\n@My{n}Controller @RestController class A { void m() { c.retrieve().Uri(x).get (); } @KafkaListener void k() {} }", n=name)
    web = F.lit("const e = require('express');\nimport y\nfoo.bar()")
    file = lambda name, content: F.struct(name.alias("file"), content.alias("content"))
    each = F.array(file(F.concat(F.lit("a/F"), "n_nationkey", F.lit(".java")), code), file(F.lit("w.js"), web), file(F.lit("build/B.java"), F.lit("@OtherController")), file(F.lit("x.txt"), F.lit("@TextController")))
    files = estate.table(spark, sf, "nation").select(F.lit("s").alias("service"), F.explode(each).alias("f")).select("service", "f.*")
    return discover.overlay(discover.usage(discover.code_files(files)))


# Readers and writers


@_query("SELECT 'Supplier:' || s_suppkey AS id, 'Supplier' AS label, s_name AS name FROM supplier UNION ALL SELECT 'Region:' || r_regionkey, 'Region', lower(replace(r_name, '_', '-')) FROM region")
def graph_written_and_read(spark: SparkSession, sf: str) -> DataFrame:
    path, g = shared_folder(spark, "graph"), estate.estate(spark, sf)
    readers.write_graph(Graph(g.nodes.where("label in ('Supplier', 'Region')"), g.edges.where("type = 'IN_REGION'")), path)
    return readers.read_graph(spark, path).nodes.select("id", "label", "name")


def _document(df: DataFrame, name: str, value: Column) -> str:
    """The path of a text file with the one row's value."""
    path = shared_folder(df.sparkSession, name)
    df.select(value.alias("value")).coalesce(1).write.text(path)
    return path


@_query("SELECT 'N' || n_nationkey AS id, 'Nation' AS label, n_name AS name, n_regionkey::VARCHAR AS region, 'R' || n_regionkey AS dst FROM nation")
def graph_json_read(spark: SparkSession, sf: str) -> DataFrame:
    nodes = F.collect_list(F.struct(F.concat(F.lit("N"), "n_nationkey").alias("id"), F.lit("Nation").alias("label"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")))
    edges = F.collect_list(F.struct(F.lit("IN").alias("type"), F.concat(F.lit("N"), "n_nationkey").alias("from"), F.concat(F.lit("R"), "n_regionkey").alias("to")))
    one = estate.table(spark, sf, "nation").agg(nodes.alias("nodes"), edges.alias("edges"))  # 25 nations
    g = readers.graph_json(spark, _document(one, "graph-json", F.to_json(F.struct("nodes", "edges"))))
    return g.nodes.select("id", "label", "name", F.col("props")["region"].alias("region")).join(g.edges.select(F.col("src").alias("id"), "dst"), "id")


@_query("""SELECT 'geo:cgc:N' || n_nationkey AS src, 'geo:cgc:N' || n_regionkey AS dst, CASE WHEN n_nationkey % 2 = 0 THEN 'CROSSES_TIER' ELSE 'USES' END AS type,
CASE WHEN n_nationkey % 3 = 0 THEN 'Endpoint' WHEN n_nationkey % 3 = 1 THEN 'Component' ELSE 'Service' END AS label FROM nation WHERE n_nationkey <> 7""")
def call_graph_read(spark: SparkSession, sf: str) -> DataFrame:
    """Functions with a path, functions without and classes; one edge names a node that is not there."""
    n = F.col("n_nationkey")
    nodes = F.collect_list(F.struct(F.concat(F.lit("N"), n).alias("id"), F.when(n % 3 == 2, "Class").otherwise("Function").alias("label"), F.col("n_name").alias("name"), F.when(n % 3 == 0, F.concat(F.lit("/p/"), n)).alias("path")))
    edges = F.collect_list(F.struct(F.concat(F.lit("N"), n).alias("from"), F.when(n == 7, "gone").otherwise(F.concat(F.lit("N"), "n_regionkey")).alias("to"), F.when(n % 2 == 0, "CallEdge").otherwise("USES").alias("type")))
    one = estate.table(spark, sf, "nation").agg(nodes.alias("nodes"), edges.alias("edges"))  # 25 nations
    g = readers.call_graph(spark, _document(one, "call-graph", F.to_json(F.struct(F.lit("geo").alias("service"), "nodes", "edges"))))
    return g.edges.select("src", "dst", "type").join(g.nodes.select(F.col("id").alias("src"), "label"), "src")


@_query("""SELECT event_id AS document, 'user-' || user_id AS service, 'svc-' || json_extract_string(props, '$.k') AS target_service,
CASE WHEN event_type <> 'purchase' THEN '/' || event_type END AS path, CASE WHEN event_type = 'purchase' THEN event_type END AS topic FROM events""")
def otlp_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Events written as trace documents, half of them plain, and read again."""
    ev, otlp, plain = _traces(spark, sf)
    texts = ev.select(F.col("event_id").alias("ordinal"), F.when(F.col("event_id") % 2 == 0, otlp).otherwise(plain).alias("value"))
    return readers.spans(texts).select(F.col("ordinal.document").alias("document"), "service", "target_service", "path", "topic")


def _traces(spark: SparkSession, sf: str) -> tuple[DataFrame, Column, Column]:
    """Events, and each as a trace document with and without resources."""
    ev = estate.table(spark, sf, "events")
    attribute = lambda k, v: F.struct(F.lit(k).alias("key"), F.struct(v.alias("stringValue")).alias("value"))
    user, target = F.concat(F.lit("user-"), "user_id"), F.concat(F.lit("svc-"), F.get_json_object("props", "$.k"))
    bought = F.col("event_type") == "purchase"
    what = F.when(bought, F.array(attribute("messaging.destination.name", F.col("event_type")))).otherwise(F.array(attribute("http.route", F.concat(F.lit("/"), "event_type"))))
    span = F.struct(F.col("event_type").alias("name"), F.concat(F.array(attribute("peer.service", target)), what).alias("attributes"))
    otlp = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(attribute("service.name", user)).alias("attributes")).alias("resource"), F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans")))
    flat = F.map_concat(F.create_map(F.lit("peer.service"), target), F.when(bought, F.create_map(F.lit("messaging.destination"), F.col("event_type"))).otherwise(F.create_map(F.lit("url.path"), F.concat(F.lit("/"), "event_type"))))
    plain = F.to_json(F.struct(user.alias("service"), F.array(F.struct(F.col("event_type").alias("name"), flat.alias("attributes"))).alias("spans")))
    return ev, otlp, plain


@_query("""WITH e AS (SELECT event_id, 'user-' || user_id AS u, 'svc-' || json_extract_string(props, '$.k') AS t, CASE WHEN event_type <> 'purchase' THEN '/' || event_type END AS path, CASE WHEN event_type = 'purchase' THEN event_type END AS topic, event_id % 3 AS kind FROM events)
SELECT event_id AS document, '0.0' AS place, u AS service, t AS target_service, path, topic FROM e WHERE kind = 0
UNION ALL SELECT event_id, '1.0', u, t, path, topic FROM e WHERE kind = 0
UNION ALL SELECT event_id, '0.0.0', u, t, path, topic FROM e WHERE kind = 1
UNION ALL SELECT event_id, '', NULL, NULL, NULL, NULL FROM e WHERE kind = 2
UNION ALL SELECT event_id, '0.0.1.0.0', u, t, path, topic FROM e WHERE kind = 2""")
def otlp_nested(spark: SparkSession, sf: str) -> DataFrame:
    """Trace documents inside lists, objects and other spans, found wherever they stand."""
    ev, otlp, plain = _traces(spark, sf)
    kind = F.col("event_id") % 3
    text = (
        F.when(kind == 0, F.concat(F.lit('[{"x":'), otlp, F.lit(',"y":"no \\"spans\\": here"},['), plain, F.lit('],{"spans":{"none":1}}]')))
        .when(kind == 1, F.concat(F.lit('{"a":{"b":['), otlp, F.lit('],"c":null}}')))
        .otherwise(F.concat(F.lit('{"spans":[{"name":"outer","z":{"deep":['), plain, F.lit("]}}]}")))
    )
    found = readers.spans(ev.select(F.col("event_id").alias("ordinal"), text.alias("value")))
    return found.select(F.col("ordinal.document").alias("document"), F.array_join("ordinal.at", ".").alias("place"), "service", "target_service", "path", "topic")


@_query("SELECT lower(replace(n_name, '_', '-')) AS host, 'svc-' || n_regionkey AS service FROM nation")
def registry_read(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark, "registry")
    lines = F.concat(F.lit("  "), "n_name", F.lit(" : 'SVC_"), F.col("n_regionkey").cast("string"), F.lit("'  # a host"))
    estate.table(spark, sf, "nation").select(F.explode(F.array(lines, F.lit("# no host"), F.lit(""))).alias("value")).write.text(path)
    return readers.service_registry(spark, path)


@_query("""SELECT 'dir-' || n_nationkey AS folder, CASE n_nationkey % 3 WHEN 0 THEN 'set-' || n_nationkey WHEN 1 THEN 'pkg-' || n_nationkey ELSE 'dir-' || n_nationkey END AS service FROM nation""")
def services_named(spark: SparkSession, sf: str) -> DataFrame:
    """Services named by their settings, by package.json, or by their folder."""
    n = F.col("n_nationkey")
    file = F.when(n % 3 == 0, "service.yaml").when(n % 3 == 1, "package.json").otherwise("x.java")
    content = F.when(n % 3 == 0, _said('# of this service\nname: "Set_{n}"\nexclude:\n  - gen/*\n', n=n)).when(n % 3 == 1, _said('{"name": "@org/Pkg_{n}"}', n=n)).otherwise("")
    files = estate.table(spark, sf, "nation").select(F.concat(F.lit("Dir_"), n).alias("folder"), file.alias("file"), content.alias("content"))
    return rules.service_names(files).withColumn("folder", text.slug(F.col("folder")))


# Reports, search and checks


@_query("""SELECT c_name || ' -PLACED-> order-' || o_orderkey AS line FROM orders JOIN customer ON o_custkey = c_custkey""")
def edge_list(spark: SparkSession, sf: str) -> DataFrame:
    g = estate.estate(spark, sf)
    return report.edge_list(Graph(g.nodes, g.edges.where("type = 'PLACED'")))


@_query("""WITH n AS (SELECT s_suppkey, lower(replace(n_name, '_', '-')) AS service FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT 'service' AS part, service AS key, count(*) AS n FROM n GROUP BY service UNION ALL SELECT 'label', 'Supplier', count(*) FROM n
UNION ALL SELECT 'type', 'IN_NATION', count(*) FROM n UNION ALL SELECT 'confidence', 'high', 2 * count(*) FROM n""")
def report_counts(spark: SparkSession, sf: str) -> DataFrame:
    g = estate.estate(spark, sf)
    return report.counts(Graph(g.nodes.where("label = 'Supplier'"), g.edges.where("type = 'IN_NATION' and src like 'Supplier:%'")))


@_query("""WITH f AS (SELECT 'Part:' || p_partkey AS id, lower(concat_ws(' ', 'Part:' || p_partkey, 'Part', 'catalog', p_name, '/api/' || lower(replace(p_brand, '#', '-')) || '/' || p_partkey, 'cgc-import', 'medium', p_brand)) AS t FROM part)
SELECT id, 'exact' AS mode FROM f WHERE contains(t, 'brand-2') ORDER BY id LIMIT 10""")
def search_any(spark: SparkSession, sf: str) -> DataFrame:
    return search.search_any(estate.estate(spark, sf), "Brand-2", label="Part").select("id", "mode")


@_query("""SELECT p_partkey, round(((string_split(p_name, ' ')[1] = 'red')::INT + 2 * list_contains(string_split(p_name, ' '), 'widget')::INT) / (sqrt(len(list_distinct(string_split(p_name, ' ')))) * sqrt(5)), 6)::DOUBLE AS likeness FROM part""")
def name_cosine(spark: SparkSession, sf: str) -> DataFrame:
    words = F.array_distinct(F.split("p_name", " "))
    own = estate.table(spark, sf, "part").select("p_partkey", F.map_from_arrays(words, F.transform(words, lambda _: F.lit(1))).alias("a"), F.create_map(F.lit("red"), F.lit(1), F.lit("widget"), F.lit(2)).alias("b"))
    return own.select("p_partkey", F.round(aggregate.cosine("a", "b"), 6).alias("likeness"))


@_query("""SELECT 'edge touches test path' AS kind, 'CROSSES_TIER ' || CASE s_suppkey % 3 WHEN 0 THEN 'src/test/A.java' ELSE '/tests/b' END AS detail FROM supplier WHERE s_suppkey % 3 <> 2""")
def test_path_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers in test files, at test paths, and elsewhere, each called once; other types of edges do not count."""
    k = F.col("s_suppkey")
    own = estate.table(spark, sf, "supplier").select(F.concat(F.lit("S:"), k).alias("id"), F.lit("Endpoint").alias("label"), F.when(k % 3 == 0, "src/test/A.java").when(k % 3 == 2, "src/main/A.java").alias("file"), F.when(k % 3 == 1, "/tests/b").alias("path"))
    edge = lambda kind: as_edges(own.select(F.lit(kind).alias("type"), F.lit("caller").alias("src"), F.col("id").alias("dst")))
    return verify.test_edges(Graph(as_nodes(own), edge("CROSSES_TIER").unionByName(edge("PLACED"))))


# Scalars


@_query(r"""SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'a' || p_partkey || ',b' WHEN 1 THEN 'one' ELSE '{unknown}' END AS topics, CASE p_partkey % 3 WHEN 0 THEN 'g' || p_size ELSE '' END AS group_id,
'v' || p_size AS object_value, CASE p_partkey % 2 WHEN 0 THEN '/ns/go' || p_size || '.do' ELSE '/abs.do' END AS action, CASE p_partkey % 3 WHEN 0 THEN 't' || p_size END AS literal, CASE p_partkey % 3 WHEN 1 THEN 'v' || p_size END AS variable,
'x' || p_size AS field, CASE p_partkey % 4 WHEN 0 THEN 'SELECT' WHEN 1 THEN 'CALL' ELSE '' END AS operation, CASE p_partkey % 3 WHEN 0 THEN 'DELETE' WHEN 1 THEN 'PUT' ELSE 'GET' END AS verb,
'/b' || p_size AS gateway, p_partkey % 2 = 0 AS is_test, p_partkey % 7 < 4 AS has_key, (2 + p_partkey % 7)::INT AS line FROM part""")
def more_scalars(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    said = lambda *options: F.element_at(F.array(*(_said(o, k=k, s="p_size") for o in options)), (k % len(options)).cast("int") + 1)
    topics = said('topics = {"a{k}", "b"}, groupId = "g{s}", x = "no"', 'topics = "one", y = "no"', "nothing")
    sent = text.sent_topic(said('q.send("t{s}", x)', "q.sendTo(v{s})", "send me"), [".send(", ".sendTo("])
    lines = F.concat(F.array(F.lit("a: 1"), F.lit("  key : 2")), F.array_repeat(F.lit("b"), (k % 7).cast("int")))
    before = F.concat(F.lit("one\n"), F.repeat(F.lit("x\n"), (k % 7).cast("int")))
    return estate.table(spark, sf, "part").select(
        k.alias("k"), F.array_join(text.extract_topics(topics), ",").alias("topics"), text.group_id(topics).alias("group_id"), text.object_string_value(said("{other: 'w', key : 'v{s}'}"), "key").alias("object_value"),
        text.action_path(F.lit("/ns/"), said("go{s}", " /abs"), F.lit(".do")).alias("action"), sent["literal"].alias("literal"), sent["variable"].alias("variable"),
        F.try_element_at(text.string_fields(said('private final String a = "w";\n String f{s} = "no"; String f{s} = "x{s}";')), _said("f{s}", s="p_size")).alias("field"),
        text.sql_operation(said("  select\t1", "Call(x)", "selected", "from a")).alias("operation"), text.infer_http_method(said("x.Delete(", "doput", "nothing")).alias("verb"),
        text.gateway_path(said("/a/b{s}/**,/other", " /a/b{s}/ "), 1).alias("gateway"), text.is_test_path(said("a/src/test/x", "a/src/main/x")).alias("is_test"),
        text.previous_key(lines, F.size(lines), "key").alias("has_key"), text.line_of_offset(F.concat(before, F.lit("rest")), F.length(before)).cast("int").alias("line"),
    )


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
