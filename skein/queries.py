"""The registered graph queries and, for each, the same in SQL over the business tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import estate, snapshots
from .functions import text
from .graph import Graph, as_nodes, materialize, version
from .operators import aggregate, clusters, dedup, extract, link, postings, resolve, search, trace, traverse, verify
from .plans import views
from .plans.cypher import PatternQuery, from_text
from .sources import readers

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def _query(sql: str | None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return keep


_NODES = """
places AS (SELECT n_nationkey, n_regionkey, lower(replace(n_name, '_', '-')) AS service, lower(replace(r_name, '_', '-')) AS region FROM nation JOIN region ON n_regionkey = r_regionkey),
nodes AS (
  SELECT 'Customer:' || c_custkey AS id, 'Customer' AS label, service, c_name AS name, '/' || region || '/' || service || '/' || c_name AS path, 'pack:crm' AS source, 'high' AS confidence, NULL AS status, c_mktsegment AS segment, NULL AS brand FROM customer JOIN places ON c_nationkey = n_nationkey
  UNION ALL SELECT 'Supplier:' || s_suppkey, 'Supplier', service, s_name, '/' || region || '/' || service || '/' || s_name, 'pack:srm', 'high', NULL, NULL, NULL FROM supplier JOIN places ON s_nationkey = n_nationkey
  UNION ALL SELECT 'Order:' || o_orderkey, 'Order', service, 'order-' || o_orderkey, NULL, 'llm:orders', CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'O' THEN 'medium' ELSE 'low' END, o_orderstatus, NULL, NULL FROM orders JOIN customer ON o_custkey = c_custkey JOIN places ON c_nationkey = n_nationkey
  UNION ALL SELECT 'Part:' || p_partkey, 'Part', 'catalog', p_name, '/api/' || lower(replace(p_brand, '#', '-')) || '/' || p_partkey, 'cgc-import', 'medium', NULL, NULL, p_brand FROM part
  UNION ALL SELECT 'Nation:' || n_nationkey, 'Nation', service, service, '/' || region || '/' || service, 'reference', 'high', NULL, NULL, NULL FROM places
  UNION ALL SELECT 'Region:' || r_regionkey, 'Region', lower(replace(r_name, '_', '-')), lower(replace(r_name, '_', '-')), '/' || lower(replace(r_name, '_', '-')), 'reference', 'high', NULL, NULL, NULL FROM region)"""
_EDGES = """
people AS (SELECT c_custkey, c_nationkey, service AS cs FROM customer JOIN places ON c_nationkey = n_nationkey),
makers AS (SELECT s_suppkey, s_nationkey, service AS ss FROM supplier JOIN places ON s_nationkey = n_nationkey),
bought AS (SELECT o_orderkey, o_custkey, cs FROM orders JOIN people ON o_custkey = c_custkey),
tiers AS (SELECT *, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS t FROM lineitem),
edges AS (
  SELECT 'PLACED' AS type, 'Customer:' || o_custkey AS src, 'Order:' || o_orderkey AS dst, cs AS from_service, cs AS to_service, 'high' AS confidence FROM bought
  UNION ALL SELECT 'CONTAINS_ITEM', 'Order:' || l_orderkey, 'Part:' || l_partkey, any_value(cs), 'catalog', ['low', 'medium', 'high'][min(t) + 1] FROM tiers JOIN bought ON l_orderkey = o_orderkey GROUP BY l_orderkey, l_partkey
  UNION ALL SELECT 'FILLED_BY', 'Order:' || l_orderkey, 'Supplier:' || l_suppkey, any_value(cs), any_value(ss), ['low', 'medium', 'high'][min(t) + 1] FROM tiers JOIN bought ON l_orderkey = o_orderkey JOIN makers ON l_suppkey = s_suppkey GROUP BY l_orderkey, l_suppkey
  UNION ALL SELECT 'IN_NATION', 'Customer:' || c_custkey, 'Nation:' || c_nationkey, cs, cs, 'high' FROM people
  UNION ALL SELECT 'IN_NATION', 'Supplier:' || s_suppkey, 'Nation:' || s_nationkey, ss, ss, 'high' FROM makers
  UNION ALL SELECT 'IN_REGION', 'Nation:' || n_nationkey, 'Region:' || n_regionkey, service, region, 'high' FROM places)"""
N, E = f"WITH {_NODES} ", f"WITH {_NODES}, {_EDGES} "


def _renamed(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.replace(".", "_") for c in df.columns))


# Pattern queries


@_query(N + "SELECT id AS c_id, segment AS c_segment FROM nodes WHERE label = 'Customer'")
def node_match(spark: SparkSession, sf: str) -> DataFrame:
    return _renamed(PatternQuery(estate.estate(spark, sf)).match("(c:Customer)").returns("c.id", "c.segment"))


@_query(E + "SELECT src AS c_id, dst AS o_id FROM edges WHERE type = 'PLACED'")
def relation_match(spark: SparkSession, sf: str) -> DataFrame:
    return _renamed(PatternQuery(estate.estate(spark, sf)).match("(c:Customer)-[p:PLACED]->(o:Order)").returns("c.id", "o.id"))


@_query(E + "SELECT c.id AS c_id, o.id AS o_id FROM edges e JOIN nodes c ON c.id = src JOIN nodes o ON o.id = dst WHERE type = 'PLACED' AND o.status = 'F'")
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return _renamed(from_text(estate.estate(spark, sf), "MATCH (c:Customer)-[p:PLACED]->(o:Order)\nWHERE o.status = 'F'\nRETURN c.id, o.id"))


@_query(E + "SELECT c.id AS c_id, o.id AS o_id FROM edges e JOIN nodes c ON c.id = src JOIN nodes o ON o.id = dst WHERE type = 'PLACED' AND c.segment LIKE 'AUTO%' AND contains(c.name, '#0000000') AND o.id LIKE '%7' AND o.confidence = 'high'")
def relation_conditions(spark: SparkSession, sf: str) -> DataFrame:
    q = PatternQuery(estate.estate(spark, sf)).match("(c:Customer)-[p:PLACED]->(o:Order)")
    return _renamed(q.where("c.segment STARTS WITH 'AUTO' AND c.name CONTAINS '#0000000' AND o.id ENDS WITH '7' AND o.confidence = 'high'").returns("c.id", "o.id"))


@_query("SELECT DISTINCT 'Customer:' || o_custkey AS c_id, 'Supplier:' || l_suppkey AS s_id, o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'")
def shared_variable(spark: SparkSession, sf: str) -> DataFrame:
    q = PatternQuery(estate.estate(spark, sf)).match("(c:Customer)-[p:PLACED]->(o:Order)").match("(o:Order)-[f:FILLED_BY]->(s:Supplier)")
    return _renamed(q.where("o.status = 'P'").returns("c.id", "s.id", "o.id")).select("c_id", "s_id", F.substring("o_id", 7, 40).cast("long").alias("o_orderkey"))


@_query(E + "SELECT dst AS n_id, src AS s_id FROM edges WHERE type = 'IN_NATION' AND src LIKE 'Supplier:%'")
def left_arrow(spark: SparkSession, sf: str) -> DataFrame:
    return _renamed(PatternQuery(estate.estate(spark, sf)).match("(n:Nation)<-[i:IN_NATION]-(s:Supplier)").returns("n.id", "s.id"))


_WALK = """
ordered AS (SELECT user_id, event_type, lead(user_id) OVER (ORDER BY ts, event_id) AS nxt FROM events),
steps AS (SELECT 'User:' || user_id AS src, 'User:' || nxt AS dst FROM ordered WHERE event_type = 'error' AND nxt IS NOT NULL)"""


@_query(f"WITH {_WALK} SELECT src AS a_id, dst AS b_id FROM steps UNION ALL SELECT dst, src FROM steps")
def undirected(spark: SparkSession, sf: str) -> DataFrame:
    return _renamed(PatternQuery(estate.walks(spark, sf)).match("(a:User)-[n:NEXT]-(b:User)").returns("a.id", "b.id"))


@_query(E + "SELECT n.id AS n_id, s.src AS s_id FROM nodes n JOIN edges s ON s.dst = n.id AND s.type = 'IN_NATION' AND s.src LIKE 'Supplier:%' WHERE n.label = 'Nation'")
def optional_some(spark: SparkSession, sf: str) -> DataFrame:
    return _renamed(PatternQuery(estate.estate(spark, sf)).match("(n:Nation)").optional_match("(n:Nation)<-[i:IN_NATION]-(s:Supplier)").returns("n.id", "s.id"))


@_query(N + "SELECT id AS r_id, NULL::VARCHAR AS s_id FROM nodes WHERE label = 'Region'")
def optional_none(spark: SparkSession, sf: str) -> DataFrame:
    return _renamed(PatternQuery(estate.estate(spark, sf)).match("(r:Region)").optional_match("(r:Region)-[i:IN_NATION]->(s:Supplier)").returns("r.id", "s.id"))


@_query(E + """SELECT c.id AS c_id, o.id AS o_id, s.dst AS s_id FROM edges e JOIN nodes c ON c.id = e.src JOIN nodes o ON o.id = e.dst JOIN edges s ON s.src = o.id AND s.type = 'FILLED_BY'
WHERE e.type = 'PLACED' AND o.confidence = 'low'""")
def clause_order(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes first, and only then the clauses that connect them: joined all the same, never crossed."""
    lines = ["MATCH (c:Customer)", "MATCH (s:Supplier)", "MATCH (o:Order)", "MATCH (o)-[f:FILLED_BY]->(s)", "MATCH (c)-[p:PLACED]->(o)", "WHERE o.confidence = 'low'", "RETURN c.id, o.id, s.id"]
    return _renamed(from_text(estate.estate(spark, sf), lines))


@_query(E + "SELECT n.id AS n_id, r.id AS r_id, e.type AS i_type FROM nodes n CROSS JOIN nodes r LEFT JOIN edges e ON e.type = 'IN_REGION' AND e.src = n.id AND e.dst = r.id WHERE n.label = 'Nation' AND r.label = 'Region'")
def clauses_apart(spark: SparkSession, sf: str) -> DataFrame:
    """What no clause connects is crossed, as asked; the optional clause then keeps each pair that is not in it."""
    q = PatternQuery(estate.estate(spark, sf)).match("(n:Nation)").match("(r:Region)").optional_match("(n:Nation)-[i:IN_REGION]->(r:Region)", strict=True)
    return _renamed(q.returns("n.id", "r.id", "i.type"))


@_query(E + "SELECT o.id AS o_id, f.dst AS s_id FROM nodes o LEFT JOIN edges f ON f.type = 'FILLED_BY' AND f.src = o.id WHERE o.label = 'Order'")
def optional_strict(spark: SparkSession, sf: str) -> DataFrame:
    """Row by row: an order without suppliers stays, although others have some."""
    q = PatternQuery(estate.estate(spark, sf)).match("(o:Order)").optional_match("(o:Order)-[f:FILLED_BY]->(s:Supplier)", strict=True)
    return _renamed(q.returns("o.id", "s.id"))


@_query(N + "SELECT r.id AS r_id, n.id AS n_id FROM nodes r LEFT JOIN nodes n ON n.label = 'Nation' WHERE r.label = 'Region'")
def optional_strict_apart(spark: SparkSession, sf: str) -> DataFrame:
    q = PatternQuery(estate.estate(spark, sf)).match("(r:Region)").optional_match("(n:Nation)", strict=True)
    return _renamed(q.returns("r.id", "n.id"))


@_query(E + "SELECT src AS o_id, dst AS s_id FROM edges WHERE type = 'FILLED_BY' AND from_service <> to_service AND confidence = 'low'")
def boolean_condition(spark: SparkSession, sf: str) -> DataFrame:
    """Booleans compare by their names."""
    q = PatternQuery(estate.estate(spark, sf)).match("(o:Order)-[f:FILLED_BY]->(s:Supplier)").where("f.cross_repo = 'True' AND f.confidence = 'low'")
    return _renamed(q.returns("o.id", "s.id"))


@_query(N + "SELECT id AS p_id, name AS p_name FROM nodes WHERE label = 'Part' AND contains(path, 'brand-1')")
def parameter_lens(spark: SparkSession, sf: str) -> DataFrame:
    return _renamed(from_text(estate.estate(spark, sf), ["MATCH (p:Part)", "WHERE p.path CONTAINS $query", "RETURN p.id, p.name"], {"query": "brand-1"}))


@_query(E + "SELECT DISTINCT s.id, s.label FROM edges e JOIN nodes s ON s.id = e.dst JOIN nodes o ON o.id = e.src WHERE e.type = 'FILLED_BY' AND o.status = 'O' UNION SELECT DISTINCT o.id, o.label FROM edges e JOIN nodes o ON o.id = e.src WHERE e.type = 'FILLED_BY' AND o.status = 'O'")
def projected_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    q = PatternQuery(estate.estate(spark, sf)).match("(o:Order)-[f:FILLED_BY]->(s:Supplier)").where("o.status = 'O'")
    return q.subgraph("o", "s", "f").nodes.select("id", "label")


# Neighbourhood


@_query(E + "SELECT type, src, dst FROM edges WHERE dst IN (SELECT id FROM nodes WHERE contains(lower(concat_ws(' ', id, label, service, name, path, source, confidence, status, segment, brand)), 'supplier#00000001'))")
def callers(spark: SparkSession, sf: str) -> DataFrame:
    return traverse.callers(estate.estate(spark, sf), "Supplier#00000001").select("type", "src", "dst")


@_query(E + "SELECT type, src, dst FROM edges WHERE src IN (SELECT id FROM nodes WHERE contains(lower(concat_ws(' ', id, label, service, name, path, source, confidence, status, segment, brand)), 'customer#00000002'))")
def callees(spark: SparkSession, sf: str) -> DataFrame:
    return traverse.callees(estate.estate(spark, sf), "Customer#00000002").select("type", "src", "dst")


@_query(E + "SELECT type, src, dst FROM edges WHERE src LIKE 'Nation:%' OR dst LIKE 'Nation:%'")
def incident_edges(spark: SparkSession, sf: str) -> DataFrame:
    g = estate.estate(spark, sf)
    return traverse.incident(g, g.nodes.where("label = 'Nation'")).select("type", "src", "dst")


@_query(E + "SELECT e.type, e.src, e.dst FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE a.confidence = 'high' AND b.confidence = 'high'")
def induced_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    g = estate.estate(spark, sf)
    return traverse.induced(g, g.nodes.where("confidence = 'high'")).select("type", "src", "dst")


def _reach(depth: int) -> str:
    return f"WITH RECURSIVE {_WALK}, hops AS (SELECT DISTINCT src, dst FROM steps), r AS (SELECT 'User:1' AS id, 0 AS d UNION SELECT dst, d + 1 FROM r JOIN hops ON src = id WHERE d < {depth}), near AS (SELECT id, min(d) AS distance FROM r GROUP BY id) "


def _walked(spark: SparkSession, sf: str, depth: int) -> tuple[Graph, DataFrame, DataFrame]:
    g = estate.walks(spark, sf)
    g = Graph(g.nodes, materialize(g.edges))
    anchors = g.nodes.where("id = 'User:1'").select("id")
    return g, anchors, traverse.flow_nodes(g, anchors, depth, ("NEXT",))


@_query(_reach(8) + "SELECT id, distance FROM near")
def flow_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return _walked(spark, sf, 8)[2]


@_query(_reach(2) + "SELECT id, distance FROM near")
def flow_limited(spark: SparkSession, sf: str) -> DataFrame:
    return _walked(spark, sf, 2)[2]


@_query(_reach(2) + "SELECT DISTINCT 'NEXT' AS type, src, dst FROM steps WHERE src IN (SELECT id FROM near WHERE distance < 2)")
def flow_edges(spark: SparkSession, sf: str) -> DataFrame:
    g, anchors, reached = _walked(spark, sf, 2)
    return traverse.flow_edges(g, anchors, reached, 2, ("NEXT",)).select("type", "src", "dst")


@_query(_reach(1) + ", e AS (SELECT DISTINCT src, dst FROM steps WHERE src IN (SELECT id FROM near WHERE distance < 1)) SELECT row_number() OVER (ORDER BY src, dst, src, dst) AS hop, src AS service, src AS node, src || ' reaches ' || dst || ' via NEXT' AS description FROM e")
def explain_flow(spark: SparkSession, sf: str) -> DataFrame:
    g, anchors, reached = _walked(spark, sf, 1)
    return traverse.explain(g, traverse.flow_edges(g, anchors, reached, 1, ("NEXT",))).withColumn("hop", F.col("hop").cast("long"))


@_query(E + "SELECT type, src, dst, confidence FROM edges WHERE from_service <> to_service")
def cross_service_edges(spark: SparkSession, sf: str) -> DataFrame:
    return traverse.cross_service(estate.estate(spark, sf)).select("type", "src", "dst", "confidence")


@_query(E + "SELECT type, src, dst, confidence FROM edges WHERE from_service <> to_service AND type = 'FILLED_BY' AND confidence = 'high'")
def cross_service_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return traverse.cross_service(estate.estate(spark, sf), {"type": "FILLED_BY", "confidence": "high", "src": None}).select("type", "src", "dst", "confidence")


@_query(N + "SELECT id, path FROM nodes WHERE label = 'Part' AND service = 'catalog' AND contains(path, '/brand-2/')")
def endpoints_in_service(spark: SparkSession, sf: str) -> DataFrame:
    return traverse.endpoints_in_service(estate.estate(spark, sf), "catalog", "/brand-2/", "Part").select("id", "path")


# Topics and linkers

_MSG = """
places AS (SELECT n_nationkey, lower(replace(n_name, '_', '-')) AS service FROM nation JOIN region ON n_regionkey = r_regionkey),
topics AS (SELECT p_partkey, p_brand || '/' || p_type || '/' || p_size AS topic FROM part),
dearest AS (SELECT l_suppkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC) AS rn FROM lineitem) WHERE rn = 1),
producers AS (SELECT 'Producer:' || s_suppkey AS id, service, topic FROM dearest JOIN topics ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN places ON s_nationkey = n_nationkey),
largest AS (SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1),
consumers AS (SELECT DISTINCT 'Consumer:' || c_custkey AS id, service, topic FROM largest JOIN lineitem ON l_orderkey = o_orderkey JOIN topics ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey JOIN places ON c_nationkey = n_nationkey),
links AS (SELECT p.id AS src, c.id AS dst, p.service AS from_service, c.service AS to_service, topic FROM producers p JOIN consumers c USING (topic) WHERE p.service <> c.service)"""


def _linked(spark: SparkSession, sf: str) -> Graph:
    nodes = materialize(estate.messages(spark, sf))
    return Graph(nodes, link.producers_to_consumers(nodes)[0])


_TOPICS = f"""WITH {_MSG}, sides AS (SELECT topic, service AS p, NULL AS c FROM producers UNION ALL SELECT topic, NULL, service FROM consumers)
SELECT s.topic, 'parts' AS bus, coalesce(string_agg(DISTINCT p, ',' ORDER BY p), '') AS producers, coalesce(string_agg(DISTINCT c, ',' ORDER BY c), '') AS consumers, coalesce(any_value(n), 0)::BIGINT AS n_links
FROM sides s LEFT JOIN (SELECT topic, count(*) AS n FROM links GROUP BY topic) k USING (topic) GROUP BY s.topic"""


@_query(_TOPICS)
def topic_groups(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.topics(_linked(spark, sf)).withColumns({c: F.array_join(c, ",") for c in ("producers", "consumers")})


@_query("""WITH k AS (SELECT p_partkey AS o, 's' || p_size AS service, 'app.' || lower(p_brand) || '.topic' || p_partkey AS key FROM part),
vars AS (SELECT 'Q:' || o AS id, service, CASE WHEN o % 5 > 0 THEN key[-(1 + o % 9):] END AS var, o FROM k),
met AS (SELECT id, arg_min('v' || k.o, k.o) AS value FROM vars JOIN k ON k.service = vars.service AND ends_with(key, var) AND k.o % 3 > 0 GROUP BY id)
SELECT id, CASE WHEN vars.o % 5 = 0 THEN 'literal' ELSE coalesce(value, '{unknown}') END AS resolved FROM vars LEFT JOIN met USING (id)""")
def topics_by_suffix(spark: SparkSession, sf: str) -> DataFrame:
    """Producers whose variable is an ending, of one to nine characters, of settings' keys: many keys of a service share the short ones, and some have none."""
    part, o = estate.table(spark, sf, "part"), F.col("p_partkey")
    key = F.concat(F.lit("app."), F.lower("p_brand"), F.lit(".topic"), o)
    service = F.concat(F.lit("s"), "p_size")
    var = F.expr("right(key, 1 + p_partkey % 9)")
    made = part.withColumn("key", key).select(F.concat(F.lit("Q:"), o).alias("id"), service.alias("service"), F.lit("producer").alias("message_role"), F.when(o % 5 == 0, "literal").alias("topic"), F.when(o % 5 > 0, var).alias("topic_var"), o.alias("ordinal"))
    kept = part.where(o % 3 > 0).select(F.concat(F.lit("C:"), o).alias("id"), F.lit("ConfigProperty").alias("label"), service.alias("service"), F.create_map(F.lit("key"), key, F.lit("default_value"), F.concat(F.lit("v"), o)).alias("props"), o.alias("ordinal"))
    return link.resolved_topics(as_nodes(made).unionByName(as_nodes(kept))).select("id", "resolved")


@_query(f"SELECT * FROM ({_TOPICS}) WHERE list_contains(string_split(consumers, ','), 'nation-3')")
def topic_groups_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.topics(_linked(spark, sf), consumer_service="nation-3").withColumns({c: F.array_join(c, ",") for c in ("producers", "consumers")})


@_query(f"WITH {_MSG} SELECT 'MESSAGE_DELIVERS' AS type, src, dst, from_service, to_service, 'high' AS confidence FROM links")
def producer_consumer_links(spark: SparkSession, sf: str) -> DataFrame:
    return link.producers_to_consumers(estate.messages(spark, sf))[0].select("type", "src", "dst", "from_service", "to_service", "confidence")


@_query(f"WITH {_MSG} SELECT id AS node_id, service, topic AS what FROM producers WHERE topic NOT IN (SELECT topic FROM consumers)")
def unresolved_producers(spark: SparkSession, sf: str) -> DataFrame:
    return link.producers_to_consumers(estate.messages(spark, sf))[1].select("node_id", "service", "what")


_CALLS = r"""
seen AS (SELECT page_id, lower(regexp_extract(url, '^(?:https?://)?([^/?#]*)', 1)) AS host, regexp_extract(url, '^(?:https?://)?[^/?#]*(/[^?#]*)', 1) AS path FROM pages),
calls AS (SELECT 'Call:' || page_id AS src, host, '/' || trim(regexp_replace(path, '\{[^}]*\}', '{}', 'g'), '/') AS spot FROM seen),
points AS (SELECT 'Endpoint:' || page_id AS id, host, page_id, '/' || trim(regexp_replace(path, '\{[^}]*\}', '{}', 'g'), '/') AS spot FROM (SELECT *, row_number() OVER (PARTITION BY host, length(path) ORDER BY page_id) AS rn FROM seen) WHERE rn = 1),
exact AS (SELECT host, spot, arg_max(id, page_id) AS id FROM points GROUP BY host, spot),
spare AS (SELECT host, arg_min(id, page_id) AS id FROM points GROUP BY host)"""


@_query(f"WITH {_CALLS} SELECT c.src, coalesce(e.id, s.id) AS dst, CASE WHEN c.host LIKE '%.com' THEN 'high' ELSE 'medium' END AS confidence FROM calls c LEFT JOIN exact e ON c.host = e.host AND c.spot = e.spot LEFT JOIN spare s ON c.host = s.host WHERE c.host LIKE '%.com' OR c.host LIKE '%.org'")
def host_links(spark: SparkSession, sf: str) -> DataFrame:
    return link.calls_to_endpoints(*estate.calls(spark, sf))[0].select("src", "dst", "confidence")


@_query(f"WITH {_CALLS} SELECT src AS node_id, host AS what FROM calls WHERE NOT (host LIKE '%.com' OR host LIKE '%.org')")
def unresolved_hosts(spark: SparkSession, sf: str) -> DataFrame:
    return link.calls_to_endpoints(*estate.calls(spark, sf))[1].select("node_id", "what")


def _injection_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Orders' priorities ask for components named after parts' brands; suppliers offer them under their nations."""
    t = lambda n: estate.table(spark, sf, n)
    from .graph import as_nodes

    ask = t("part").select(F.concat(F.lit("Inj:"), "p_partkey").alias("id"), F.lit("Injection").alias("label"), F.concat(F.lit("nation-"), "p_size").alias("service"), F.create_map(F.lit("injected_type"), F.concat(F.lit("org.shop."), "p_type")).alias("props"), F.col("p_partkey").alias("ordinal"))
    offer = t("supplier").select(F.concat(F.lit("Comp:"), "s_suppkey").alias("id"), F.lit("Component").alias("label"), F.concat(F.lit("nation-"), "s_nationkey").alias("service"), F.element_at(F.array(*map(F.lit, ("SMALL", "com.acme.LARGE", "org.shop.PROMO", "MEDIUM"))), (F.col("s_nationkey") % 4 + 1).cast("int")).alias("name"), F.col("s_suppkey").alias("ordinal"))
    return as_nodes(ask).unionByName(as_nodes(offer))


_INJ = """WITH ask AS (SELECT 'Inj:' || p_partkey AS id, 'nation-' || p_size AS service, 'org.shop.' || p_type AS wanted, p_type AS leaf FROM part),
offer AS (SELECT 'Comp:' || s_suppkey AS id, 'nation-' || s_nationkey AS service, ['SMALL', 'com.acme.LARGE', 'org.shop.PROMO', 'MEDIUM'][s_nationkey % 4 + 1] AS name, s_suppkey AS o FROM supplier),
named AS (SELECT id, service, o, name AS n FROM offer UNION SELECT id, service, o, string_split(name, '.')[-1] FROM offer),
met AS (SELECT a.id AS src, k.id AS dst, row_number() OVER (PARTITION BY a.id ORDER BY CASE WHEN k.n = a.wanted THEN 0 ELSE 1 END, CASE WHEN k.service = a.service THEN 0 ELSE 1 END, k.o) AS rn FROM ask a JOIN named k ON k.n = a.wanted OR k.n = a.leaf)
"""


@_query(_INJ + "SELECT 'INJECTS' AS type, src, dst FROM met WHERE rn = 1")
def preferred_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return link.injections(_injection_nodes(spark, sf))[0].select("type", "src", "dst")


@_query(_INJ + "SELECT id AS node_id, wanted AS what FROM ask WHERE id NOT IN (SELECT src FROM met)")
def unresolved_injections(spark: SparkSession, sf: str) -> DataFrame:
    return link.injections(_injection_nodes(spark, sf))[1].select("node_id", "what")


@_query("""WITH p AS (SELECT 'P:' || s_suppkey AS src, 'shop.Nation' || s_nationkey AS t FROM supplier),
c AS (SELECT 'C:' || c_custkey AS dst, CASE WHEN c_mktsegment = 'BUILDING' THEN 'shop.' ELSE '' END || 'Nation' || c_nationkey AS t FROM customer),
exact AS (SELECT src, dst FROM p JOIN c USING (t) UNION ALL SELECT src, dst FROM p JOIN c ON string_split(c.t, '.')[-1] = p.t AND c.t <> p.t)
SELECT 'EVENT_DELIVERS' AS type, src, dst FROM exact UNION ALL SELECT 'EVENT_DELIVERS', src, dst FROM p JOIN c ON string_split(p.t, '.')[-1] = string_split(c.t, '.')[-1] WHERE src NOT IN (SELECT src FROM exact)""")
def event_links(spark: SparkSession, sf: str) -> DataFrame:
    from .graph import as_nodes

    t = lambda n: estate.table(spark, sf, n)
    kind = lambda c: F.create_map(F.lit("event_type"), c).alias("props")
    p = t("supplier").select(F.concat(F.lit("P:"), "s_suppkey").alias("id"), F.lit("EventProducer").alias("label"), F.lit("a").alias("service"), kind(F.concat(F.lit("shop.Nation"), "s_nationkey")))
    c = t("customer").select(F.concat(F.lit("C:"), "c_custkey").alias("id"), F.lit("EventConsumer").alias("label"), F.lit("b").alias("service"), kind(F.concat(F.when(F.col("c_mktsegment") == "BUILDING", "shop.").otherwise(""), F.lit("Nation"), "c_nationkey")))
    return link.events(as_nodes(p).unionByName(as_nodes(c)))[0].select("type", "src", "dst")


@_query("""WITH rel AS (SELECT 'Rel:' || o_orderkey AS id, 'shop.N' || (o_custkey % 30) AS owner, 'List<shop.N' || (o_orderkey % 30) || '>' AS target FROM orders),
ent AS (SELECT 'Ent:' || n_nationkey AS id, 'N' || n_nationkey AS name FROM nation)
SELECT DISTINCT 'RELATES_TO' AS type, a.id AS src, b.id AS dst FROM rel JOIN ent a ON string_split(owner, '.')[-1] = a.name JOIN ent b ON regexp_extract(target, 'N[0-9]+', 0) = b.name""")
def entity_relations(spark: SparkSession, sf: str) -> DataFrame:
    from .graph import as_nodes

    t = lambda n: estate.table(spark, sf, n)
    rel = t("orders").select(F.concat(F.lit("Rel:"), "o_orderkey").alias("id"), F.lit("EntityRelation").alias("label"), F.lit("a").alias("service"), F.create_map(F.lit("owner_class"), F.concat(F.lit("shop.N"), F.col("o_custkey") % 30), F.lit("target_type"), F.concat(F.lit("List<shop.N"), F.col("o_orderkey") % 30, F.lit(">"))).alias("props"))
    ent = t("nation").select(F.concat(F.lit("Ent:"), "n_nationkey").alias("id"), F.lit("Entity").alias("label"), F.lit("b").alias("service"), F.concat(F.lit("N"), "n_nationkey").alias("name"), F.col("n_nationkey").cast("long").alias("ordinal"))
    return link.entity_relations(as_nodes(rel).unionByName(as_nodes(ent)))[0].select("type", "src", "dst").distinct()


@_query("""WITH par AS (SELECT 'Par:' || c_custkey AS dst, 'nation-' || c_nationkey AS service, 'Shop.m' || c_nationkey AS handler FROM customer),
ep AS (SELECT 'Ep:' || s_suppkey AS src, 'nation-' || (s_nationkey % 7) AS service, 'Shop.m' || s_nationkey AS handler FROM supplier),
same AS (SELECT src, dst FROM par JOIN ep USING (service, handler))
SELECT 'HAS_PARAM' AS type, src, dst FROM same UNION ALL SELECT 'HAS_PARAM', src, dst FROM par JOIN ep USING (handler) WHERE dst NOT IN (SELECT dst FROM same)""")
def endpoint_params(spark: SparkSession, sf: str) -> DataFrame:
    from .graph import as_nodes

    t = lambda n: estate.table(spark, sf, n)
    par = t("customer").select(F.concat(F.lit("Par:"), "c_custkey").alias("id"), F.lit("EndpointParam").alias("label"), F.concat(F.lit("nation-"), "c_nationkey").alias("service"), F.create_map(F.lit("owner_class"), F.lit("Shop"), F.lit("owner_method"), F.concat(F.lit("m"), "c_nationkey")).alias("props"))
    ep = t("supplier").select(F.concat(F.lit("Ep:"), "s_suppkey").alias("id"), F.lit("Endpoint").alias("label"), F.concat(F.lit("nation-"), F.col("s_nationkey") % 7).alias("service"), F.concat(F.lit("Shop.m"), "s_nationkey").alias("handler"))
    return link.endpoint_params(as_nodes(par).unionByName(as_nodes(ep)))[0].select("type", "src", "dst")


# Counts


_COVER = """WITH n AS (SELECT d.source AS service, CASE WHEN quality IS NULL THEN 'llm' ELSE 'pack' END AS family, CASE WHEN quality IS NULL THEN 'low' WHEN toxic = 1 THEN 'low' WHEN quality = 1 THEN 'high' ELSE 'medium' END AS tier FROM documents d LEFT JOIN labels USING (doc_id)),
f AS (SELECT service, family, count(*) AS k FROM n GROUP BY ALL), t AS (SELECT service, tier, count(*) AS k FROM n GROUP BY ALL)
SELECT service, total_nodes, sources, confidences, round(pack / total_nodes, 4)::DOUBLE AS pack_coverage_ratio, round(llm / total_nodes, 4)::DOUBLE AS llm_ratio FROM
(SELECT service, sum(k)::BIGINT AS total_nodes, string_agg(family || ':' || k, ',' ORDER BY family) AS sources, (sum(k) FILTER (family = 'pack'))::DOUBLE AS pack, (sum(k) FILTER (family = 'llm'))::DOUBLE AS llm FROM f GROUP BY service)
JOIN (SELECT service, string_agg(tier || ':' || k, ',' ORDER BY tier) AS confidences FROM t GROUP BY service) USING (service)"""


@_query(_COVER)
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.coverage(estate.labelled(spark, sf)).drop("below_threshold")


@_query(f"SELECT service FROM ({_COVER}) WHERE pack_coverage_ratio < 0.4")
def coverage_below(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.coverage(estate.labelled(spark, sf), 0.4).where("below_threshold").select("service")


@_query(E + "SELECT count(*) FILTER (confidence = 'high') AS high, count(*) FILTER (confidence = 'medium') AS medium, count(*) FILTER (confidence = 'low') AS low FROM (SELECT confidence FROM nodes UNION ALL SELECT confidence FROM edges)")
def confidence_summary(spark: SparkSession, sf: str) -> DataFrame:
    g = estate.estate(spark, sf)
    return aggregate.confidence_summary(g.nodes, g.edges)


@_query(f"WITH {_MSG} SELECT count(*) AS n_edges, 0::BIGINT AS n_cross_repo_http, 0::BIGINT AS n_kafka_deliveries, count(*) AS n_message_deliveries FROM links")
def edge_stats(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.edge_stats(_linked(spark, sf).edges)


@_query(N + "SELECT count(*) AS n_nodes, count(DISTINCT service) AS n_services, string_agg(DISTINCT service, ',' ORDER BY service) AS services FROM nodes")
def result_stats(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.result_stats(estate.nodes(spark, sf))


@_query(E + "SELECT service, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT from_service AS service, 1 AS o, 0 AS i FROM edges UNION ALL SELECT to_service, 0, 1 FROM edges) GROUP BY service")
def service_degrees(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.service_degrees(estate.estate(spark, sf))


@_query(E + "SELECT service, count(*) AS risk FROM (SELECT from_service AS service FROM edges WHERE from_service <> to_service AND confidence <> 'high' UNION ALL SELECT to_service FROM edges WHERE from_service <> to_service AND confidence <> 'high') GROUP BY service")
def cross_service_risk(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.cross_service_weights(estate.estate(spark, sf))


# Views


@_query(N + "SELECT id, service, path FROM nodes WHERE label = 'Customer' AND segment = 'BUILDING' AND service = 'nation-4'")
def view_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return views.run_view(estate.estate(spark, sf), {"kind": "nodes", "label": "Customer", "where": {"segment": "$segment", "name": None, "brand": "$brand"}, "sort": ["service", "path"]}, {"segment": "BUILDING", "service": "nation-4"}).select("id", "service", "path")


@_query(E + "SELECT type, src, dst FROM edges WHERE type = 'FILLED_BY' AND from_service <> to_service AND confidence = 'medium'")
def view_edges(spark: SparkSession, sf: str) -> DataFrame:
    return views.run_view(estate.estate(spark, sf), {"kind": "edges", "cross_repo": True, "where": {"confidence": "medium"}, "sort": ["from", "to"]}, {"type": "FILLED_BY"}).select("type", "src", "dst")


@_query(E + "SELECT p.brand AS group_key, string_agg(DISTINCT o.service, ',' ORDER BY o.service) AS buyers, string_agg(DISTINCT p.name, ',' ORDER BY p.name) AS parts FROM edges e JOIN nodes p ON p.id = e.dst JOIN nodes o ON o.id = e.src WHERE e.type = 'CONTAINS_ITEM' GROUP BY p.brand")
def view_groups(spark: SparkSession, sf: str) -> DataFrame:
    view = {"kind": "group_edges", "edge_type": "CONTAINS_ITEM", "group_by": {"side": "to", "property": "brand"}, "fields": {"buyers": {"side": "from", "property": "service"}, "parts": {"side": "to", "property": "name"}}}
    return views.run_view(estate.estate(spark, sf), view).withColumns({c: F.array_join(c, ",") for c in ("buyers", "parts")})


# Dedup


_SITES = "SELECT 'Site:' || event_id AS id, min(event_id) OVER w AS first, count(*) OVER w AS n, event_id FROM events WINDOW w AS (PARTITION BY user_id, event_type, hour(ts))"


@_query(f"SELECT id, CASE WHEN n > 1 THEN n END AS duplicate_count FROM ({_SITES}) WHERE event_id = first")
def call_site_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.call_sites(estate.sites(spark, sf)).nodes.select("id", "duplicate_count")


@_query(f"SELECT 'USED_BY' AS type, id AS src FROM ({_SITES}) WHERE event_id = first")
def call_site_edges(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.call_sites(estate.sites(spark, sf)).edges.select("type", "src")


@_query("SELECT 'BUYS' AS type, 'Order:' || l_orderkey AS src, 'Part:' || l_partkey AS dst, arg_min(l_returnflag, row(l_shipdate, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_returnflag)) AS confidence FROM lineitem GROUP BY l_orderkey, l_partkey")
def edge_dedup(spark: SparkSession, sf: str) -> DataFrame:
    lines = estate.table(spark, sf, "lineitem")
    own = lines.select(F.lit("BUYS").alias("type"), F.concat(F.lit("Order:"), "l_orderkey").alias("src"), F.concat(F.lit("Part:"), "l_partkey").alias("dst"), F.col("l_returnflag").alias("confidence"), F.struct("l_shipdate", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag").alias("at"))
    return dedup.edges_once(own, "at").select("type", "src", "dst", "confidence")


# Extraction


_RULES = [
    {"name": "license", "match": {"strategy": "regex", "patterns": [{"regex": r"Licensed under (?P<name>[A-Za-z0-9 .-]+)", "per_line": True}]}, "emit": {"label": "License", "source": "pack:license", "values": {"name": "{{name}}", "kind": "{{missing|text}}"}}},
    {"name": "phone", "match": {"strategy": "token-line", "tokens": ["+1 (", "555-"], "extract": r"(?P<number>\d{3}-\d{4})", "files": ["*.en", "*.fr"]}, "emit": {"label": "Phone", "source": "pack:phone", "confidence": "medium", "values": {"name": "{{number}}"}}},
]
_LINES = "lines AS (SELECT source AS service, doc_id || '.' || lang AS file, lang, generate_subscripts(p, 1) AS line, unnest(p) AS text FROM (SELECT *, string_split(text, chr(10)) AS p FROM documents))"


@_query(rf"WITH {_LINES} SELECT service, file, line::INT AS line, regexp_extract(text, 'Licensed under ([A-Za-z0-9 .-]+)', 1) AS name, 'text' AS kind FROM lines WHERE regexp_matches(text, 'Licensed under [A-Za-z0-9 .-]+')")
def extract_lines(spark: SparkSession, sf: str) -> DataFrame:
    return extract.extract(estate.files(spark, sf), _RULES[:1]).select("service", "file", "line", "name", "kind")


@_query(rf"WITH {_LINES} SELECT service, file, line::INT AS line, regexp_extract(text, '[0-9]{{3}}-[0-9]{{4}}') AS name FROM lines WHERE lang IN ('en', 'fr') AND (contains(text, '+1 (') OR contains(text, '555-')) AND regexp_matches(text, '[0-9]{{3}}-[0-9]{{4}}')")
def extract_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return extract.extract(estate.files(spark, sf), _RULES[1:]).select("service", "file", "line", "name")


@_query("WITH p AS (SELECT page_id || '.html' AS file, string_split(html, '<h1>') AS s FROM pages) SELECT file, trim(regexp_extract(s[2], '(?s)^(.*?)</h1>', 1)) AS name, (length(s[1]) - length(replace(s[1], chr(10), '')) + 1)::INT AS line FROM p WHERE len(s) > 1")
def extract_markup(spark: SparkSession, sf: str) -> DataFrame:
    rule = {"name": "h1", "match": {"strategy": "xml-element", "tag": "h1", "files": ["*.html"]}, "emit": {"label": "Heading", "source": "pack:h1", "values": {"name": "{{body}}"}}}
    return extract.extract(estate.markup(spark, sf), [rule]).select("file", "name", "line")


@_query("""SELECT id, 'AUTO' AS status, brand_path AS path, kind FROM (SELECT 'Part:' || p_partkey AS id, NULL AS status, '/' || regexp_extract(p_brand, '([0-9]+)$', 1) AS brand_path, CASE WHEN regexp_matches(p_name, '^(red|blue) ') THEN 'colour:' || regexp_extract(p_name, '^(red|blue) ', 1) ELSE 'any' END AS kind FROM part WHERE regexp_matches(p_brand, '[0-9]+$'))""")
def resolve_rules(spark: SparkSession, sf: str) -> DataFrame:
    nodes = estate.nodes(spark, sf).where("label = 'Part'").withColumns({"path": F.lit(None).cast("string"), "kind": F.lit("")})
    rules = [
        {"match": {"label": "Part", "field": "brand", "pattern": r"(?P<no>\d+)$"}, "set": {"path": "/{{no}}", "status": "AUTO"}},
        {"match": {"label": "Part", "field": "name", "pattern": r"^(?P<c>red|blue) ", "where": {"status": "AUTO"}}, "set": {"kind": "colour:{{c}}", "path": "never"}},
        {"match": {"label": "Part", "field": "status", "pattern": "AUTO"}, "set": {"kind": "{{none|any}}"}},
    ]
    return resolve.resolve(nodes, rules).select("id", "status", "path", "kind")


@_query("""WITH p AS (SELECT p_partkey, regexp_extract(p_brand, '([0-9]+)$', 1) AS b FROM part)
SELECT 'Part:' || p_partkey AS id, 'k' || b AS kind, 'row-' || b AS path, CASE WHEN b LIKE '%3' THEN 'third' WHEN b LIKE '1%' THEN 'teens' ELSE '' END AS topic, CASE WHEN b LIKE '%3' THEN 'T' WHEN b LIKE '2%' THEN 'late' END AS status FROM p
UNION ALL SELECT 'Supplier:' || s_suppkey, 's' || right(s_suppkey::VARCHAR, 1), 'sup', '', NULL FROM supplier""")
def resolve_many_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Eighty rules of two labels in three layers: what brands say, what follows from that, and what follows from both."""
    nodes = estate.nodes(spark, sf).where("label in ('Part', 'Supplier')").withColumns({"path": F.lit(None).cast("string"), "kind": F.lit(""), "topic": F.lit(""), "status": F.lit(None).cast("string")})
    rule = lambda label, field, pattern, set_, **where: {"match": {"label": label, "from": field, "patterns": [{"regex": pattern}], "where": where}, "set": set_}
    rules = [rule("Part", "brand", rf"#(?P<b>{i})$", {"kind": "k{{b}}"}) for i in range(26)] + [rule("Part", "kind", rf"^k(?P<a>{i})$", {"path": "row-{{a}}"}) for i in range(26)]
    rules += [rule("Part", "path", "3$", {"topic": "third", "status": "{{none|T}}"}), rule("Part", "path", "-1", {"topic": "teens", "kind": "never"}), rule("Part", "path", "^row-2", {"status": "late"}), rule("Part", "path", "^row", {"topic": "never"}, status="never")]
    rules += [rule("Supplier", "id", rf"(?P<d>{i})$", {"kind": "s{{d}}"}) for i in range(10)] + [rule("Supplier", "kind", rf"^s{i}$", {"path": "sup"}) for i in range(10)]
    return resolve.resolve(nodes, rules).select("id", "kind", "path", "topic", "status")


@_query("""WITH t AS (SELECT source || '' AS s, doc_id || '.' || lang AS file, unnest(regexp_extract_all(text, '[a-z]{5,}')) AS term FROM documents)
SELECT term, count(*) AS n FROM t GROUP BY term ORDER BY n DESC, min(file), term LIMIT 30""")
def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.vocabulary(estate.files(spark, sf), "[a-z]{5,}", 30, 0)


# Search


_FIELDS = "SELECT *, lower(coalesce(path, '')) AS f1, lower(coalesce(name, '')) AS f2, lower(coalesce(service, '')) AS f3, lower(label) AS f4, lower(id) AS f5 FROM nodes"


@_query(N + f", f AS ({_FIELDS}), s AS (SELECT id, 50.0 * contains(f1, 'brand-25')::INT + 30 * contains(f2, 'brand-25')::INT + 20 * contains(f3, 'brand-25')::INT + 15 * contains(f4, 'brand-25')::INT + 10 * contains(f5, 'brand-25')::INT AS score FROM f) SELECT id, round(score, 4)::DOUBLE AS score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 10")
def search_exact(spark: SparkSession, sf: str) -> DataFrame:
    return search.search(estate.estate(spark, sf), "Brand-25").select("id", "score")


@_query(_sql["callers"])
def callers_by_index(spark: SparkSession, sf: str) -> DataFrame:
    return postings.callers(postings.build(estate.estate(spark, sf)), "Supplier#00000001").select("type", "src", "dst")


@_query(_sql["callees"])
def callees_by_index(spark: SparkSession, sf: str) -> DataFrame:
    return postings.callees(postings.build(estate.estate(spark, sf)), "Customer#00000002").select("type", "src", "dst")


@_query(_sql["search_exact"])
def search_by_index(spark: SparkSession, sf: str) -> DataFrame:
    return postings.search(postings.build(estate.estate(spark, sf)), "Brand-25").select("id", "score")


def _overlap_sql(field: str, words: list[str]) -> str:
    return " + ".join(f"len(list_filter(regexp_split_to_array({field}, '[^a-z0-9]+'), lambda x: x = '{w}'))" for w in words)


@_query(N + f", f AS ({_FIELDS}), s AS (SELECT id, 5.0 * ({_overlap_sql('f1', ['red', 'car', 'widget', 'motor', 'vehicle'])}) + 3 * ({_overlap_sql('f2', ['red', 'car', 'widget', 'motor', 'vehicle'])}) + 2 * ({_overlap_sql('f3', ['red', 'car', 'widget', 'motor', 'vehicle'])}) + 1.5 * ({_overlap_sql('f4', ['red', 'car', 'widget', 'motor', 'vehicle'])}) + ({_overlap_sql('f5', ['red', 'car', 'widget', 'motor', 'vehicle'])}) AS score FROM f) SELECT id, round(score, 4)::DOUBLE AS score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 25")
def search_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return search.search(estate.estate(spark, sf), "red car widget", limit=25).select("id", "score")


# Generated lenses


@_query(N + ", r AS (SELECT path, list_filter(string_split(path, '/'), lambda x: x <> '') AS p FROM nodes WHERE label = 'Part') SELECT 'route.api.' || p[2] AS name, count(*) AS n_nodes, arg_min(path, row(length(path), path)) AS anchor FROM r GROUP BY 1")
def route_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.routes(estate.nodes(spark, sf), "Part")


@_query(E + """, w AS (SELECT DISTINCT id, label, t AS token FROM (SELECT id, label, unnest(regexp_split_to_array(lower(coalesce(path, '') || ' ' || coalesce(name, '')), '[^a-z0-9]+')) AS t FROM nodes) WHERE length(t) > 2 AND NOT regexp_matches(t, '^[0-9]+$') AND t NOT IN ('api', 'src', 'main', 'java', 'example', 'controller', 'resource', 'service', 'listener', 'kafka', 'http', 'get', 'post', 'put', 'delete', 'patch')),
own AS (SELECT token, id FROM w WHERE label IN ('Part', 'Nation')),
pulled AS (SELECT token, unnest([src, dst]) AS id FROM edges JOIN w ON w.id IN (src, dst) WHERE type = 'IN_REGION' AND token IN (SELECT token FROM own)),
m AS (SELECT token, id FROM own UNION SELECT token, id FROM pulled)
SELECT token, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM m GROUP BY token HAVING count(*) >= 2""")
def domain_clusters(spark: SparkSession, sf: str) -> DataFrame:
    found = clusters.domains(estate.estate(spark, sf), ("Part", "Nation"), "IN_REGION")
    return found.groupBy("token").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


# Traces


_SPANS = """spans AS (SELECT event_id AS o, user_id, 'user-' || user_id AS service, 'svc-' || json_extract_string(props, '$.k') AS target, event_type, event_type = 'purchase' AS bought FROM events),
first AS (SELECT event_type, arg_min(target, o) AS target FROM spans WHERE event_type <> 'view' GROUP BY event_type),
stub AS (SELECT event_type, target, target || ':otel:' || substr(sha1(target || ':' || CASE WHEN event_type = 'purchase' THEN event_type ELSE '/' || event_type END), 1, 10) AS id FROM first)"""


@_query(f"WITH {_SPANS} SELECT DISTINCT CASE WHEN bought THEN 'KAFKA_DELIVERS' ELSE 'CROSSES_TIER' END AS type, CASE WHEN event_type = 'view' THEN 'Endpoint:view' ELSE 'Component:' || user_id END AS src, stub.id AS dst, 'low' AS confidence FROM spans JOIN stub USING (event_type)")
def trace_edges(spark: SparkSession, sf: str) -> DataFrame:
    return trace.merge(estate.traced(spark, sf), estate.spans(spark, sf))[1].select("type", "src", "dst", "confidence")


@_query(f"WITH {_SPANS} SELECT id, target AS service, CASE WHEN event_type = 'purchase' THEN 'KafkaConsumer' ELSE 'Endpoint' END AS label FROM stub")
def trace_stubs(spark: SparkSession, sf: str) -> DataFrame:
    return trace.merge(estate.traced(spark, sf), estate.spans(spark, sf))[0].select("id", "service", "label")


@_query("SELECT 0::BIGINT AS n_nodes, 0::BIGINT AS n_edges")
def trace_again(spark: SparkSession, sf: str) -> DataFrame:
    spans = estate.spans(spark, sf)
    once = trace.merged(estate.traced(spark, sf), spans)
    once = Graph(materialize(once.nodes), materialize(once.edges))
    nodes, edges, _ = trace.merge(once, spans)
    return nodes.agg(F.count("*").alias("n_nodes")).crossJoin(edges.agg(F.count("*").alias("n_edges")))  # two rows of one value each


# Verification


@_query("SELECT 'duplicate node id' AS kind, 'Line:' || l_orderkey || '-' || l_linenumber AS detail FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, sf: str) -> DataFrame:
    g = estate.estate(spark, sf)
    lines = estate.table(spark, sf, "lineitem").select(F.concat(F.lit("Line:"), "l_orderkey", F.lit("-"), "l_linenumber").alias("id"))
    return verify.duplicate_ids(Graph(lines, g.edges))


@_query(E + "SELECT 'count' AS kind, 'Nation ' || count(*) || ' < 26' AS detail FROM nodes WHERE label = 'Nation' UNION ALL SELECT 'count', 'Ghost 0 < 1'")
def min_counts(spark: SparkSession, sf: str) -> DataFrame:
    return verify.min_counts(estate.estate(spark, sf), {"Nation": 26, "Region": 2, "Ghost": 1, "nodes": 100, "IN_REGION": 5})


@_query("SELECT 'missing required edge' AS kind, d AS detail FROM (VALUES ('PLACED nation-1 nation-2'), ('IN_REGION nation-1 atlantis')) AS t(d)")
def required_edges(spark: SparkSession, sf: str) -> DataFrame:
    wanted = [{"type": "PLACED", "from_service": "nation-1", "to_service": "nation-2"}, {"type": "FILLED_BY", "from_service": "nation-1"}, {"type": "IN_REGION", "from_service": "nation-1", "to_service": "atlantis"}, {"type": "IN_NATION"}]
    return verify.required_edges(estate.estate(spark, sf), wanted)


@_query(N + "SELECT 'missing service' AS kind, 'atlantis' AS detail UNION ALL SELECT 'forbidden node label', label || ' ' || id FROM nodes WHERE label = 'Region' UNION ALL SELECT 'unapproved low confidence', 'X' FROM nodes WHERE false")
def verify_suite(spark: SparkSession, sf: str) -> DataFrame:
    return verify.verify(estate.estate(spark, sf), {"services": ["nation-1", "atlantis"], "no_duplicate_node_ids": True, "no_test_path_edges": True, "forbidden_labels": ["Region"], "min_counts": {"Nation": 3}, "required_edges": [{"type": "PLACED"}]})


@_query(N + "SELECT 'unapproved low confidence' AS kind, id AS detail FROM nodes WHERE confidence = 'low' AND source <> 'reference'")
def low_confidence(spark: SparkSession, sf: str) -> DataFrame:
    g = estate.estate(spark, sf)
    return verify.unapproved_low(Graph(g.nodes, g.edges.where("type = 'PLACED'")), ["reference"])


@_query(E + """, k AS (SELECT 'n:' || id AS k FROM nodes UNION ALL SELECT 'e:' || type || ':' || src || ':' || dst FROM edges),
h AS (SELECT sha256(k) AS h FROM k),
s AS (SELECT sum(('0x' || substr(h, 1, 8))::BIGINT)::BIGINT AS a, sum(('0x' || substr(h, 9, 8))::BIGINT)::BIGINT AS b, sum(('0x' || substr(h, 17, 8))::BIGINT)::BIGINT AS c, sum(('0x' || substr(h, 25, 8))::BIGINT)::BIGINT AS d, count(*) AS n FROM h)
SELECT substr(sha256(a || ':' || b || ':' || c || ':' || d || ':' || n), 1, 16) AS graph_version FROM s""")
def graph_version(spark: SparkSession, sf: str) -> DataFrame:
    return version(estate.estate(spark, sf))


@_query(_sql["graph_version"])
def graph_version_merged(spark: SparkSession, sf: str) -> DataFrame:
    """The version of a snapshot that was written in three parts, from their digests alone."""
    g = estate.estate(spark, sf)
    nodes, edges = materialize(g.nodes), materialize(g.edges)
    part = lambda k: Graph(nodes.where(F.pmod(F.xxhash64("id"), F.lit(3)) == k), edges.where(F.pmod(F.xxhash64("dst"), F.lit(3)) == k))
    path = snapshots.create(part(0))
    snapshots.append(spark, path, part(1))
    # what is there already, and what is there twice in an addition, adds nothing
    again = part(2)
    snapshots.append(spark, path, Graph(again.nodes.unionByName(nodes), again.edges.unionByName(edges.where("type = 'PLACED'")).unionByName(again.edges)))
    return snapshots.version(spark, path)


# Scalars


@_query(r"""SELECT page_id, lower(regexp_replace(string_split(regexp_replace(lower(replace(trim(url), '_', '-')), '^https?://', ''), '/')[1], '^$', '')) AS slug,
regexp_extract(url, '^(?:https?://)?([^/?#]*)', 1) AS host, regexp_extract(url, '^(?:https?://)?[^/?#]*(/[^?#]*)', 1) AS path,
'/' || trim(regexp_extract(url, '^(?:https?://)?[^/?#]*(/[^?#]*)', 1), '/') AS normal,
'/' || array_to_string(list_filter(string_split(regexp_extract(url, '^(?:https?://)?[^/?#]*(/[^?#]*)', 1), '/'), lambda x: x <> '')[2:], '/') AS stripped,
coalesce(nullif(regexp_extract(html, '"([^"]*)"', 1), ''), '') AS first_string, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS title,
(instr(html, '<h1>') > 0) AS has_h1, regexp_extract(html, 'lang="([^"]*)"', 1) AS lang FROM pages""")
def scalar_battery(spark: SparkSession, sf: str) -> DataFrame:
    url, html = F.col("url"), F.col("html")
    return estate.table(spark, sf, "pages").select(
        "page_id", text.slug(url).alias("slug"), text.url_host(url).alias("host"), text.url_path(url).alias("path"), text.normalize_path(text.url_path(url)).alias("normal"),
        text.strip_segments(text.url_path(url), 1).alias("stripped"), text.first_string(html).alias("first_string"), text.xml_tag_value(html, "title").alias("title"),
        html.contains("<h1>").alias("has_h1"), text.xml_attr(html, "lang").alias("lang"),
    )


def entry(spark: SparkSession, sf: str) -> DataFrame:
    return flagship(spark, sf)


def queries() -> dict[str, Query]:
    from . import code_queries, source_queries

    return _queries | source_queries.queries() | code_queries.queries()


def oracle_sql() -> dict[str, str]:
    from . import code_queries, source_queries

    return _sql | source_queries.oracle_sql() | code_queries.oracle_sql()


__all__ = ["entry", "oracle_sql", "queries", "readers"]
