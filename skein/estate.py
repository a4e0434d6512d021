"""The business tables as a typed graph, so that the graph operators run on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.text import slug, url_host, url_path
from .graph import EDGE, NODE, Graph, as_edges, as_nodes, shaped

#: Node columns of the estate beyond the usual ones.
ESTATE = NODE | {"status": "string", "segment": "string", "brand": "string"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_regionkey", slug(F.col("n_name")).alias("service"), slug(F.col("r_name")).alias("region"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, suppliers, orders, parts, nations and regions; the service is the nation."""
    t = lambda name: table(spark, sf_dir, name)
    places = _places(spark, sf_dir)
    node_id = lambda label, key: F.concat(F.lit(f"{label}:"), F.col(key).cast("string"))
    at = lambda name: F.concat_ws("/", F.lit(""), "region", "service", name)
    person = lambda df, nation: df.join(places, F.col(nation) == F.col("n_nationkey"))
    customer = person(t("customer"), "c_nationkey").select(node_id("Customer", "c_custkey").alias("id"), F.lit("Customer").alias("label"), "service", F.col("c_name").alias("name"), at("c_name").alias("path"), F.lit("pack:crm").alias("source"), F.lit("high").alias("confidence"), F.col("c_mktsegment").alias("segment"))
    supplier = person(t("supplier"), "s_nationkey").select(node_id("Supplier", "s_suppkey").alias("id"), F.lit("Supplier").alias("label"), "service", F.col("s_name").alias("name"), at("s_name").alias("path"), F.lit("pack:srm").alias("source"), F.lit("high").alias("confidence"))
    homes = person(t("customer").select("c_custkey", "c_nationkey"), "c_nationkey").select("c_custkey", "service")
    tier = F.when(F.col("o_orderstatus") == "F", "high").when(F.col("o_orderstatus") == "O", "medium").otherwise("low")
    order = t("orders").join(homes, F.col("o_custkey") == F.col("c_custkey")).select(node_id("Order", "o_orderkey").alias("id"), F.lit("Order").alias("label"), "service", F.concat(F.lit("order-"), "o_orderkey").alias("name"), F.lit("llm:orders").alias("source"), tier.alias("confidence"), F.col("o_orderstatus").alias("status"))
    part = t("part").select(node_id("Part", "p_partkey").alias("id"), F.lit("Part").alias("label"), F.lit("catalog").alias("service"), F.col("p_name").alias("name"), F.concat_ws("/", F.lit("/api"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), F.col("p_partkey").cast("string")).alias("path"), F.lit("cgc-import").alias("source"), F.lit("medium").alias("confidence"), F.col("p_brand").alias("brand"))
    nation = places.select(node_id("Nation", "n_nationkey").alias("id"), F.lit("Nation").alias("label"), "service", F.col("service").alias("name"), F.concat_ws("/", F.lit(""), "region", "service").alias("path"), F.lit("reference").alias("source"), F.lit("high").alias("confidence"))
    region = t("region").select(node_id("Region", "r_regionkey").alias("id"), F.lit("Region").alias("label"), slug(F.col("r_name")).alias("service"), slug(F.col("r_name")).alias("name"), F.concat(F.lit("/"), slug(F.col("r_name"))).alias("path"), F.lit("reference").alias("source"), F.lit("high").alias("confidence"))
    out = shaped(customer, ESTATE)
    for more in (supplier, order, part, nation, region):
        out = out.unionByName(shaped(more, ESTATE))
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PLACED, CONTAINS_ITEM, FILLED_BY, IN_NATION and IN_REGION; a line's return flag is its edge's confidence, the lowest of several."""
    t = lambda name: table(spark, sf_dir, name)
    places = _places(spark, sf_dir)
    customers = t("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey", F.col("service").alias("c_service"))
    suppliers = t("supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", F.col("service").alias("s_service"))
    orders = t("orders").select("o_orderkey", "o_custkey").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    made = lambda df, kind, a, ka, b, kb, fs, ts, tier: as_edges(df.select(F.lit(kind).alias("type"), F.concat(F.lit(f"{a}:"), F.col(ka).cast("string")).alias("src"), F.concat(F.lit(f"{b}:"), F.col(kb).cast("string")).alias("dst"), fs.alias("from_service"), ts.alias("to_service"), (fs != ts).alias("cross_repo"), tier.alias("confidence"), F.lit("estate").alias("source")))
    # 0 is the lowest tier, so that the lowest of an edge's lines is a plain minimum
    rank = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    name = F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("rank") + 1)
    lines = t("lineitem")
    items = lines.groupBy("l_orderkey", "l_partkey").agg(F.min(rank).alias("rank")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    filled = lines.groupBy("l_orderkey", "l_suppkey").agg(F.min(rank).alias("rank")).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    high = F.lit("high")
    out = made(orders, "PLACED", "Customer", "o_custkey", "Order", "o_orderkey", F.col("c_service"), F.col("c_service"), high)
    for more in (
        made(items, "CONTAINS_ITEM", "Order", "l_orderkey", "Part", "l_partkey", F.col("c_service"), F.lit("catalog"), name),
        made(filled, "FILLED_BY", "Order", "l_orderkey", "Supplier", "l_suppkey", F.col("c_service"), F.col("s_service"), name),
        made(customers, "IN_NATION", "Customer", "c_custkey", "Nation", "c_nationkey", F.col("c_service"), F.col("c_service"), high),
        made(suppliers, "IN_NATION", "Supplier", "s_suppkey", "Nation", "s_nationkey", F.col("s_service"), F.col("s_service"), high),
        made(places, "IN_REGION", "Nation", "n_nationkey", "Region", "n_regionkey", F.col("service"), F.col("region"), high),
    ):
        out = out.unionByName(more)
    return out


def estate(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(nodes(spark, sf_dir), edges(spark, sf_dir))


def walks(spark: SparkSession, sf_dir: str) -> Graph:
    """Users, and NEXT edges from the user of an error event to the user of the following event.

    The next event is the one with the smallest later (ts, event_id). It is found by day,
    so that no window holds all events: within a day by a window, and for a day's last
    event by the first of the next day that has any.
    """
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", F.to_date("ts").alias("day"))
    following = Window.partitionBy("day").orderBy("ts", "event_id")
    own = ev.withColumn("next_user", F.lead("user_id").over(following)).withColumn("tail", F.lead("event_id").over(following).isNull())
    firsts = ev.groupBy("day").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("first_user"))
    # days are few and grow by one a day: the one thing ordered in a single place
    order = Window.orderBy("day")
    after = firsts.select("day", F.lead("first_user").over(order).alias("first_after"))
    linked = own.join(after, "day").withColumn("to", F.when(F.col("tail"), F.col("first_after")).otherwise(F.col("next_user"))).where("event_type = 'error' and `to` is not null")
    user = lambda c: F.concat(F.lit("User:"), F.col(c).cast("string"))
    people = ev.select("user_id").distinct().select(user("user_id").alias("id"), F.lit("User").alias("label"), user("user_id").alias("service"), user("user_id").alias("name"), F.lit("high").alias("confidence"))
    steps = linked.select(F.lit("NEXT").alias("type"), user("user_id").alias("src"), user("to").alias("dst"), user("user_id").alias("from_service"), user("to").alias("to_service"), F.lit("high").alias("confidence"))
    return Graph(as_nodes(people), as_edges(steps.withColumn("cross_repo", F.col("src") != F.col("dst"))))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as producers of the topic of their dearest line, customers as consumers of the topics of their largest order."""
    t = lambda name: table(spark, sf_dir, name)
    places = _places(spark, sf_dir)
    topics = t("part").select("p_partkey", F.concat_ws("/", "p_brand", "p_type", F.col("p_size").cast("string")).alias("topic"))
    best = F.max_by("l_partkey", F.struct("l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey"))
    dearest = t("lineitem").groupBy("l_suppkey").agg(best.alias("p_partkey")).join(topics, "p_partkey")
    producers = dearest.join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    made = producers.select(F.concat(F.lit("Producer:"), "s_suppkey").alias("id"), F.lit("Producer").alias("label"), "service", F.col("s_name").alias("name"), "topic", F.lit("producer").alias("message_role"), F.lit("parts").alias("bus"), F.lit("pack:srm").alias("source"), F.lit("high").alias("confidence"), F.col("s_suppkey").alias("ordinal"))
    largest = t("orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("l_orderkey"))
    used = t("lineitem").select("l_orderkey", "l_partkey").join(largest, "l_orderkey").join(topics, F.col("l_partkey") == F.col("p_partkey")).groupBy("o_custkey").agg(F.array_sort(F.collect_set("topic")).alias("topics"))
    consumers = used.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    read = consumers.select(F.concat(F.lit("Consumer:"), "c_custkey").alias("id"), F.lit("Consumer").alias("label"), "service", F.col("c_name").alias("name"), "topics", F.lit("consumer").alias("message_role"), F.lit("parts").alias("bus"), F.lit("pack:crm").alias("source"), F.lit("medium").alias("confidence"), F.col("c_custkey").alias("ordinal"))
    return as_nodes(made).unionByName(as_nodes(read))


def calls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, registry and service names: a page is a call to its host; each host's first page of each path length is an endpoint.

    Hosts under .com are in the registry, hosts under .org are services by name, others
    are unknown.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", F.lower(url_host(F.col("url"))).alias("host"), url_path(F.col("url")).alias("path"))
    asked = pages.select(F.concat(F.lit("Call:"), "page_id").alias("id"), F.lit("HttpCall").alias("label"), F.lit("web").alias("service"), "host", "path", F.col("page_id").alias("ordinal"))
    first = pages.groupBy("host", F.length("path").alias("n")).agg(F.min_by(F.struct("page_id", "path"), "page_id").alias("p"))
    offered = first.select(F.concat(F.lit("Endpoint:"), F.col("p.page_id")).alias("id"), F.lit("Endpoint").alias("label"), slug(F.col("host")).alias("service"), F.col("p.path").alias("path"), F.lit("GET").alias("http_method"), F.col("p.page_id").alias("ordinal"))
    hosts = pages.select("host").distinct()
    registry = hosts.where("host like '%.com'").select("host", slug(F.col("host")).alias("service"))
    names = hosts.where("host like '%.org'").select(F.col("host").alias("name"), slug(F.col("host")).alias("service"))
    return as_nodes(asked).unionByName(as_nodes(offered)), registry, names


def sites(spark: SparkSession, sf_dir: str) -> Graph:
    """Events as call sites: user, type and hour name the place; NEXT-free edges from each to its user."""
    ev = table(spark, sf_dir, "events")
    own = ev.select(F.concat(F.lit("Site:"), "event_id").alias("id"), F.lit("HttpCall").alias("label"), F.concat(F.lit("user-"), "user_id").alias("service"), F.col("event_type").alias("file"), F.hour("ts").alias("line"), F.col("event_type").alias("path"), F.col("event_id").alias("ordinal"))
    used = ev.select(F.lit("USED_BY").alias("type"), F.concat(F.lit("Site:"), "event_id").alias("src"), F.concat(F.lit("User:"), "user_id").alias("dst"))
    return Graph(as_nodes(own), as_edges(used))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source files: the source is the service, id and language make the name."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("service"), F.concat_ws(".", F.col("doc_id").cast("string"), "lang").alias("file"), F.col("text").alias("content"))


def markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.lit("web").alias("service"), F.concat("page_id", F.lit(".html")).alias("file"), F.col("html").alias("content"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as spans: the user is the service, the number in props the target, and the type the topic of purchases or else the path."""
    ev = table(spark, sf_dir, "events")
    bought = F.col("event_type") == "purchase"
    return ev.select(F.col("event_id").alias("ordinal"), F.col("event_type").alias("name"), F.concat(F.lit("user-"), "user_id").alias("service"), F.concat(F.lit("svc-"), F.get_json_object("props", "$.k")).alias("target_service"), F.when(~bought, F.concat(F.lit("/"), "event_type")).alias("path"), F.when(bought, F.col("event_type")).alias("topic"))


def traced(spark: SparkSession, sf_dir: str) -> Graph:
    """What spans are merged into: a component for each user, and one endpoint, /view."""
    ev = table(spark, sf_dir, "events")
    users = ev.groupBy("user_id").agg(F.min("event_id").alias("ordinal")).select(F.concat(F.lit("Component:"), "user_id").alias("id"), F.lit("Component").alias("label"), F.concat(F.lit("user-"), "user_id").alias("service"), F.concat(F.lit("/home/"), "user_id").alias("path"), "ordinal")
    view = ev.select(F.lit("Endpoint:view").alias("id"), F.lit("Endpoint").alias("label"), F.lit("front").alias("service"), F.lit("/view").alias("path"), F.lit(-1).cast("long").alias("ordinal")).limit(1)
    return Graph(as_nodes(users).unionByName(as_nodes(view)), as_edges(view.limit(0).select(F.lit("").alias("type"))))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as nodes whose coverage is judged: labelled ones come from a pack, others from a model."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels")
    tier = F.when(F.col("toxic") == 1, "low").when(F.col("quality") == 1, "high").otherwise("medium")
    own = docs.join(labels, "doc_id", "left").select(F.concat(F.lit("Doc:"), "doc_id").alias("id"), F.lit("Doc").alias("label"), F.col("source").alias("service"), F.when(F.col("quality").isNotNull(), "pack:labels").otherwise("llm:none").alias("source"), F.when(F.col("quality").isNull(), "low").otherwise(tier).alias("confidence"))
    return as_nodes(own)


__all__ = ["EDGE", "calls", "edges", "estate", "files", "labelled", "markup", "messages", "nodes", "sites", "spans", "table", "traced", "walks"]
