"""URL filters: path rules, and trust and distrust spread over the host graph.

A page's host and path are matched with the rules of its host and of the domains
above it; the longest rule decides. Other pages are judged by their host. Links in
the pages make weighted edges between hosts. Trust starts at hosts in proportion to
their pages that a rule allows and follows the links; distrust starts at hosts in
proportion to their pages that a rule blocks and follows the links backwards, for a
host that links to bad ones is suspect. Both are personalised PageRanks, with one
page's mass the same in either. Rounds go on until what still moves is below a tolerance. A host is blocked where its distrust exceeds `ratio` times its trust. In the
graph, though not in the result, a host stands without a user part and a port.

Edge cases: a url that is null or has no "://" has an empty host and path, fits no
rule and is allowed unless its (empty) host is distrusted, which cannot be; a page
without html has no links; repeated pages and links count as often as they stand
there; a tie of trust and distrust allows; extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import materialize

#: (host, path, verdict)
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Share of a host's mass that follows its links, and how many times the trust the distrust of an allowed host may be.
DAMPING, RATIO = 0.85, 2.0
#: Of the whole mass, which is 1 at most, how much may still move when the rounds end; after ROUNDS no more can.
TOLERANCE, ROUNDS = 1e-6, 88
#: Rounds between two looks at what still moves, where lineage is cut.
_LOOK = 8
_UPPER = "".join(map(chr, range(65, 91)))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z in lower case, and the path of a url; both empty where it has none."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _UPPER.lower()), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def bare_host(host: Column) -> Column:
    """A host as the graph names it: without a user part and a port."""
    return F.regexp_replace(host, r"^[^@]*@|:\d+$", "")


def with_rule(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """pages with host, path, and the longest rule that fits and its verdict, else nulls."""
    host, path = host_and_path(F.col("url"))
    own = pages.withColumn("host", host).withColumn("path", path)
    fits = lambda h, p: ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
    ranked = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    pick = lambda value: reduce(lambda rest, r: F.when(fits(r[0], r[1]), F.lit(value(r))).otherwise(rest), reversed(ranked), F.lit(None).cast("string"))
    return own.withColumn("rule", pick(lambda r: r[0] + r[1])).withColumn("rule_verdict", pick(lambda r: r[2]))


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst and n: how many links lead from one host to another."""
    links = F.regexp_extract_all("html", F.lit(r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""), F.lit(1))
    apart = pages.select(bare_host(F.col("host")).alias("src"), F.explode(links).alias("raw"))
    dst = F.translate(bare_host(F.col("raw")), _UPPER, _UPPER.lower())
    return apart.select("src", dst.alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank: (host, mass) from (host, seed) over (src, dst, n). Mass of hosts without links ends there.

    Every round adds to the masses of the one before, so that what all together have
    gained since the last look tells whether anything still moves.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    steps = materialize(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share")))
    base = seeds.select("host", (F.col("seed") * (1 - damping)).alias("mass"))
    if steps.isEmpty():
        return base
    whole = lambda df: df.agg(F.coalesce(F.sum("mass"), F.lit(0.0)).alias("m")).first()["m"]
    base = materialize(base)
    now, mass = base, whole(base)
    for k in range(ROUNDS):
        moved = steps.join(now, steps["src"] == now["host"]).select(F.col("dst").alias("host"), (F.col("mass") * F.col("share") * damping).alias("mass"))
        now = base.unionByName(moved).groupBy("host").agg(F.sum("mass").alias("mass"))
        if k % _LOOK == _LOOK - 1:
            now = materialize(now)
            before, mass = mass, whole(now)
            if mass - before <= tolerance:
                break
    return now


def host_scores(judged: DataFrame, links: DataFrame) -> DataFrame:
    """host, trust and distrust of every host that has some."""
    counted = judged.where("rule_verdict is not null").groupBy("host").agg(F.count_if(F.col("rule_verdict") == "allow").alias("allowed"), F.count_if(F.col("rule_verdict") == "block").alias("blocked"))
    counted = materialize(counted)
    total = counted.agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")).first()
    judged_pages = float((total["a"] or 0) + (total["b"] or 0) or 1)
    share = lambda name: counted.where(F.col(name) > 0).select("host", (F.col(name) / F.lit(judged_pages)).alias("seed"))
    trust = spread(share("allowed"), links).withColumnRenamed("mass", "trust")
    distrust = spread(share("blocked"), links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")).withColumnRenamed("mass", "distrust")
    return trust.join(distrust, "host", "full").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, ratio: float = RATIO) -> DataFrame:
    """page_id, host, path, rule and verdict of every page; `host_scores` gives the masses behind it."""
    own = with_rule(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), rules)
    light = own.drop("html", "url").withColumn("node", bare_host(F.col("host")))
    # one aggregate of all pages' hosts and links: the hot host is summed before anything is joined
    scores = host_scores(light.select(F.col("node").alias("host"), "rule_verdict"), materialize(host_links(own)))
    bad = scores.where(F.col("distrust") > ratio * F.col("trust")).select(F.col("host").alias("node"), F.lit(True).alias("bad"))
    joined = light.join(bad, "node", "left")
    verdict = F.coalesce("rule_verdict", F.when(F.col("bad"), "block").otherwise("allow"))
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
