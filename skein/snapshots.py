"""Graph snapshots that grow by parts: each addition is written beside the earlier ones with the digest of what it adds.

The version of a graph is made from sums over its keys, so the version of all parts
together is made from their digests, a row a part, without reading a part again.
A manifest row is written last; a part without one was left by a run that failed, and
is not read. One writer at a time.

An addition is compared by keys alone (ids; type, src and dst) with the parts before it;
what they have, or what it has twice, adds nothing: the first row of a key stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import EDGE, NODE, Graph, as_edges, as_nodes, digest, named, shared_folder

_SUMS = "part int, s0 decimal(30,0), s1 decimal(30,0), s2 decimal(30,0), s3 decimal(30,0), n long"
_EDGE_KEY = ["type", "src", "dst"]


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_SUMS).parquet(f"{path}/manifest/*")


def _write(graph: Graph, path: str, part: int) -> None:
    spark, at = graph.spark, f"part-{part:06d}"
    as_nodes(graph.nodes).dropDuplicates(["id"]).write.mode("overwrite").parquet(f"{path}/nodes/{at}")
    as_edges(graph.edges).dropDuplicates(_EDGE_KEY).write.mode("overwrite").parquet(f"{path}/edges/{at}")
    written = Graph(_read(spark, path, "nodes", NODE, [part]), _read(spark, path, "edges", EDGE, [part]))
    digest(written).select(F.lit(part).alias("part"), *(F.col(f"s{i}").cast("decimal(30,0)") for i in range(4)), "n").write.mode("overwrite").parquet(f"{path}/manifest/{at}")


def _read(spark: SparkSession, path: str, what: str, schema: dict[str, str], parts: list[int]) -> DataFrame:
    return spark.read.schema(", ".join(f"{c} {t}" for c, t in schema.items())).parquet(*(f"{path}/{what}/part-{p:06d}" for p in parts))


def parts(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished parts, one for each addition ever made."""
    return sorted(r["part"] for r in _manifest(spark, path).select("part").collect())


def create(graph: Graph, path: str | None = None) -> str:
    """Write a first part; returns the folder."""
    path = path or shared_folder(graph.spark, "snapshot")
    _write(graph, path, 0)
    return path


def read(spark: SparkSession, path: str) -> Graph:
    done = parts(spark, path)
    return Graph(_read(spark, path, "nodes", NODE, done), _read(spark, path, "edges", EDGE, done))


def append(spark: SparkSession, path: str, addition: Graph) -> None:
    """Write what the addition has and no part before it."""
    have = read(spark, path)
    fresh = Graph(addition.nodes.join(have.nodes.select("id"), "id", "left_anti"), addition.edges.join(have.edges.select(*_EDGE_KEY), _EDGE_KEY, "left_anti"))
    _write(fresh, path, parts(spark, path)[-1] + 1)


def version(spark: SparkSession, path: str) -> DataFrame:
    """One row, `graph_version`, equal to that of the whole graph; only the manifest is read."""
    sums = _manifest(spark, path)
    return named(sums.agg(*(F.coalesce(F.sum(f"s{i}"), F.lit(0)).cast("decimal(38,0)").alias(f"s{i}") for i in range(4)), F.coalesce(F.sum("n"), F.lit(0)).alias("n")))
