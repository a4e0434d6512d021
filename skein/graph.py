"""The typed property graph: nodes and edges as DataFrames."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that every node and edge table has; further properties are columns of their own or entries of `props`.
NODE = {
    "id": "string", "label": "string", "service": "string", "file": "string", "line": "int", "source": "string", "confidence": "string",
    "name": "string", "path": "string", "http_method": "string", "handler": "string", "host": "string", "host_var": "string", "url": "string",
    "topic": "string", "topic_var": "string", "topics": "array<string>", "bus": "string", "message_role": "string", "delivery_edge": "string",
    "kind": "string", "props": "map<string,string>", "ordinal": "bigint",
}
EDGE = {"type": "string", "src": "string", "dst": "string", "from_service": "string", "to_service": "string", "cross_repo": "boolean", "confidence": "string", "source": "string", "props": "map<string,string>"}


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession


def shaped(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """df with just the schema's columns, in order; those it lacks are null."""
    have = set(df.columns)
    return df.select(*((F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in schema.items()))


def as_nodes(df: DataFrame) -> DataFrame:
    return shaped(df, NODE)


def as_edges(df: DataFrame) -> DataFrame:
    return shaped(df, EDGE)


def prop(df: DataFrame, name: str) -> Column:
    """A property by name: the column if there is one, else the entry of `props`."""
    if name in df.columns:
        return F.col(name)
    return F.try_element_at("props", F.lit(name)) if "props" in df.columns else F.lit(None).cast("string")


def _checkpoint_base(spark: SparkSession) -> str:
    """The session's checkpoint folder; where none is set (tests on one machine) a temporary one, set once for both uses."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines see")
        base = tempfile.mkdtemp(prefix="skein-checkpoint-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def materialize(df: DataFrame) -> DataFrame:
    """df computed once into the shared checkpoint folder; a lost executor loses nothing."""
    _checkpoint_base(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that all machines see, beside the checkpoints."""
    return f"{_checkpoint_base(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Writes in here drop their shuffles' files when they are done: what is written does not need them again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def parted(df: DataFrame, column: str, name: str) -> DataFrame:
    """df, written once into the shared folder in a folder for each value of a column."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    with _shuffles_dropped(spark):
        df.repartition(column).write.option("compression", "zstd").partitionBy(column).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, *keys: str) -> DataFrame:
    """df, written once into the shared folder in as many buckets by keys as shuffles have partitions: joins and groups on these keys (and more) leave it where it is."""
    spark, name = df.sparkSession, f"skein_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # dealt as the buckets are, so that a task writes one file
    with _shuffles_dropped(spark):
        df.repartition(n, *keys).write.format("parquet").option("compression", "zstd").option("path", shared_folder(spark, name)).bucketBy(n, *keys).sortBy(*keys).saveAsTable(name)
    return spark.table(name)


def version(graph: Graph) -> DataFrame:
    """One row, `graph_version`: the start of a digest over all node ids and edge keys.

    Every id and key is hashed by itself and the 32-bit parts of the hashes are summed,
    so that no sorted list of the whole graph is built in one place.
    """
    return named(digest(graph))


def digest(graph: Graph) -> DataFrame:
    """One row of sums (s0 to s3) over the hashes of all node ids and edge keys, and their number n; digests of parts add up."""
    keys = graph.nodes.select(F.concat(F.lit("n:"), "id").alias("k")).unionByName(graph.edges.select(F.concat_ws(":", F.lit("e"), "type", "src", "dst").alias("k")))
    # decimals, as beyond some billions of keys the sums leave 64 bits
    part = lambda i: F.coalesce(F.sum(F.conv(F.substring(F.sha2("k", 256), 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)"))
    return keys.agg(*(part(i).alias(f"s{i}") for i in range(4)), F.count("*").alias("n"))


def named(sums: DataFrame) -> DataFrame:
    return sums.select(F.substring(F.sha2(F.concat_ws(":", "s0", "s1", "s2", "s3", "n"), 256), 1, 16).alias("graph_version"))
