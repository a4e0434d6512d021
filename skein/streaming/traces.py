"""Traces merged as they arrive: Structured Streaming over trace documents.

What a merge asks of a graph is kept beside the additions as keyed rows: signatures, a
node of each service, ids of nodes and keys of edges. The rows are dealt into buckets
by their keys, and a batch reads those buckets alone that its own keys name, of the
base as of the additions; the base's rows are written once, by the first batch.

The rows that a batch adds are a run. When as many runs of one width as WIDE are
complete they are written as one, so that a batch finds all before it in fewer than
WIDE runs of each width, and a row is written again only once for each width. Which
runs hold what follows from the batch's number, so that a batch that is repeated
reads what it read before and replaces what it wrote. Runs that are part of wider ones
stay where they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..graph import EDGE, NODE, Graph, as_nodes, materialize
from ..operators.trace import asked, linked, signatures, spares, unknown
from ..sources.readers import spans

#: Runs that become one.
WIDE = 16
_ROW = "kind string, a string, b string, c string, id string, own string, first long"


def runs_before(number: int) -> list[tuple[int, int]]:
    """Width and first batch of the runs that hold all batches before this one."""
    found, start, width = [], 0, 1
    while width * WIDE <= number:
        width *= WIDE
    while start < number:
        while start + width > number:
            width //= WIDE
        found.append((width, start))
        start += width
    return found


class Known:
    """The keyed rows kept at path, as they stand before one batch."""

    def __init__(self, spark: SparkSession, path: str, buckets: int) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets

    def bucket(self, kind: str, *key: str | Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(kind), *key), F.lit(self.buckets)).cast("int").alias("bucket")

    def rows(self, graph: Graph) -> DataFrame:
        """The keyed rows of a graph's nodes and edges."""
        sign = materialize(signatures(as_nodes(graph.nodes)))
        none, zero = F.lit(None).cast("string"), F.lit(None).cast("long")
        kinds = [
            sign.select(self.bucket("sign", "service", "key"), F.lit("sign").alias("kind"), "service", "key", none, "id", "own", "first"),
            spares(sign).select(self.bucket("spare", "service"), F.lit("spare"), "service", "of", "key", "id", none, "first"),
            graph.nodes.select(self.bucket("id", "id"), F.lit("id"), "id", none, none, none, none, zero),
            graph.edges.select(self.bucket("edge", "type", "src", "dst"), F.lit("edge"), "type", "src", "dst", none, none, zero),
        ]
        return reduce(DataFrame.union, kinds).toDF("bucket", *(c.split()[0] for c in _ROW.split(", ")))

    def write(self, rows: DataFrame, run: str) -> None:
        # large buckets in several files, small ones together in a task
        rows.hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/known/run={run}")

    def read(self, runs: list[str]) -> DataFrame:
        kept = f"{self.path}/known"
        return self.spark.read.schema(f"{_ROW}, run string, bucket int").option("basePath", kept).parquet(*(f"{kept}/run={run}" for run in runs)).drop("run")

    def before(self, number: int) -> DataFrame:
        """All rows from before a batch."""
        return self.read(["base", *(f"{width}-{start}" for width, start in runs_before(number))])

    def widen(self, number: int) -> None:
        """Write the runs that end before this batch and are complete now."""
        width = WIDE
        while number and number % width == 0:
            part = width // WIDE
            self.write(self.read([f"{part}-{start}" for start in range(number - width, number, part)]), f"{width}-{number - width}")
            width *= WIDE

    def asked_for(self, rows: DataFrame, kind: str, keys: DataFrame, *key: str) -> DataFrame:
        """Of rows those of a kind in the buckets that keys name: at most as many numbers as there are buckets pass through the driver."""
        named = [r["bucket"] for r in keys.select(self.bucket(kind, *key)).distinct().collect()]
        return rows.where(F.col("bucket").isin(named) & (F.col("kind") == kind))


def merge_stream(documents: DataFrame, base: Graph, path: str, checkpoint: str, buckets: int = 32) -> StreamingQuery:
    """Start merging a stream of trace documents (value) into the additions kept at path.

    Each batch is merged into the base and all additions before it, and what it adds is
    written under its own number, so that a repeated batch replaces itself. Documents are
    named by a digest of their text: within a batch they have no order, and equal ones
    add nothing. The base is read by the first batch; the number of buckets stays what
    it was then.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        known = Known(spark, path, buckets)
        if number == 0:
            known.write(known.rows(base), "base")
        known.widen(number)
        earlier = known.before(number)
        found = materialize(spans(df.select(F.sha2("value", 256).alias("ordinal"), "value").dropDuplicates(["value"])))
        asks = asked(found, "service").unionByName(asked(found, "target_service"))
        sign = known.asked_for(earlier, "sign", asks, "service", "key").select(F.col("a").alias("service"), F.col("b").alias("key"), "id", "own", "first")
        spare = known.asked_for(earlier, "spare", found.where("service is not null"), "service")
        spare = spare.groupBy(F.col("a").alias("service")).agg(F.min_by("id", F.struct("first", "b", "c")).alias("id"))
        nodes, edges, _ = linked(found, sign, spare)
        nodes, edges = materialize(nodes), materialize(edges)
        ids = known.asked_for(earlier, "id", nodes, "id").select(F.col("a").alias("id"))
        keys = known.asked_for(earlier, "edge", edges, "type", "src", "dst").select(F.col("a").alias("type"), F.col("b").alias("src"), F.col("c").alias("dst"))
        for part, new in zip(("nodes", "edges"), unknown(nodes, edges, ids, keys), strict=True):
            new.write.mode("overwrite").parquet(f"{path}/{part}/batch={number}")
        written = (spark.read.schema(", ".join(f"{c} {t}" for c, t in kind.items())).parquet(f"{path}/{part}/batch={number}") for part, kind in (("nodes", NODE), ("edges", EDGE)))
        known.write(known.rows(Graph(*written)), f"1-{number}")

    return documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
