"""Connected components of links between numbered things, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import materialize

#: Links that one task takes, for the number of partitions that hold them.
_PER_TASK = 500_000


def components(links: DataFrame) -> DataFrame:
    """node and component, the smallest node reachable, for every end of a link (a, b).

    A round gives each node the smallest label among its own and its neighbours', then
    the label of that label, so that long chains shrink by halves. It ends with the
    first round that changes nothing. A hub's neighbours are summed before they move.
    """
    spark = links.sparkSession
    ends = links.select("a", "b").where("a <> b")
    both = materialize(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    parts = max(spark.sparkContext.defaultParallelism, both.count() // _PER_TASK)
    both = both.coalesce(parts)
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"))
    labels = materialize(labels.coalesce(parts))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        stepped = hooked.join(labels.select(F.col("node").alias("label"), F.col("label").alias("further")), "label", "left")
        stepped = materialize(stepped.select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")).coalesce(parts))
        labels = stepped.select("node", "label")
        if not stepped.agg(F.count_if(F.col("old") != F.col("label")).alias("n")).first()["n"]:
            return labels.withColumnRenamed("label", "component")
