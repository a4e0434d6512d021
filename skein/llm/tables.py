"""Reading the tables, and cutting lineage where every executor can read it again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


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
    """df, computed once and kept in the shared checkpoint folder, so that lost executors lose nothing."""
    _checkpoint_base(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that all machines see, beside the checkpoints."""
    return f"{_checkpoint_base(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: smaller than a checkpoint where columns repeat."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_size(df: DataFrame, *columns: str) -> int:
    """Bytes of the columns over all rows."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(0))
    return int(df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"])


def partitions_for(spark: SparkSession, size: int, each: int) -> int:
    """Partitions so that none gets much more than `each` of `size`; at least the session's own number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def bare(df: DataFrame, **columns: Column | str) -> DataFrame:
    """The named columns alone, so that clashing or odd extra columns of the input do no harm."""
    return df.select(*(F.col(c).alias(k) if isinstance(c, str) else c.alias(k) for k, c in columns.items()))


def aside(docs: DataFrame, *used: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with all columns but the used ones under names that clash with nothing, and by what name each column is found."""
    names = {c: c if c in used else f"_given_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), names
