"""A corpus from raw documents to token ids: five stages, each on all that the one before has kept.

Edge cases, in each stage: a null or empty text fails the base rule of quality and goes;
given to a later stage by itself it has no lines, no shingles, no benchmark passage and no
ids, and stays. Rows without an id and rows that share one are judged each for itself,
but of rows equal in id and text the grouping stage keeps one, the first by language,
source and size. Of equal texts the line stage keeps the one with the smallest id, and of
ties in the grouping stage the smallest id stays. An empty table passes through all stages
as an empty table. Only the columns of documents are read, whatever others there are,
and all stages but the last return just these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm import bpe, contamination, line_dedup, ngram_join, quality
from skein.llm.tables import materialize, shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor a certified rule rejects."""
    return quality.keep(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), joint=True)


def deduplicated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier; one of which nothing is left but short lines that stand earlier goes."""
    done = line_dedup.dedup(docs.select(*COLUMNS), fold=True, drop_copies=True)
    return done.withColumn("n_chars", F.when(F.col("n_lines_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (five-word shingles, similarity 0.8) the document with the smallest id; one without an id comes first.

    A hash of id and text stands for the id, so that rows that share an id or have none
    are judged each for itself; of rows with the same id and text one stays.
    """
    keyed = docs.select(*COLUMNS).withColumn("_row", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"))
    found = materialize(ngram_join.groups(keyed.select(F.col("_row").alias("doc_id"), "text"), n=5, p=80, q=100).select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group"), "n_shingles"))
    linked = found.where("_row <> _group")
    crowd = materialize(linked.select("_row", "_group").union(linked.select("_group", "_group")).distinct())
    named = keyed.select("_row", "doc_id").join(crowd, "_row").groupBy("_group").agg(F.min(F.struct("doc_id", "_row")).alias("first"))
    gone = crowd.join(named, "_group").where("_row <> first._row").select("_row")
    left = keyed.join(materialize(gone), "_row", "left_anti")
    copies = materialize(found.where("n_shingles > 0").groupBy("_row").count().where("count > 1").select("_row"))
    nth = F.row_number().over(Window.partitionBy("_row").orderBy("lang", "source", "n_chars"))
    once = left.join(copies, "_row", "left_semi").withColumn("_nth", nth).where("_nth = 1")
    return left.join(copies, "_row", "left_anti").select(*COLUMNS).union(once.select(*COLUMNS))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item by half."""
    return contamination.judge(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).where("not contaminated").select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and the digest of the text that they decode to."""
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "n_chars", "text"), bpe.vocabulary_path(spark, "word_bpe_49k.json"), decoded="decoded")
    return coded.select("doc_id", "lang", "source", "n_chars", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"), "token_ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("deduplicated_lines", deduplicated_lines),
    ("one_of_each_group", one_of_each_group),
    ("decontaminated", decontaminated),
    ("token_ids", token_ids),
]

#: SQL expresses neither the certified cutoffs, the tiling nor the encoding; brute force stands in (tests/llm).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir; each stage is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
