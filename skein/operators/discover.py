"""What a workspace's code uses: counts of imports, annotations and calls, and the settings they suggest.

Texts that are null or empty count for nothing. Counts cover all files; `top` is the
report's own limit. Equal counts are ordered by term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .extract import lines_of

#: Endings of code files, folders left out, calls of clients, and annotations of controllers.
ENDINGS = (".java", ".js", ".ts", ".tsx")
LEFT_OUT = ("target", "build", "dist", "node_modules", "__tests__")
CLIENT_CALLS = ("uri", "retrieve", "exchange", "getforobject", "postforentity")
CONTROLLERS = ("@RestController", "@Controller")


def code_files(files: DataFrame) -> DataFrame:
    own = files.where(F.regexp_extract("file", r"(\.[^./]+)$", 1).isin(*ENDINGS))
    return own.where(~F.exists(F.split("file", "/"), lambda p: p.isin(*LEFT_OUT)))


def usage(files: DataFrame) -> DataFrame:
    """what (import, annotation or call), term and n over all lines of files (service, file, content)."""
    text = F.col("text")
    # the root of what a line imports, by statement or by call
    named = F.regexp_extract(text, r"^\s*import\s+([\w.]+)", 1)
    required = F.regexp_extract(text, r"""^\s*const\s+\w+\s*=\s*require\((["'])((?:(?!\1)[^"'])+)["']\)""", 2)
    root = F.substring_index(F.when(named != "", named).otherwise(required), ".", 1)
    every = lambda what, pattern, group: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: F.struct(F.lit(what).alias("what"), x.alias("term")))
    found = F.concat(F.when((named != "") | (required != ""), F.array(F.struct(F.lit("import").alias("what"), root.alias("term")))).otherwise(F.array()), every("annotation", r"@\w+", 0), every("call", r"\.(\w+)\s*\(", 1))
    return lines_of(files).select(F.inline(found)).groupBy("what", "term").agg(F.count("*").alias("n"))


def top(counts: DataFrame, k: int = 30) -> DataFrame:
    """The k most frequent terms of each kind."""
    rank = F.row_number().over(Window.partitionBy("what").orderBy(F.desc("n"), "term"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def overlay(counts: DataFrame) -> DataFrame:
    """section, key and value of the settings that the counts suggest for review."""
    term = F.col("term")
    is_ = lambda what, test: (F.col("what") == what) & test
    row = lambda section, key, value: F.struct(F.lit(section).alias("section"), F.lit(key).alias("key"), (value if isinstance(value, Column) else F.lit(value)).alias("value"))
    found = F.array_compact(
        F.array(
            F.when(is_("call", F.lower(term).isin(*CLIENT_CALLS)), row("spring.http_clients", "tokens", F.concat(F.lit("."), term, F.lit("(")))),
            F.when(is_("annotation", term.endswith("Controller") | term.isin(*CONTROLLERS)), row("spring.rest", "controller_annotations", term)),
            F.when(is_("annotation", term.contains("KafkaListener")), row("spring.message_buses", "kafka", "@KafkaListener")),
            F.when(is_("import", term == "express") | is_("call", term == "Router"), row("javascript.express", "app_tokens", "express()")),
            F.when(is_("import", term == "express") | is_("call", term == "Router"), row("javascript.express", "app_tokens", "Router()")),
        )
    )
    return counts.select(F.inline(found)).distinct()
