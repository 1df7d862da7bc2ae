"""Pages, question files, digests and caches."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVIDENCE = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.StringType()), ("start", T.IntegerType()), ("end", T.IntegerType()), ("anchor", T.StringType()), ("quote", T.StringType()))]))
QUESTION = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("answerable", T.BooleanType()),
        T.StructField("evidence", EVIDENCE),
        T.StructField("kind", T.StringType()),
        T.StructField("origin", T.StringType()),
        T.StructField("candidate_id", T.StringType()),
    ]
)


def read_pages(spark: SparkSession, folder: str, glob: str = "*.md") -> DataFrame:
    """(doc_id, markdown) of the files below a folder; doc_id is the path from it. Order by doc_id where order matters."""
    root = folder.rstrip("/") + "/"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    doc_id = F.substring_index("path", re.sub("^[a-z0-9]+:/+", "/", root), -1)
    return found.select(doc_id.alias("doc_id"), F.decode("content", "utf-8").alias("markdown"))


def wanted_paths(files: DataFrame, keep: str, column: str = "path") -> DataFrame:
    """Files whose path matches, without any that climbs out of its folder."""
    climbs = F.array_contains(F.split(column, "/"), "..")
    return files.where(F.col(column).rlike(keep) & ~climbs)


def content_digest(files: DataFrame) -> DataFrame:
    """(digest, n): sha256 over the sorted (path, sha256 of content) lines; contents stay where they are."""
    each = files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("sha"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("path", "sha"))), lambda x: F.concat(x["path"], F.lit(" "), x["sha"]))
    return each.agg(F.sha2(F.array_join(lines, "\n"), 256).alias("digest"), F.count("*").alias("n"))


def require_digest(files: DataFrame, expected: str) -> None:
    found = content_digest(files).first()["digest"]
    if found != expected:
        raise ValueError(f"content digest {found}, expected {expected}")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions from JSON lines; blank lines are skipped."""
    return spark.read.schema(QUESTION).json(path)


def write_jsonl(rows: DataFrame, path: str, *order: str) -> None:
    """One JSON object a line; in one ordered file if an order is named, as for a reviewed set."""
    (rows.orderBy(*order).coalesce(1) if order else rows).write.mode("overwrite").json(path)


def write_summary(row: DataFrame, path: str) -> None:
    row.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def embedding_misses(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """(key, text) of the texts that a vector cache (key, embedding) lacks; keys are by model and text, so adding a text costs one encoding."""
    keyed = texts.select(F.sha2(F.concat_ws("\0", F.lit(model), "text"), 256).alias("key"), "text").dropDuplicates(["key"])
    return keyed.join(cache.select("key"), "key", "left_anti")
