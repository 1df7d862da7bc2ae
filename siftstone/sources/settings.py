"""Settings from a file and the environment, and checks that inputs are there."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def load_settings(lines: list[str], environment: dict[str, str] | None = None) -> dict[str, str]:
    """NAME=value lines, comments and quotes dropped; the environment wins."""
    environment = dict(os.environ) if environment is None else environment
    out = {}
    for line in lines:
        name, equals, value = line.strip().partition("=")
        if equals and not name.startswith("#"):
            out[name.strip()] = environment.get(name.strip(), value.strip().strip("\"'"))
    return out


def require_path(spark: SparkSession, path: str, hint: str) -> None:
    """An error with a hint if nothing is at a path of any file system Spark reads."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        raise FileNotFoundError(f"{path} is missing; {hint}")


def file_digest(spark: SparkSession, path: str, digits: int = 16) -> str:
    """The first hex digits of a file's sha256."""
    return spark.read.format("binaryFile").load(path).select(F.substring(F.sha2("content", 256), 1, digits)).first()[0]
