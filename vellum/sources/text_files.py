"""Uploaded texts, keyword lists and results."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.arrow_udf(StringType())
def _decoded(contents: pa.Array) -> pa.Array:
    return pa.array([c.decode("utf-8", "replace") if c is not None else None for c in contents.to_pylist()], pa.string())


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file: path and content, in which bytes that aren't UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", _decoded("content").alias("content"))


def keywords(lines: Column) -> Column:
    """One keyword a line, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(lines, r"\R", -1), lambda x: F.trim(x)), lambda k: k != "")


def write_reports(reports: DataFrame, path: str) -> None:
    """Reports as JSON lines."""
    reports.write.mode("overwrite").json(path)
