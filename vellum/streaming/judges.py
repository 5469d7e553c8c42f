"""Judges over streams. They look at one row at a time, so the batch transformations run unchanged and need no state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def read_requests(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of Parquet files of requests."""
    return spark.readStream.schema(schema).parquet(path)


def judge_stream(requests: DataFrame, judge: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Append judged rows as Parquet; what is there when it starts is worked off, then it ends. Files are written once each."""
    return judge(requests).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
