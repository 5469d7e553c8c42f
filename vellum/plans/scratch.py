"""Tables written once to the folder that driver and executors share, so that several branches of a plan read one result."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame

#: Used only by sessions on one machine that name no spark.checkpoint.dir.
LOCAL = "/tmp/checkpoints"


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table under spark.checkpoint.dir and read it back; lost executors lose nothing."""
    spark = df.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = f"{(named or LOCAL).rstrip('/')}/vellum/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)
