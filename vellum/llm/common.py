"""What the operators share: table reading, scratch tables, hashing folds and Arrow helpers."""

from __future__ import annotations

import functools
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where scratch tables go if a session on one machine names no spark.checkpoint.dir (tests, notebooks).
LOCAL_SCRATCH = "/tmp/checkpoints"


#: Rows of whole documents in an Arrow batch, in place of Spark's 10,000: a batch is held by the JVM and by Python at once.
ARROW_ROWS = 1_000


def own_session(spark: SparkSession) -> SparkSession:
    """A session with the caller's settings but Arrow batches of that size; the caller's own settings stay as they are."""
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if own.conf.get(name, None) != value:
            own.conf.set(name, value)
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return own


def moved(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df as a DataFrame of another session of the same application, so that it runs by that session's settings."""
    name = f"vellum_{uuid.uuid4().hex}"
    df.createGlobalTempView(name)
    try:
        return spark.table(f"global_temp.{name}")
    finally:
        df.sparkSession.catalog.dropGlobalTempView(name)


def small_batches(query: Callable) -> Callable:
    """The query or stage in a session of its own with small Arrow batches; its result, which runs later, belongs to that session."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args) -> DataFrame:
        own = own_session(spark)
        return query(own, *(moved(own, a) if isinstance(a, DataFrame) else a for a in args))

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only on a single machine may the session leave it unnamed."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or LOCAL_SCRATCH).rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/vellum/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: short lineage, and lost executors lose nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """The name, or one like it, that no column of df has."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.crc32(doc_id.cast("string")) % folds == fold


def bounded_sample(rows: DataFrame, key: str, limit: int, seed: int) -> DataFrame:
    """At most `limit` rows, those with the smallest seeded hash of the key; the same rows on every run."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key)).limit(limit)


def bounded_texts(docs: DataFrame, keys: DataFrame, most_bytes: int, seed: int) -> DataFrame:
    """doc_id, text and the columns of keys, a bounded sample of distinct doc_ids, for texts of `most_bytes` together at most.

    Of rows that repeat a doc_id the one with the smallest hash of its text counts, and texts are taken in the order of
    the keys' seeded hash while they have room; a text that has none is left out, later ones may still fit.
    """
    hashed = docs.where("text is not null").select("doc_id", "text", F.xxhash64("text").alias("_hash"))
    small = F.broadcast(keys)
    one = hashed.join(F.broadcast(keys.select("doc_id")), "doc_id").groupBy("doc_id").agg(F.min(F.struct("_hash", F.octet_length("text").alias("size"))).alias("of"))
    chosen, room = [], most_bytes
    for r in one.select("doc_id", "of._hash", "of.size").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").collect():
        if r.size <= room:
            chosen.append((r.doc_id, r._hash))
            room -= r.size
    taken = F.broadcast(docs.sparkSession.createDataFrame(chosen, one.select("doc_id", "of._hash").schema))
    return hashed.join(taken, ["doc_id", "_hash"]).dropDuplicates(["doc_id"]).drop("_hash").join(small, "doc_id")


def train_once(sample: DataFrame, train: Callable, schema: str) -> list:
    """Run train(pandas frame) -> pandas frame in one task over a sample that is bounded by its caller; collect its model rows."""

    def fit(frames):
        import pandas as pd

        frames = [f for f in frames if len(f)]
        if frames:
            yield train(pd.concat(frames, ignore_index=True))

    return sample.repartition(1).mapInPandas(fit, schema).collect()


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about `most` bytes of the column, or one row if that is longer."""
    for batch in batches:
        if batch.nbytes <= most:
            if batch.num_rows:
                yield batch
            pa.default_memory_pool().release_unused()
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)
        # Workers are used again by later stages: what a batch took goes back.
        pa.default_memory_pool().release_unused()


def keep_rows(docs: DataFrame, judge: Callable[[], Callable[[list], list[bool]]], column: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose value in the column is kept by judge()(values), made once in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = judge()
        for batch in pieces(batches, column):
            yield batch.filter(pa.array(kept(batch.column(batch.schema.get_field_index(column)).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights of a logistic curve over the columns of x, the first of which is all ones, by Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    scale = np.r_[0.01, np.ones(x.shape[1] - 1)] * ridge
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(scale + 1e-9), x.T @ (y - p) - scale * w)
        w += step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-8:
            break
    return w
