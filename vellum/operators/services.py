"""Outside services over whole tables: each distinct request is served once, its answer goes to all rows that asked.

Requests meet by digest, never by row. A request that fails is an answer too, with the name of its failure, and concerns
only the rows that asked for it. What very many rows ask for is looked up under salts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.plans import scratch

#: An answer is hot if over one in HOT_SHARE of all requests, and HOT_REQUESTS at least, ask for it; so at most HOT_SHARE answers are.
HOT_SHARE, HOT_REQUESTS, SALT = 10_000, 10_000, 64

Encode = Callable[[list[str]], list[list[float]]]

_made: dict[str, object] = {}


def once(name: str, make: Callable[[], object]) -> object:
    """What make() gives, made once in each Python worker; only the latest is kept."""
    if name not in _made:
        _made.clear()
        _made[name] = make()
    return _made[name]


def digest(request: Column) -> Column:
    return F.unhex(F.sha2(request, 256))


def failure(e: Exception) -> str:
    return f"{type(e).__name__}: {e}" if str(e) else type(e).__name__


def served(serve: Callable[[list[str]], list], requests: list[str]) -> tuple[list, list[str | None]]:
    """Answers and failures: a batch that fails is served one by one, so that only what fails alone has a failure."""
    try:
        answers = list(serve(requests))
        if len(answers) == len(requests):
            return answers, [None] * len(requests)
        raise ValueError(f"{len(answers)} answers to {len(requests)} requests")
    except Exception as e:  # noqa: BLE001 - whatever a service raises is its answer
        if len(requests) == 1:
            return [None], [failure(e)]
    parts = [served(serve, [r]) for r in requests]
    return [a[0] for a, _ in parts], [f[0] for _, f in parts]


def distinct(asked: DataFrame) -> DataFrame:
    """asked (digest, request) -> digest, request, uses; copies fall together before they are shuffled."""
    return asked.groupBy("digest").agg(F.first("request").alias("request"), F.count("*").alias("uses"))


def look_up(asked: DataFrame, answers: DataFrame, spread: Column) -> DataFrame:
    """asked (digest, ...) with the other columns of answers (digest, uses, ...); `spread` tells rows of one digest apart."""
    least = max(HOT_REQUESTS, (answers.agg(F.sum("uses")).first()[0] or 0) // HOT_SHARE)
    hot = F.broadcast(answers.where(F.col("uses") > least).select("digest", F.lit(True).alias("_hot")))
    asked = asked.join(hot, "digest", "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SALT))).otherwise(F.lit(0)).cast("int")).drop("_hot")
    salts = F.when(F.col("uses") > least, F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0)))
    return asked.join(answers.withColumn("_salt", F.explode(salts)).drop("uses"), ["digest", "_salt"], "left").drop("_salt")


@dataclass(frozen=True)
class Encoder:
    """An encoder of texts, made by `make` once in each worker and called for `batch` distinct texts at a time."""

    make: Callable[[], Encode]
    batch: int = 64
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def named(self, text: Column) -> Column:
        """What tells texts of one vector from others."""
        return digest(text)

    def known(self, asked: DataFrame) -> DataFrame:
        """asked (digest, request) -> digest, uses, vector, failure."""
        return self.vectors(distinct(asked))

    def vectors(self, texts: DataFrame) -> DataFrame:
        """texts (digest, request, uses) -> digest, uses, vector, failure."""
        make, batch_size, name = self.make, self.batch, self.name

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                asked = batch.column(1).to_pylist()
                vectors, failures = [], []
                for i in range(0, len(asked), batch_size):
                    found, failed = served(lambda r: [[float(x) for x in v] for v in once(name, make)(r)], asked[i : i + batch_size])
                    vectors += found
                    failures += failed
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(vectors, pa.list_(pa.float64())), pa.array(failures, pa.string())], ["digest", "uses", "vector", "failure"])

        # The time that a model takes doesn't show in bytes, by which Spark would put texts into few tasks.
        n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return texts.select("digest", "request", "uses").repartition(n, "digest").mapInArrow(run, "digest binary, uses long, vector array<double>, failure string")


@dataclass(frozen=True)
class VectorTable:
    """Vectors that are there already: a table (key, vector) and the key of a text; a text without one has failed."""

    table: DataFrame
    key: Callable[[Column], Column]

    def named(self, text: Column) -> Column:
        return self.key(text)

    def known(self, asked: DataFrame) -> DataFrame:
        """asked (digest, a key) -> digest, uses, vector, failure; the texts themselves go nowhere."""
        table = self.table.select(F.col("key").alias("digest"), F.col("vector").cast("array<double>").alias("vector"))
        found = asked.groupBy("digest").agg(F.count("*").alias("uses")).join(table, "digest", "left")
        return found.withColumn("failure", F.when(F.col("vector").isNull(), "no vector"))

    def vectors(self, texts: DataFrame) -> DataFrame:
        known = self.table.select(F.col("key").alias("_key"), F.col("vector").cast("array<double>").alias("vector"))
        found = texts.withColumn("_key", self.key(F.col("request"))).join(known, "_key", "left")
        return found.select("digest", "uses", "vector", F.when(F.col("vector").isNull(), "no vector").alias("failure"))


def embed(df: DataFrame, texts: str, encoder: Encoder | VectorTable, vectors: str, failure: str) -> DataFrame:
    """df -> also `vectors`, those of an array of texts in its order, and `failure`, the first of its texts that has none.

    Each distinct text of the whole table is encoded once. If one text of a row fails, the row has null vectors; other rows
    keep theirs. Null arrays have null vectors without a failure. df is written once to the shared folder, so that it isn't
    computed again for each of its uses; rows that repeat stay.
    """
    keyed = scratch.durable(df.withColumn("_row", F.monotonically_increasing_id()), "embedding-rows")
    asked = keyed.select("_row", F.posexplode(texts).alias("_at", "request")).withColumn("digest", digest(F.col("request")))
    known = scratch.durable(encoder.vectors(distinct(asked)), "embedding-vectors")
    found = look_up(asked.drop("request"), known, F.col("_row"))
    found = found.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_at", "vector", "failure"))).alias("_found"))
    joined = keyed.join(found, "_row", "left")
    failed = F.get(F.filter("_found", lambda x: x["vector"].isNull()), F.lit(0))
    whole = F.when(failed.isNull(), F.coalesce(F.transform("_found", lambda x: x["vector"]), F.when(F.col(texts).isNotNull(), F.array().cast("array<array<double>>"))))
    return joined.withColumns({vectors: whole, failure: F.coalesce(failed["failure"], F.when(failed.isNotNull(), "no vector"))}).drop("_row", "_found")


def closeness(df: DataFrame, texts: str, encoder: Encoder | VectorTable, measure: Callable[[Column, Column], Column], near: str, failure: str) -> DataFrame:
    """df -> also `near`, the measure of an array's first text with each of the others in their order, and `failure` as in embed().

    Vectors stay where they are: each distinct pair of a first text and another is measured once, and rows get numbers. If
    one text of a row fails, the row has a null `near`; null arrays have one without a failure.
    """
    keyed = scratch.durable(df.withColumn("_row", F.monotonically_increasing_id()), "embedding-rows")
    asked = keyed.select("_row", encoder.named(F.get(texts, F.lit(0))).alias("_main"), F.posexplode(texts).alias("_at", "request"))
    asked = asked.withColumn("digest", encoder.named(F.col("request")))
    known = scratch.durable(encoder.known(asked), "embedding-vectors")
    asked = asked.drop("request")
    pairs = scratch.durable(asked.groupBy("_main", "digest").agg(F.count("*").alias("uses")), "embedding-pairs")
    mains = pairs.groupBy(F.col("_main").alias("digest")).agg(F.count("*").alias("uses")).join(known.select("digest", F.col("vector").alias("_first")), "digest", "left")
    pairs = look_up(pairs.withColumnRenamed("uses", "_pair_uses"), known, F.col("_main"))
    pairs = look_up(pairs.select(F.col("_main").alias("digest"), F.col("digest").alias("_other"), "_pair_uses", "vector", "failure"), mains, F.col("_other"))
    failed = F.when(F.col("vector").isNull(), F.coalesce("failure", F.lit("no vector")))
    measured = pairs.select(F.struct(F.col("digest").alias("main"), F.col("_other").alias("other")).alias("digest"), F.col("_pair_uses").alias("uses"), measure(F.col("_first"), F.col("vector")).alias("_near"), failed.alias("_failure"))
    asked = asked.select("_row", "_at", F.struct(F.col("_main").alias("main"), F.col("digest").alias("other")).alias("digest"))
    found = look_up(asked, scratch.durable(measured, "embedding-closeness"), F.col("_row"))
    # A text without a name, as a null key is, meets nothing.
    found = found.withColumn("_failure", F.coalesce("_failure", F.when(F.col("digest.other").isNull(), "no vector")))
    found = found.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_at", "_near", "_failure"))).alias("_found"))
    joined = keyed.join(found, "_row", "left")
    failed = F.get(F.filter("_found", lambda x: x["_failure"].isNotNull()), F.lit(0))["_failure"]
    whole = F.when(failed.isNull(), F.coalesce(F.transform(F.slice("_found", F.lit(2), F.greatest(F.size("_found") - 1, F.lit(0))), lambda x: x["_near"]), F.when(F.col(texts).isNotNull(), F.array().cast("array<double>"))))
    return joined.withColumns({near: whole, failure: failed}).drop("_row", "_found")


def ask(df: DataFrame, model: Callable[[list[str]], list[str]], prompt: str = "prompt", reply: str = "llm_raw_response", failure: str = "llm_error", under_way: int = 8, threads: int = 4, batch: int = 1) -> DataFrame:
    """df -> also the model's reply to each prompt and the failure of each request, null if it was answered.

    Each distinct prompt of the whole table is asked once, `batch` of them in a request, and no more than `under_way`
    requests are under way at a time over all tasks. A request that raises is a failure of its prompts' rows alone. Null
    prompts aren't asked. Replies are written to the shared folder: what follows never asks again.
    """
    threads = max(1, min(threads, under_way))
    keyed = df.withColumn("_row", F.monotonically_increasing_id()).withColumn("digest", digest(F.col(prompt)))
    prompts = distinct(keyed.where(F.col(prompt).isNotNull()).select("digest", F.col(prompt).alias("request")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(threads) as pool:
            for rows in batches:
                asked = rows.column(1).to_pylist()
                found = list(pool.map(lambda i: served(model, asked[i : i + batch]), range(0, len(asked), batch)))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array([a for x, _ in found for a in x], pa.string()), pa.array([f for _, x in found for f in x], pa.string())], ["digest", "uses", "_reply", "_failure"])

    answers = prompts.repartition(max(1, under_way // threads)).mapInArrow(run, "digest binary, uses long, _reply string, _failure string")
    out = look_up(keyed, scratch.durable(answers, "replies"), F.col("_row"))
    none = F.col(prompt).isNotNull() & F.col("_reply").isNull() & F.col("_failure").isNull()
    return out.withColumns({reply: F.col("_reply"), failure: F.coalesce("_failure", F.when(none, "no reply"))}).select(*df.columns, reply, failure)
