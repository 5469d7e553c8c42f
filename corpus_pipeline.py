"""A training corpus from documents: five stages, each written as Parquet and read again as the next one's documents.

Toxic documents go, then those without a recognisable language, then all but one of each group of near duplicates (five
words, similarity 0.8); what is left is mixed to the target weights of its sources (rows repeat or go, whole documents
only) and encoded by byte-level BPE. All but the last stage return the columns of documents, whatever their names.

Nulls, empty and very long texts, repeated rows and rows without doc_id are cases that the stages' docstrings define; an
empty table passes through all of them. Stages run in a session of their own, so that the caller's settings stay as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import byte_bpe, common, language, mixing, near_dedup, toxicity

RANKS = "byte_bpe_multi_50k.tiktoken"


@common.small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of a toxic text go. Null and empty texts, repeated rows and rows without doc_id stay as they are; scores are not ranked, so ties need no rule."""
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, model)


@common.small_batches
def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a recognisable language go: null texts, texts without a letter, and those whose best language has a posterior under one half.

    On the given tables no text with letters has so low a posterior: there only texts without letters go.
    """
    model = language.train(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return language.identified(docs, model)


@common.small_batches
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates that of the smallest doc_id stays, of rows that repeat one; texts without words and rows without doc_id stay."""
    return near_dedup.representatives(docs)


@common.small_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole rows, each as often as its source's target takes it; null texts and texts without words are never taken; ties go by doc_id and text."""
    return mixing.mix(docs)


@common.small_batches
def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids (little-endian unsigned 32-bit integers) of each row; null texts have no ids."""
    path = public_tokenizers.path(RANKS)
    found = byte_bpe.decode(byte_bpe.encode(docs, path, public_tokenizers.PATTERN), path)
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_identified),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("byte_bpe", encode_tokens),
]

#: Trained models and subword merges are beyond SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return common.durable(STAGES[-1][1](spark, docs, sf_dir), f"pipeline-{STAGES[-1][0]}")
