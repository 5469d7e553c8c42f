"""Byte-level BPE by a global shuffle of distinct words.

Texts are cut into pre-tokens ("words") by the public pattern. A task works on blocks of some megabytes: each document
becomes the sequence of its words' numbers in the block's list of distinct words (the exploded positions), and that list
is dealt by a hash of the word, packed by bucket. A bucket gathers a word from all blocks, so each distinct word of the
whole table is encoded once; its ids go back to the blocks that asked for it, which join them with their documents and
reassemble them by position. A frequent word costs a row's entry per block, not per occurrence. The number of buckets
grows with the bytes of text; a task streams through its buckets' rows and holds only distinct words. Blocks are written
once, bucketed by block number, to the shared folder, so the final join moves only the words' ids.
"""

from __future__ import annotations

import base64
import itertools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import common

BLOCK_BYTES = 16 << 20
#: Bytes of text for each bucket of distinct words. Beyond the most buckets, whose lists would be cut too fine, tasks stream for longer.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 256 << 20, 64, 8_192
#: Distinct words that a task holds; a bucket with more of them encodes some again.
HELD_WORDS = 1_000_000
#: A vocabulary is broadcast only up to so many tokens; rank files of public tokenizers have some hundred thousand.
MAX_VOCABULARY = 2_000_000


def ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id of a rank file (base64 token, space, id on each line)."""
    with open(path, "rb") as lines:
        found = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    if len(found) > MAX_VOCABULARY:
        raise ValueError(f"{len(found)} tokens are more than the {MAX_VOCABULARY} that tasks may hold")
    return found


def splitter(pattern: str):
    """The pattern for the regex module; \\s and \\S mean Unicode white space alone, as in the tokenizer libraries."""
    import regex

    return regex.compile(pattern.replace(r"[^\s\p", r"[^\p{White_Space}\p").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _planes(codes: np.ndarray) -> bytes:
    """The numbers byte by byte, all lowest bytes first: that compresses well."""
    return codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _blocks(docs: DataFrame, pattern: str, buckets: int) -> DataFrame:
    """A row for each document (doc_id, codes) and for each bucket of a block's distinct words (words, their lengths and numbers)."""
    schema = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("codes", pa.binary()), ("bucket", pa.int32()), ("words", pa.binary()), ("lengths", pa.binary()), ("places", pa.binary())])

    def listed(block: int, numbers: _Numbers) -> Iterator[pa.RecordBatch]:
        words = [w.encode() for w in numbers]
        of = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
        order = np.argsort(of, kind="stable")
        ends = np.flatnonzero(np.r_[of[order][1:] != of[order][:-1], True]) + 1 if len(words) else np.zeros(0, int)
        rows, start = [], 0
        for end in ends.tolist():
            at = order[start:end]
            own = [words[j] for j in at.tolist()]
            rows.append((block, None, None, int(of[at[0]]), b"".join(own), _planes(np.fromiter(map(len, own), "<u4", len(own))), _planes(np.diff(at, prepend=0))))
            start = end
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cut = splitter(pattern)
        block, size, numbers = TaskContext.get().partitionId() << 32, 0, _Numbers()
        for batch in common.pieces(batches):
            if size >= BLOCK_BYTES:
                yield from listed(block, numbers)
                block, size, numbers = block + 1, 0, _Numbers()
            codes = []
            for t in batch.column(1).to_pylist():
                found = cut.findall(t) if t else []
                codes.append(_planes(np.fromiter(map(numbers.__getitem__, found), np.uint32, len(found))))
                size += len(t or "")
            n = len(codes)
            yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), batch.column(0), pa.array(codes, pa.binary())] + [pa.nulls(n, f.type) for f in list(schema)[3:]], schema=schema)
        yield from listed(block, numbers)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "block long, doc_id long, codes binary, bucket int, words binary, lengths binary, places binary")


def bucket_count(docs: DataFrame) -> int:
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-total // BUCKET_BYTES)))


def _bucketed(df: DataFrame, key: str) -> DataFrame:
    """A table in the shared folder whose rows with the same key are in files of one bucket, so that joins on it leave it in place.

    The catalog's entry goes at once; the files and the plan that reads them stay.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"vellum_blocks_{uuid.uuid4().hex[:12]}"
    df.write.bucketBy(n, key).option("path", common.scratch_path(spark, name)).option("compression", "zstd").saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return found


def _encode_words(vocabulary):
    """Rows of distinct words, sorted by bucket -> their ids; a bucket's words are remembered, so that each is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        # Any word is one match of this pattern: it has been cut before.
        encode = tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=vocabulary.value, special_tokens={}).encode_ordinary
        known: dict[bytes, tuple[int, ...]] = {}
        current = None
        for batch in common.pieces(batches, "words"):
            counts, ids = [], []
            for bucket, words, lengths in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if bucket != current or len(known) > HELD_WORDS:
                    known, current = {}, bucket
                found, start = [], 0
                for end in np.cumsum(_from_planes(lengths), dtype=np.int64).tolist():
                    w = words[start:end]
                    start = end
                    got = known.get(w)
                    if got is None:
                        known[w] = got = tuple(encode(w.decode()))
                    found.append(got)
                counts.append(_planes(np.fromiter(map(len, found), "<u4", len(found))))
                ids.append(_planes(np.fromiter(itertools.chain.from_iterable(found), "<u4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.binary()), pa.array(ids, pa.binary())], ["block", "bucket", "counts", "ids"])

    return run


def _gather(starts: np.ndarray, counts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The runs values[start : start + count], one after the other."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - counts), counts) + np.arange(total)]


def encode(docs: DataFrame, rank_path: str, pattern: str, buckets: int | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, ids: the token ids of each whole text as little-endian unsigned 32-bit integers.

    No special tokens. Null and empty texts have no ids. Each input row gives one row, repeated ones and rows without
    doc_id too; an empty table gives none. Other columns of docs, whatever their names, are not read. A very long text is
    one row of one block. Nothing is ranked, so there are no ties: equal texts have equal ids.
    """
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(ranks(rank_path))
    blocks = _bucketed(_blocks(docs, pattern, buckets or bucket_count(docs)), "block")
    listed = blocks.where("bucket is not null").select("block", "bucket", "words", "lengths")
    encoded = listed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_encode_words(vocabulary), "block long, bucket int, counts binary, ids binary")

    def assemble(own: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        listed = own[own.bucket.notna()]
        places = dict(zip(listed.bucket.astype(int), listed.places, strict=True))
        n = sum(len(p) // 4 for p in places.values())
        starts, counts, base, values = np.zeros(n, np.int64), np.zeros(n, np.int64), 0, []
        for bucket, c, ids in zip(words.bucket, words["counts"], words.ids, strict=True):
            at, c, ids = np.cumsum(_from_planes(places[int(bucket)]), dtype=np.int64), _from_planes(c).astype(np.int64), _from_planes(ids)
            counts[at] = c
            starts[at] = base + np.cumsum(c) - c
            base += len(ids)
            values.append(ids)
        flat = np.concatenate(values) if values else np.zeros(0, "<u4")
        docs_of = own[own.bucket.isna()]
        out = []
        for data in docs_of.codes:
            codes = _from_planes(data)
            out.append(_gather(starts[codes], counts[codes], flat).astype("<u4").tobytes())
        return pd.DataFrame({"doc_id": docs_of.doc_id.astype("Int64"), "ids": pd.Series(out, index=docs_of.index, dtype=object)})

    own = blocks.select("block", "doc_id", "codes", "bucket", "places")
    return own.groupBy("block").cogroup(encoded.groupBy("block")).applyInPandas(assemble, "doc_id long, ids binary")


def decode(encoded: DataFrame, rank_path: str) -> DataFrame:
    """encoded (doc_id, ids) -> also decoded, the bytes of the ids.

    The token-byte table has a fixed, checked size, so each task holds it and joins the ids with it by position;
    an id that is not in the table is an error. Empty ids give empty bytes; null ids are an error, as encode() makes none.
    One row for each row, repeated ones and those without doc_id too; an empty table gives none; other columns are dropped.
    """
    table = encoded.sparkSession.sparkContext.broadcast(ranks(rank_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(table.value.values(), default=-1) + 1
        tokens: list[bytes | None] = [None] * size
        for t, i in table.value.items():
            tokens[i] = t
        for batch in common.pieces(batches, column="ids"):
            out = [b"".join(map(tokens.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")
