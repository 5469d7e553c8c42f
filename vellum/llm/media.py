"""Media columns in a store of content-defined chunks.

A text becomes a payload of whole 576-byte frames, stored as 8-bit mono PCM in a WAV container. A rolling gear hash cuts
the media into chunks, so equal stretches give equal chunks wherever they begin. Chunk digests, never bytes, are joined
to find each chunk's owner, the first media that has it; a media's store row holds the chunks that it owns. Reading
back, media that own all their chunks are put together where they lie; the others fetch theirs by digest. Every chunk
is verified, then the whole media, before anything is computed from it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import common

FRAME = 576
RATE = 16_000
HEADER = 44
LEAST, BITS, MOST = 1_024, 12, 32_768
#: Notes on which media share chunks are broadcast up to so many bytes, else joined by shuffling.
BROADCAST_BYTES = 32 << 20
#: A key is hot if it has over one in HOT_SHARE of all rows, and HOT_ROWS at least: there are at most HOT_SHARE hot keys.
HOT_SHARE, HOT_ROWS = 10_000, 1_000
#: Parts in which ids look up what many of them share.
SALT = 16
_GEAR = np.random.default_rng(576).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 of the text, filled up with bytes 255 to a positive multiple of the frame, and its length before that."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\xff" * (max(FRAME, -(-len(data) // FRAME) * FRAME) - len(data)), len(data)


def wav(samples: bytes) -> bytes:
    """A WAV file of unsigned 8-bit mono samples."""
    pad = b"\0" * (len(samples) % 2)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples)) + samples + pad


def samples(media: bytes) -> bytes:
    """The samples of a file that wav() wrote."""
    riff, _, kind, _, _, code, channels, _, _, _, bits, _, n = struct.unpack("<4sI4s4sIHHIIHH4sI", media[:HEADER])
    if (riff, kind, code, channels, bits) != (b"RIFF", b"WAVE", 1, 1, 8) or len(media) != HEADER + n + n % 2:
        raise ValueError("not an 8-bit mono WAV file")
    return media[HEADER : HEADER + n]


def feature(sound: bytes) -> str:
    """Mean, root mean square about the middle, peak and sign changes of the samples."""
    x = np.frombuffer(sound, np.uint8).astype(np.int64) - 128
    if not len(x):
        return "mean=0;rms=0;peak=0;crossings=0"
    return f"mean={int(x.sum()) // len(x)};rms={int(np.sqrt(int((x * x).sum()) / len(x)))};peak={int(np.abs(x).max())};crossings={int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))}"


def cuts(data: bytes, least: int = LEAST, bits: int = BITS, most: int = MOST) -> list[int]:
    """Ends of the chunks: where the low bits of the gear hash of the last bytes are zero, `least` to `most` bytes apart."""
    n = len(data)
    if n <= least:
        return [n]
    # Only the last `bits` bytes reach the low bits: sums of 1, 2, 4, ... shifted bytes by doubling, then the rest.
    h, width = _GEAR[np.frombuffer(data, np.uint8)], 1
    single = h
    with np.errstate(over="ignore"):
        while width < bits:
            step = min(width, bits - width)
            if step == width:
                more = h
            else:
                more = single.copy()
                for _ in range(step - 1):
                    nxt = single.copy()
                    nxt[1:] += more[:-1] << np.uint32(1)
                    more = nxt
            # The earlier bytes stand `width` places further left.
            grown = h.copy()
            grown[width:] += more[:-width] << np.uint32(width)
            h, width = grown, width + step
    marks = np.flatnonzero((h & np.uint32((1 << bits) - 1)) == 0) + 1
    out, start = [], 0
    while n - start > least:
        i = np.searchsorted(marks, start + least)
        end = min(int(marks[i]) if i < len(marks) else n, start + most, n)
        out.append(end)
        start = end
    if start < n:
        out.append(n)
    return out


def chunks(media: bytes) -> list[bytes]:
    ends = cuts(media)
    return [media[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def digest(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:16]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text", F.unhex(F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)).alias("key"))


def recipes(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, key (digest of the text), n_bytes, media_bytes, media_digest, chunk digests in order.

    A row for each row, repeated ones and those without doc_id too; null and empty texts are one frame of filling; very long
    texts are cut whole, one at a time. An empty table gives no rows; other columns, whatever their names, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            n, size, whole, lists = [], [], [], []
            for t in batch.column(1).to_pylist():
                data, length = payload(t)
                media = wav(data)
                n.append(length)
                size.append(len(media))
                whole.append(hashlib.sha256(media).hexdigest())
                lists.append([digest(c) for c in chunks(media)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(size, pa.int64()), pa.array(whole), pa.array(lists, pa.list_(pa.binary()))],
                ["doc_id", "key", "n_bytes", "media_bytes", "media_digest", "digests"],
            )

    return _keyed(docs).mapInArrow(run, "doc_id long, key binary, n_bytes long, media_bytes long, media_digest string, digests array<binary>")


def _notes(listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of media that have copies, share a chunk or repeat one: key, first doc_id, `borrowed` and `shared` positions; and all chunk places of borrowers.

    A place (key, at, digest) belongs to the first place of its digest by key and position. Copies fall together before
    anything is shuffled, and places look up owners under salts, so that a chunk that very many media hold gathers nowhere.
    """
    chosen = listed.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.first("digests").alias("digests"))
    chosen = common.durable(chosen, "media-chosen")
    first = chosen.select("key", "first", "copies")
    places = chosen.select("key", F.posexplode("digests").alias("at", "digest"))
    owners = places.groupBy("digest").agg(F.min(F.struct("key", "at")).alias("owner"), F.count("*").alias("uses")).where("uses > 1")
    owners = owners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    shared = places.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALT)).cast("int")).join(owners, ["digest", "salt"])
    own = (F.col("owner.key") == F.col("key")) & (F.col("owner.at") == F.col("at"))
    by_key = shared.groupBy("key").agg(F.array_sort(F.collect_set(F.when(~own, F.col("at")))).alias("borrowed"), F.array_sort(F.collect_set(F.when(own, F.col("at")))).alias("shared"))
    notes = first.join(by_key, "key", "left").where("copies > 1 or shared is not null or borrowed is not null")
    empty = F.array().cast("array<int>")
    notes = notes.select("key", "first", F.coalesce("borrowed", empty).alias("borrowed"), F.coalesce("shared", empty).alias("shared"))
    notes = common.durable(notes, "media-notes")
    borrowers = places.join(notes.where(F.size("borrowed") > 0).select("key"), "key", "left_semi")
    return notes, borrowers


def _hot(rows: DataFrame, key: str) -> DataFrame:
    """The keys with the most rows, at most HOT_SHARE of them whatever the table."""
    least = max(HOT_ROWS, rows.count() // HOT_SHARE)
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where(F.col("n") > least).select(key, F.col("first").alias("hot_first"))


def store(docs: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Write the chunk store; its rows (key, whole, chunks) and the places (key, at, digest) that are filled from others.

    Of copies only the first by doc_id is stored. Copies of the few hot texts are dropped where they are read, so texts that
    are shuffled to their notes, which happens only where these are large, have no hot key. No documents, no rows.
    """
    notes, borrowers = _notes(listed)
    held = notes.agg(F.sum(F.size("borrowed") + F.size("shared")).alias("places"), F.count("*").alias("n")).first()
    small = 4 * (held.places or 0) + 64 * held.n <= BROADCAST_BYTES
    rows = _keyed(docs).join(F.broadcast(_hot(listed, "key").withColumn("hot", F.lit(True))), "key", "left").where("hot is null or hot_first <=> doc_id").drop("hot", "hot_first")
    rows = rows.join(F.broadcast(notes) if small else notes, "key", "left").where("borrowed is null or first <=> doc_id").select("key", "text", "borrowed", "shared")
    kind = pa.list_(pa.struct([("at", pa.int32()), ("digest", pa.binary()), ("data", pa.binary()), ("wanted", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            lists, whole = [], []
            for t, borrowed, shared in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                away, asked = set(borrowed or ()), set(shared or ())
                cut = chunks(wav(payload(t)[0]))
                lists.append([{"at": i, "digest": digest(c), "data": c, "wanted": bool(away) or i in asked} for i, c in enumerate(cut) if i not in away])
                whole.append(not away)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(whole, pa.bool_()), pa.array(lists, kind)], ["key", "whole", "chunks"])

    written = rows.mapInArrow(run, "key binary, whole boolean, chunks array<struct<at:int,digest:binary,data:binary,wanted:boolean>>")
    return common.durable(written, "media-store"), borrowers


def _verified(parts: list[tuple[int, bytes, bytes]]) -> bytes:
    parts.sort(key=lambda p: p[0])
    if [p[0] for p in parts] != list(range(len(parts))) or any(digest(data) != d for _, d, data in parts):
        raise ValueError("a chunk is missing or differs from its digest")
    return b"".join(data for *_, data in parts)


def _described(media: bytes) -> tuple:
    sound = samples(media)
    return len(sound), hashlib.sha256(sound).hexdigest(), zlib.crc32(sound[-32:]), hashlib.sha256(media).hexdigest(), feature(sound)


def read(stored: DataFrame, borrowers: DataFrame) -> DataFrame:
    """Put all media together again -> key, payload_bytes, payload_sha256, tail_crc32, media_sha256, feature; each key once.

    Every chunk is held to its digest; one that is missing or differs is an error, never a shorter result. Chunks that very
    many media hold are fetched in parts. A task holds one media at a time, however long. An empty store gives no rows.
    """
    fields = "key binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, feature string"
    names = ["key", "payload_bytes", "payload_sha256", "tail_crc32", "media_sha256", "feature"]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_described(_verified([(c["at"], c["digest"], c["data"]) for c in x])) for x in batch.column(1).to_pylist()]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c) for c in zip(*found, strict=True)], names)

    def fetched(frame: pd.DataFrame) -> pd.DataFrame:
        media = _verified(list(zip(frame["at"].tolist(), frame.digest, frame.data, strict=True)))
        return pd.DataFrame([(frame.key.iloc[0], *_described(media))], columns=names)

    wanted = stored.select(F.explode("chunks").alias("c")).where("c.wanted").select("c.digest", "c.data").dropDuplicates(["digest"])
    # Borrowed places have no doc_id; hot digests are few, their chunks are repeated under salts.
    hot = F.broadcast(_hot(borrowers.withColumn("doc_id", F.lit(0)), "digest").select("digest", F.lit(True).alias("hot")))
    salts = lambda n: F.when(F.col("hot"), F.lit(n)).otherwise(F.lit(1))
    asked = borrowers.join(hot, "digest", "left").withColumn("salt", F.pmod(F.xxhash64("key"), salts(16 * SALT)).cast("int")).drop("hot")
    wanted = wanted.join(hot, "digest", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts(16 * SALT) - 1))).drop("hot")
    away = asked.join(wanted, ["digest", "salt"]).drop("salt").groupBy("key").applyInPandas(fetched, fields)
    return stored.where("whole").select("key", "chunks").mapInArrow(local, fields).unionByName(away).dropDuplicates(["key"])


def media_columns(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    All but the counts of bytes come from the media read back, whose digest must equal the one taken before storing.
    Null texts are empty ones: a frame of bytes 255. Equal texts share their media, whichever copy is stored; ties between
    copies go to the smallest doc_id, none before any. Each input row gives one row, repeated ones and those without doc_id
    too; very long texts are whole; an empty table gives no rows. Other columns, whatever their names, are not read.
    """
    listed = common.durable(recipes(docs), "media-recipes")
    back = read(*store(docs, listed))
    hot = common.durable(_hot(listed, "key").where("hot_first is not null"), "media-hot")
    back = common.durable(back, "media-back")
    rows = listed.select("doc_id", "key", "n_bytes", "media_bytes", "media_digest").join(F.broadcast(hot), "key", "left").withColumn("hot", F.col("hot_first").isNotNull())
    # What many rows share is a few hundred bytes for each of a bounded number of texts.
    few = F.broadcast(back.join(F.broadcast(hot), "key", "left_semi"))
    whole = rows.where("hot").join(few, "key", "left").unionByName(rows.where("NOT hot").join(back, "key", "left"))
    checked = F.when(F.col("media_sha256") == F.col("media_digest"), F.col("media_sha256")).otherwise(F.raise_error(F.lit("media read back differ from those stored")))
    return whole.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", checked.cast("string").alias("media_sha256"), "feature")
