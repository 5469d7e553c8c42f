"""WARC archives: one gzip member for each record, written by tasks and read back sequentially.

Payload digests find records with equal payloads; all but the first become revisit records without payload. Each task
writes archives of bounded size to the shared folder and returns their names; only names of finished tasks are listed.
The reader decompresses a member step by step, frames the block by its Content-Length and verifies its digests.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import common

#: Payloads below this size are never replaced by a revisit.
LEAST_REVISIT = 100
ARCHIVE_BYTES = 64 << 20
#: Pages that share a payload look up its first page in so many parts.
SALT = 16
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_READ = 1 << 16


def with_revisits(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, payload, payload_digest, refers_to (null: a response record).

    A null html is an empty payload. Rows that repeat the smallest page_id of a payload are all responses; a null page_id
    is never referred to. One row for each row; an empty table gives none; other columns, whatever their names, are not
    read. Payloads meet their notes by page_id and digest; by digest alone only ids are joined, salted, so that a
    payload that very many pages share gathers nowhere. Few notes are broadcast by Spark, which knows their table's size.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload")).withColumn("payload_digest", F.sha2("payload", 256))
    ids = rows.where(F.octet_length("payload") >= LEAST_REVISIT).select("page_id", "payload_digest")
    first = ids.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("payload_digest", "first")
    salted = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    notes = ids.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALT)).cast("int")).join(salted, ["payload_digest", "salt"])
    notes = notes.where("page_id is null or page_id <> first").select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), "first").distinct()
    notes = common.durable(notes, "revisits")
    joined = rows.join(notes, rows["page_id"].eqNullSafe(notes["_id"]) & (rows["payload_digest"] == notes["_digest"]), "left")
    return joined.select("page_id", "url", "payload", "payload_digest", F.col("first").alias("refers_to"))


def record_id(page_id: int | None, serial: str) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:page:none:{serial}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, serial: str = "") -> bytes:
    """A response record, or a revisit without the payload, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, serial)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or 'about:blank', safe=';/?:@&=+$,#%[]!*()~-._')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to, '')}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder as a URI of the file system that Spark itself finds it on, so that a path without scheme is no local one on a cluster."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"file://{uri[5:]}" if uri.startswith("file:/") and not uri.startswith("file://") else uri


def write(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write with_revisits() rows as .warc.gz files under the folder, which all executors reach; -> path, records, size of each.

    Every row is a record: null and odd URLs are quoted, a null page_id gets a name from its place. A payload is held whole,
    one at a time. Repeated rows are records of their own. An empty table writes no archive. Other columns are not read.
    """

    folder = qualified(pages.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root)
        out = path = None
        records = size = serial = 0

        def close():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "size"])

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out, records, size = system.open_output_stream(path, compression=None), 0, 0
                serial += 1
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = record(row["page_id"], row["url"], row["payload"], row["payload_digest"], row["refers_to"], f"{path}:{serial}")
                data = packer.compress(data) + packer.flush()
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    rows = pages.select("page_id", "url", "payload", "payload_digest", "refers_to")
    return rows.mapInArrow(run, "path string, records long, size long")


class Damaged(ValueError):
    """An archive whose framing or digests are wrong."""


def members(stream) -> Iterator[bytes]:
    """The content of each gzip member of a stream, read and inflated in steps; memory is bounded by the largest record."""
    left = b""
    while True:
        left = left or stream.read(_READ)
        if not left:
            return
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if not left and not (left := stream.read(_READ)):
                raise Damaged("the last gzip member is cut short")
            try:
                parts.append(inflate.decompress(left))
            except zlib.error as e:
                raise Damaged(str(e)) from e
            left = inflate.unused_data
        yield b"".join(parts)


def parse(data: bytes) -> dict:
    """Headers and payload of a record; the lengths and digests that it states are verified."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise Damaged("no WARC header")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise Damaged("the block is not as long as its Content-Length")
    block = rest[:n]
    if fields["warc-block-digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
        raise Damaged("wrong block digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    said = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    if fields["warc-type"] == "response" and (len(payload) != said or fields["warc-payload-digest"] != "sha256:" + hashlib.sha256(payload).hexdigest()):
        raise Damaged("wrong payload")
    return fields | {"payload": payload if fields["warc-type"] == "response" else None, "payload_bytes": said}


def _page(text: str | None) -> int | None:
    tail = (text or "").removeprefix("<urn:page:").removesuffix(">")
    return int(tail) if tail.lstrip("-").isdigit() else None


def read(archives: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """archives (path) -> page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload (null for revisits or if not asked for).

    A row for each record, in no order; no archives, no rows. Empty payloads come back empty, not null. Damaged archives are
    an error, never a shorter result.
    """
    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    folder = qualified(archives.sparkSession, folder)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with system.open_input_stream(path, compression=None) as stream:
                    rows, held = [], 0
                    for data in members(stream):
                        r = parse(data)
                        digest = r["warc-payload-digest"].removeprefix("sha256:")
                        rows.append((_page(r["warc-record-id"]), r["warc-target-uri"], r["warc-type"], _page(r.get("warc-refers-to")), digest, r["payload_bytes"], r["payload"] if payloads else None))
                        held += len(data) if payloads else 200
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return archives.select("path").repartition(n).mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")


def resolved(records: DataFrame) -> DataFrame:
    """read() rows with payload_digest and payload_bytes of revisits taken from the response that they refer to.

    Revisits look up their response under salts, so that a page with very many copies gathers nowhere; only responses that
    are referred to are repeated. A row for each row; no records, no rows.
    """
    asked = records.where("record_type = 'revisit'").select("refers_to").distinct()
    responses = records.where("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("refers_to")).agg(F.max(F.struct("payload_digest", "payload_bytes")).alias("of"))
    own = records.select("page_id", "record_type", "refers_to", "payload_digest", "payload_bytes")
    responses = responses.join(asked, "refers_to", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    revisits = own.where("record_type = 'revisit'").withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALT)).cast("int")).join(responses, ["refers_to", "salt"], "left")
    checked = F.when(F.col("of.payload_digest") == F.col("payload_digest"), F.col("of.payload_bytes")).otherwise(F.raise_error(F.lit("a revisit's response is missing or differs")))
    revisits = revisits.select("page_id", "record_type", "refers_to", "payload_digest", checked.cast("long").alias("payload_bytes"))
    return own.where("record_type = 'response'").unionByName(revisits)


def archive(pages: DataFrame, label: str = "warc") -> tuple[DataFrame, str]:
    """Write pages to a new folder under the shared one; the list of archives and the folder."""
    folder = common.scratch_path(pages.sparkSession, label)
    return common.durable(write(with_revisits(pages), folder), f"{label}-list"), folder
