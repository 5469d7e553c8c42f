"""Company exports: archives of JSON documents as tables, and evaluation requests built from them."""

from __future__ import annotations

import contextlib
import io
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import links
from vellum.plans import scratch

#: Folders of an export.
FOLDERS = ("organization", "topic", "content", "contentVersion", "plan", "persona", "theme")
#: Characters of documents after which a batch of them leaves the reader.
BATCH_CHARS = 4 << 20
#: Bytes of an archive's documents that a task reads, on average.
SHARE_BYTES = 32 << 20
#: Tasks that read archives; more shares than these are dealt among them.
MOST_TASKS = 100_000
#: Judges that such a request asks for, in order.
JUDGES = ("length", "typography", "seo", "structure", "sources")


def _document(data: bytes) -> str | None:
    """An entry's JSON text if it holds an object, else null."""
    try:
        document = json.loads(data.decode())
    except ValueError:
        return None
    return json.dumps(document, ensure_ascii=False) if isinstance(document, dict) else None


def _wanted(name: str, folders: tuple[str, ...]) -> bool:
    return name.endswith(".json") and name.split("/", 1)[0] in folders


def _uri(path: str) -> str:
    """Spark's name of a local file, with as many slashes as other readers expect."""
    return f"file://{path[5:]}" if path.startswith("file:/") and not path.startswith("file://") else path


def _seekable(path: str) -> bool:
    """Whether tasks can open the file themselves; stores that only Spark's readers know can't be sought in."""
    from pyarrow import fs

    try:
        system, inner = fs.FileSystem.from_uri(_uri(path))
        return system.get_file_info(inner).type == fs.FileType.File
    except (pa.ArrowException, OSError):
        return False


@contextlib.contextmanager
def _opened(path: str, source) -> Iterator[zipfile.ZipFile]:
    try:
        opened = zipfile.ZipFile(source)
    except zipfile.BadZipFile as e:
        raise ValueError(f"{path} is not a ZIP archive") from e
    with opened:
        yield opened


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """(archive, folder, entry, document) in batches of a bounded number of characters."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= BATCH_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], ["archive", "folder", "entry", "document"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], ["archive", "folder", "entry", "document"])


def _split(files: DataFrame, folders: tuple[str, ...], share_bytes: int) -> DataFrame:
    """files (path) -> documents: one job lists the entries from the archives' directories, then tasks seek and read shares of them."""
    from pyarrow import fs

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, inner = fs.FileSystem.from_uri(_uri(path))
                with system.open_input_file(inner) as source, _opened(path, source) as archive:
                    rows, size = [], 0
                    for i, entry in enumerate(archive.infolist()):
                        if _wanted(entry.filename, folders):
                            rows.append((path, i, size // share_bytes))
                            size += entry.file_size
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "entry", "share"])

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            by_path: dict[str, list[int]] = {}
            for path, entry in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_path.setdefault(path, []).append(entry)
            for path, entries in by_path.items():
                system, inner = fs.FileSystem.from_uri(_uri(path))
                with system.open_input_file(inner) as source, _opened(path, source) as archive:
                    infos = archive.infolist()
                    for i in entries:
                        document = _document(archive.read(infos[i]))
                        if document is not None:
                            yield path, infos[i].filename.split("/", 1)[0], i, document

    shares = files.select("path").repartition("path").mapInArrow(listed, "path string, entry long, share long")
    # As many tasks as shares: their rows are few bytes, by which alone Spark would put them into one.
    shares = scratch.durable(shares, "archive-entries")
    tasks = min(MOST_TASKS, max(1, shares.select("path", "share").distinct().count()))
    dealt = shares.repartition(tasks, "path", "share").sortWithinPartitions("path", "entry").select("path", "entry")
    return dealt.mapInArrow(lambda batches: _batches(rows_of(batches)), "archive string, folder string, entry long, document string")


def read_zip(spark: SparkSession, path: str, folders: tuple[str, ...] = FOLDERS, share_bytes: int = SHARE_BYTES) -> DataFrame:
    """Archives under a path -> archive, folder, entry (its place), document (JSON text of an object).

    Entries other than JSON, outside the folders, undecodable or not objects are left out; a file that is no archive is an
    error. Directories are listed when this is called; an archive of any size is then read in shares of about `share_bytes`, each by a task that seeks in it, and never as a
    whole; only in stores that tasks can't open themselves is an archive one value of Spark's reader (2 GB at most).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    first = files.select("path").first()
    if first is None or _seekable(first.path):
        return _split(files, folders, share_bytes)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with _opened(archive, io.BytesIO(content)) as opened:
                    for i, name in enumerate(opened.namelist()):
                        document = _document(opened.read(name)) if _wanted(name, folders) else None
                        if document is not None:
                            yield archive, name.split("/", 1)[0], i, document

    return files.select("path", "content").mapInArrow(lambda batches: _batches(rows_of(batches)), "archive string, folder string, entry long, document string")


def _field(path: str) -> Column:
    return F.get_json_object("document", f"$.{path}")


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def latest(df: DataFrame, keys: list[str], created: str, entry: str) -> DataFrame:
    """The row of each key with the largest creation date, as text; of equal ones the first entry."""
    return first_by(df, keys, [F.col(created).desc_nulls_last(), F.col(entry)])


def clean_html(body: Column) -> Column:
    """An exported body without the quotes around it and with its escapes undone."""
    bare = F.trim(body)
    bare = F.when(bare.rlike(r'(?s)^".*"$') & (F.length(bare) > 1), F.substr(bare, F.lit(2), F.length(bare) - 2)).otherwise(bare)
    return F.replace(F.replace(F.replace(bare, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\\/"), F.lit("/"))


def website(url: Column, default: str) -> Column:
    return F.when(F.coalesce(F.trim(url), F.lit("")) == "", F.lit(default)).otherwise(links.origin(F.trim(url)))


def contents(documents: DataFrame) -> DataFrame:
    """archive, uuid and title (or uuid) of each content that has a uuid."""
    rows = documents.where("folder = 'content'").select("archive", "entry", _field("uuid").alias("uuid"), _field("data.title").alias("title"))
    return rows.where("coalesce(uuid, '') <> ''").select("archive", "entry", "uuid", F.coalesce(F.nullif("title", F.lit("")), "uuid").alias("title"))


def requests(documents: DataFrame, default_website: str = "") -> DataFrame:
    """An evaluation request for each content of an export, from its latest version, its topic and its organization."""
    key = ["archive", "uuid"]
    kept = lambda folder: documents.where(F.col("folder") == folder)
    body = first_by(kept("content").withColumn("uuid", _field("uuid")).where("coalesce(uuid, '') <> ''"), key, [F.col("entry")])
    body = body.select("archive", "uuid", _field("data.topicId").alias("topic"), _field("data.body").alias("body"), _field("data.principalKeyword").alias("keyword"))
    version = kept("contentVersion").select("archive", "entry", _field("data.contentId").alias("uuid"), _field("traceability.creationDate").alias("created"), _field("data.body").alias("outline"))
    version = latest(version, key, "created", "entry").select("archive", "uuid", "outline")
    topic = first_by(kept("topic").withColumn("topic", _field("uuid")), ["archive", "topic"], [F.col("entry")])
    topic = topic.select("archive", "topic", _field("data.contentType").alias("kind"), _field("data.length").alias("length"), _field("data.funnelStage").alias("stage"), _field("data.evergreen").cast("boolean").alias("evergreen"))
    organization = kept("organization").groupBy("archive").agg(F.min_by("document", "entry").alias("document")).select("archive", _field("data.identity.website").alias("site"))
    joined = body.join(version, key, "left").join(topic, ["archive", "topic"], "left").join(organization, "archive", "left")
    default = lambda c, value: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(value))
    none = F.array().cast("array<string>")
    return joined.select(
        F.col("uuid").alias("request_id"), clean_html(F.coalesce("body", F.lit(""))).alias("content"), F.array(*map(F.lit, JUDGES)).alias("enabled_judges"),
        default("kind", "articles").alias("content_type"), default("length", "MEDIUM").alias("expected_length"), default("stage", "AWARENESS").alias("funnel_stage"),
        F.lit("fr-FR").alias("locale"), website(F.col("site"), default_website).alias("organization_website"), F.coalesce("keyword", F.lit("")).alias("main_keyword"),
        none.alias("secondary_keywords"), none.alias("long_tail_keywords"), F.lit(True).alias("require_sources"), clean_html(F.coalesce("outline", F.lit(""))).alias("expected_outline_html"),
        F.col("evergreen").alias("evergreen_required"),
    )
