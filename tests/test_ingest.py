import json
import zipfile

import pytest
from pyspark.sql import functions as F

from vellum.functions import text
from vellum.operators import length, typography
from vellum.sources import company_export, text_files
from vellum.streaming import judges


@pytest.fixture
def export(tmp_path):
    def doc(uuid=None, created=None, **data):
        return json.dumps({"uuid": uuid, "traceability": {"creationDate": created}, "data": data})

    path = tmp_path / "export" / "one.zip"
    path.parent.mkdir()
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("organization/b.json", doc("o1", identity={"website": "https://me.fr/path?x"}))
        z.writestr("organization/a.json", doc("o2", identity={"website": "https://other.fr"}))
        z.writestr("content/1.json", doc("c1", topicId="t1", body='"<p class=\\"x\\">a\\/b</p>"', principalKeyword="key", title="T"))
        z.writestr("content/2.json", doc("c2", topicId="none", body="<p>two</p>"))
        z.writestr("content/3.json", doc("", body="no uuid"))
        z.writestr("topic/1.json", doc("t1", contentType="quiz", length="LONG", funnelStage="", evergreen=True))
        z.writestr("contentVersion/1.json", doc("v1", "2024-01-02", contentId="c1", body="<h2>first of two</h2>"))
        z.writestr("contentVersion/2.json", doc("v2", "2024-01-02", contentId="c1", body="<h2>second</h2>"))
        z.writestr("contentVersion/3.json", doc("v3", "2023-12-31", contentId="c1", body="<h2>old</h2>"))
        z.writestr("content/bad.json", "{")
        z.writestr("content/list.json", "[1]")
        z.writestr("content/bytes.json", b"\xff\xfe")
        z.writestr("elsewhere/1.json", doc("x"))
        z.writestr("content/readme.txt", "no")
    return path


@pytest.mark.parametrize("batch_chars", [4 << 20, 1])
def test_requests_of_an_export(spark, export, batch_chars, monkeypatch):
    monkeypatch.setattr(company_export, "BATCH_CHARS", batch_chars)
    documents = company_export.read_zip(spark, str(export.parent))
    assert documents.count() == 9
    found = {r.request_id: r for r in company_export.requests(documents, "https://default.example").collect()}
    a, b = found["c1"], found["c2"]
    assert (a.content, a.expected_outline_html, a.content_type, a.expected_length, a.funnel_stage) == ('<p class="x">a/b</p>', "<h2>first of two</h2>", "quiz", "LONG", "AWARENESS")
    assert (a.organization_website, a.main_keyword, a.evergreen_required, a.require_sources) == ("https://me.fr", "key", True, True)
    assert (b.content_type, b.expected_length, b.expected_outline_html, b.main_keyword) == ("articles", "MEDIUM", "", "")
    assert [(r.uuid, r.title) for r in company_export.contents(documents).orderBy("uuid").collect()] == [("c1", "T"), ("c2", "c2")]


def test_no_archive_is_an_error(spark, tmp_path):
    (tmp_path / "x.zip").write_bytes(b"text")
    with pytest.raises(Exception, match="not a ZIP"):
        company_export.read_zip(spark, str(tmp_path)).collect()


def test_text_files_and_keywords(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("été ".encode() + b"\xff")
    assert text_files.read_texts(spark, str(tmp_path)).first().content == "été �"
    df = spark.createDataFrame([(" a \r\n\n b\nc",)], "k string").select(text_files.keywords(F.col("k")).alias("k"))
    assert df.first().k == ["a", "b", "c"]


def test_reports_are_written(spark, tmp_path):
    text_files.write_reports(spark.createDataFrame([("a", 1)], "name string, n int"), str(tmp_path / "reports"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "reports")).select("name", "n").collect()] == [("a", 1)]


def test_website(spark):
    df = spark.createDataFrame([(None,), (" ",), ("https://a.b/c?d#e",), ("a.b/c",)], "u string").select(company_export.website(F.col("u"), "D").alias("w"))
    assert [r.w for r in df.collect()] == ["D", "D", "https://a.b", "a.b/c"]


def test_streams_give_the_batch_result(spark, tmp_path):
    schema = "content string, locale string, content_type string, expected_length string"
    rows = [("a  b", "fr-FR", "quiz", "LONG"), ("Quoi?", "fr-FR", "articles", "SIMPLE"), (None, None, None, None)]
    batch = spark.createDataFrame(rows, schema)
    batch.write.parquet(str(tmp_path / "in"))

    def judge(df):
        return length.judge(typography.judge(df.withColumn("word_count", text.word_count(text.visible_text(F.col("content"))))))

    query = judges.judge_stream(judges.read_requests(spark, str(tmp_path / "in"), schema), judge, str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination()
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(str, judge(batch).collect()))


def test_an_archive_is_read_by_several_tasks(spark, tmp_path):
    from vellum.sources import company_export

    with zipfile.ZipFile(tmp_path / "large.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(400):
            z.writestr(f"content/{i}.json", json.dumps({"uuid": str(i), "data": {"body": "x" * 500}}))
        z.writestr("other/1.json", "{}")
        z.writestr("content/bad.json", "{")
    read = company_export.read_zip(spark, str(tmp_path), share_bytes=20_000).withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r.entry for r in read) == list(range(400))
    assert {json.loads(r.document)["uuid"] for r in read} == {str(i) for i in range(400)}
    assert len({r.task for r in read}) > 1
    by_task = {}
    for r in read:
        by_task.setdefault(r.task, []).append(r.entry)
    assert all(x == sorted(x) for x in by_task.values())


def test_archives_that_tasks_cannot_open_come_whole(spark, tmp_path, monkeypatch):
    from vellum.sources import company_export

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("content/1.json", '{"uuid": "é"}')
        z.writestr("topic/2.json", "[1]")
    split = company_export.read_zip(spark, str(tmp_path)).collect()
    monkeypatch.setattr(company_export, "_seekable", lambda path: False)
    assert company_export.read_zip(spark, str(tmp_path)).collect() == split
    assert [(r.folder, r.entry, r.document) for r in split] == [("content", 0, '{"uuid": "é"}')]
    (tmp_path / "b.zip").write_text("no archive")
    for seekable in (True, False):
        monkeypatch.setattr(company_export, "_seekable", lambda path, s=seekable: s)
        with pytest.raises(Exception, match="is not a ZIP archive"):
            company_export.read_zip(spark, str(tmp_path)).collect()
