"""The span table of a document: its size, its slices, and documents that the parser rejects."""

import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from vellum.functions import html
from vellum.operators import evergreen, length, seo, sources, structure
from vellum.plans import evaluate

BROKEN = ["<p>a</p><![foo[bar]]>", "<![ %foo; [x]]><h2>b</h2>"]


@pytest.mark.parametrize("tag", ["<p>", "<p><b>", "<h2>", "<div><p>", "<ul><li>"])
def test_unclosed_tags_take_time_and_memory_in_proportion(tag):
    def cost(n):
        content = "".join(f"{tag}some words here {i}</i>" for i in range(n))
        tracemalloc.start()
        html.tokenize("x")
        began = time.perf_counter()
        tree = html.tokenize(content)
        took = time.perf_counter() - began
        size = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return took, size, tree

    _, small, _ = cost(1_000)
    took, large, tree = cost(8_000)
    assert large < 11 * small
    assert took < 5
    assert len(tree["pieces"]) == 8_000
    assert (tree["elements"][0]["first"], tree["elements"][0]["end"]) == (0, 8_000)


def test_table_of_unclosed_paragraphs_is_small(spark):
    content = "<p>some words and again words xxx" * 8_000
    page = spark.createDataFrame([(content,)], "c string").select(html.parse(F.col("c")).alias("p"))
    r = page.select(F.size("p.elements").alias("n"), F.length(F.to_json("p")).alias("size"), F.length(html.body(F.col("p"))).alias("text"), html.introduction(F.col("p"), F.lit(-1), ("p",)).alias("intro")).first()
    assert r.n == 8_000
    assert r.size < 5_000_000
    assert r.text == len(r.intro) == len(" ".join(content.replace("<p>", " ").split()))


def test_slices_are_the_texts_of_elements(spark):
    content = "<div> a <b>b &amp; &amp;nbsp; c</b><script>no</script>d<ul><li>e<li>f</ul></div>g<i> </i>"
    page = spark.createDataFrame([(content,)], "c string").select(html.parse(F.col("c")).alias("p"))
    found = page.select(F.transform("p.elements", lambda e: F.struct(e["tag"], html.text_of(F.col("p"), e))).alias("x"), html.body(F.col("p")).alias("body"), F.col("p.error")).first()
    assert [tuple(x) for x in found.x] == [("div", "a b & c d e f"), ("b", "b & c"), ("script", ""), ("ul", "e f"), ("li", "e f"), ("li", "f"), ("i", "")]
    assert (found.body, found.error) == ("a b & c d e f g", None)


def test_titles_for_further_reading():
    def flags(content):
        return [e["further"] for e in html.tokenize(content)["elements"] if e["tag"] == "a"]

    assert flags("<h2>Learn <b>more</b></h2><a>x</a><h3>Learn  more</h3><a>y</a><h2> LEARN&nbsp;more </h2><a>z</a><h2>learn more</h2><p><a>w</a>") == [True, False, False, True]
    assert flags("<h2>learn more<h2>other<a>x</a>") == [False]


def test_source_of_links_and_calls_to_action(spark):
    content = """<body><p class='lead  cta' data-x="a'b&quot;<">go <STRONG>now</strong> &lt;&eacute;<br><!-- c --></p><p class=ctas>no</p><A HREF=/x disabled title='say "hi"'>y &amp; z</a>"""
    page = spark.createDataFrame([(content, "")], "content string, organization_website string")
    cta = page.select(html.parse(F.col("content")).alias("p")).select(html.cta_signals(F.col("p"), ()).alias("c")).first().c
    assert [b.html for b in cta.cta_blocks] == ["""<p class="lead cta" data-x="a'b&quot;&lt;">go <strong>now</strong> &lt;é<br/><!-- c --></p>"""]
    assert [x.html for x in sources.extract(page).first().links] == ["""<a href="/x" disabled="" title='say "hi"'>y &amp; z</a>"""]


@pytest.mark.parametrize("content", BROKEN)
def test_a_document_that_cannot_be_parsed_is_data(spark, content):
    rows = spark.createDataFrame([(1, content), (2, "<p>fine</p>"), (3, None)], "id int, c string")
    found = {r.id: r for r in rows.select("id", html.parse(F.col("c")).alias("p"), evergreen.temporal_references(F.col("c"), F.lit("fr-FR"), F.array().cast("array<string>")).alias("r")).collect()}
    assert found[1].p.error.startswith("html_parse_error:")
    assert (found[1].p.elements, found[1].r) == ([], None)
    assert (found[2].p.error, found[2].p.pieces, found[2].r) == (None, ["fine"], [])
    assert (found[3].p.error, found[3].p.pieces) == (None, [])


def test_links_within_links_beyond_the_bound_are_an_error(monkeypatch):
    monkeypatch.setattr(html, "MOST_SOURCE", 10_000)
    assert html.tokenize("<a>x" * 200)["error"] == "html_parse_error:OverflowError"
    assert html.tokenize("<a>x</a>" * 200)["error"] is None


REQUEST = (
    "request_id string, content string, enabled_judges array<string>, content_type string, expected_length string, locale string, organization_website string, funnel_stage string,"
    "main_keyword string, secondary_keywords array<string>, long_tail_keywords array<string>, expected_outline_html string, require_sources boolean"
)


@pytest.mark.parametrize("content", BROKEN)
def test_judges_report_a_parse_error_and_leave_other_rows_whole(spark, content):
    row = lambda name, c: (name, c, None, "articles", "MEDIUM", "fr-FR", "https://me.fr", "DECISION", "x", [], [], "<h2>b</h2>", False)
    good = "<p>a</p><h2>b</h2>"
    found = {r.evaluation_id: r for r in evaluate.evaluate(spark.createDataFrame([row("bad", content), row("good", good)], REQUEST)).collect()}
    alone = evaluate.evaluate(spark.createDataFrame([row("good", good)], REQUEST)).first()
    assert found["good"] == alone
    assert not found["good"].errors
    assert {(e.dimension, e.error.split(":")[0]) for e in found["bad"].errors} == {(j, "html_parse_error") for j in ("length", "seo", "structure", "sources")}
    assert [x.dimension for x in found["bad"].results if x.error is None] == ["typography"]
    assert found["bad"].summary == "Global evaluation completed with some technical errors."


def test_context_errors_come_before_parse_errors(spark):
    rows = spark.createDataFrame([("", BROKEN[0])], "expected_outline_html string, content string")
    assert structure.judge(rows).first().structure.error == "missing_expected_outline_html"
    broken_outline = spark.createDataFrame([(BROKEN[1], "<p>a</p>")], "expected_outline_html string, content string")
    assert structure.judge(broken_outline).first().structure.error.startswith("html_parse_error:")
    counted = spark.createDataFrame([(3, None, "SIMPLE", "x")], "word_count int, content_type string, expected_length string, parse_error string")
    assert length.judge(counted).first().length.error == "missing_content_type"


def test_keyword_signals_of_a_broken_document_are_empty(spark):
    df = spark.createDataFrame([(BROKEN[0], "a", ["b"], ["c"])], "content string, main_keyword string, secondary_keywords array<string>, long_tail_keywords array<string>")
    r = seo.lexical(df).first()
    assert (r.lexical_body, r.lexical_parse_error.split(":")[0]) == (0, "html_parse_error")
