"""Golden cases of the judges: inputs written here, results as the rules demand."""

import json
import ssl

import pytest
from pyspark.sql import functions as F

from vellum.functions import html, links, rules, text
from vellum.operators import evergreen, length, seo, services, sources, structure, typography
from vellum.plans import evaluate

REQUEST = (
    "request_id string, content string, enabled_judges array<string>, content_type string, expected_length string, locale string, organization_website string, funnel_stage string, "
    "main_keyword string, secondary_keywords array<string>, long_tail_keywords array<string>, expected_outline_html string, require_sources boolean"
)


def one(spark, schema, row, f):
    return f(spark.createDataFrame([row], schema)).first()


@pytest.mark.parametrize(
    ("words", "status", "rule"),
    [(899, "fail", "length.too_short"), (900, "pass", "length.valid"), (2198, "pass", "length.valid"), (2199, "fail", "length.too_long")],
)
def test_length_bounds_are_inclusive(spark, words, status, rule):
    r = one(spark, "word_count int, content_type string, expected_length string", (words, "articles", "MEDIUM"), length.judge)
    assert (r.length.status, r.length.findings[0].rule_id, r.length.score) == (status, rule, 100 if status == "pass" else 0)


@pytest.mark.parametrize(
    ("kind", "size", "error"),
    [
        (None, "LONG", "missing_content_type"), ("poem", None, "missing_expected_length"), ("poem", "HUGE", "unsupported_content_type"), (" ", "LONG", "unsupported_content_type"),
        ("quiz", " ", "unsupported_expected_length"), ("quiz", "", "missing_expected_length"), ("quiz", "HUGE", "unsupported_expected_length"),
    ],
)
def test_length_context_errors(spark, kind, size, error):
    assert one(spark, "word_count int, content_type string, expected_length string", (5, kind, size), length.judge).length.error == error


def test_open_range_has_no_upper_bound(spark):
    assert one(spark, "word_count int, content_type string, expected_length string", (10**6, "quiz", "LONG"), length.judge).length.status == "pass"


def test_visible_text(spark):
    rows = [("<p>a&nbsp;b</p><script>x < y</script>c&amp;d", "a b c&d"), (None, ""), ("    ", ""), ("<style>p{}</style>x\n\ny", "x y")]
    found = spark.createDataFrame([r[:1] for r in rows], "c string").select(text.visible_text(F.col("c")).alias("t")).collect()
    assert [r.t for r in found] == [t for _, t in rows]


TYPO = [
    ("double_spaces", "a  b   c", 2), ("trailing_spaces", "a \nb\t\r\nc", 2), ("space_before_dot", "<b>x</b>. y .", 2), ("space_before_comma", "a , b,", 1),
    ("french_nbsp_before_double_punctuation", "a ! b? 10 % :", 3), ("multiple_punctuation", "wait... no!? ok.", 2), ("attached_links", "é<a href='x'>y</a> <a>z</a>", 1),
    ("repeated_line_breaks", "a<br><br/> <br />b<br>c", 1),
]


@pytest.mark.parametrize(("rule", "content", "n"), TYPO)
def test_typography_counts(spark, rule, content, n):
    assert spark.createDataFrame([(content,)], "c string").select(typography.count(F.col("c"), rule).alias("n")).first().n == n


@pytest.mark.parametrize(("content", "locale", "status", "score"), [("Rien à dire.", "fr-FR", "pass", 100), ("a  b", "fr-FR", "warn", 90), ("Quoi?", "fr-FR", "fail", 75), ("Quoi??  .", "fr-FR", "fail", 45), (None, "fr-FR", "pass", 100)])
def test_typography_judge(spark, content, locale, status, score):
    r = one(spark, "content string, locale string", (content, locale), typography.judge).typography
    assert (r.status, r.score) == (status, score)


def test_typography_locale_errors(spark):
    found = typography.judge(spark.createDataFrame([("x", None), ("x", "en-US")], "content string, locale string")).collect()
    assert [r.typography.error for r in found] == ["missing_locale", "unsupported_locale"]


OUTLINE = "<h2>One</h2><h3>Two</h3><h2>Three</h2>"
STRUCTURE = [
    (OUTLINE + "<p>text</p>", set()),
    ("<h3>Two</h3><h2>One</h2><h2>Three</h2>", {"heading_order", "heading_levels"}),
    ("<h2>One</h2><h2>Two</h2><h2>Three</h2>", {"heading_levels"}),
    ("<h2>One</h2><h3>Two</h3>", {"heading_order", "heading_levels", "heading_text", "no_removed_sections"}),
    (OUTLINE + "<h2>Learn more</h2><p><a>x</a></p>", set()),
    (OUTLINE + "<h2>Learn more</h2><h2>More</h2>", {"heading_order", "heading_levels", "heading_text", "no_added_sections"}),
    (OUTLINE + "<h1>t</h1><script>1</script><span>s</span>", {"no_h1_in_body", "allowed_tags_only", "no_scripts", "no_decorative_spans"}),
    (OUTLINE + "<p style='x'>a</p><table style='y'></table>", {"no_inline_styles_except_tables"}),
    (OUTLINE + "<p>a notebook</p>", {"no_internal_outline_comments_exposed"}),
]


@pytest.mark.parametrize(("content", "rules_found"), STRUCTURE)
def test_structure(spark, content, rules_found):
    r = one(spark, "expected_outline_html string, content string", (OUTLINE, content), structure.judge).structure
    assert {f.rule_id.split(".")[1] for f in r.findings} == (rules_found or {"valid"})
    assert (r.status, r.score) == (("fail", 0) if rules_found else ("pass", 100))


def test_structure_switches_and_errors(spark):
    df = spark.createDataFrame([(OUTLINE, OUTLINE + "<span>s</span>"), (" ", "x")], "expected_outline_html string, content string")
    found = structure.judge(df, enabled={"no_decorative_spans": False}).collect()
    assert [f.rule_id for f in found[0].structure.findings] == ["structure.allowed_tags_only"]
    assert found[1].structure.error == "missing_expected_outline_html"


PAGE = "<html><body><p>intro <b>bold</p><h2>A</h2><p>one</p>bare<ul><li>two</ul><h3>B</h3><div><h2>In</h2><p>deep</p></div><h2>conclusion</h2><blockquote>end</blockquote><!-- no --><script>var x = '</p>'</script></body></html>"


def test_document_tree(spark):
    df = evaluate.preprocess(spark.createDataFrame([(PAGE,), (None,), ("just text &amp; more",)], "content string"))
    page, none, bare = (r.signals for r in df.collect())
    assert [(h.level, h.text) for h in page.headings] == [("h2", "A"), ("h3", "B"), ("h2", "In"), ("h2", "conclusion")]
    assert page.introduction == "intro bold"
    assert page.conclusion == "end"
    assert [(s.h2, s.text) for s in page.h2_sections] == [("A", "one two B"), ("In", "deep"), ("conclusion", "end")]
    assert "var x" not in page.text
    assert page.has_script
    assert (none.text, none.is_empty, none.word_count) == ("", True, 0)
    assert bare.text == "just text & more"


def test_cta(spark):
    content = "<p class='lead cta'>Buy <strong>now</strong></p><div><p class='cta'>nested</p></div><h2>Learn more</h2><p>x</p>"
    c = evaluate.preprocess(spark.createDataFrame([(content,)], "content string")).first().signals.cta
    assert (c.cta_count, c.cta_texts, c.complementary_indexes, c.top_level_tag_count) == (1, ["Buy now"], [2], 4)
    assert [(b["index"], b.text, b.tag_name, b.classes, b.has_strong, b.strong_text) for b in c.cta_blocks] == [(0, "Buy now", "p", ["lead", "cta"], True, "now")]
    assert (c.has_cta, c.has_complementary_reading, c.has_quiz_correction) == (True, True, False)


LINKED = '<h2>T</h2><p><a href=" https://other.org/a?utm_x=1&amp;b=" target="_blank" rel="noopener  noreferrer">src</a><a href="https://me.fr/x">in</a><a>none</a></p><h3>Learn more</h3><p><a href="//OTHER.org/z">read more</a></p>'


def test_links(spark):
    df = spark.createDataFrame([(LINKED, "https://me.fr")], "content string, organization_website string")
    found = sources.extract(df).first().links
    assert [(x.href, x.is_external, x.section) for x in found] == [
        ("https://other.org/a?utm_x=1&b=", True, "body"), ("https://me.fr/x", False, "body"), ("", False, "body"), ("//OTHER.org/z", True, "complementary_reading"),
    ]
    assert found[0].rel == "noopener noreferrer"


@pytest.mark.parametrize(
    ("url", "names"),
    [("http://a/?utm_x=1&utm_x=2&ref=", ["utm_x"]), ("http://a/?ref=1#src=2", ["ref"]), ("http://a/?r%65f=1&xref=1", ["ref"]), ("http://a/", [])],
)
def test_tracking(spark, url, names):
    assert spark.createDataFrame([(url,)], "u string").select(links.tracking_parameters(F.col("u")).alias("t")).first().t == names


@pytest.mark.parametrize(("code", "status", "error"), [(200, "reachable", None), (404, "unreachable", "http_status_404"), (503, "unknown", "http_status_503"), (418, "unknown", "unhandled_http_status_418"), (None, "unknown", None)])
def test_status_classes(spark, code, status, error):
    r = spark.createDataFrame([(code,)], "c int").select(links.status_class(F.col("c")).alias("s")).first().s
    assert (r.network_status, r.error) == (status, error)


def test_sources_judge(spark):
    schema = "evaluation_id string, content string, content_type string, expected_length string, require_sources boolean, organization_website string"
    good = '<p><a href="https://other.org/a" target="_blank" rel="noopener noreferrer">a study</a></p>'
    rows = [
        ("good", good, "articles", "MEDIUM", True, "https://me.fr"), ("none", "<p>x</p>", "articles", "MEDIUM", True, "https://me.fr"), ("quiz", good, "quiz", "LONG", False, "https://me.fr"),
        ("audio", good, "audioScript", "LONG", False, "https://me.fr"), ("twice", good * 2, "articles", "SIMPLE", False, "https://me.fr"), ("bare", good + "https://bare.org [x](https://m.org) y<a href='https://me.fr/1'>z</a>", "articles", "LONG", False, "https://me.fr"),
        ("site", good, "articles", "LONG", False, ""),
    ]
    df = sources.extract(spark.createDataFrame(rows, schema))

    def request(method, url, timeout):
        if "other" not in url:
            raise TimeoutError
        return 200

    statuses = sources.fetch_statuses(df, request)
    judged = sources.judge(sources.with_checks(df, "evaluation_id", statuses))
    found = {r.evaluation_id: (r.sources.status, [f.rule_id.split(".")[1] for f in r.sources.findings]) for r in judged.collect()}
    assert found["good"] == ("pass", ["valid"])
    assert found["none"] == ("fail", ["real_and_accessible_sources", "external_reference_count_by_length"])
    assert found["quiz"] == ("fail", ["content_type_policy"])
    assert found["audio"] == ("warn", ["content_type_policy"])
    assert found["twice"] == ("fail", ["external_reference_count_by_length", "no_duplicate_links"])
    assert found["bare"] == ("fail", ["no_raw_or_markdown_url", "no_raw_or_markdown_url", "html_anchor_format", "network_accessibility"])
    assert found["site"] == (None, [])


def seo_row(**changes):
    row = {"content": "<p>Blue tea is fine.</p><h2>Blue tea now</h2><p>Green leaf. Blue tea.</p><h2>Conclusion</h2><p>Blue téa, leaf.</p>", "content_type": "articles", "expected_length": "SIMPLE", "funnel_stage": "DECISION", "main_keyword": "Blue Tea", "secondary_keywords": ["leaf"], "long_tail_keywords": []}
    row |= changes
    return row


SEO = "content string, content_type string, expected_length string, funnel_stage string, main_keyword string, secondary_keywords array<string>, long_tail_keywords array<string>"


def judged_seo(spark, encoder=None, **changes):
    row = seo_row(**changes)
    return seo.judge(spark.createDataFrame([tuple(row.values())], SEO), encoder).first()


def test_lexical_signals(spark):
    r = seo.lexical(spark.createDataFrame([tuple(seo_row().values())], SEO)).first()
    assert (r.lexical_body, r.lexical_introduction, r.lexical_headings, r.lexical_conclusion) == (4, 1, 1, 1)
    assert [(s.h2, s.matched) for s in r.lexical_distribution] == [("Blue tea now", ["leaf"]), ("Conclusion", ["leaf"])]


def test_seo_without_encoder(spark):
    r = judged_seo(spark)
    assert [f.rule_id for f in r.seo.findings] == ["seo.semantic_unavailable", "seo.overoptimization_semantic_unavailable", "seo.keyword_occurrences"]
    assert (r.seo_scores.lexical, r.seo_scores.semantic, r.seo.score, r.seo.status) == (85, 0, 55, "fail")


def test_seo_with_encoder(spark):
    same = lambda texts: F.transform(texts, lambda t: F.array(F.lit(1.0), F.lit(0.0)))
    r = judged_seo(spark, same)
    assert (r.seo_scores.semantic, r.seo_scores.overoptimization_risk, r.seo_scores.overoptimization) == (100, "medium_high", 62)
    assert [(f.rule_id, f.severity) for f in r.seo.findings] == [("seo.keyword_occurrences", "minor"), ("seo.over_optimization", "major")]


@pytest.mark.parametrize(
    ("changes", "error"),
    [({"content_type": ""}, "missing_content_type"), ({"expected_length": "X"}, "unsupported_expected_length"), ({"funnel_stage": None}, "missing_funnel_stage"), ({"main_keyword": " "}, "missing_main_keyword")],
)
def test_seo_errors(spark, changes, error):
    assert judged_seo(spark, **changes).seo.error == error


def test_keyword_missing(spark):
    r = judged_seo(spark, main_keyword="absent", content="<p>nothing</p>", secondary_keywords=[])
    assert [f.rule_id.split(".")[1] for f in r.seo.findings[2:]] == ["main_keyword_presence", "main_keyword_locations", "keyword_occurrences"]
    assert (r.seo.score, r.seo.status) == (26, "fail")


def test_phrase_count(spark):
    rows = [("café cafés du café-café", "cafe", 3), ("a.b a+b", "a.b", 1), ("x", "", 0)]
    df = spark.createDataFrame([r[:2] for r in rows], "t string, k string").select(text.phrase_count(text.fold(F.col("t")), F.col("k")).alias("n"))
    assert [r.n for r in df.collect()] == [n for *_, n in rows]


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 240, 241, 500])
def test_chunks_equal_the_loop(spark, n):
    words, out, start = [f"w{i}" for i in range(n)], [], 0
    while start < n:
        end = min(start + 128, n)
        out.append((start, end, " ".join(words[start:end])))
        if end >= n:
            break
        start = end - 16
    found = spark.createDataFrame([(" ".join(words),)], "t string").select(text.chunks(F.col("t"), 128, 16).alias("c")).first().c
    assert [(c.start_word, c.end_word, c.text) for c in found] == out


def test_scores(spark):
    r = spark.range(1).select(seo.weighted_score(F.array(F.lit(0.8), F.lit(0.6))).alias("a"), seo.weighted_score(F.array().cast("array<double>")).alias("b")).first()
    assert (r.a, r.b) == (74, 0)
    o = spark.range(1).select(seo.overoptimization(F.array(F.lit(4), F.lit(0), F.lit(0), F.lit(0)), F.lit(50)).alias("o")).first().o
    assert (o.density_score, o.concentration_score, o.local_score, o.score, o.risk) == (20, 45, 20, 29, "high")


REPLIES = [
    ('```json\n{"score_global_evergreen": 72.9, "passages_problematiques": [{"extrait": "a", "probleme": "b"}]}\n```', True, "pass", 72, ["moyenne"]),
    ('{"score_global_evergreen": "85.5"}', True, "fail", 0, []), ('{"score_global_evergreen": "55"}', True, "warn", 55, []), ('{"score_global_evergreen": 20}', False, "warn", 20, []),
    ('{"other": 1}', True, "fail", 0, ["major"]), ("nothing", False, "fail", 0, ["major"]), (None, True, "fail", 0, ["major"]),
]


@pytest.mark.parametrize(("reply", "required", "status", "score", "severities"), REPLIES)
def test_evergreen(spark, reply, required, status, score, severities):
    r = one(spark, "llm_raw_response string, evergreen_required boolean, locale string", (reply, required, "fr-FR"), evergreen.judge).evergreen
    assert (r.status, r.score, [f.severity for f in r.findings]) == (status, score, severities)


def test_temporal_references(spark):
    content = "<p>Depuis mars 2021, le 12/03/2024. Actuellement.</p><h2>Learn more</h2><p>2020</p><h3>Next</h3><p>selon 1999</p>"
    found = spark.createDataFrame([(content,)], "c string").select(evergreen.temporal_references(F.col("c"), F.lit("fr-FR"), F.array(F.lit("1999"))).alias("r")).first().r
    assert [(x.type, x.value) for x in found] == [("full_date", "12/03/2024"), ("year", "2021"), ("year", "2024"), ("year", "1999"), ("month_year", "mars 2021"), ("relative_date", "Actuellement")]
    assert [x.in_input for x in found] == [False, False, False, True, False, False]
    assert all(x.in_source_context and x.in_historical_context for x in found)


def test_whole_evaluation(spark):
    rows = [("a", "<p>x</p>", None, "articles", "MEDIUM", "fr-FR", "https://me.fr", "DECISION", "x", [], [], "<h2>T</h2>", False), ("b", "y", ["seo", "nope", "length", "seo"], "articles", None, "fr-FR", "https://me.fr", "DECISION", "x", [], [], "", False), (None, "z", [], "articles", "LONG", "fr-FR", "", "DECISION", "x", [], [], "", False)]
    found = {r.evaluation_id: r for r in evaluate.evaluate(spark.createDataFrame(rows, REQUEST)).collect()}
    assert [x.dimension for x in found["a"].results] == list(rules.DEFAULT_JUDGES)
    assert found["a"].summary == "Global evaluation completed with 5 judge result(s)."
    assert found["b"].summary == "Global evaluation could not be completed."
    assert [(x.dimension, x.error) for x in found["b"].errors] == [("seo", "missing_expected_length"), ("length", "missing_expected_length")]
    assert found["b"].metadata.skipped_judges == ["nope"]
    assert (found["b"].metadata.profile, found["b"].metadata.enabled_judges) == ("default", ["seo", "length"])
    shown = {x.dimension: x for x in found["a"].results}
    assert json.loads(shown["seo"].subscores)["semantic"] == 0
    assert json.loads(shown["seo"].semantic_signals)["available"] is False
    assert shown["length"].subscores == "{}"
    third = next(r for k, r in found.items() if k not in ("a", "b"))
    assert (third.evaluation_id[:11], third.summary, third.results) == ("evaluation-", "Global evaluation completed with 0 judge result(s).", [])


def test_tokenizer_rules():
    tree = html.tokenize("<P Class='a  b'>one<p>two</i></p><br/>x<b>y<i>z</b>w&eacute;&#33;")
    tags = [(e["tag"], e["parent"], " ".join(tree["pieces"][e["first"] : e["end"]])) for e in tree["elements"]]
    assert tags == [("p", -1, "one two x y z wé!"), ("p", 0, "two"), ("br", 0, ""), ("b", 0, "y z"), ("i", 3, "z")]
    assert tree["elements"][0]["classes"] == "a b"


def test_requests_of_one_name_stay_apart(spark):
    rows = [("same", content, ["length"], "articles", "MEDIUM", "fr-FR", "https://me.fr", "DECISION", "x", [], [], "", False) for content in ("<p>a</p>", "<p>" + "w " * 1500 + "</p>")]
    found = evaluate.evaluate(spark.createDataFrame(rows, REQUEST)).collect()
    assert sorted(r.results[0].status for r in found) == ["fail", "pass"]
    assert {r.evaluation_id for r in found} == {"same"}


READING = [
    ("<p>a</p><h2>Learn more</h2><p>2020</p>bare 2010<h3>Next</h3><p>1999</p>", "a bare 2010 Next 1999"),
    ("<div><h2>Lecture compl&eacute;mentaire</h2><p>2011</p>bare 2010</div><p>kept 2012</p>", "bare 2010 kept 2012"),
    ("<h2>Learn  more</h2><p>stays</p>", "Learn more stays"), ("x<h2>LEARN MORE</h2>y<br>z", "xyz"), ("<!-- a > b -->&lt;i&gt;", "b --><i>"), ("", ""),
]


@pytest.mark.parametrize(("content", "left"), READING)
def test_further_reading_goes_but_bare_text_stays(content, left):
    assert html.reading(content)[0] == left


def test_values_in_links_are_sources(spark):
    content = "<p>mars 2021</p><h2>Learn more</h2><p><a>Bilan MARS 2021</a></p>"
    found = spark.createDataFrame([(content,)], "c string").select(evergreen.temporal_references(F.col("c"), F.lit("fr-FR"), F.array().cast("array<string>")).alias("r")).first().r
    assert [(x.type, x.value, x.in_source_context) for x in found] == [("year", "2021", True), ("month_year", "mars 2021", True)]


def test_sections_hold_their_h3_headings(spark):
    content = "<title>Ti Tle</title><h2>A</h2><p>one</p><h3>Bee leaf</h3><p>two</p><h2>leaf care</h2><p>none</p>"
    s = evaluate.preprocess(spark.createDataFrame([(content,)], "content string")).first().signals
    assert [(x.h2, x.h3_headings, x.text) for x in s.h2_sections] == [("A", ["Bee leaf"], "one Bee leaf two"), ("leaf care", [], "none")]
    assert (s.text, s.word_count) == ("Ti Tle A one Bee leaf two leaf care none", 10)
    assert [h["index"] for h in s.headings] == [0, 1, 2]
    assert s.headings_h2_h3 == ["A", "Bee leaf", "leaf care"]
    r = seo.lexical(spark.createDataFrame([tuple(seo_row(content=content).values())], SEO)).first()
    assert [(x.h2, x.matched) for x in r.lexical_distribution] == [("A", ["leaf"]), ("leaf care", [])]
    assert r.lexical_concentrated


def test_conclusions_by_folded_title(spark):
    content = "<h2>One</h2><p>last</p><h2>LECTURE Complémentaire</h2><p>more</p>"
    page = spark.createDataFrame([(content.replace("é", "e\u0301"),)], "c string").select(html.parse(F.col("c")).alias("p"))
    found = page.select(html.conclusion(html.sections(F.col("p")), rules.COMPLEMENTARY_TITLES, folded=True).alias("a"), html.conclusion(html.sections(F.col("p")), rules.COMPLEMENTARY_TITLES).alias("b")).first()
    assert (found.a, found.b) == ("last", "more")


def test_site_without_scheme_has_no_host(spark):
    df = spark.createDataFrame([('<a href="https://me.fr/x">a</a><a href="/y">b</a>', "me.fr")], "content string, organization_website string")
    assert [x.is_external for x in sources.extract(df).first().links] == [True, False]


@pytest.mark.parametrize(
    ("kind", "size", "site", "error"),
    [("poem", "LONG", "https://me.fr", "unsupported_content_type"), ("poem", "LONG", " ", "missing_organization_website"), (" ", None, "", "missing_content_type"), ("quiz", "", "", "missing_expected_length"), ("quiz", "HUGE", "https://me.fr", "unsupported_expected_length"), (" quiz ", "LONG", "https://me.fr", None)],
)
def test_sources_context_errors(spark, kind, size, site, error):
    schema = "evaluation_id string, content string, content_type string, expected_length string, require_sources boolean, organization_website string"
    df = sources.extract(spark.createDataFrame([("a", "<p>x</p>", kind, size, False, site)], schema))
    assert sources.judge(sources.with_checks(df, "evaluation_id")).first().sources.error == error


def test_url_requests():
    def request(method, url, timeout):
        if method == "HEAD":
            raise ssl.SSLError
        if url == "b":
            raise ConnectionRefusedError
        if url == "c":
            raise UnicodeError
        return 204

    assert [sources.fetch_status(u, request, ["HEAD", "GET"], 5) for u in "abc"] == [(204, None, None), (None, "connection_error", None), (None, "request_error:UnicodeError", None)]
    assert sources.fetch_status("a", request, ["HEAD"], 5) == (None, "ssl_error", None)
    assert sources.normalized_methods([" get ", "HEAD"]) == ["GET", "HEAD"]
    for wrong in ("GET", [], ["POST"], None):
        with pytest.raises(ValueError, match="methods"):
            sources.normalized_methods(wrong)


def test_python_encoders(spark):
    asked = []
    near = seo.python_encoder(lambda texts: [[1.0, 0.0] if "tea" in t.lower() else [0.0, 1.0] for t in texts])
    r = judged_seo(spark, near, content="<p>Intro.</p><h2>Green</h2><p>A cup of téa. Leaf tea now. More.</p>", main_keyword="blue tea")
    assert r.seo_signals.semantic.available
    assert r.seo_signals.semantic.best_similarity == 1.0
    assert r.seo_signals.overoptimization.occurrences == 1
    assert [x.keyword for x in r.seo_signals.secondary_occurrences] == ["leaf"]

    def broken(texts):
        raise RuntimeError(asked)

    r = judged_seo(spark, seo.python_encoder(broken))
    assert [f.rule_id for f in r.seo.findings][:2] == ["seo.semantic_unavailable", "seo.overoptimization_semantic_unavailable"]


def test_settings_and_rules_from_outside(spark):
    one_vector = lambda texts: F.transform(texts, lambda t: F.array(F.lit(1.0)))
    rows = spark.createDataFrame([tuple(seo_row(content="<p>" + "word " * 50 + "</p>").values())], SEO)
    r = seo.judge(rows, one_vector, chunk_words=10, chunk_overlap=2, top_chunks=2).first().seo_signals.semantic
    assert [(c.chunk.chunk_id, c.chunk.word_count) for c in r.top_chunks] == [(1, 10), (2, 10)]
    r = one(spark, "word_count int, content_type string, expected_length string", (5, "poem", "TINY"), lambda df: length.judge(df, ranges_by_type={"poem": {"TINY": (4, 6)}}))
    assert r.length.status == "pass"


def test_typography_signals(spark):
    r = spark.createDataFrame([("a <b> x</b>&amp;\r\nb<br>",), (None,)], "c string").select(typography.signals(F.col("c")).alias("s")).collect()
    s = r[0].s
    assert (s.text_without_html, s.decoded_text, s.decoded_text_no_newlines, s.normalized_text) == ("a x &amp;\r\nb ", "a x &\r\nb ", "a x &  b ", "a x & b")
    assert (s.br_tag_count, s.anchor_tag_count, s.is_empty, r[1].s.is_empty) == (1, 0, False, True)


def test_evergreen_prompt_and_model(spark):
    df = spark.createDataFrame([("body", [("year", "2020")])], "c string, r array<struct<type:string,value:string>>")
    asked = df.select(evergreen.prompt("Read {{CONTENT}} with {{TEMPORAL_SIGNALS}}", F.col("c"), F.col("r")).alias("prompt"))
    assert asked.first().prompt == 'Read body with [{"type":"year","value":"2020"}]'
    assert services.ask(asked, lambda prompts: [p.upper() for p in prompts]).first().llm_raw_response.startswith("READ BODY")
