"""Rule files: read, checked and put before each judge."""

import json

import pytest
from test_judges import SEO, seo_row

from vellum.functions import settings
from vellum.operators import evergreen, length, seo, sources, structure, typography
from vellum.plans import evaluate
from vellum.sources import rule_files



def judged(spark, judge, schema, row, rules):
    df = spark.createDataFrame([(*row, rules)], f"{schema}, r map<string,string>")
    return judge(df, settings="r").first()


def test_files_become_one_checked_table(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"profile": "strict", "seo": {"keyword_occurrences": {"severity": "critical"}, "occurrences": {"MEDIUM": {"max": None}}}, "length.tolerance_pct": 0}))
    (tmp_path / "b.json").write_text(json.dumps({"profile": "strict", "structure": {"no_scripts": {"enabled": False}}}))
    (tmp_path / "c.json").write_text(json.dumps({"sources": {"references": {"SIMPLE": {"max": 4}}}}))
    table = {r.profile: r.rules for r in rule_files.table(rule_files.read(spark, str(tmp_path))).collect()}
    assert table == {
        "strict": {"seo.keyword_occurrences.severity": "critical", "seo.occurrences.MEDIUM.max": "none", "length.tolerance_pct": "0", "structure.no_scripts.enabled": "false"},
        "default": {"sources.references.SIMPLE.max": "4"},
    }


@pytest.mark.parametrize(
    ("content", "said"),
    [
        ('{"seo": {"nope": 1}}', "seo.nope = 1: unknown key"), ('{"structure": {"no_scripts": {"severity": "huge"}}}', "not a severity"), ('{"length": {"tolerance_pct": -1}}', "not a number"),
        ('{"seo": {"occurrences": {"LONG": {"min": 1.5}}}}', "not a limit"), ('{"seo": {"keyword_occurrences": {"enabled": "yes"}}}', "not a switch"), ("[1]", "TypeError"), ("{", "JSONDecodeError"),
    ],
)
def test_wrong_files_are_errors(spark, tmp_path, content, said):
    (tmp_path / "a.json").write_text(content)
    with pytest.raises(ValueError, match="wrong rules") as e:
        rule_files.table(rule_files.read(spark, str(tmp_path)))
    assert said in str(e.value)


def test_two_values_of_a_rule_are_an_error(spark):
    rows = spark.createDataFrame([("p", "length.tolerance_pct", "1"), ("p", "length.tolerance_pct", "2")], "profile string, key string, value string")
    with pytest.raises(ValueError, match="several values: p: length.tolerance_pct"):
        rule_files.table(rows)


def test_every_known_value_is_of_its_kind():
    assert all(rule_files.fault(kind, value) is None for kind, value in settings.known().values())


def test_length_rules(spark):
    schema, row = "word_count int, content_type string, expected_length string", (1_050, "articles", "SIMPLE")
    assert judged(spark, length.judge, schema, row, {}).length.status == "pass"
    strict = judged(spark, length.judge, schema, row, {"length.tolerance_pct": "0", "length.too_long.severity": "minor"}).length
    assert (strict.status, strict.findings[0].rule_id, strict.findings[0].severity) == ("fail", "length.too_long", "minor")
    assert judged(spark, length.judge, schema, row, {"length.tolerance_pct": "0", "length.too_long.enabled": "false"}).length.status == "pass"
    assert judged(spark, length.judge, schema, row, {"length.tolerance_pct": "0", "length.ranges.articles.SIMPLE.max": "none"}).length.status == "pass"
    assert judged(spark, length.judge, schema, row, {"length.ranges.articles.SIMPLE.min": "2000"}).length.status == "fail"


def test_typography_rules(spark):
    schema, row = "content string, locale string", ("a  b !", "fr-FR")
    assert (lambda t: (t.status, t.score))(judged(spark, typography.judge, schema, row, {}).typography) == ("fail", 65)
    eased = judged(spark, typography.judge, schema, row, {"typography.french_nbsp_before_double_punctuation.severity": "minor", "typography.minor_penalty": "7"}).typography
    assert (eased.status, eased.score) == ("warn", 86)
    off = {f"typography.{r}.enabled": "false" for r in settings.RULES["typography"]}
    assert judged(spark, typography.judge, schema, row, off).typography.status == "pass"


def test_structure_rules(spark):
    schema, row = "expected_outline_html string, content string", ("<h2>a</h2>", "<h2>a</h2><script>x</script>")
    found = judged(spark, structure.judge, schema, row, {"structure.no_scripts.severity": "minor", "structure.allowed_tags_only.enabled": "false"}).structure
    assert [(f.rule_id, f.severity) for f in found.findings] == [("structure.no_scripts", "minor")]
    assert [f.severity for f in judged(spark, structure.judge, schema, row, {}).structure.findings] == ["major", "critical"]


def test_seo_rules(spark):
    row = tuple(seo_row().values())
    found = judged(spark, seo.judge, SEO, row, {"seo.keyword_occurrences.severity": "critical"})
    assert [(f.rule_id, f.severity) for f in found.seo.findings][2:] == [("seo.keyword_occurrences", "critical")]
    freed = judged(spark, seo.judge, SEO, row, {"seo.occurrences.SIMPLE.min": "0", "seo.warn_score": "10"})
    assert [f.rule_id for f in freed.seo.findings][2:] == []
    assert (freed.seo_scores.lexical, freed.seo.status) == (100, "warn")
    assert judged(spark, seo.judge, SEO, row, {"seo.keyword_occurrences.enabled": "false"}).seo_scores.lexical == 100
    assert judged(spark, seo.judge, SEO, row, {"seo.occurrences.SIMPLE.max": "2"}).seo_scores.lexical == 85


def test_sources_rules(spark):
    schema = "content string, content_type string, expected_length string, require_sources boolean, organization_website string"
    row = ('<p><a href="https://o.org/a">a study</a> <a href="https://o.org/b">b study</a></p>', "articles", "SIMPLE", False, "https://me.fr")
    judge = lambda df, settings: sources.judge(sources.with_checks(sources.extract(df), "content"), settings=settings)
    assert [f.rule_id.split(".")[1] for f in judged(spark, judge, schema, row, {}).sources.findings] == ["external_reference_count_by_length", "html_anchor_format", "html_anchor_format"]
    more = judged(spark, judge, schema, row, {"sources.references.SIMPLE.max": "2", "sources.warn_score": "55"}).sources
    assert (more.status, more.score, len(more.findings)) == ("warn", 55, 2)
    none = judged(spark, judge, schema, row, {"sources.references.SIMPLE.max": "none", "sources.html_anchor_format.enabled": "false"}).sources
    assert (none.status, [f.rule_id for f in none.findings]) == ("pass", ["sources.valid"])
    assert judged(spark, judge, schema, row, {"sources.references.SIMPLE.max": "2", "sources.html_anchor_format.severity": "major"}).sources.status == "fail"


def test_evergreen_rules(spark):
    schema, row = "llm_raw_response string, evergreen_required boolean, locale string", ('{"score_global_evergreen": 65}', True, "fr-FR")
    assert judged(spark, evergreen.judge, schema, row, {}).evergreen.status == "warn"
    assert judged(spark, evergreen.judge, schema, row, {"evergreen.pass_score": "60"}).evergreen.status == "pass"
    broken = judged(spark, evergreen.judge, schema, ("x", True, "fr-FR"), {"evergreen.llm_error.severity": "critical"}).evergreen
    assert [f.severity for f in broken.findings] == ["critical"]


def test_profiles_of_a_whole_evaluation(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"profile": "free", "length": {"ranges": {"articles": {"SIMPLE": {"min": 1}}}}, "typography": {"double_spaces": {"enabled": False}}, "structure": {"heading_text": {"severity": "minor"}}}))
    schema = (
        "request_id string, profile string, content string, enabled_judges array<string>, content_type string, expected_length string, locale string, organization_website string, funnel_stage string,"
        "main_keyword string, secondary_keywords array<string>, long_tail_keywords array<string>, expected_outline_html string, require_sources boolean"
    )
    row = lambda name, profile: (name, profile, "<p>two  words</p><h2>b</h2>", None, "articles", "SIMPLE", "fr-FR", "https://me.fr", "DECISION", "x", [], [], "<h2>c</h2>", False)
    rows = spark.createDataFrame([row("a", "free"), row("b", "other"), row("c", None)], schema)
    table = rule_files.table(rule_files.read(spark, str(tmp_path)))
    found = {r.evaluation_id: {x.dimension: x for x in r.results} for r in evaluate.evaluate(rows, rule_table=table).collect()}
    plain = {r.evaluation_id: {x.dimension: x for x in r.results} for r in evaluate.evaluate(rows).collect()}
    assert (found["b"], found["c"]) == (plain["b"], plain["c"])
    assert [found["a"][j].status for j in ("length", "typography")] == ["pass", "pass"]
    assert [found["b"][j].status for j in ("length", "typography")] == ["fail", "warn"]
    assert {f.rule_id: f.severity for f in found["a"]["structure"].findings}["structure.heading_text"] == "minor"
    chunks = evaluate.evaluate(rows, seo_options={"chunk_words": 2, "chunk_overlap": 0, "top_chunks": 1}).first()
    assert chunks.status == "completed"
