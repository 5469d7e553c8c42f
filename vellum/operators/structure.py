"""Structure judge: generated HTML against the headings of its outline and the tags that it may use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import html, rules, text
from vellum.functions.settings import Settings


def leaked_comments(visible: Column, patterns: tuple[str, ...] = rules.COMMENT_PATTERNS) -> Column:
    """The patterns that stand in the text, also within words and in any case, in their own order."""
    return F.filter(F.array(*map(F.lit, patterns)), lambda p: F.contains(F.lower(visible), F.lower(p)))


def without_trailing(found: Column, titles: tuple[str, ...] = rules.TRAILING_TITLES) -> Column:
    """Headings without the last one, if that has one of the optional titles."""
    last = F.lower(F.trim(F.try_element_at(found, F.lit(-1))["text"]))
    return F.when(last.isin(*(t.lower() for t in titles)), F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0)))).otherwise(found)


def judge(df: DataFrame, expected: str = "expected_outline_html", content: str = "content", column: str = "structure", enabled: dict[str, bool] | None = None, page: str | None = None, settings: str | None = None) -> DataFrame:
    """df (expected_outline_html, content) -> also `structure`: status, score, findings, error.

    Any finding fails. An outline that is null or blank, and an outline or content that can't be parsed, is an error. Rules set to False in `enabled` find nothing.
    `page` names a column that holds the parsed content already, `settings` a map column of rules that change severities and
    switches.
    """
    own = Settings(settings)
    on = lambda rule: F.lit((enabled or {}).get(rule, True)) & own.enabled(f"structure.{rule}")
    parsed = df.withColumn("_e", html.parse(F.col(expected))).withColumn("_g", F.col(page) if page else html.parse(F.col(content)))
    # An array of one, taken apart again: the optimizer leaves that where it is, so texts are cut once for all rules.
    cut = F.struct(html.headings(F.col("_e"), rules.HEADING_TAGS).alias("e"), without_trailing(html.headings(F.col("_g"), rules.HEADING_TAGS)).alias("g"), html.body(F.col("_g")).alias("text"))
    parsed = parsed.withColumn("_cut", F.explode(F.array(cut))).withColumns({"_eh": F.col("_cut.e"), "_gh": F.col("_cut.g")})
    field = lambda c, f: F.transform(c, lambda h: F.trim(h[f]) if f == "text" else h[f])
    e_text, g_text, e_level, g_level = (field(F.col(c), f) for f in ("text", "level") for c in ("_eh", "_gh"))
    generated = F.col("_g")
    counts = {"expected_count": F.size("_eh"), "generated_count": F.size("_gh")}
    tags = F.array_except(html.used_tags(generated), F.array(*map(F.lit, rules.HEADING_TAGS + rules.BODY_TAGS)))
    # h1, script and span have rules of their own but are unauthorised as well.
    leaked = leaked_comments(F.col("_cut.text"))
    checks = (
        ("heading_order", e_text != g_text, "The headings come in another order than in the outline.", {"expected": e_text, "generated": g_text}),
        ("heading_levels", e_level != g_level, "The heading levels differ from those of the outline.", {"expected": e_level, "generated": g_level}),
        ("heading_text", F.array_sort(e_text) != F.array_sort(g_text), "The heading texts differ from those of the outline.", {"expected": F.array_sort(e_text), "generated": F.array_sort(g_text)}),
        ("no_added_sections", F.size("_gh") > F.size("_eh"), "Sections were added to the outline.", counts),
        ("no_removed_sections", F.size("_gh") < F.size("_eh"), "Sections of the outline are missing.", counts),
        ("no_h1_in_body", html.has(generated, "h1"), "The body holds a heading of the first level.", {}),
        ("no_internal_outline_comments_exposed", F.size(leaked) > 0, "Notes of the outline show in the text.", {"patterns": leaked}),
        ("allowed_tags_only", F.size(tags) > 0, "Tags are used that the rules don't allow.", {"tags": tags}),
        ("no_scripts", html.has(generated, "script"), "The content holds a script.", {}),
        ("no_decorative_spans", html.has(generated, "span"), "The content holds decorative spans.", {}),
        ("no_inline_styles_except_tables", html.styled_outside_tables(generated, rules.TABLE_TAGS), "Inline styles stand outside tables.", {}),
    )
    found = text.findings(*((c & on(rule), text.finding(f"structure.{rule}", own.severity(f"structure.{rule}"), message, **proof)) for rule, c, message, proof in checks))
    error = F.when(F.coalesce(F.trim(expected), F.lit("")) == "", "missing_expected_outline_html")
    error = F.coalesce(error, F.col("_e.error"), F.col("_g.error"))
    ok, none = error.isNull(), F.size("_f") == 0
    valid = F.array(text.finding("structure.valid", "info", "The content keeps to the outline and the allowed tags."))
    result = F.struct(
        F.when(ok, F.when(none, "pass").otherwise("fail")).alias("status"),
        F.when(ok, F.when(none, 100).otherwise(0)).alias("score"),
        F.when(ok, F.when(none, valid).otherwise(F.col("_f"))).otherwise(F.array().cast(f"array<{text.FINDING}>")).alias("findings"),
        error.alias("error"),
    )
    return parsed.withColumn("_f", found).withColumn(column, result).drop("_e", "_g", "_eh", "_gh", "_cut", "_f")
