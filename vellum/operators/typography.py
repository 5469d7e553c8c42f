"""Typography judge: counts of spacing and punctuation faults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import rules, text
from vellum.functions.settings import Settings

CHECKS = rules.TYPOGRAPHY


def _counted(content: Column, decoded: Column, rule: str) -> Column:
    _, _, where, pattern, _ = next(c for c in CHECKS if c[0] == rule)
    if where == "lines":
        return F.size(F.filter(text.lines(content), lambda x: x.rlike(pattern)))
    return F.regexp_count(decoded if where == "decoded" else content, F.lit(pattern))


def count(content: Column, rule: str) -> Column:
    """How often a rule finds its fault in a content."""
    return _counted(F.coalesce(content, F.lit("")), text.decoded_text(content), rule)


def signals(content: Column) -> Column:
    """The texts and counts that the rules rest on."""
    content = F.coalesce(content, F.lit(""))
    bare, decoded, plain = text.without_tags(content), text.decoded_text(content), text.collapse(text.decoded_text(content))
    return F.struct(
        bare.alias("text_without_html"), decoded.alias("decoded_text"), F.regexp_replace(decoded, r"[\r\n]", " ").alias("decoded_text_no_newlines"), plain.alias("normalized_text"),
        text.lines(content).alias("original_lines"), text.lines(decoded).alias("decoded_lines"), F.regexp_count(content, F.lit(r"(?iU)<br\s*/?>")).alias("br_tag_count"),
        F.regexp_count(content, F.lit(r"(?iU)<a\b")).alias("anchor_tag_count"), (plain == "").alias("is_empty"),
    )


def judge(df: DataFrame, content: str = "content", locale: str = "locale", column: str = "typography", settings: str | None = None) -> DataFrame:
    """df (content, locale) -> also `typography`: status, score, findings, error. A null content is empty.

    `settings` names a map column of rules that change severities, switches and what findings take off the score.
    """
    own = Settings(settings)
    code = F.col(locale)
    error = F.when(F.coalesce(F.trim(code), F.lit("")) == "", "missing_locale").when(~code.isin(*rules.TYPOGRAPHY_LOCALES), "unsupported_locale")
    # The decoded text is a column of its own, so that it is made once for all rules.
    counted = df.withColumn("_decoded", text.decoded_text(F.col(content))).withColumns({f"_n_{c[0]}": _counted(F.coalesce(F.col(content), F.lit("")), F.col("_decoded"), c[0]) for c in CHECKS})
    found = text.findings(*(((F.col(f"_n_{rule}") > 0) & own.enabled(f"typography.{rule}"), text.finding(f"typography.{rule}", own.severity(f"typography.{rule}"), message, count=F.col(f"_n_{rule}"))) for rule, _, _, _, message in CHECKS))
    majors, minors = (F.size(F.filter("_f", lambda f: f["severity"].isin(*kinds))) for kinds in (("major", "critical"), ("minor",)))
    valid = F.array(text.finding("typography.valid", "info", "No fault of spacing or punctuation was found."))
    ok = error.isNull()
    none = F.size("_f") == 0
    result = F.struct(
        F.when(ok, F.when(none, "pass").when(majors > 0, "fail").otherwise("warn")).alias("status"),
        F.when(ok, F.when(none, 100).otherwise(F.greatest(F.lit(0), (100 - own.number("typography.major_penalty") * majors - own.number("typography.minor_penalty") * minors).cast("int")))).alias("score"),
        F.when(ok, F.when(none, valid).otherwise(F.col("_f"))).otherwise(F.array().cast(f"array<{text.FINDING}>")).alias("findings"),
        error.alias("error"),
    )
    return counted.withColumn("_f", found).withColumn(column, result).drop("_f", "_decoded", *(f"_n_{c[0]}" for c in CHECKS))
