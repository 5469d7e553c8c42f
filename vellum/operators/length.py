"""Length judge: word count against the range of its content type and expected length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import rules, text
from vellum.functions.settings import Settings


Ranges = dict[str, dict[str, tuple[int, int | None]]]


def ranges(spark: SparkSession, table: Ranges = rules.LENGTH_RANGES) -> DataFrame:
    """The rule table, a few rows: word ranges (least, most) by content type and expected length."""
    rows = [(kind, length, least, most) for kind, by in table.items() for length, (least, most) in by.items()]
    return spark.createDataFrame(rows, "content_type string, expected_length string, min_words int, max_words int")


def resolution_error(content_type: Column, expected_length: Column, table: Ranges = rules.LENGTH_RANGES) -> Column:
    """Code of the first thing wrong with the context, null if nothing is. Blanks are values, though none that a rule knows."""
    missing = lambda c: F.coalesce(c, F.lit("")) == ""
    known = F.coalesce(*(F.when(content_type == kind, expected_length.isin(*by)) for kind, by in table.items()), F.lit(False))
    return (
        F.when(missing(content_type), "missing_content_type")
        .when(missing(expected_length), "missing_expected_length")
        .when(~content_type.isin(*table), "unsupported_content_type")
        .when(~known, "unsupported_expected_length")
    )


def judge(df: DataFrame, tolerance_pct: float = rules.LENGTH_TOLERANCE_PCT, column: str = "length", ranges_by_type: Ranges = rules.LENGTH_RANGES, settings: str | None = None) -> DataFrame:
    """df (word_count, content_type, expected_length) -> also `length`: status, score, findings, error; and `length_rule`, the range applied.

    Bounds are inclusive after the tolerance. Rows whose context has no rule, and those with a parse_error if there is such a
    column, carry an error instead of a result. `settings` names a map column of rules that change ranges, tolerance,
    severities and switches.
    """
    own = Settings(settings)
    key = lambda end: F.concat_ws(".", F.lit("length.ranges"), "content_type", "expected_length", F.lit(end))
    table = F.broadcast(ranges(df.sparkSession, ranges_by_type).withColumnsRenamed({"content_type": "_type", "expected_length": "_length"}))
    joined = df.join(table, (df.content_type == table._type) & (df.expected_length == table._length), "left").drop("_type", "_length")
    if settings is None:
        below, above = F.lit(1 - tolerance_pct / 100.0), F.lit(1 + tolerance_pct / 100.0)
    else:
        joined = joined.withColumns({"min_words": F.coalesce(own.limit(key("min"), F.col("min_words")), F.lit(0)), "max_words": own.limit(key("max"), F.col("max_words"))})
        below, above = 1 - own.number("length.tolerance_pct") / 100.0, 1 + own.number("length.tolerance_pct") / 100.0
    least = (F.col("min_words") * below).cast("int")
    most = (F.col("max_words") * above).cast("int")
    n = F.col("word_count")
    proof = {"word_count": n, "tolerated_min": least, "tolerated_max": most}
    short, long = (n < least) & own.enabled("length.too_short"), most.isNotNull() & (n > most) & own.enabled("length.too_long")
    found = (
        F.when(short, text.finding("length.too_short", own.severity("length.too_short"), "The text has fewer words than the tolerated range allows.", **proof))
        .when(long, text.finding("length.too_long", own.severity("length.too_long"), "The text has more words than the tolerated range allows.", **proof))
        .otherwise(text.finding("length.valid", "info", "The number of words lies in the tolerated range.", **proof))
    )
    error = resolution_error(F.col("content_type"), F.col("expected_length"), ranges_by_type)
    if "parse_error" in df.columns:
        error = F.coalesce(error, F.col("parse_error"))
    ok = error.isNull()
    bad = short | long
    result = F.struct(
        F.when(ok, F.when(bad, "fail").otherwise("pass")).alias("status"),
        F.when(ok, F.when(bad, 0).otherwise(100)).alias("score"),
        F.when(ok, F.array(found)).otherwise(F.array().cast(f"array<{text.FINDING}>")).alias("findings"),
        error.alias("error"),
    )
    applied = F.when(ok, F.struct("min_words", "max_words", least.alias("tolerated_min"), most.alias("tolerated_max")))
    return joined.withColumns({column: result, f"{column}_rule": applied}).drop("min_words", "max_words")
