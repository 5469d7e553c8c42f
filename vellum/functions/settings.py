"""Rules of a row: severities, switches and limits from a rule table, where it has them, else the values in `rules`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions import rules

SEVERITIES = ("info", "minor", "major", "critical")
#: Rules of each judge whose findings have a severity, as they are without a rule table.
RULES = {
    "length": {"too_short": "major", "too_long": "major"},
    "typography": {rule: severity for rule, severity, *_ in rules.TYPOGRAPHY},
    "structure": {
        "heading_order": "major", "heading_levels": "major", "heading_text": "major", "no_added_sections": "major", "no_removed_sections": "major",
        "no_h1_in_body": "major", "no_internal_outline_comments_exposed": "major", "allowed_tags_only": "major", "no_scripts": "critical",
        "no_decorative_spans": "minor", "no_inline_styles_except_tables": "major",
    },
    "seo": {
        "main_keyword_presence": "major", "main_keyword_locations": "major", "keyword_occurrences": "major", "keyword_distribution": "minor",
        "over_optimization": "major", "formatting_constraints": "minor",
    },
    "sources": {
        "content_type_policy": "major", "complementary_reading_policy": "major", "real_and_accessible_sources": "major", "external_reference_count_by_length": "major",
        "no_raw_or_markdown_url": "major", "html_anchor_format": "minor", "descriptive_anchor_text": "minor", "no_duplicate_links": "minor", "no_tracking_parameters": "major", "network_accessibility": "major",
    },
    "evergreen": {"llm_error": "major"},
}
#: Scores at and above which a judge passes or warns, and what findings take off a score.
NUMBERS = {
    "length.tolerance_pct": rules.LENGTH_TOLERANCE_PCT, "typography.major_penalty": 25, "typography.minor_penalty": 10, "seo.pass_score": 85, "seo.warn_score": 60,
    "sources.warn_score": 80, "evergreen.pass_score": 70, "evergreen.warn_score": 50,
}


def known() -> dict[str, tuple[str, object]]:
    """Every key that a rule table may hold, with its kind and its value without one; a limit of null is none."""
    found: dict[str, tuple[str, object]] = {k: ("number", v) for k, v in NUMBERS.items()}
    for judge, by in RULES.items():
        for rule, severity in by.items():
            found[f"{judge}.{rule}.severity"] = ("severity", severity)
            found[f"{judge}.{rule}.enabled"] = ("switch", True)
    for kind, by in rules.LENGTH_RANGES.items():
        for length, (least, most) in by.items():
            found |= {f"length.ranges.{kind}.{length}.min": ("limit", least), f"length.ranges.{kind}.{length}.max": ("limit", most)}
    for length, limits in {**rules.OCCURRENCES, "quiz": rules.QUIZ_OCCURRENCES}.items():
        found |= {f"seo.occurrences.{length}.{name}": ("limit", v) for name, v in zip(("min", "max", "main_min"), limits, strict=True)}
    for length, (most, least) in rules.REFERENCE_LIMITS.items():
        found |= {f"sources.references.{length}.max": ("limit", most), f"sources.references.{length}.min": ("limit", least)}
    return found


class Settings:
    """Reads a map column of a row's rules, key to text; without one every value is the one in `rules`, a literal."""

    def __init__(self, column: str | None = None):
        self.column = column

    def _found(self, key: str | Column) -> Column:
        return F.try_element_at(F.col(self.column), F.lit(key) if isinstance(key, str) else key)

    def severity(self, rule: str, default: str | Column | None = None) -> Column:
        """A rule's severity. `default` is what the rule has in a case of its own, such as a caution; tables change those as well."""
        judge, name = rule.split(".", 1)
        own = F.lit(RULES[judge][name]) if default is None else F.lit(default) if isinstance(default, str) else default
        return own if self.column is None else F.coalesce(self._found(f"{rule}.severity"), own)

    def enabled(self, rule: str) -> Column:
        return F.lit(True) if self.column is None else F.coalesce(self._found(f"{rule}.enabled").cast("boolean"), F.lit(True))

    def number(self, key: str) -> Column:
        own = F.lit(NUMBERS[key])
        return own if self.column is None else F.coalesce(self._found(key).cast("double"), own.cast("double"))

    def limit(self, key: Column, own: Column) -> Column:
        """A limit in whole numbers; where the table has the key but not a number there is none."""
        own = own.cast("int")
        return own if self.column is None else F.when(F.map_contains_key(F.col(self.column), key), self._found(key).try_cast("int")).otherwise(own)
