"""Evergreen judge: temporal references of a text, and a language model's reply about them."""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from vellum.functions import html, rules, text
from vellum.functions.settings import Settings

_KIND = pa.struct([
    ("value", pa.string()), ("type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("context", pa.string()),
    ("in_source_context", pa.bool_()), ("in_historical_context", pa.bool_()), ("in_input", pa.bool_()),
])
_DATES = {
    lang: [("full_date", re.compile(rules.FULL_DATE)), ("year", re.compile(rules.YEAR)), ("month_year", re.compile(rf"\b(?:{'|'.join(rules.MONTHS[lang])})\s+(?:19|20)\d{{2}}\b", re.I))]
    for lang in ("fr", "en")
}
#: A date of any kind ends in such digits.
_YEAR_LIKE = re.compile(r"(?:19|20)\d\d")
_EXPRESSIONS = {lang: [(kind, x, re.compile(rf"\b{re.escape(x)}\b", re.I)) for kind, by in rules.EXPRESSIONS.items() for x in by[lang]] for lang in ("fr", "en")}
_WORD = re.compile(r"\w")
#: Letters that equal i or s when case is ignored, though their lower case doesn't.
_ODD_CASE = re.compile("[\u0130\u0131\u017f\u212a]")


@functools.cache
def _automaton(lang: str):
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, (_, x, _) in enumerate(_EXPRESSIONS[lang]):
        found.add_word(x.lower(), (i, len(x)))
    found.make_automaton()
    return found


def _places(t: str, lang: str) -> list[tuple[str, int, int]]:
    """kind, start and end of dates and then of expressions, each expression's in order."""
    found = [(kind, m.start(), m.end()) for kind, pattern in _DATES[lang] for m in pattern.finditer(t)] if _YEAR_LIKE.search(t) else []
    low = t.lower()
    if len(low) != len(t) or _ODD_CASE.search(t):
        return found + [(kind, m.start(), m.end()) for kind, _, pattern in _EXPRESSIONS[lang] for m in pattern.finditer(t)]
    # One pass finds all expressions; only whole words count.
    places = []
    for last, (i, n) in _automaton(lang).iter(low):
        start, end = last + 1 - n, last + 1
        if not (start and _WORD.match(t[start - 1])) and not (end < len(t) and _WORD.match(t[end])):
            places.append((i, start, end))
    return found + [(_EXPRESSIONS[lang][i][0], start, end) for i, start, end in sorted(places)]


@F.arrow_udf(from_arrow_type(pa.list_(_KIND)))
def temporal_references(contents: pa.Array, locales: pa.Array, allowed: pa.Array) -> pa.Array:
    """Dates, years, months and time expressions of a content (HTML) in that order, with places, contexts and what excuses them.

    Arguments: content, locale, allowed values. Sections for further reading are left out, but the links in them count as
    sources. Text of scripts stays, as only tags are removed. Null for a content that can't be parsed.
    """
    out = []
    for content, locale, given in zip(*(x.to_pylist() for x in (contents, locales, allowed)), strict=True):
        try:
            t, links = html.reading(content or "")
        except Exception:  # noqa: BLE001 - whatever a document makes the parser raise concerns its row alone
            out.append(None)
            continue
        links = [x.lower() for x in links]
        lang, known = "en" if (locale or "").lower().startswith("en") else "fr", {x.lower() for x in given or () if x}
        found = []
        for kind, start, end in _places(t, lang):
            around = t[max(0, start - rules.CONTEXT_CHARS) : end + rules.CONTEXT_CHARS].strip()
            low, value = around.lower(), t[start:end].lower()
            found.append({
                "value": t[start:end], "type": kind, "start": start, "end": end, "context": around,
                "in_source_context": any(x in low for x in rules.SOURCE_MARKERS[lang]) or any(value in a for a in links),
                "in_historical_context": any(x in low for x in rules.HISTORY_MARKERS[lang]), "in_input": value in known,
            })
        out.append(found)
    return pa.array(out, pa.list_(_KIND))


def prompt(template: str, content: Column, references: Column) -> Column:
    """A request for a language model: the content and its temporal signals put into a template."""
    return F.replace(F.replace(F.lit(template), F.lit("{{CONTENT}}"), content), F.lit("{{TEMPORAL_SIGNALS}}"), F.to_json(references))


def judge(df: DataFrame, reply: str = "llm_raw_response", column: str = "evergreen", failure: str = "llm_error", settings: str | None = None) -> DataFrame:
    """df (llm_raw_response, evergreen_required, locale, maybe llm_error and parse_error) -> also `evergreen`: status, score, findings, error.

    Replies come from services.ask(), whose failures are an error result as well. `settings` names a map
    column of rules that change the scores that pass and the severity of an error. The reply's outermost braces hold JSON, fenced or not. A reply without it or without a score is an error result that
    fails; a failure is only a warning where evergreen content isn't required.
    """
    own = Settings(settings)
    raw = F.regexp_extract(F.coalesce(F.col(reply), F.lit("")), r"(?s)\{.*\}", 0)
    parsed = F.try_parse_json(F.nullif(raw, F.lit("")))
    whole = F.get_json_object(raw, "$.score_global_evergreen")
    present = parsed.isNotNull() & whole.isNotNull()
    # Numbers lose their fraction; strings count only if they are whole numbers.
    number = F.when(whole.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(whole).try_cast("int"))
    plain = F.try_variant_get(parsed, "$.score_global_evergreen", "double").cast("int")
    is_string = F.schema_of_variant(F.try_variant_get(parsed, "$.score_global_evergreen", "variant")) == "STRING"
    score = F.coalesce(F.when(is_string, number).otherwise(plain), F.lit(0))
    kind = "array<struct<extrait:string,probleme:string,gravite:string>>"
    passages = F.coalesce(F.from_json(F.get_json_object(raw, "$.passages_problematiques"), kind), F.array().cast(kind))
    found = F.transform(
        F.filter(passages, lambda p: p.isNotNull()),
        lambda p: text.finding("evergreen.llm.problematic_passage", F.coalesce(p["gravite"], F.lit("moyenne")), "A passage ties the text to its time.", excerpt=p["extrait"], problem=p["probleme"]),
    )
    locale = F.col("locale")
    error = F.when(F.col("evergreen_required").isNull(), "missing_evergreen").when(F.coalesce(F.trim(locale), F.lit("")) == "", "missing_locale").when(~locale.isin(*rules.EVERGREEN_LOCALES), "unsupported_locale")
    if "parse_error" in df.columns:
        error = F.coalesce(error, F.col("parse_error"))
    ok = error.isNull()
    status = F.when(~present, "fail").when(score >= own.number("evergreen.pass_score"), "pass").when(score >= own.number("evergreen.warn_score"), "warn").otherwise("fail")
    eased = F.when(present & (status == "fail") & ~F.col("evergreen_required"), "warn").otherwise(status)
    reason = F.when(parsed.isNull(), "the reply holds no JSON object").otherwise("the reply holds no score_global_evergreen")
    if failure in df.columns:
        reason = F.coalesce(F.col(failure), reason)
    failed = F.array(text.finding("evergreen.llm_error", own.severity("evergreen.llm_error"), "The language model's reply could not be read.", error=reason))
    result = F.struct(
        F.when(ok, eased).alias("status"), F.when(ok, F.when(present, score).otherwise(0)).alias("score"),
        F.when(ok, F.when(present, found).otherwise(failed)).otherwise(F.array().cast(f"array<{text.FINDING}>")).alias("findings"), error.alias("error"),
    )
    return df.withColumn(column, result)
