"""Text expressions: pure columns, but for HTML entities, which only texts with an ampersand send to Python."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from vellum.functions import shares

#: White space as Python's str knows it.
SPACE = r"(?U)[\s\x1c-\x1f]"


@F.arrow_udf(StringType())
def _unescape(texts: pa.Array) -> pa.Array:
    return shares.gathered(lambda found: pa.array([html.unescape(t) if t is not None else None for t in found.to_pylist()], pa.string()), texts)


def unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("&")), _unescape(F.when(F.contains(text, F.lit("&")), text))).otherwise(text)


def collapse(text: Column) -> Column:
    """Each run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def normalize(text: Column) -> Column:
    return collapse(unescape(F.coalesce(text, F.lit(""))))


def visible_text(content: Column) -> Column:
    """Text without script and style elements and tags, entities decoded, white space collapsed."""
    bare = F.regexp_replace(F.coalesce(content, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return normalize(F.regexp_replace(bare, r"<[^>]+>", " "))


def word_count(text: Column) -> Column:
    """Words of a text whose white space is collapsed."""
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " ", -1)))


def without_tags(content: Column) -> Column:
    """Runs of tags with the blanks around them as one space; line ends and outer space stay."""
    return F.regexp_replace(F.coalesce(content, F.lit("")), r"[ \t]*<[^>]+>(?:[ \t]*<[^>]+>)*[ \t]*", " ")


def decoded_text(content: Column) -> Column:
    """without_tags() with entities decoded."""
    return unescape(without_tags(content))


def escaped_payload(content: Column) -> Column:
    """Escaped quotes and line feeds of a transported text as the characters that they stand for."""
    out = F.replace(F.replace(content, F.lit('\\"'), F.lit('"')), F.lit("\\'"), F.lit("'"))
    return F.replace(out, F.lit("\\n"), F.lit("\n"))


def lines(text: Column) -> Column:
    """The lines of a text; an end of line closes a line and opens none."""
    cut = F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", -1)
    return F.when(F.element_at(cut, -1) == "", F.slice(cut, 1, F.greatest(F.size(cut) - 1, F.lit(0)))).otherwise(cut)


def sentences(text: Column) -> Column:
    cut = F.transform(F.split(normalize(text), r"(?<=[.!?]) +", -1), lambda x: F.trim(x))
    return F.filter(cut, lambda s: s != "")


def _accents() -> tuple[str, str]:
    """Latin letters whose decomposition is a base letter and marks, and those letters."""
    pairs = [(chr(c), "".join(x for x in unicodedata.normalize("NFD", chr(c)) if unicodedata.category(x) != "Mn")) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()


def fold(text: Column) -> Column:
    """For matching: lower case, Latin accents removed, white space collapsed."""
    lowered = F.lower(unescape(F.coalesce(text, F.lit(""))))
    return collapse(F.regexp_replace(F.translate(lowered, ACCENTED, PLAIN), r"\p{Mn}", ""))


def fold_plain(text: Column) -> Column:
    """fold() for texts whose entities are already decoded; usable inside lambdas."""
    return collapse(F.regexp_replace(F.translate(F.lower(text), ACCENTED, PLAIN), r"\p{Mn}", ""))


def phrase_count(folded: Column, phrase: Column) -> Column:
    """How often a folded phrase stands in a folded text as whole words; 0 for an empty phrase."""
    quoted = F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.replace(phrase, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?!\w)"))
    return F.when(phrase == "", 0).otherwise(F.regexp_count(folded, quoted))


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def chunks(text: Column, size: int, overlap: int) -> Column:
    """Overlapping runs of words of a text whose entities are decoded: structs of chunk_id, text, start_word, end_word, word_count; the last ends with the text."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap at least 0 and below size")
    step = size - overlap

    def cut(words: Column) -> Column:
        n = F.size(words)
        starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))
        return F.transform(
            starts,
            lambda s, i: F.struct(
                (i + 1).alias("chunk_id"), F.array_join(F.slice(words, s + 1, F.lit(size)), " ").alias("text"), s.alias("start_word"),
                F.least(s + size, n).alias("end_word"), (F.least(s + size, n) - s).alias("word_count"),
            ),
        )

    return bind(F.filter(F.split(collapse(text), " ", -1), lambda w: w != ""), cut)


def finding(rule_id: str, severity: str | Column, message: str, **evidence: Column) -> Column:
    """A finding: rule, severity, message and its evidence as JSON with fields in alphabetical order."""
    fields = [evidence[k].alias(k) for k in sorted(evidence)]
    return F.struct(
        F.lit(rule_id).alias("rule_id"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        F.lit(message).alias("message"),
        (F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}) if fields else F.lit("{}")).alias("evidence"),
    )


FINDING = "struct<rule_id:string,severity:string,message:string,evidence:string>"


def findings(*checks: tuple[Column, Column]) -> Column:
    """The findings whose condition holds, in order."""
    return F.filter(F.array(*(F.when(c, f) for c, f in checks)), lambda x: x.isNotNull())
