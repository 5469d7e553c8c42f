"""Assembled articles: deterministic HTML built from documents, so that headings, sections, links and dates are there to judge.

Both kinds hold every word of every text, and a null text is an article without words. articles() has three headings, by one
SQL template for Spark and DuckDB (only word lists and slices differ); whole_articles() has a section for each run of words, for Spark only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WORDS = {
    "spark": "filter(split(translate(text, '&<>' || chr(9) || chr(10) || chr(13), '      '), ' '), x -> x <> '')",
    "duckdb": "list_filter(string_split(translate(text, '&<>' || chr(9) || chr(10) || chr(13), '      '), ' '), lambda x: x <> '')",
}
# First and last word of each part; `tail` is the first of the last 15 words, or word 79 of a text with fewer than 93.
_PARTS = {"intro": (1, 20), "h_a": (21, 23), "p_a": (24, 53), "h_b": (54, 55), "p_b": (56, 75), "h_c": (76, 78), "p_c": (79, "tail - 1"), "p_d": ("tail", "greatest(tail, n)")}


def _slice(dialect: str, first: int | str, last: int | str) -> str:
    return f"array_join(slice(w, {first}, {last} - {first} + 1), ' ')" if dialect == "spark" else f"array_to_string(w[{first}:{last}], ' ')"


def sql(dialect: str, documents: str = "documents") -> str:
    """A query for content_id, the parts, content, outline and contexts of all articles."""
    parts = ", ".join(f"{_slice(dialect, *at)} AS {name}" for name, at in _PARTS.items())
    size, none = ("size", "CAST(array() AS array<string>)") if dialect == "spark" else ("len", "CAST([] AS VARCHAR[])")
    return f"""
    SELECT *,
      concat('<p>', intro, '</p><h2>', h_a, '</h2><p>', p_a, ' ', link_a, '</p><h3>', h_b, '</h3><p>', p_b, dated, '</p><h2>', h_c, '</h2><p>', p_c,
             ' <strong>', keyword, '</strong></p><h2>Conclusion</h2><p>', p_d, '</p>',
             CASE WHEN content_id % 3 = 0 THEN concat('<h2>Lecture complémentaire</h2><p>', link_b, '</p>') ELSE '' END) AS content,
      concat('<h2>', CASE WHEN content_id % 4 = 1 THEN h_c ELSE h_a END, '</h2>', CASE WHEN content_id % 4 = 2 THEN '<h4>' ELSE '<h3>' END, h_b,
             CASE WHEN content_id % 4 = 2 THEN '</h4>' ELSE '</h3>' END, '<h2>', CASE WHEN content_id % 4 = 1 THEN h_a ELSE h_c END, '</h2><h2>Conclusion</h2>') AS outline
    FROM (SELECT *,
        concat('<a href="', href_a, '"', CASE WHEN content_id % 2 = 0 THEN ' target="_blank" rel="noopener noreferrer"' ELSE '' END, '>étude citée</a>') AS link_a,
        concat('<a href="', href_b, '">suite</a>') AS link_b,
        CASE content_id % 5 WHEN 0 THEN ' depuis mars 2021' WHEN 1 THEN ' in 2019' WHEN 2 THEN ' le 12/03/2024' WHEN 3 THEN ' actuellement' ELSE '' END AS dated
      FROM (SELECT doc_id AS content_id, lang, {parts}, 'the' AS keyword,
          concat('https://www.example.org/p/', CAST(doc_id AS string), CASE WHEN doc_id % 4 = 0 THEN '?utm_source=x' ELSE '' END) AS href_a,
          CASE WHEN doc_id % 5 = 0 THEN concat('https://autre.example/', CAST(doc_id % 7 AS string)) ELSE concat('/interne/', CAST(doc_id % 7 AS string)) END AS href_b
        FROM (SELECT *, greatest(79, n - 14) AS tail
          FROM (SELECT *, {size}(w) AS n
            FROM (SELECT doc_id, lang, coalesce({_WORDS[dialect]}, {none}) AS w FROM {documents}) AS split_words) AS counted) AS ended) AS cut) AS linked
    """


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(sql("spark", "{documents}"), documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Words of a whole article's introduction and conclusion, and of a section's h2, first paragraph and h3; the rest of its run is the second paragraph.
INTRO, END, RUN, H2, P1, H3 = 20, 15, 100, 3, 30, 2


def whole_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """content_id, lang, keyword, h_a, href_a, href_b, content, outline: an article of all words for each document.

    The introduction has the first words, the conclusion the last ones, and a section each run of words between them; there is
    one section at least. A null text is an article without words. The first of every five sections has the link, all have the
    date and the last the keyword. As in articles(), every fourth outline has its sections reversed and every fourth h4 for h3.
    """
    words = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").alias("content_id"), "lang", F.coalesce(F.expr(_WORDS["spark"]), F.array().cast("array<string>")).alias("w")
    )
    cut = words.selectExpr("*", f"greatest({INTRO}, size(w) - {END}) AS body_end").selectExpr("*", f"greatest(1, cast(ceil((body_end - {INTRO}) / {RUN}) AS int)) AS n_sections")
    run = lambda at, n: f"array_join(slice(w, {INTRO} + i * {RUN} + {at} + 1, greatest(0, least({n}, least(size(w), body_end) - {INTRO} - i * {RUN} - {at}))), ' ')"
    parts = f"named_struct('at', i, 'h2', {run(0, H2)}, 'p1', {run(H2, P1)}, 'h3', {run(H2 + P1, H3)}, 'p2', {run(H2 + P1 + H3, RUN - H2 - P1 - H3)})"
    split = cut.selectExpr(
        "content_id", "lang", "'the' AS keyword", f"array_join(slice(w, 1, {INTRO}), ' ') AS intro", "array_join(slice(w, body_end + 1, greatest(0, size(w) - body_end)), ' ') AS conclusion",
        f"transform(sequence(0, n_sections - 1), i -> {parts}) AS sections",
        "concat('https://www.example.org/p/', CAST(content_id AS string), CASE WHEN content_id % 4 = 0 THEN '?utm_source=x' ELSE '' END) AS href_a",
        "CASE WHEN content_id % 5 = 0 THEN concat('https://autre.example/', CAST(content_id % 7 AS string)) ELSE concat('/interne/', CAST(content_id % 7 AS string)) END AS href_b",
        "CASE content_id % 5 WHEN 0 THEN ' depuis mars 2021' WHEN 1 THEN ' in 2019' WHEN 2 THEN ' le 12/03/2024' WHEN 3 THEN ' actuellement' ELSE '' END AS dated",
    )
    link = """CASE WHEN s.at % 5 = 0 THEN concat(' <a href="', href_a, '"', CASE WHEN content_id % 2 = 0 THEN ' target="_blank" rel="noopener noreferrer"' ELSE '' END, '>étude citée</a>') ELSE '' END"""
    strong = "CASE WHEN s.at = size(sections) - 1 THEN concat(' <strong>', keyword, '</strong>') ELSE '' END"
    body = f"array_join(transform(sections, s -> concat('<h2>', s.h2, '</h2><p>', s.p1, {link}, '</p><h3>', s.h3, '</h3><p>', s.p2, dated, {strong}, '</p>')), '')"
    more = """CASE WHEN content_id % 3 = 0 THEN concat('<h2>Lecture complémentaire</h2><p><a href="', href_b, '">suite</a></p>') ELSE '' END"""
    level = "CASE WHEN content_id % 4 = 2 THEN 'h4>' ELSE 'h3>' END"
    heads = f"transform(CASE WHEN content_id % 4 = 1 THEN reverse(sections) ELSE sections END, s -> concat('<h2>', s.h2, '</h2><', {level}, s.h3, '</', {level}))"
    return split.selectExpr(
        "content_id", "lang", "keyword", "sections[0].h2 AS h_a", "href_a", "href_b",
        f"concat('<p>', intro, '</p>', {body}, '<h2>Conclusion</h2><p>', conclusion, '</p>', {more}) AS content",
        f"concat(array_join({heads}, ''), '<h2>Conclusion</h2>') AS outline",
    )
