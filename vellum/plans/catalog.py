"""Registered queries over the driver tables, each with DuckDB SQL for the same rows where SQL can express them.

Queries on assembled articles (vellum.plans.corpus) take apart their HTML; the SQL beside them starts from the parts that
the articles are made of. Each of these queries has a second one, `..._whole`, over articles with a section for each run of words.
Arrays are joined to strings, so that either engine shows them alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import html, links, rules, text
from vellum.operators import evergreen, length, seo, services, sources, structure, typography
from vellum.plans import corpus, evaluate
from vellum.sources import company_export

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
WEBSITE = "https://www.home.example"


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _joined(items: Column) -> Column:
    return F.array_join(items, "|")


# ---- documents as they are ----
_SPACES = r"[\s\p{Z}\x0B\x1c-\x1f\x{85}]"
_VISIBLE = (
    rf"trim(regexp_replace(regexp_replace(regexp_replace(text, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '{_SPACES}+', ' ', 'g'))"
)
_COUNTED = f"SELECT doc_id, lang, CASE WHEN {_VISIBLE} = '' THEN 0 ELSE len(string_split({_VISIBLE}, ' ')) END::INT AS word_count FROM documents"
_RANGES = ", ".join(f"('{k}', '{e}', {a}, {'NULL' if b is None else b})" for k, by in rules.LENGTH_RANGES.items() for e, (a, b) in by.items())
_JUDGED = f"""
    SELECT c.*, r.expected_length, CASE WHEN word_count < trunc(least_words * 0.9::DOUBLE) OR word_count > trunc(most_words * 1.1::DOUBLE) THEN 'fail' ELSE 'pass' END AS status
    FROM ({_COUNTED}) c, (VALUES {_RANGES}) r(content_type, expected_length, least_words, most_words)
    WHERE r.content_type = 'articles' AND r.expected_length = CASE doc_id % 3 WHEN 0 THEN 'SIMPLE' WHEN 1 THEN 'MEDIUM' ELSE 'LONG' END
"""


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = _table(spark, sf_dir, "documents").select("doc_id", "lang", text.visible_text(F.col("text")).alias("plain"))
    return plain.select("doc_id", "lang", text.word_count(F.col("plain")).alias("word_count"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("doc_id") % 3 == 0, "SIMPLE").when(F.col("doc_id") % 3 == 1, "MEDIUM").otherwise("LONG")
    return length.judge(_counted(spark, sf_dir).withColumns({"content_type": F.lit("articles"), "expected_length": kind}))


@_query(f"SELECT doc_id, word_count, word_count = 0 AS is_empty FROM ({_COUNTED})")
def q01_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(spark, sf_dir).select("doc_id", "word_count", (F.col("word_count") == 0).alias("is_empty"))


@_query(f"SELECT doc_id, expected_length, word_count, status, CASE WHEN status = 'pass' THEN 100 ELSE 0 END AS score, (status = 'fail')::INT AS blocking FROM ({_JUDGED})")
def q02_length_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocking = F.size(evaluate.blocking(F.lit("length"), F.col("length")))
    return _judged(spark, sf_dir).select("doc_id", "expected_length", "word_count", "length.status", "length.score", blocking.alias("blocking"))


@_query(f"SELECT lang, status, count(*) AS n FROM ({_JUDGED}) GROUP BY ALL")
def q03_length_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).groupBy("lang", F.col("length.status").alias("status")).agg(F.count("*").alias("n"))


_DECODED = r"regexp_replace(text, '[ \t]*<[^>]+>(?:[ \t]*<[^>]+>)*[ \t]*', ' ', 'g')"
_TYPO = {
    "double_spaces": rf"len(regexp_extract_all({_DECODED}, ' {{2,}}'))",
    "trailing_spaces": r"len(list_filter(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'), lambda x: regexp_matches(x, '[ \t]+$')))",
    "space_before_dot": rf"len(regexp_extract_all({_DECODED}, '{_SPACES}+\.'))",
    "space_before_comma": rf"len(regexp_extract_all({_DECODED}, '{_SPACES}+,'))",
    "french_nbsp_before_double_punctuation": rf"len(regexp_extract_all({_DECODED}, '[:;!?%]')) - len(regexp_extract_all({_DECODED}, '\x{{A0}}[:;!?%]'))",
    "multiple_punctuation": rf"len(regexp_extract_all({_DECODED}, '[!?.,;:]{{2,}}'))",
}
for _i, _rule in enumerate(_TYPO):

    def _typo(spark: SparkSession, sf_dir: str, rule: str = _rule) -> DataFrame:
        return _table(spark, sf_dir, "documents").select("doc_id", typography.count(F.col("text"), rule).alias("n"))

    QUERIES[f"q{_i + 4:02d}_typo_{_rule}"] = _typo
    ORACLE_SQL[f"q{_i + 4:02d}_typo_{_rule}"] = f"SELECT doc_id, coalesce({_TYPO[_rule]}, 0)::INT AS n FROM documents"

_HTML_TYPO = {"attached_links": r"(?i)[\p{L}\p{N}\p{M}_]<a\b", "repeated_line_breaks": rf"(?i)(?:<br{_SPACES}*/?>{_SPACES}*){{2,}}"}
for _i, _rule in enumerate(_HTML_TYPO):

    def _html_typo(spark: SparkSession, sf_dir: str, rule: str = _rule) -> DataFrame:
        return _table(spark, sf_dir, "pages").select("page_id", typography.count(F.col("html"), rule).alias("n"))

    QUERIES[f"q{_i + 10}_typo_{_rule}"] = _html_typo
    ORACLE_SQL[f"q{_i + 10}_typo_{_rule}"] = f"SELECT page_id, len(regexp_extract_all(coalesce(html, ''), '{_HTML_TYPO[_rule]}'))::INT AS n FROM pages"

_MAJOR = f"({_TYPO['french_nbsp_before_double_punctuation']} > 0)::INT"
_MINOR = " + ".join(f"({x} > 0)::INT" for k, x in _TYPO.items() if not k.startswith("french"))


@_query(f"""
    SELECT doc_id, CASE WHEN major + minor = 0 THEN 'pass' WHEN major > 0 THEN 'fail' ELSE 'warn' END AS status, greatest(0, 100 - 25 * major - 10 * minor)::INT AS score,
           CASE WHEN major > 0 THEN major + minor ELSE 0 END::INT AS blocking
    FROM (SELECT doc_id, {_MAJOR} AS major, {_MINOR} AS minor FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))
""")  # fmt: skip
def q12_typography_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), F.lit("fr-FR").alias("locale"))
    out = typography.judge(rows)
    return out.select("doc_id", "typography.status", "typography.score", F.size(evaluate.blocking(F.lit("typography"), F.col("typography"))).alias("blocking"))


# ---- pages ----
_TAGS = r"regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<(?:script|style)[^>]*>.*?</(?:script|style)>', '<scripted>', 'g'), '<([a-zA-Z][a-zA-Z0-9]*)', 1)"
_USED = f"""SELECT page_id, list_sort(list_distinct(list_concat(list_filter(list_transform({_TAGS}, lambda t: lower(t)), lambda t: t <> 'scripted'),
    CASE WHEN regexp_matches(html, '(?i)<script') THEN ['script'] ELSE [] END, CASE WHEN regexp_matches(html, '(?i)<style') THEN ['style'] ELSE [] END))) AS tags FROM pages"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", "url", html.parse(F.col("html")).alias("page"))


@_query(f"SELECT page_id, array_to_string(tags, '|') AS tags FROM ({_USED})")
def q13_used_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", _joined(html.used_tags(F.col("page"))).alias("tags"))


@_query(f"SELECT page_id, list_contains(tags, 'h1') AS has_h1, list_contains(tags, 'script') AS has_script, list_contains(tags, 'span') AS has_span, list_contains(tags, 'p') AS has_p FROM ({_USED})")
def q14_structure_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", *(html.has(F.col("page"), t).alias(f"has_{t}") for t in ("h1", "script", "span", "p")))


_ALLOWED = ", ".join(f"'{t}'" for t in rules.HEADING_TAGS + rules.BODY_TAGS)


@_query(f"SELECT page_id, array_to_string(list_filter(tags, lambda t: t NOT IN ({_ALLOWED})), '|') AS tags FROM ({_USED})")
def q15_disallowed_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = F.array(*map(F.lit, rules.HEADING_TAGS + rules.BODY_TAGS))
    return _pages(spark, sf_dir).select("page_id", _joined(F.array_except(html.used_tags(F.col("page")), allowed)).alias("tags"))


# ---- assembled articles: structure ----
_ART = corpus.sql("duckdb")
_HEADS = "[h_a, h_b, h_c, 'Conclusion']"
_TRAIL = "CASE WHEN content_id % 3 = 0 THEN ['Lecture complémentaire'] ELSE [] END"


Articles = Callable[[SparkSession, str], DataFrame]


@_query(f"SELECT content_id, array_to_string(list_concat({_HEADS}, {_TRAIL}), '|') AS headings, array_to_string(list_concat(['h2', 'h3', 'h2', 'h2'], CASE WHEN content_id % 3 = 0 THEN ['h2'] ELSE [] END), '|') AS levels FROM ({_ART})")
def q16_headings(spark: SparkSession, sf_dir: str, articles: Articles = corpus.articles) -> DataFrame:
    found = html.headings(F.col("page"), rules.HEADING_TAGS)
    rows = articles(spark, sf_dir).select("content_id", html.parse(F.col("content")).alias("page")).select("content_id", found.alias("h"))
    return rows.select("content_id", _joined(F.col("h.text")).alias("headings"), _joined(F.col("h.level")).alias("levels"))


_SECTION_ROWS = """
    SELECT content_id, 1 AS "at", h_a AS h2, h_b AS h3, concat_ws(' ', nullif(trim(concat(p_a, ' étude citée')), ''), nullif(h_b, ''), nullif(trim(concat(p_b, dated)), '')) AS section FROM ({art})
    UNION ALL SELECT content_id, 2, h_c, '', trim(concat(p_c, ' the')) FROM ({art})
    UNION ALL SELECT content_id, 3, 'Conclusion', '', p_d FROM ({art})
    UNION ALL SELECT content_id, 4, 'Lecture complémentaire', '', 'suite' FROM ({art}) WHERE content_id % 3 = 0
""".format(art=_ART)


@_query(_SECTION_ROWS)
def q17_sections(spark: SparkSession, sf_dir: str, articles: Articles = corpus.articles) -> DataFrame:
    rows = articles(spark, sf_dir).select("content_id", html.parse(F.col("content")).alias("page"))
    rows = rows.select("content_id", F.posexplode(html.sections(F.col("page"))).alias("at", "s"))
    return rows.select("content_id", (F.col("at") + 1).alias("at"), "s.h2", _joined(F.col("s.h3_headings")).alias("h3"), F.col("s.text").alias("section"))


@_query(f"SELECT content_id, intro AS introduction FROM ({_ART})")
def q18_introduction(spark: SparkSession, sf_dir: str, articles: Articles = corpus.articles) -> DataFrame:
    rows = articles(spark, sf_dir).select("content_id", html.parse(F.col("content")).alias("page"))
    return rows.select("content_id", html.introduction(F.col("page"), F.lit(-1), rules.TEXT_BLOCKS).alias("introduction"))


@_query(f"SELECT content_id, p_d AS conclusion FROM ({_ART})")
def q19_conclusion(spark: SparkSession, sf_dir: str, articles: Articles = corpus.articles) -> DataFrame:
    rows = articles(spark, sf_dir).select("content_id", html.parse(F.col("content")).alias("page"))
    return rows.select("content_id", html.conclusion(html.sections(F.col("page")), rules.COMPLEMENTARY_TITLES, folded=True).alias("conclusion"))


@_query(f"""
    SELECT content_id, CASE WHEN rules = '' THEN 'pass' ELSE 'fail' END AS status, CASE WHEN rules = '' THEN 'structure.valid' ELSE rules END AS rules FROM (
      SELECT content_id, concat_ws('|', CASE WHEN content_id % 4 = 1 AND h_a <> h_c THEN 'structure.heading_order' END, CASE WHEN content_id % 4 = 2 THEN 'structure.heading_levels' END,
        CASE WHEN regexp_matches(lower(concat_ws(' ', intro, h_a, p_a, 'étude citée', h_b, p_b, dated, h_c, p_c, keyword, 'Conclusion', p_d, CASE WHEN content_id % 3 = 0 THEN 'Lecture complémentaire suite' END)), 'angle de réponse|note|instruction|indication')
             THEN 'structure.no_internal_outline_comments_exposed' END) AS rules FROM ({_ART}))
""")  # fmt: skip
def q20_structure_judge(spark: SparkSession, sf_dir: str, articles: Articles = corpus.articles) -> DataFrame:
    rows = structure.judge(articles(spark, sf_dir).select("content_id", "content", F.col("outline").alias("expected_outline_html")))
    return rows.select("content_id", "structure.status", _joined(F.col("structure.findings.rule_id")).alias("rules"))


@_query(f"SELECT content_id, (content_id % 2)::INT AS cta_count, CASE WHEN content_id % 2 = 1 THEN h_a ELSE '' END AS strong_text, CASE WHEN content_id % 3 = 0 THEN '9' ELSE '' END AS complementary, CASE WHEN content_id % 3 = 0 THEN 12 ELSE 10 END::INT AS top_level FROM ({_ART})")
def q21_cta_signals(spark: SparkSession, sf_dir: str, articles: Articles = corpus.articles) -> DataFrame:
    """Articles with a call to action added in a paragraph of that class, or one of another class."""
    call = F.concat(F.lit("<p class='"), F.when(F.col("content_id") % 2 == 1, "lead cta").otherwise("ctas"), F.lit("'>go <strong>"), F.col("h_a"), F.lit("</strong></p>"))
    rows = articles(spark, sf_dir).select("content_id", html.parse(F.concat(F.col("content"), call)).alias("page"))
    rows = rows.select("content_id", html.cta_signals(F.col("page"), rules.COMPLEMENTARY_TITLES).alias("c"))
    return rows.select("content_id", "c.cta_count", F.coalesce(F.get("c.cta_blocks", F.lit(0))["strong_text"], F.lit("")).alias("strong_text"), _joined(F.transform("c.complementary_indexes", lambda i: i.cast("string"))).alias("complementary"), F.col("c.top_level_tag_count").alias("top_level"))


# ---- links and sources ----
_LINK_ROWS = f"""
    SELECT content_id, 1 AS link, href_a AS href, 'étude citée' AS anchor_text, CASE WHEN content_id % 2 = 0 THEN '_blank' ELSE '' END AS target, TRUE AS is_external, 'body' AS section FROM ({_ART})
    UNION ALL SELECT content_id, 2, href_b, 'suite', '', content_id % 5 = 0, 'complementary_reading' FROM ({_ART}) WHERE content_id % 3 = 0
"""


def _linked(spark: SparkSession, sf_dir: str, articles: Articles) -> DataFrame:
    return sources.extract(articles(spark, sf_dir).withColumn("organization_website", F.lit(WEBSITE)))


@_query(_LINK_ROWS)
def q22_links(spark: SparkSession, sf_dir: str, articles: Articles = corpus.articles) -> DataFrame:
    rows = _linked(spark, sf_dir, articles).select("content_id", F.explode("links").alias("x"))
    return rows.select("content_id", F.col("x.index").alias("link"), "x.href", "x.anchor_text", "x.target", "x.is_external", "x.section")


@_query(r"""
    SELECT page_id, len(h)::INT AS n_links, len(list_filter(h, lambda x: regexp_matches(x, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]+')))::INT AS external_links
    FROM (SELECT page_id, regexp_extract_all(regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<(?:script|style)[^>]*>.*?</(?:script|style)>', '', 'g'), '(?i)<a\s[^>]*?href="([^"]*)"', 1) AS h FROM pages)
""")
def q23_page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("content"), F.lit(WEBSITE).alias("organization_website"))
    n = sources.partitions(F.col("links"))
    return sources.extract(pages).select("page_id", F.size("links").alias("n_links"), n["external_count"].alias("external_links"))


@_query(f"""
    SELECT content_id, 1 + (content_id % 3 = 0 AND content_id % 5 = 0)::INT AS external, (content_id % 3 = 0 AND content_id % 5 <> 0)::INT AS internal, 1 AS body_external,
           (content_id % 3 = 0)::INT AS complementary, (content_id % 15 = 0)::INT AS complementary_external FROM ({_ART})
""")
def q24_link_partitions(spark: SparkSession, sf_dir: str, articles: Articles = corpus.articles) -> DataFrame:
    rows = _linked(spark, sf_dir, articles).select("content_id", sources.partitions(F.col("links")).alias("n"))
    return rows.select("content_id", *(F.col(f"n.{x}_count").alias(x) for x in ("external", "internal", "body_external", "complementary", "complementary_external")))


@_query(f"""
    SELECT content_id, CASE content_id % 3 WHEN 0 THEN concat('https://bare.example/', content_id::VARCHAR) WHEN 1 THEN 'https://marked.example)' ELSE '' END AS raw_urls,
           CASE WHEN content_id % 3 = 1 THEN '[x](https://marked.example)' ELSE '' END AS markdown_links, (content_id % 3 = 2)::INT AS attached FROM ({_ART})
""")
def q25_raw_markdown_urls(spark: SparkSession, sf_dir: str, articles: Articles = corpus.articles) -> DataFrame:
    """Articles with a bare URL, a Markdown link or an attached anchor added."""
    more = F.when(F.col("content_id") % 3 == 0, F.concat(F.lit("<p>see https://bare.example/"), F.col("content_id"), F.lit("</p>"))).when(F.col("content_id") % 3 == 1, "<p>[x](https://marked.example)</p>").otherwise('<p>word<a href="/x">y</a></p>')
    rows = sources.extract(articles(spark, sf_dir).select("content_id", F.concat("content", more).alias("content"), F.lit(WEBSITE).alias("organization_website")))
    return rows.select("content_id", _joined(F.col("raw_urls")).alias("raw_urls"), _joined(F.col("markdown_links")).alias("markdown_links"), F.col("attached_anchors").alias("attached"))


_NAMES = "list_distinct(list_transform(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: regexp_matches(p, '^[^=]*=.')), lambda p: regexp_extract(p, '^([^=]*)=', 1)))"
_EXACT = ", ".join(f"'{p}'" for p in rules.TRACKING_PATTERNS if "*" not in p)


@_query(f"SELECT page_id, regexp_matches(url, '(?i)^https?://[^/?#]+') AS valid, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1) AS netloc, array_to_string(list_sort(list_filter({_NAMES}, lambda n: n IN ({_EXACT}) OR n LIKE 'utm\\_%' ESCAPE '\\')), '|') AS tracking FROM pages")
def q26_url_format_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return _table(spark, sf_dir, "pages").select("page_id", links.allowed_scheme(url).alias("valid"), links.netloc(url).alias("netloc"), _joined(F.array_sort(links.tracking_parameters(url))).alias("tracking"))


_CODES = (200, 301, 302, 400, 404, 410, 401, 403, 406, 202, 500, 502, 503, 418, 307)
_IN = lambda codes: ", ".join(map(str, codes))


@_query(f"""
    SELECT page_id, code, CASE WHEN code IN ({_IN(rules.STATUS_ALLOWED)}) THEN 'reachable' WHEN code IN ({_IN(rules.STATUS_FORBIDDEN)}) THEN 'unreachable' ELSE 'unknown' END AS network_status,
           CASE WHEN code IN ({_IN(rules.STATUS_FORBIDDEN + rules.STATUS_UNKNOWN)}) THEN concat('http_status_', code) WHEN code NOT IN ({_IN(rules.STATUS_ALLOWED)}) THEN concat('unhandled_http_status_', code) END AS error
    FROM (SELECT page_id, ([{_IN(_CODES)}])[(page_id % {len(_CODES)} + 1)::INT]::INT AS code FROM pages)
""")  # fmt: skip
def q27_url_status_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.element_at(F.array(*map(F.lit, _CODES)), (F.col("page_id") % len(_CODES) + 1).cast("int"))
    rows = _table(spark, sf_dir, "pages").select("page_id", code.alias("code"))
    return rows.select("page_id", "code", links.status_class(F.col("code")).alias("s")).select("page_id", "code", "s.network_status", "s.error")


@_query(f"""
    SELECT content_id, CASE WHEN major > 0 THEN 'fail' WHEN minor > 0 THEN 'warn' ELSE 'pass' END AS status, CASE WHEN major > 0 THEN 0 WHEN minor > 0 THEN 80 ELSE 100 END::INT AS score, major::INT AS blocking FROM (
      SELECT content_id,
        (content_id % 15 = 0)::INT + (expected_length = 'SIMPLE' AND content_id % 15 = 0)::INT + (content_id % 4 = 0)::INT + (content_id % 3 = 0 AND content_id % 5 <> 0)::INT AS major,
        (content_id % 2 = 1)::INT + (content_id % 15 = 0)::INT AS minor
      FROM (SELECT content_id, CASE content_id % 3 WHEN 0 THEN 'SIMPLE' WHEN 1 THEN 'MEDIUM' ELSE 'LONG' END AS expected_length FROM ({_ART})))
""")
def q29_sources_judge(spark: SparkSession, sf_dir: str, articles: Articles = corpus.articles) -> DataFrame:
    kind = F.when(F.col("content_id") % 3 == 0, "SIMPLE").when(F.col("content_id") % 3 == 1, "MEDIUM").otherwise("LONG")
    rows = _linked(spark, sf_dir, articles).withColumns({"content_type": F.lit("articles"), "expected_length": kind, "require_sources": F.lit(True)})
    out = sources.judge(sources.with_checks(rows, "content_id"))
    return out.select("content_id", "sources.status", "sources.score", F.size(evaluate.blocking(F.lit("sources"), F.col("sources"))).alias("blocking"))


@_query(f"""
    SELECT href, count(*) AS n FROM (SELECT href_b AS href FROM ({_ART}) WHERE content_id % 3 = 0) GROUP BY href HAVING count(*) > 1
""")
def q28_duplicate_links(spark: SparkSession, sf_dir: str, articles: Articles = corpus.articles) -> DataFrame:
    rows = _linked(spark, sf_dir, articles).select(F.explode("links").alias("x")).where("x.section = 'complementary_reading'")
    return rows.groupBy(F.col("x.href").alias("href")).agg(F.count("*").alias("n")).where("n > 1")


@_query(f"SELECT content_id, content_id % 2 = 0 AS duplicated FROM ({_ART})")
def q43_duplicate_links_in_text(spark: SparkSession, sf_dir: str, articles: Articles = corpus.articles) -> DataFrame:
    """Articles of which every other one links its first source again."""
    again = F.when(F.col("content_id") % 2 == 0, F.concat(F.lit('<p><a href="'), F.col("href_a"), F.lit('">encore</a></p>'))).otherwise("")
    rows = sources.extract(articles(spark, sf_dir).select("content_id", F.concat("content", again).alias("content"), F.lit(WEBSITE).alias("organization_website")))
    rows = rows.withColumns({"content_type": F.lit("articles"), "expected_length": F.lit("LONG"), "require_sources": F.lit(False)})
    out = sources.judge(sources.with_checks(rows, "content_id"))
    return out.select("content_id", F.array_contains("sources.findings.rule_id", "sources.no_duplicate_links").alias("duplicated"))


# ---- keywords and meaning ----
_KEYWORDS = ("the", "de la", "und", "in")


def _count_sql(zone: str, keyword: str) -> str:
    """Whole-word occurrences; separators are doubled first, as a match consumes the ones around it."""
    folded = rf"regexp_replace(strip_accents(lower({zone})), '([^\p{{L}}\p{{N}}\p{{M}}_])', '\1\1', 'g')"
    return rf"len(regexp_extract_all(concat(' ', {folded}, ' '), '(?:^|[^\p{{L}}\p{{N}}\p{{M}}_]){keyword.replace(' ', '  ')}(?:$|[^\p{{L}}\p{{N}}\p{{M}}_])'))::INT"


@_query("SELECT doc_id, " + ", ".join(f"{_count_sql('text', k)} AS k{i}" for i, k in enumerate(_KEYWORDS)) + r" FROM (SELECT doc_id, coalesce(trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')), '') AS text FROM documents)")
def q30_phrase_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", text.fold(F.col("text")).alias("f"))
    return rows.select("doc_id", *(text.phrase_count(F.col("f"), F.lit(k)).alias(f"k{i}") for i, k in enumerate(_KEYWORDS)))


def _seo_rows(spark: SparkSession, sf_dir: str, articles: Articles) -> DataFrame:
    return articles(spark, sf_dir).select(
        "content_id", "content", F.lit("articles").alias("content_type"), F.lit("MEDIUM").alias("expected_length"), F.lit("DECISION").alias("funnel_stage"),
        F.col("keyword").alias("main_keyword"), F.array(F.lit("of"), F.lit("que")).alias("secondary_keywords"), F.array().cast("array<string>").alias("long_tail_keywords"),
    )


_BODY = "concat_ws(' ', intro, h_a, p_a, 'étude citée', h_b, p_b || dated, h_c, p_c, 'the', 'Conclusion', p_d, CASE WHEN content_id % 3 = 0 THEN 'Lecture complémentaire suite' END)"


@_query(f"""SELECT content_id, {_count_sql(_BODY, 'the')} AS lexical_body, {_count_sql('intro', 'the')} AS lexical_introduction,
    ({" + ".join(_count_sql(h, 'the') for h in ('h_a', 'h_b', 'h_c'))})::INT AS lexical_headings, {_count_sql('p_d', 'the')} AS lexical_conclusion, 1 AS emphasis FROM ({_ART})""")
def q31_keyword_signals(spark: SparkSession, sf_dir: str, articles: Articles = corpus.articles) -> DataFrame:
    rows = seo.lexical(_seo_rows(spark, sf_dir, articles), signals=("body", "introduction", "headings", "conclusion", "emphasis"))
    return rows.select("content_id", "lexical_body", "lexical_introduction", "lexical_headings", "lexical_conclusion", F.size("lexical_emphasis").alias("emphasis"))


@_query(f"SELECT content_id, 'strong' AS tag, 'the' AS keyword, 'the' AS text FROM ({_ART})")
def q33_keyword_emphasis(spark: SparkSession, sf_dir: str, articles: Articles = corpus.articles) -> DataFrame:
    rows = seo.lexical(_seo_rows(spark, sf_dir, articles), signals=("emphasis",)).select("content_id", F.explode("lexical_emphasis").alias("e"))
    return rows.select("content_id", "e.tag", "e.keyword", "e.text")


_MATCHED = "array_to_string(list_filter(['of', 'que'], lambda k: CASE k WHEN 'of' THEN n_of ELSE n_que END > 0), '|')"


@_query(f"""
    SELECT content_id, ("at" - 1)::INT AS "at", h2, {_MATCHED} AS matched, sum((n_of + n_que > 0)::INT) OVER (PARTITION BY content_id) = 1 AS concentrated
    FROM (SELECT content_id, "at", h2, {_count_sql("section", 'of')} AS n_of, {_count_sql("section", 'que')} AS n_que FROM ({_SECTION_ROWS}) WHERE "at" < 4)
""")
def q32_section_distribution(spark: SparkSession, sf_dir: str, articles: Articles = corpus.articles) -> DataFrame:
    rows = seo.lexical(_seo_rows(spark, sf_dir, articles), signals=("distribution", "concentrated")).select("content_id", "lexical_concentrated", F.posexplode("lexical_distribution").alias("at", "s"))
    return rows.select("content_id", "at", "s.h2", _joined(F.col("s.matched")).alias("matched"), F.col("lexical_concentrated").alias("concentrated"))


@_query(rf"""
    SELECT doc_id, (i * 112)::INT AS start_word, least(i * 112 + 128, n)::INT AS end_word, array_to_string(w[i * 112 + 1 : i * 112 + 128], ' ') AS chunk
    FROM (SELECT *, unnest(range(0, CASE WHEN n = 0 THEN 0 ELSE greatest(n - 17, 0) // 112 + 1 END)) AS i
          FROM (SELECT doc_id, w, len(w) AS n FROM (SELECT doc_id, list_filter(string_split(trim(regexp_replace(coalesce(text, ''), '{_SPACES}+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents)))
""")
def q34_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", text.collapse(F.coalesce("text", F.lit(""))).alias("t"))
    rows = rows.select("doc_id", F.explode(text.chunks(F.col("t"), rules.CHUNK_WORDS, rules.CHUNK_OVERLAP)).alias("c"))
    return rows.select("doc_id", "c.start_word", "c.end_word", F.col("c.text").alias("chunk"))


@_query("""
    SELECT grp, rank, vec_id, round(similarity, 6) AS similarity FROM (
      SELECT *, row_number() OVER (PARTITION BY grp ORDER BY similarity DESC, vec_id)::INT AS rank FROM (
        SELECT e.vec_id % 10 AS grp, e.vec_id, list_cosine_similarity(list_transform(e.embedding, lambda x: x::DOUBLE), list_transform(k.embedding, lambda x: x::DOUBLE)) AS similarity
        FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) k WHERE e.vec_id <> 0)) WHERE rank <= 3
""")
def q35_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three chunks nearest to a keyword's vector (vec_id 0), in each of ten documents of chunks."""
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    keyword = F.broadcast(vectors.where("vec_id = 0").select(F.col("embedding").alias("key")).limit(1))
    rows = vectors.where("vec_id <> 0").crossJoin(keyword).select((F.col("vec_id") % 10).alias("grp"), "vec_id", seo.cosine(F.col("embedding"), F.col("key")).alias("similarity"))
    best = Window.partitionBy("grp").orderBy(F.col("similarity").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= rules.TOP_CHUNKS).select("grp", "rank", "vec_id", F.round("similarity", 6).alias("similarity"))


def _flags(texts: Column) -> Column:
    """A deterministic encoder for tests of plans: one constant vector for each text, so only exact matches count."""
    return F.transform(texts, lambda t: F.array(F.lit(0.0), F.lit(0.0)))


_PARAGRAPHS = f"SELECT content_id, intro AS txt FROM ({_ART}) WHERE intro <> '' UNION ALL SELECT content_id, section FROM ({_SECTION_ROWS}) WHERE \"at\" < 4 AND section <> ''"
_SENTENCES = r"list_filter(string_split(regexp_replace(txt, '([.!?]) +', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"
_BANDS = "CASE WHEN {x} <= {a} THEN 100 WHEN {x} <= {b} THEN 75 WHEN {x} <= {c} THEN 45 ELSE 20 END"


@_query(f"""
    SELECT content_id, score::INT AS overoptimization, CASE WHEN n = 0 THEN 'not_applicable' WHEN score >= 85 THEN 'low' WHEN score >= 70 THEN 'medium_low' WHEN score >= 50 THEN 'medium_high' ELSE 'high' END AS overoptimization_risk
    FROM (SELECT content_id, n, CASE WHEN n = 0 THEN 100 ELSE round_even(0.40::DOUBLE * {_BANDS.format(x="n / words", a=0.025, b=0.045, c=0.065)} + 0.35::DOUBLE * CASE WHEN spread >= 0.75 THEN 100 WHEN spread >= 0.5 THEN 75 WHEN spread >= 0.25 THEN 45 ELSE 20 END + 0.25::DOUBLE * {_BANDS.format(x="most", a=1, b=2, c=3)}, 0) END AS score
          FROM (SELECT content_id, sum(m) AS n, sum(words)::DOUBLE AS words, count(*) FILTER (m > 0) / nullif(sum(m), 0)::DOUBLE AS spread, max(m) AS most
                FROM (SELECT content_id, len(string_split(txt, ' ')) AS words, len(list_filter({_SENTENCES}, lambda s: {_count_sql("s", "the")} > 0)) AS m FROM ({_PARAGRAPHS})) GROUP BY content_id))
""")
def q36_overoptimisation(spark: SparkSession, sf_dir: str, articles: Articles = corpus.articles) -> DataFrame:
    rows = seo.judge(_seo_rows(spark, sf_dir, articles), _flags)
    return rows.select("content_id", "seo_scores.overoptimization", "seo_scores.overoptimization_risk")


@_query(f"""
    SELECT content_id, lexical::INT AS lexical, round_even(0.65::DOUBLE * lexical, 0)::INT AS score, CASE WHEN n > 0 AND round_even(0.65::DOUBLE * lexical, 0) >= 60 THEN 'warn' ELSE 'fail' END AS status,
           concat_ws('|', 'seo.semantic_unavailable', 'seo.overoptimization_semantic_unavailable', CASE WHEN n = 0 THEN 'seo.main_keyword_presence' END, CASE WHEN away THEN 'seo.main_keyword_locations' END,
                     CASE WHEN n < 7 OR n > 10 THEN 'seo.keyword_occurrences' END, CASE WHEN uneven THEN 'seo.keyword_distribution' END, 'seo.formatting_constraints') AS rules
    FROM (SELECT *, greatest(0, 90 - 25 * (n = 0)::INT - 20 * away::INT - 15 * (n < 7 OR n > 10)::INT - 8 * uneven::INT) AS lexical
          FROM (SELECT k.content_id, lexical_body AS n, lexical_introduction = 0 OR lexical_headings = 0 OR lexical_conclusion = 0 OR lexical_body = 0 AS away, uneven
                FROM ({{q31}}) k JOIN (SELECT content_id, bool_or(matched = '' OR concentrated) AS uneven FROM ({{q32}}) GROUP BY content_id) d USING (content_id)))
""".replace("{q31}", ORACLE_SQL["q31_keyword_signals"]).replace("{q32}", ORACLE_SQL["q32_section_distribution"]))  # fmt: skip
def q37_seo_judge(spark: SparkSession, sf_dir: str, articles: Articles = corpus.articles) -> DataFrame:
    rows = seo.judge(_seo_rows(spark, sf_dir, articles))
    return rows.select("content_id", "seo.status", "seo.score", "seo_scores.lexical", _joined(F.col("seo.findings.rule_id")).alias("rules"))


# A text of odd length, as the keyword is, has the keyword's vector; any other that whose number is its length modulo the number of vectors.
_VECTOR = "SELECT list_transform(embedding, lambda x: x::DOUBLE) AS v, vec_id FROM embeddings"
_KEYED = "CASE WHEN length({x}) % 2 = 1 THEN 3 ELSE length({x}) % (SELECT count(*) FROM embeddings) END"
_OVER = f"0.40::DOUBLE * {_BANDS.format(x='hits / words', a=0.025, b=0.045, c=0.065)} + 0.35::DOUBLE * CASE WHEN spread >= 0.75 THEN 100 WHEN spread >= 0.5 THEN 75 WHEN spread >= 0.25 THEN 45 ELSE 20 END + 0.25::DOUBLE * {_BANDS.format(x='most', a=1, b=2, c=3)}"


@_query(f"""
    WITH vectors AS ({_VECTOR}), keyword AS (SELECT v AS kv FROM vectors WHERE vec_id = {_KEYED.format(x="'the'")}),
    parts AS (SELECT content_id, 0 AS "at", intro AS txt FROM ({_ART}) WHERE intro <> ''
              UNION ALL SELECT content_id, "at", CASE WHEN h2 = '' THEN '' ELSE concat(h2, '. ') END || section FROM ({_SECTION_ROWS}) WHERE "at" < 4 AND section <> ''),
    words AS (SELECT content_id, list_filter(string_split(coalesce(p.txt, {_BODY}), ' '), lambda x: x <> '') AS w
              FROM ({_ART}) LEFT JOIN (SELECT content_id, string_agg(txt, ' ' ORDER BY "at") AS txt FROM parts GROUP BY content_id) p USING (content_id)),
    chunks AS (SELECT content_id, i, array_to_string(w[i * 112 + 1 : i * 112 + 128], ' ') AS txt FROM (SELECT *, unnest(range(0, CASE WHEN len(w) = 0 THEN 0 ELSE greatest(len(w) - 17, 0) // 112 + 1 END)) AS i FROM words)),
    ranked AS (SELECT content_id, s, row_number() OVER (PARTITION BY content_id ORDER BY s DESC, i) AS r
               FROM (SELECT content_id, i, list_cosine_similarity(kv, v) AS s FROM chunks JOIN vectors ON vec_id = {_KEYED.format(x="txt")}, keyword)),
    closeness AS (SELECT content_id, max(s) AS best, round_even(100 * sum(s * [0.60::DOUBLE, 0.25, 0.15][r]) / sum([0.60::DOUBLE, 0.25, 0.15][r]), 0)::INT AS semantic FROM ranked WHERE r <= 3 GROUP BY content_id),
    sentences AS (SELECT content_id, p, unnest({_SENTENCES}) AS s FROM (SELECT content_id, txt, row_number() OVER () AS p FROM ({_PARAGRAPHS}))),
    spoken AS (SELECT content_id, p, s, {_count_sql("s", "the")} > 0 AS exact, list_cosine_similarity(kv, v) >= 0.75 AS near FROM sentences JOIN vectors ON vec_id = {_KEYED.format(x="s")}, keyword),
    counted AS (SELECT content_id, sum(m) AS hits, sum(only_near) AS only_near, count(*) FILTER (m > 0) / nullif(sum(m), 0)::DOUBLE AS spread, max(m) AS most
                FROM (SELECT content_id, p, count(*) FILTER (exact OR near) AS m, count(*) FILTER (near AND NOT exact) AS only_near FROM spoken GROUP BY content_id, p) GROUP BY content_id),
    sized AS (SELECT content_id, sum(len(string_split(txt, ' ')))::DOUBLE AS words FROM ({_PARAGRAPHS}) GROUP BY content_id)
    SELECT content_id, round(best, 6) AS best_similarity, CASE WHEN n = 0 THEN least(semantic, 40) ELSE least(greatest(semantic, 0), 100) END::INT AS semantic,
           CASE WHEN n = 0 THEN 'none' WHEN semantic >= 75 THEN 'strong' WHEN semantic >= 60 THEN 'medium' ELSE 'none' END AS compensation,
           hits::INT AS occurrences, only_near::INT AS only_near, over_score::INT AS overoptimization,
           CASE WHEN hits = 0 THEN 'not_applicable' WHEN over_score >= 85 THEN 'low' WHEN over_score >= 70 THEN 'medium_low' WHEN over_score >= 50 THEN 'medium_high' ELSE 'high' END AS risk
    FROM (SELECT *, CASE WHEN hits = 0 THEN 100 ELSE round_even({_OVER}, 0) END AS over_score FROM (SELECT content_id, {_count_sql(_BODY, 'the')} AS n FROM ({_ART})) JOIN closeness USING (content_id) JOIN counted USING (content_id) JOIN sized USING (content_id))
""")  # fmt: skip
def q44_semantic_signals(spark: SparkSession, sf_dir: str, articles: Articles = corpus.articles) -> DataFrame:
    """Closeness of chunks and sentences to the keyword, each distinct text of the table having one of the table's vectors."""
    table = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    n = table.count()
    rows = seo.judge(_seo_rows(spark, sf_dir, articles), services.VectorTable(table, lambda t: F.when(F.length(t) % 2 == 1, 3).otherwise(F.length(t) % n)))
    signals = rows.select("content_id", "seo_scores.semantic", "seo_scores.overoptimization", F.col("seo_scores.overoptimization_risk").alias("risk"), F.col("seo_signals.semantic.best_similarity").alias("best"), F.col("seo_signals.compensation.level").alias("compensation"), F.col("seo_signals.overoptimization.occurrences").alias("occurrences"), F.col("seo_signals.overoptimization.only_near").alias("only_near"))
    return signals.select("content_id", F.round("best", 6).alias("best_similarity"), "semantic", "compensation", "occurrences", "only_near", "overoptimization", "risk")


_READ = "concat_ws(' ', intro, h_a, p_a, 'étude citée', h_b, p_b || dated, h_c, p_c, 'the', 'Conclusion', p_d)"
_DATES = [("full_date", rules.FULL_DATE), ("year", rules.YEAR), ("month_year", rf"(?i)\b(?:{'|'.join(rules.MONTHS['fr'])})\s+(?:19|20)\d{{2}}\b")]
_DATES += [(kind, rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])({x})(?:$|[^\p{{L}}\p{{N}}_])".replace("'", "''")) for kind, by in rules.EXPRESSIONS.items() for x in by["fr"]]
_FOUND = " UNION ALL ".join(f"SELECT content_id, '{kind}' AS type, unnest(regexp_extract_all(t, '{pattern}', {int('(' in pattern.replace('(?', ''))})) AS value FROM texts" for kind, pattern in _DATES)


@_query(f"WITH texts AS (SELECT content_id, trim(regexp_replace({_READ}, '{_SPACES}+', ' ', 'g')) AS t FROM ({_ART})) SELECT content_id, type, value, lower(value) = '2019' AS in_input FROM ({_FOUND})")
def q38_temporal_refs(spark: SparkSession, sf_dir: str, articles: Articles = corpus.articles) -> DataFrame:
    rows = articles(spark, sf_dir).select("content_id", F.explode(evergreen.temporal_references(F.col("content"), F.lit("fr-FR"), F.array(F.lit("2019")))).alias("r"))
    return rows.select("content_id", "r.type", "r.value", "r.in_input")


@_query(f"""
    SELECT content_id, CASE WHEN content_id % 5 = 4 THEN 'fail' WHEN score >= 70 THEN 'pass' WHEN score >= 50 OR content_id % 2 = 0 THEN 'warn' ELSE 'fail' END AS status, score,
           CASE WHEN content_id % 5 = 4 THEN 'evergreen.llm_error' WHEN content_id % 5 = 1 THEN 'evergreen.llm.problematic_passage' ELSE '' END AS rules,
           CASE WHEN content_id % 5 = 1 THEN h_a ELSE '' END AS excerpt
    FROM (SELECT content_id, h_a, CASE WHEN content_id % 5 = 4 THEN 0 ELSE content_id % 101 END::INT AS score FROM ({_ART}))
""")
def q39_evergreen_judge(spark: SparkSession, sf_dir: str, articles: Articles = corpus.articles) -> DataFrame:
    """Replies made from id and first heading: plain or fenced JSON, scores as numbers or text, a passage, or no JSON at all."""
    score = (F.col("content_id") % 101).cast("string")
    quoted = F.to_json(F.struct(F.col("h_a").alias("extrait"), F.lit("b").alias("probleme")))
    passage = F.when(F.col("content_id") % 5 == 1, F.concat(F.lit(', "passages_problematiques": ['), quoted, F.lit("]"))).otherwise("")
    reply = F.when(F.col("content_id") % 5 == 4, "no reply").otherwise(F.concat(F.lit('```json\n{"score_global_evergreen": '), F.when(F.col("content_id") % 2 == 0, F.concat(F.lit('"'), score, F.lit('"'))).otherwise(F.concat(score, F.lit(".9"))), passage, F.lit("}\n```")))
    rows = articles(spark, sf_dir).select("content_id", reply.alias("llm_raw_response"), (F.col("content_id") % 2 == 1).alias("evergreen_required"), F.lit("fr-FR").alias("locale"))
    excerpt = F.coalesce(F.get_json_object(F.get("evergreen.findings", F.lit(0))["evidence"], "$.excerpt"), F.lit(""))
    return evergreen.judge(rows).select("content_id", "evergreen.status", "evergreen.score", _joined(F.col("evergreen.findings.rule_id")).alias("rules"), excerpt.alias("excerpt"))


@_query()
def q40_dimension_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole evaluations of all articles, counted by judge and status."""
    rows = _seo_rows(spark, sf_dir, corpus.whole_articles).withColumns({"request_id": F.col("content_id").cast("string"), "locale": F.lit("fr-FR"), "organization_website": F.lit(WEBSITE), "require_sources": F.lit(True), "enabled_judges": F.lit(None).cast("array<string>")})
    outline = corpus.whole_articles(spark, sf_dir).select(F.col("content_id").cast("string").alias("request_id"), F.col("outline").alias("expected_outline_html"))
    return evaluate.report(evaluate.evaluate(rows.drop("content_id").join(outline, "request_id")))


@_query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n = 1")
def q41_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return company_export.latest(_table(spark, sf_dir, "conversations").withColumn("entry", F.lit(0)), ["conv_id"], "turn", "entry").select("conv_id", "turn", "role", "text")


@_query(rf"""
    SELECT doc_id, len(list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(coalesce(text, ''), '{_SPACES}+', ' ', 'g')), '([.!?]) +', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> ''))::INT AS n_sentences,
           sha256(array_to_string(list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(coalesce(text, ''), '{_SPACES}+', ' ', 'g')), '([.!?]) +', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> ''), '|')) AS digest FROM documents
""")
def q42_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", text.sentences(F.col("text")).alias("s"))
    return rows.select("doc_id", F.size("s").alias("n_sentences"), F.sha2(_joined(F.col("s")), 256).alias("digest"))


def _whole(f: Callable[..., DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(spark, sf_dir, corpus.whole_articles)

    query.__name__ = f"{f.__name__}_whole"
    return query


# The queries whose SQL starts from the parts of articles, over articles of many sections; without SQL.
for _f in (
    q16_headings, q17_sections, q18_introduction, q19_conclusion, q20_structure_judge, q21_cta_signals, q22_links, q24_link_partitions, q25_raw_markdown_urls,
    q28_duplicate_links, q29_sources_judge, q31_keyword_signals, q32_section_distribution, q33_keyword_emphasis, q36_overoptimisation, q37_seo_judge, q38_temporal_refs, q39_evergreen_judge, q43_duplicate_links_in_text,
):
    _query()(_whole(_f))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
