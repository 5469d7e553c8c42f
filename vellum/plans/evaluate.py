"""Whole evaluations: requests in, one report each out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import html, rules, text
from vellum.operators import length, seo, services, sources, structure, typography
from vellum.plans import scratch
from vellum.sources import rule_files

CONTEXT = (
    "content_type string, expected_length string, locale string, organization_website string, funnel_stage string, main_keyword string, "
    "secondary_keywords array<string>, long_tail_keywords array<string>, expected_outline_html string, require_sources boolean, evergreen_required boolean"
)
RESULT = f"struct<status:string,score:int,findings:array<{text.FINDING}>,error:string>"
EXTRAS = "struct<subscores:string,semantic_signals:string,semantic_compensation:string,overoptimization_signals:string>"


def preprocess(df: DataFrame, content: str = "content", column: str = "signals", internal_domain: str = "", page: str | None = None) -> DataFrame:
    """df -> also the signals that judges of a whole evaluation share. `page` names a column that holds the parsed, unescaped content already."""
    parsed = F.col("_parsed")
    out = df.withColumn("_norm", text.escaped_payload(F.coalesce(F.col(content), F.lit(""))))
    out = sources.extract(out.withColumn("_parsed", F.col(page) if page else html.parse(F.col("_norm"))).withColumn("_site", F.lit(internal_domain)), content=content, website="_site", page="_parsed")
    out = out.withColumns({"_body": html.body(parsed), "_sections": html.sections(parsed)})
    body, found = F.col("_body"), F.col("links")
    part = lambda test: F.filter(found, test)
    external, in_body = (lambda x: x["is_external"]), (lambda x: x["section"] == "body")
    linked = F.struct(
        found.alias("all"), part(external).alias("external"), part(lambda x: ~external(x)).alias("internal"), part(in_body).alias("body"), part(lambda x: ~in_body(x)).alias("complementary_reading"),
        F.col("raw_urls"), F.col("markdown_links"), F.col("attached_anchors"), F.size(found).alias("links_count"), F.size(part(external)).alias("external_links_count"), F.size("raw_urls").alias("raw_urls_count"),
        F.size("markdown_links").alias("markdown_links_count"), (F.size(found) > 0).alias("has_links"), (F.size(part(external)) > 0).alias("has_external_links"),
    )
    signals = F.struct(
        F.coalesce(F.col(content), F.lit("")).alias("original_content"), F.col("_norm").alias("normalized_content"),
        body.alias("text"), text.word_count(body).alias("word_count"), (body == "").alias("is_empty"),
        F.filter(html.texts(parsed, html.named(parsed, ("p",))), lambda t: t != "").alias("paragraphs"),
        html.headings(parsed, ("h1", "h2", "h3", "h4")).alias("headings"), F.transform(html.headings(parsed, ("h2", "h3")), lambda h: h["text"]).alias("headings_h2_h3"),
        html.introduction(parsed, parsed["root"], rules.TEXT_BLOCKS).alias("introduction"), html.conclusion(F.col("_sections"), rules.GLOBAL_TRAILING_TITLES).alias("conclusion"),
        F.transform("_sections", lambda s: s.dropFields("blocks")).alias("h2_sections"), linked.alias("links"), html.cta_signals(parsed, rules.COMPLEMENTARY_TITLES).alias("cta"), html.used_tags(parsed).alias("used_tags"),
        html.has(parsed, "h1").alias("has_h1"), html.has(parsed, "script").alias("has_script"), html.has(parsed, "span").alias("has_span"), html.has(parsed, "p").alias("has_intro_paragraph"),
        html.styled_outside_tables(parsed, rules.TABLE_TAGS).alias("styled_outside_tables"), typography.signals(F.col(content)).alias("typography"),
    )
    return out.withColumn(column, signals).drop("_parsed", "_norm", "_site", "_body", "_sections", "parse_error", "links", "raw_urls", "markdown_links", "attached_anchors")


def selected(enabled: Column) -> Column:
    """The judges to run: the known ones of a request in its order, each once; all if it names none at all."""
    known = F.array_distinct(F.filter(enabled, lambda j: j.isin(*rules.DEFAULT_JUDGES)))
    return F.when(enabled.isNull(), F.array(*map(F.lit, rules.DEFAULT_JUDGES))).otherwise(known)


def skipped(enabled: Column) -> Column:
    return F.coalesce(F.filter(enabled, lambda j: ~j.isin(*rules.DEFAULT_JUDGES)), F.array().cast("array<string>"))


def blocking(judge: Column, result: Column) -> Column:
    """The findings that block: all of a failed judge, of the sources judge only its major ones."""
    found = F.when(judge == "sources", F.filter(result["findings"], lambda f: f["severity"].isin("major", "critical"))).otherwise(result["findings"])
    return F.when(result["status"] == "fail", found).otherwise(F.array().cast(f"array<{text.FINDING}>"))


def judges(encoder: seo.Encoder | services.Encoder | services.VectorTable | None = None, statuses: DataFrame | None = None, default_website: str = "", key: str = "evaluation_id", page: str | None = None, raw_page: str | None = None, settings: str | None = None, seo_options: dict | None = None) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """The judges by name: each adds a column of its name to rows of a unique key, content and context.

    `page` and `raw_page` name columns that hold the content, unescaped and as it is, parsed already; `settings` a column of rules.
    """

    def counted(df: DataFrame) -> DataFrame:
        parsed = F.col(page) if page else html.parse(text.escaped_payload(F.coalesce("content", F.lit(""))))
        df = df.withColumn("_parsed", parsed)
        return length.judge(df.withColumns({"word_count": text.word_count(html.body(F.col("_parsed"))), "parse_error": F.col("_parsed.error")}), settings=settings)

    def linked(df: DataFrame) -> DataFrame:
        return sources.judge(sources.with_checks(sources.extract(df, default_website, page=page), key, statuses, enabled=statuses is not None), settings=settings)

    return {
        "length": counted, "typography": lambda df: typography.judge(df, settings=settings), "seo": lambda df: seo.judge(df, encoder, page=raw_page, settings=settings, **seo_options or {}),
        "structure": lambda df: structure.judge(df, page=raw_page, settings=settings), "sources": linked,
    }


def evaluate(requests: DataFrame, encoder: seo.Encoder | services.Encoder | services.VectorTable | None = None, statuses: DataFrame | None = None, default_website: str = "", rule_table: DataFrame | None = None, seo_options: dict | None = None) -> DataFrame:
    """requests (request_id, content, enabled_judges, context columns, maybe profile) -> evaluation_id, status, score, summary, results, errors, metadata.

    One report for each row, complete and without a score of its own. A context that a judge can't use becomes a technical
    error of that judge, after the results of the others. Without request_id a report is named by a digest of its request;
    rows are told apart by a key of their own, whatever their names. Contents are parsed once and written with it to the
    shared folder; each judge reads only the rows that ask for it, and their results, a few small rows for each request,
    meet in one shuffle. `rule_table` (see rule_files.table) holds the rules of profiles, `seo_options` the sizes of chunks.
    """
    digest = F.concat(F.lit("evaluation-"), F.substring(F.sha2(F.to_json(F.struct(*(c for c in requests.columns if c != "request_id"))), 256), 1, 32))
    profile = F.coalesce("profile", F.lit("default")) if "profile" in requests.columns else F.lit("default")
    content = F.coalesce("content", F.lit(""))
    named = requests.withColumns({"evaluation_id": F.coalesce("request_id", digest), "_profile": profile, "_row": F.monotonically_increasing_id()})
    # Most contents have nothing escaped, so that one span table serves both forms and only one is written.
    named = named.withColumn("_raw_page", html.parse(content)).withColumn("_differs", text.escaped_payload(content) != content)
    named = named.withColumn("_other", html.parse(F.when(F.col("_differs"), text.escaped_payload(content)).otherwise("")))
    named = scratch.durable(named.withColumn("_other", F.when(F.col("_differs"), F.col("_other"))).drop("_differs"), "requests")
    named = named.withColumn("_norm_page", F.coalesce("_other", "_raw_page")).drop("_other")
    settings = None
    if rule_table is not None:
        named, settings = rule_files.with_rules(named, rule_table, "_profile", "_rules"), "_rules"
    asked = selected(F.col("enabled_judges"))
    meta = F.struct(F.col("evaluation_id"), F.col("_profile").alias("profile"), asked.alias("enabled_judges"), skipped(F.col("enabled_judges")).alias("skipped_judges"))
    none = F.lit(None)
    rows = named.select("_row", none.cast("int").alias("place"), none.cast("string").alias("dimension"), none.cast(RESULT).alias("result"), none.cast(EXTRAS).alias("extras"), meta.alias("meta"))
    for name, judge in judges(encoder, statuses, default_website, "_row", "_norm_page", "_raw_page", settings, seo_options).items():
        own = judge(named.where(F.array_contains(asked, name)))
        extras = F.struct(F.lit(""), F.lit(""), F.lit(""), F.lit(""))
        if name == "seo":
            extras = F.struct(F.to_json("seo_scores"), F.to_json("seo_signals.semantic"), F.to_json("seo_signals.compensation"), F.to_json("seo_signals.overoptimization"))
        own = own.select("_row", F.array_position(asked, name).cast("int").alias("place"), F.lit(name).alias("dimension"), F.col(name).cast(RESULT).alias("result"), extras.cast(EXTRAS).alias("extras"), none.cast(meta_type(named, meta)).alias("meta"))
        rows = rows.unionByName(own)
    found = F.when(F.col("place").isNotNull(), F.struct("place", "dimension", "result", "extras"))
    grouped = rows.groupBy("_row").agg(F.array_sort(F.collect_list(found)).alias("_all"), F.first("meta", ignorenulls=True).alias("_meta"))
    shown = F.transform("_all", lambda x: F.struct(
        x["dimension"].alias("dimension"), x["result"]["status"].alias("status"), x["result"]["score"].alias("score"),
        *(F.coalesce(F.nullif(x["extras"][f], F.lit("")), F.lit("{}")).alias(f) for f in ("subscores", "semantic_signals", "semantic_compensation", "overoptimization_signals")),
        x["result"]["findings"].alias("findings"), blocking(x["dimension"], x["result"]).alias("blocking"), x["result"]["error"].alias("error"),
    ))
    out = grouped.withColumn("_shown", shown)
    good, bad = F.filter("_shown", lambda r: r["error"].isNull()), F.filter("_shown", lambda r: r["error"].isNotNull())
    failed, partly, done = rules.SUMMARIES
    summary = F.when(F.size(bad) == 0, F.format_string(done, F.size(good))).when(F.size(good) == 0, failed).otherwise(partly)
    return out.select(
        "_meta.evaluation_id", F.lit("completed").alias("status"), F.lit(None).cast("int").alias("score"), summary.alias("summary"),
        F.concat(good, bad).alias("results"), F.transform(bad, lambda r: F.struct(r["dimension"].alias("dimension"), r["error"].alias("error"))).alias("errors"),
        F.col("_meta").dropFields("evaluation_id").alias("metadata"),
    )


def meta_type(df: DataFrame, meta: Column) -> str:
    return df.select(meta.alias("m")).schema["m"].dataType.simpleString()


def report(evaluations: DataFrame) -> DataFrame:
    """Number of evaluations by judge and status, over all of them."""
    rows = evaluations.select(F.explode("results").alias("r"))
    return rows.groupBy(F.col("r.dimension").alias("dimension"), F.coalesce("r.status", F.lit("error")).alias("status")).agg(F.count("*").alias("n"), F.sum(F.size("r.findings")).alias("findings"))
