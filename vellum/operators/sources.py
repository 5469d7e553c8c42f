"""Sources judge: links, their format, number, policy and reachability."""

from __future__ import annotations

import socket
import ssl
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import html, links, rules, text
from vellum.functions.settings import Settings

#: method, URL, seconds -> status code, or status code and the URL that redirects led to
Request = Callable[[str, str, float], int | tuple[int, str | None]]


def extract(df: DataFrame, default_website: str = "", content: str = "content", website: str = "organization_website", page: str | None = None) -> DataFrame:
    """df -> also `links`, `raw_urls`, `markdown_links`, `attached_anchors`, from the content with escaped quotes undone; and `parse_error`.

    `page` names a column that holds that content parsed already.
    """
    payload = text.escaped_payload(F.coalesce(F.col(content), F.lit("")))
    domain = F.when(F.coalesce(F.trim(website), F.lit("")) == "", F.lit(default_website)).otherwise(F.col(website))
    out = df.withColumn("_payload", payload).withColumn("_page", F.col(page) if page else html.parse(F.col("_payload")))
    return out.withColumns({
        "links": links.links(F.col("_page"), domain),
        "raw_urls": F.regexp_extract_all("_payload", F.lit(rules.RAW_URL), 1),
        "markdown_links": F.regexp_extract_all("_payload", F.lit(rules.MARKDOWN_LINK), 0),
        "attached_anchors": F.regexp_count("_payload", F.lit(rules.ATTACHED_ANCHOR)),
        "parse_error": F.col("_page.error"),
    }).drop("_payload", "_page")


def urls(found: Column) -> Column:
    """The URLs to validate: of all links, trimmed, without empty ones, each once by first appearance."""
    return F.array_distinct(F.filter(F.transform(found, lambda x: x["href"]), lambda u: u != ""))


def partitions(found: Column) -> Column:
    """Links by side and section, with counts."""
    external, body = (lambda x: x["is_external"]), (lambda x: x["section"] == "body")
    parts = {
        "external": external, "internal": lambda x: ~external(x), "body": body, "complementary": lambda x: ~body(x),
        "body_external": lambda x: external(x) & body(x), "complementary_external": lambda x: external(x) & ~body(x),
    }
    return F.struct(*(F.size(F.filter(found, f)).alias(f"{name}_count") for name, f in parts.items()))


def normalized_methods(methods: object) -> list[str]:
    """The HTTP methods to try in order; anything but a filled list of HEAD and GET is an error."""
    if not isinstance(methods, (list, tuple)) or not methods:
        raise ValueError("methods must be a list that isn't empty")
    found = [str(m).upper().strip() for m in methods]
    if wrong := [m for m in found if m not in rules.METHODS]:
        raise ValueError(f"unsupported HTTP methods: {wrong}")
    return found


def http_request(method: str, url: str, timeout: float) -> tuple[int, str | None]:
    """Status code of a request that follows redirects, and where they led; raises what the network raises."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, method=method), timeout=timeout) as answer:  # noqa: S310
            return answer.status, answer.geturl()
    except urllib.error.HTTPError as e:
        return e.code, e.geturl()
    except urllib.error.URLError as e:
        raise e.reason if isinstance(e.reason, Exception) else e from e


def failure_name(e: Exception) -> str:
    if isinstance(e, TimeoutError):
        return "timeout"
    if isinstance(e, ssl.SSLError):
        return "ssl_error"
    if isinstance(e, (ConnectionError, socket.gaierror)):
        return "connection_error"
    return f"request_error:{type(e).__name__}"


def fetch_status(url: str, request: Request, methods: list[str], timeout: float) -> tuple[int | None, str | None, str | None]:
    """The code of the first method that is answered, or else the name of the last failure; then the URL that answered."""
    failure = None
    for method in methods:
        try:
            answer = request(method, url, timeout)
            code, final = answer if isinstance(answer, tuple) else (answer, None)
            return code, None, final
        except Exception as e:  # noqa: BLE001 - whatever a request raises is its result
            failure = failure_name(e)
    return None, failure, None


def fetch_statuses(
    df: DataFrame,
    request: Request = http_request,
    methods: object = rules.METHODS,
    timeout: float = rules.TIMEOUT_SECONDS,
    concurrency: int = rules.MAX_CONCURRENCY,
    per_host: int = 2,
) -> DataFrame:
    """Status table (url, code, failure, final_url) of the distinct valid URLs of df (links): each is fetched once for the whole table.

    request(method, url, timeout) returns a status code, maybe with the URL that redirects led to, or raises. A host's URLs
    are dealt to `per_host` lines, each worked off one after another in one task, so that no host has more requests under
    way over all tasks; a task has up to `concurrency` of them. Without links there are no rows.
    """
    tried = normalized_methods(methods)
    distinct = df.select(F.explode(urls(F.col("links"))).alias("url")).where(links.allowed_scheme(F.col("url"))).distinct()

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    line = F.struct(F.lower(links.netloc(F.col("url"))).alias("host"), F.pmod(F.xxhash64("url"), F.lit(per_host)).alias("line"))
    dealt = distinct.withColumn("line", line).repartition(n, "line").sortWithinPartitions("line").select("url", F.to_json("line").alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(concurrency) as pool:
            # Batches come one after another, so a line that goes on in the next one isn't under way twice.
            for batch in batches:
                lines: dict[str, list[str]] = {}
                for url, of in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    lines.setdefault(of, []).append(url)
                found = [x for part in pool.map(lambda urls: [(u, *fetch_status(u, request, tried, timeout)) for u in urls], lines.values()) for x in part]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], ["url", "code", "failure", "final_url"])

    return dealt.mapInArrow(run, "url string, code int, failure string, final_url string")


def with_checks(df: DataFrame, key: str, statuses: DataFrame | None = None, enabled: bool = True) -> DataFrame:
    """df (key, links) -> also `url_checks`, an array in order of the URLs. Without a status table (url, code, failure, maybe final_url) nothing was checked on the network."""
    if statuses is None:
        empty = F.lit(None)
        return df.withColumn("url_checks", F.transform(urls(F.col("links")), lambda u: links.check(u, empty.cast("int"), empty.cast("string"), enabled=False)))
    asked = df.select(key, F.posexplode(urls(F.col("links"))).alias("at", "url"))
    if "final_url" not in statuses.columns:
        statuses = statuses.withColumn("final_url", F.lit(None).cast("string"))
    known = asked.join(statuses.dropDuplicates(["url"]), "url", "left")
    checked = known.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", links.check(F.col("url"), F.col("code"), F.col("failure"), enabled, F.col("final_url")).alias("c")))).alias("_c"))
    checks = F.coalesce(F.transform("_c", lambda x: x["c"]), F.transform(urls(F.col("links")), lambda u: links.check(u, F.lit(None).cast("int"), F.lit(None).cast("string"), False)))
    return df.join(checked, key, "left").withColumn("url_checks", checks).drop("_c")


def judge(df: DataFrame, column: str = "sources", settings: str | None = None) -> DataFrame:
    """df (links, raw_urls, markdown_links, attached_anchors, url_checks, content_type, expected_length, require_sources,
    organization_website) -> also `sources`: status, score, findings, error.

    Rows with a parse_error, if there is such a column, carry it as their error unless their context has one.
    `settings` names a map column of rules that change severities, switches, numbers of references and the score of a warning.
    """
    own = Settings(settings)
    all_links, checks = F.col("links"), F.col("url_checks")
    n = partitions(all_links)
    external = F.filter(all_links, lambda x: x["is_external"])
    away = F.filter(all_links, lambda x: x["is_external"] & (x["section"] == "complementary_reading"))
    required = F.coalesce(F.col("require_sources"), F.lit(False))
    sourced = (n["body_external_count"] > 0) | (n["complementary_count"] > 0)
    kind, length = F.trim("content_type"), F.trim("expected_length")
    fixed = lambda i: F.coalesce(*(F.when(length == k, F.lit(v[i]).cast("int")) for k, v in rules.REFERENCE_LIMITS.items()))
    limit = lambda i: own.limit(F.concat(F.lit("sources.references."), length, F.lit((".max", ".min")[i])), fixed(i))
    some, most, least = n["external_count"] > 0, limit(0), limit(1)
    f = text.finding
    counts = {"external_links": n["external_count"]}
    whole = text.findings(
        (kind.isin(*rules.FORBIDDEN_TYPES) & some, f("sources.content_type_policy", own.severity("sources.content_type_policy", "major"), "This content type must not link to other sites.", content_type=kind, **counts)),
        (kind.isin(*rules.CAUTION_TYPES) & some, f("sources.content_type_policy", own.severity("sources.content_type_policy", "minor"), "This content type should link to other sites with caution.", content_type=kind, **counts)),
        ((F.coalesce(F.trim("organization_website"), F.lit("")) != "") & (F.size(away) > 0), f("sources.complementary_reading_policy", own.severity("sources.complementary_reading_policy", "major"), "Complementary reading links to other sites.", links=F.transform(away, lambda x: x["href"]))),
        (required & ~sourced, f("sources.real_and_accessible_sources", own.severity("sources.real_and_accessible_sources", "major"), "Sources are required and none is linked.", body_external=n["body_external_count"], complementary=n["complementary_count"])),
        (most.isNotNull() & (n["external_count"] > most), f("sources.external_reference_count_by_length", own.severity("sources.external_reference_count_by_length", "major"), "There are more references than this length allows.", most=most, **counts)),
        (required & least.isNotNull() & ~sourced, f("sources.external_reference_count_by_length", own.severity("sources.external_reference_count_by_length", "minor"), "There are fewer references than this length asks for.", least=least, **counts)),
        (F.size("raw_urls") > 0, f("sources.no_raw_or_markdown_url", own.severity("sources.no_raw_or_markdown_url", "major"), "URLs stand bare in the text.", urls=F.col("raw_urls"))),
        (F.size("markdown_links") > 0, f("sources.no_raw_or_markdown_url", own.severity("sources.no_raw_or_markdown_url", "major"), "Links are written in Markdown.", links=F.col("markdown_links"))),
        (F.col("attached_anchors") > 0, f("sources.html_anchor_format", own.severity("sources.html_anchor_format", "minor"), "Links are attached to the word before them.", count=F.col("attached_anchors"))),
    )

    def per_link(x: Column) -> Column:
        lacking = F.array_except(F.array(*map(F.lit, rules.REQUIRED_REL)), F.split(F.lower(x["rel"]), " ", -1))
        anchor = F.lower(F.trim(x["anchor_text"]))
        return text.findings(
            ((x["target"] != rules.REQUIRED_TARGET) | (F.size(lacking) > 0), f("sources.html_anchor_format", own.severity("sources.html_anchor_format", "minor"), "A link lacks the required target or rel.", href=x["href"], rel=x["rel"], target=x["target"])),
            (anchor.isin("", *rules.FORBIDDEN_ANCHORS), f("sources.descriptive_anchor_text", own.severity("sources.descriptive_anchor_text", "minor"), "A link's text doesn't describe its target.", anchor_text=x["anchor_text"], href=x["href"])),
        )

    hrefs = F.transform(external, lambda x: x["href"])
    repeated = F.filter(F.array_distinct(hrefs), lambda h: F.size(F.filter(hrefs, lambda y: y == h)) > 1)
    doubled = text.findings((F.size(repeated) > 0, f("sources.no_duplicate_links", own.severity("sources.no_duplicate_links", "minor"), "Other sites are linked more than once.", links=repeated)))

    def per_check(c: Column) -> Column:
        return text.findings(
            (~c["is_valid_format"], f("sources.real_and_accessible_sources", own.severity("sources.real_and_accessible_sources", "major"), "A URL isn't valid.", error=c["error"], url=c["url"])),
            (F.size(c["tracking_parameters"]) > 0, f("sources.no_tracking_parameters", own.severity("sources.no_tracking_parameters", "major"), "A URL carries tracking parameters.", parameters=c["tracking_parameters"], url=c["url"])),
            (c["network_status"] == "unreachable", f("sources.network_accessibility", own.severity("sources.network_accessibility", "major"), "A URL can't be reached.", error=c["error"], url=c["url"])),
            (c["network_status"] == "unknown", f("sources.network_accessibility", own.severity("sources.network_accessibility", "minor"), "It isn't known whether a URL can be reached.", error=c["error"], url=c["url"])),
        )

    found = F.concat(whole, F.flatten(F.transform(external, per_link)), doubled, F.flatten(F.transform(checks, per_check)))
    if settings is not None:
        found = F.filter(found, lambda x: F.coalesce(F.try_element_at(F.col(settings), F.concat(x["rule_id"], F.lit(".enabled"))) != "false", F.lit(True)))
    missing = lambda c: F.coalesce(c, F.lit("")) == ""
    error = (
        F.when(missing(kind), "missing_content_type").when(missing(length), "missing_expected_length").when(missing(F.trim("organization_website")), "missing_organization_website")
        .when(~kind.isin(*rules.ALLOWED_TYPES, *rules.CAUTION_TYPES, *rules.FORBIDDEN_TYPES), "unsupported_content_type").when(~length.isin(*rules.REFERENCE_LIMITS), "unsupported_expected_length")
    )
    if "parse_error" in df.columns:
        error = F.coalesce(error, F.col("parse_error"))
    ok, none = error.isNull(), F.size("_f") == 0
    major = F.exists("_f", lambda x: x["severity"].isin("major", "critical"))
    valid = F.array(f("sources.valid", "info", "Links and sources follow the rules."))
    result = F.struct(
        F.when(ok, F.when(major, "fail").when(none, "pass").otherwise("warn")).alias("status"),
        F.when(ok, F.when(major, 0).when(none, 100).otherwise(own.number("sources.warn_score").cast("int"))).alias("score"),
        F.when(ok, F.when(none, valid).otherwise(F.col("_f"))).otherwise(F.array().cast(f"array<{text.FINDING}>")).alias("findings"),
        error.alias("error"),
    )
    return df.withColumn("_f", found).withColumn(column, result).drop("_f")
