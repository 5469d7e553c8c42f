"""Links and URLs as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions import html, rules

def netloc(url: Column) -> Column:
    """Host with port and user as they stand, empty if there is none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), rules.AUTHORITY, 1)


def origin(url: Column) -> Column:
    """Scheme and host of a URL that has both; null or blank stays so, anything else as it is."""
    found = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    return F.when(found == "", url).otherwise(found)


def links(page: Column, internal_domain: Column) -> Column:
    """Structs of index, href, anchor_text, target, rel, is_external and section, in document order.

    A link's section is that of the nearest h2 or h3 before it. A domain without `//` has no host, so every link with one is external.
    """

    def link(a: Column, i: Column) -> Column:
        href = F.trim(F.coalesce(a["href"], F.lit("")))
        return F.struct(
            (i + 1).alias("index"), href.alias("href"), html.text_of(page, a).alias("anchor_text"), F.coalesce(a["target"], F.lit("")).alias("target"), F.coalesce(a["rel"], F.lit("")).alias("rel"),
            ((netloc(href) != "") & (netloc(href) != netloc(internal_domain))).alias("is_external"), F.when(a["further"], "complementary_reading").otherwise("body").alias("section"), a["html"].alias("html"),
        )

    return F.transform(F.filter(page["elements"], lambda e: e["tag"] == "a"), link)


def allowed_scheme(url: Column) -> Column:
    return url.rlike(r"(?i)^https?://[^/?#]+")


def glob(pattern: str) -> str:
    """A regular expression for a shell pattern: * any characters, ? one, [ab-c] or [!ab] one of a set or none of it; others stand for themselves."""
    out, i = [], 0
    while i < len(pattern):
        c, end = pattern[i], -1
        if c == "[":
            # A closing bracket that comes first belongs to the set; without another one the bracket is a character.
            end = pattern.find("]", i + 3 if pattern[i + 1 : i + 2] == "!" else i + 2)
        if end > 0:
            inside = pattern[i + 1 : end]
            negated, inside = inside.startswith("!"), inside.removeprefix("!")
            out.append(f"[{'^' if negated else ''}{re.sub(r'([^\w-])', r'\\\1', inside)}]")
            i = end
        else:
            out.append({"*": ".*", "?": "."}.get(c) or re.sub(r"(\W)", r"\\\1", c))
        i += 1
    return f"(?s)\\A(?:{''.join(out)})\\z"


def tracking_parameters(url: Column, patterns: tuple[str, ...] = rules.TRACKING_PATTERNS) -> Column:
    """Names of query parameters with a value that match a shell pattern, by first appearance, once for each pattern that they match."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&", -1), lambda p: p.rlike(r"^[^=]*=."))
    names = F.array_distinct(F.transform(pairs, lambda p: F.coalesce(F.try_url_decode(F.regexp_extract(p, "^([^=]*)=", 1)), F.regexp_extract(p, "^([^=]*)=", 1))))
    if not patterns:
        return F.filter(names, lambda n: F.lit(False))
    matching = lambda n: F.filter(F.array(*(F.when(n.rlike(glob(p)), n) for p in patterns)), lambda x: x.isNotNull())
    return F.flatten(F.transform(names, matching))


def status_class(code: Column) -> Column:
    """Struct of network_status and error for an HTTP status code; unknown without a code."""
    status = F.when(code.isin(*rules.STATUS_ALLOWED), "reachable").when(code.isin(*rules.STATUS_FORBIDDEN), "unreachable").otherwise("unknown")
    error = F.when(code.isin(*rules.STATUS_FORBIDDEN, *rules.STATUS_UNKNOWN), F.concat(F.lit("http_status_"), code)).when(~code.isin(*rules.STATUS_ALLOWED), F.concat(F.lit("unhandled_http_status_"), code))
    return F.struct(status.alias("network_status"), error.alias("error"))


def check(url: Column, code: Column, failure: Column, enabled: bool = True, final_url: Column | None = None, patterns: tuple[str, ...] = rules.TRACKING_PATTERNS) -> Column:
    """Validation of one URL from its status code, or from the name of the transport failure that ended the attempts.

    final_url is where redirects led; without an answer it is the URL itself.
    """
    url = F.trim(F.coalesce(url, F.lit("")))
    classed = status_class(code)
    answered = F.when(code.isNotNull(), classed).otherwise(F.struct(F.lit("unknown").alias("network_status"), failure.alias("error")))
    valid = allowed_scheme(url)
    return F.struct(
        url.alias("url"), valid.alias("is_valid_format"), valid.alias("has_allowed_scheme"), tracking_parameters(url, patterns).alias("tracking_parameters"),
        (F.size(tracking_parameters(url, patterns)) > 0).alias("has_tracking_parameters"), F.coalesce(F.when(valid & F.lit(enabled) & code.isNotNull(), F.lit(None) if final_url is None else final_url), url).alias("final_url"),
        F.when(~valid, "not_checked").when(F.lit(not enabled), "disabled").otherwise(answered["network_status"]).alias("network_status"),
        F.when(valid & F.lit(enabled), code).alias("http_status_code"),
        F.when(url == "", "empty_url").when(~valid, "invalid_url_format").when(F.lit(enabled), answered["error"]).alias("error"),
    )
