"""Shell patterns of parameters, redirects and requests by host."""

import fnmatch
import random
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from vellum.functions import links
from vellum.operators import sources

PATTERNS = ("*id", "a?", "[ab]*", "[!ab]x", "utm_*", "a.b", "[x", "x]", "[]]", "[!]]", "a[b-d]", "$^", "**", "")


def test_patterns_match_as_in_a_shell(spark):
    draw = random.Random(4)
    names = ["".join(draw.choice("abdx_id.]![$^") for _ in range(draw.randrange(0, 5))) for _ in range(600)] + ["fbclid", "utm_x", "ab", "ax\n"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    found = df.select("n", *(F.col("n").rlike(links.glob(p)).alias(str(i)) for i, p in enumerate(PATTERNS))).collect()
    for r in found:
        for i, p in enumerate(PATTERNS):
            assert r[str(i)] == fnmatch.fnmatchcase(r.n, p), (r.n, p)


def test_tracking_parameters_by_pattern(spark):
    url = "https://a.org/?fbclid=1&ab=2&x=3&ab=4&empty=&bid=5&%61c=6"
    row = spark.createDataFrame([(url,)], "u string").select(links.tracking_parameters(F.col("u"), ("*id", "a?", "[ab]*")).alias("t"), links.tracking_parameters(F.col("u"), ()).alias("none")).first()
    assert (row.t, row.none) == (["fbclid", "ab", "ab", "bid", "bid", "ac", "ac"], [])


@pytest.fixture(scope="module")
def server():
    state = {"now": 0, "most": 0, "lock": threading.Lock()}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            with state["lock"]:
                state["now"] += 1
                state["most"] = max(state["most"], state["now"])
            time.sleep(0.02)
            with state["lock"]:
                state["now"] -= 1
            if self.path.startswith("/moved"):
                self.send_response(301)
                self.send_header("Location", "/there")
            else:
                self.send_response(404 if self.path == "/gone" else 200)
            self.end_headers()

        do_HEAD = do_GET

        def log_message(self, *_):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", state
    http.shutdown()


def test_redirects_are_recorded(spark, server):
    at, _ = server
    content = "".join(f'<a href="{at}/{p}">x</a>' for p in ("moved", "there", "gone")) + '<a href="ftp://x.org/?ref=1">y</a><a href="http://127.0.0.1:1/">z</a>'
    df = sources.extract(spark.createDataFrame([(1, content, "https://me.fr")], "id int, content string, organization_website string"))
    checks = {c.url: c for c in sources.with_checks(df, "id", sources.fetch_statuses(df, timeout=3)).first().url_checks}
    found = {u.removeprefix(at): (c.final_url.removeprefix(at), c.http_status_code, c.network_status, c.has_allowed_scheme, c.has_tracking_parameters) for u, c in checks.items()}
    assert found == {
        "/moved": ("/there", 200, "reachable", True, False), "/there": ("/there", 200, "reachable", True, False), "/gone": ("/gone", 404, "unreachable", True, False),
        "ftp://x.org/?ref=1": ("ftp://x.org/?ref=1", None, "not_checked", False, True), "http://127.0.0.1:1/": ("http://127.0.0.1:1/", None, "unknown", True, False),
    }
    unchecked = sources.with_checks(df, "id").first().url_checks
    assert {c.final_url for c in unchecked} == set(checks)


@pytest.mark.parametrize("per_host", [1, 2])
def test_a_host_has_no_more_requests_under_way(spark, server, per_host):
    at, state = server
    state["most"] = 0
    content = "".join(f'<a href="{at}/{i}">x</a>' for i in range(40))
    df = sources.extract(spark.createDataFrame([(i, content, "https://me.fr") for i in range(6)], "id int, content string, organization_website string").repartition(6))
    found = sources.fetch_statuses(df, methods=["GET"], concurrency=10, per_host=per_host).collect()
    assert sorted(r.url for r in found) == sorted(f"{at}/{i}" for i in range(40))
    assert {r.code for r in found} == {200}
    assert state["most"] <= per_host
