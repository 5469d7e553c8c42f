"""What a Python worker holds at a time, whatever an Arrow batch holds."""

import random
import re
import tracemalloc

import pyarrow as pa
import pytest

from vellum.functions import html, matching, shares, text
from vellum.operators import seo
from vellum.plans import catalog, scratch

CONTENTS = [f"<p>the {i} Été</p><h2>of {i}</h2><p>que {'the ' * (i % 7)}. A of!</p><h3>x</h3><strong>the</strong>" if i % 5 else "" for i in range(700)]
KEYWORDS = [["the"] * 700, [["of", "que"]] * 700, [None] * 700]


def test_shares_are_bounded_and_whole():
    texts = pa.array(["x" * (i % 4 * 500_000) for i in range(20)] + [None] * 1000 + ["y" * (3 * shares.BYTES)])
    numbers = pa.array(range(len(texts)))
    found = list(shares.cut((texts, numbers)))
    assert [i for _, n in found for i in n.to_pylist()] == list(range(len(texts)))
    assert [x for t, _ in found for x in t.to_pylist()] == texts.to_pylist()
    assert all(len(t) <= shares.ROWS and (len(t) == 1 or t.nbytes + n.nbytes <= shares.BYTES) for t, n in found)


@pytest.mark.parametrize("run", [lambda: html.parse.func(iter([pa.array(CONTENTS)])), lambda: seo._finder(("emphasis",), True, False).func(iter([(pa.array(CONTENTS), *map(pa.array, KEYWORDS))]))])
def test_a_share_is_given_out_before_the_next_is_read(run, monkeypatch):
    """A batch of 700 contents was parsed as a whole before anything was given out."""
    read = []
    plain = html.tokenize
    monkeypatch.setattr(html, "tokenize", lambda c: read.append(c) or plain(c))
    found = run()
    first = next(iter(found))
    assert len(first) == len(read) <= shares.ROWS
    assert len(first) + sum(map(len, found)) == len(CONTENTS)


def test_slices_of_span_tables_hold_their_own_pages():
    pages = pa.array([html.tokenize(c) for c in CONTENTS], html._KIND)
    for at in (0, 333, 695):
        part = pages.slice(at, 5)
        for i in range(5):
            a, b = seo._Pages(part).page(i), seo._Page.of(CONTENTS[at + i])
            assert vars(a) == vars(b)


def test_wanted_signals_are_those_of_all():
    page = seo._Page.of("<p>The été</p><h2>of</h2><p>the que. The of!</p><h2>que</h2><strong>the theme</strong>")
    of = lambda *wanted, spoken=True: seo._signals(page, "the", ["of", "que"], [], frozenset(wanted), spoken)
    every = of(*seo._LEXICAL.names)
    assert of("emphasis") == {"emphasis": every["emphasis"], "parse_error": None} and every["emphasis"]
    for name in seo._LEXICAL.names:
        assert of(name)[name] == every[name]
    assert [p["sentences"] for p in of("paragraphs", spoken=False)["paragraphs"]] == [[]] * len(every["paragraphs"])
    assert seo._sentences("A b. C! D?E ... f.", "a b. c! d?e ... f.")[1] == ("C!", "c!") and len(seo._sentences("A b. C! D?E ... f.", "a b. c! d?e ... f.")) == 4


def test_counts_are_those_of_a_search_for_whole_words():
    draw = random.Random(3)
    for _ in range(300):
        found = "".join(draw.choice(["the", "the", " ", "_", "é", ".", "a a", "²"]) for _ in range(12))
        for p in ("the", "a a", "a", "the the"):
            assert matching.count(found, p) == len(re.findall(rf"(?<!\w){p}(?!\w)", found))


#: 251 is Spark's number of iterator UDFs over Arrow columns, 250 that of those that get and give a whole batch.
SHARED = [
    "q19_conclusion",
    "q20_structure_judge",
    "q20_structure_judge_whole",
    "q15_disallowed_tags",
    "q37_seo_judge_whole",
    "q29_sources_judge",
    "q18_introduction",
    "q31_keyword_signals",
    "q36_overoptimisation",
    "q36_overoptimisation_whole",
]


@pytest.mark.parametrize("name", SHARED)
def test_queries_read_documents_in_shares(spark, name, tmp_path):
    spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "u", "<p>a")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    plan = catalog.queries()[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    kinds = {x for line in plan.splitlines() if "ArrowEvalPython" in line for x in re.findall(r"\b25[01]\b", line.rpartition("]")[2])}
    assert "251" in kinds


def test_entities_are_decoded_in_shares():
    """20 MB of texts were 40 MB of Python strings at once."""
    texts = pa.array([f"a &amp; {'x' * 4000} {i}" for i in range(5000)] + [None])
    tracemalloc.start()
    found = text._unescape.func(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.to_pylist() == [f"a & {'x' * 4000} {i}" for i in range(5000)] + [None]
    assert most < 8 * shares.BYTES
    assert text._unescape.func(pa.array([], pa.string())).to_pylist() == []


def test_whole_evaluations_read_documents_in_shares(spark, tmp_path, monkeypatch):
    """Of q40, both the table that holds the parsed contents and the judges that read it."""
    spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    plans, durable = [], scratch.durable
    monkeypatch.setattr(scratch, "durable", lambda df, label: plans.append(df) or durable(df, label))
    plans.append(catalog.queries()["q40_dimension_report"](spark, str(tmp_path)))
    for df, step in zip(plans, ("parse", "run"), strict=True):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        kinds = [kind for name, kind in re.findall(r"ArrowEvalPython \[(\w+)\(.*?\], \[pythonUDF\d+[^\]]*\], (25[01])", plan, re.S) if name == step]
        assert kinds and set(kinds) == {"251"}
