"""Whole articles against a plain version over a small table."""

import random
import re

import pytest

from vellum.plans import catalog, corpus

DRAW = random.Random(15)
WORDS = {i: None if i == 4 else [DRAW.choice(["the", "of", "Wort", "été", "vent", "2019", "que"]) + DRAW.choice(["", "", "x"]) for _ in range(n)] for i, n in enumerate([0, 1, 20, 21, 0, 35, 36, 113, 135, 136, 255, 2222])}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("whole")
    rows = [(i, None if w is None else "\n ".join(w), "en") for i, w in WORDS.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{at}/documents.parquet")
    return str(at)


def parts(words):
    """Introduction, sections (h2, first paragraph, h3, second paragraph) and conclusion of a text's words."""
    words = words or []
    end = max(20, len(words) - 15)
    runs = [words[i : min(i + 100, end)] for i in range(20, min(end, len(words)), 100)] or [[]]
    return words[:20], [(r[:3], r[3:33], r[33:35], r[35:]) for r in runs], words[end:]


def dated(i):
    return [" depuis mars 2021", " in 2019", " le 12/03/2024", " actuellement", ""][i % 5].split()


def rows_of(spark, folder, name):
    return {r.content_id: r for r in catalog.queries()[name](spark, folder).collect()}


def test_every_word_of_every_text_is_in_its_article(spark, folder):
    found = {r.content_id: r for r in corpus.whole_articles(spark, folder).collect()}
    assert set(found) == set(WORDS)
    for i, words in WORDS.items():
        intro, sections, conclusion = parts(words)
        assert intro + [w for s in sections for p in s for w in p] + conclusion == (words or [])
        shown = list(intro)
        for k, (h2, p1, h3, p2) in enumerate(sections):
            shown += h2 + p1 + ["étude", "citée"] * (k % 5 == 0) + h3 + p2 + dated(i) + ["the"] * (k == len(sections) - 1)
        shown += ["Conclusion", *conclusion] + ["Lecture", "complémentaire", "suite"] * (i % 3 == 0)
        assert re.sub("<[^>]+>", " ", found[i].content).split() == shown
        outline = [(h2, h3) for h2, _, h3, _ in sections][:: -1 if i % 4 == 1 else 1]
        assert re.sub("<[^>]+>", " ", found[i].outline).split() == [w for pair in outline for h in pair for w in h] + ["Conclusion"]


def test_queries_see_whole_texts(spark, folder):
    heads, intros, ends, keys, seo = (rows_of(spark, folder, f"{q}_whole") for q in ("q16_headings", "q18_introduction", "q19_conclusion", "q31_keyword_signals", "q37_seo_judge"))
    assert set(heads) == set(intros) == set(ends) == set(keys) == set(seo) == set(WORDS)
    for i, words in WORDS.items():
        intro, sections, conclusion = parts(words)
        titles = [" ".join(h) for h2, _, h3, _ in sections for h in (h2, h3)] + ["Conclusion"] + ["Lecture complémentaire"] * (i % 3 == 0)
        assert [h for h in heads[i].headings.split("|") if h] == [h for h in titles if h]
        assert intros[i].introduction == " ".join(intro)
        assert ends[i].conclusion == " ".join(conclusion)
        assert keys[i].lexical_body == (words or []).count("the") + 1
        assert keys[i].lexical_introduction == intro.count("the")
        assert keys[i].lexical_headings == sum(h.count("the") for h2, _, h3, _ in sections for h in (h2, h3))
        assert keys[i].lexical_conclusion == conclusion.count("the")


def test_sections_links_and_dates_of_whole_texts(spark, folder):
    found = {(r.content_id, r["at"]): r for r in catalog.queries()["q17_sections_whole"](spark, folder).collect()}
    links = catalog.queries()["q22_links_whole"](spark, folder).collect()
    dates = catalog.queries()["q38_temporal_refs_whole"](spark, folder).collect()
    for i, words in WORDS.items():
        _, sections, _ = parts(words)
        assert sum(k[0] == i for k in found) == len([s for s in sections if s[0]] or [0]) + 1 + (i % 3 == 0)
        for k, (h2, p1, h3, p2) in enumerate(sections):
            if h2:
                own = found[i, k + 1]
                assert (own.h2, own.h3) == (" ".join(h2), " ".join(h3))
                assert own.section.split() == p1 + ["étude", "citée"] * (k % 5 == 0) + h3 + p2 + dated(i) + ["the"] * (k == len(sections) - 1)
        assert sum(x.content_id == i and x.section == "body" for x in links) == (len(sections) + 4) // 5
        years = (words or []).count("2019") + len(sections) * any(w[-4:].isdigit() for w in dated(i))
        assert sum(x.content_id == i and x.type == "year" for x in dates) == years


def test_structure_and_calls_of_whole_texts(spark, folder):
    judged, calls = (rows_of(spark, folder, f"{q}_whole") for q in ("q20_structure_judge", "q21_cta_signals"))
    for i, words in WORDS.items():
        _, sections, _ = parts(words)
        heads = [(" ".join(h2), " ".join(h3)) for h2, _, h3, _ in sections]
        wanted = [x for h2, h3 in heads[:: -1 if i % 4 == 1 else 1] for x in (("h2", h2), ("h4" if i % 4 == 2 else "h3", h3))]
        shown = [x for h2, h3 in heads for x in (("h2", h2), ("h3", h3))]
        rules = [r for r, k in (("heading_order", 1), ("heading_levels", 0)) if [x[k] for x in wanted] != [x[k] for x in shown]]
        assert judged[i].rules == ("|".join(f"structure.{r}" for r in rules) or "structure.valid")
        assert judged[i].status == ("fail" if rules else "pass")
        top = 1 + 4 * len(sections) + 2
        found = calls[i]
        assert (found.cta_count, found.strong_text) == ((1, heads[0][0]) if i % 2 else (0, ""))
        assert (found.complementary, found.top_level) == ((str(top), top + 3) if i % 3 == 0 else ("", top + 1))


def test_sources_of_whole_texts(spark, folder):
    counts, raw, judged, twice = (rows_of(spark, folder, f"{q}_whole") for q in ("q24_link_partitions", "q25_raw_markdown_urls", "q29_sources_judge", "q43_duplicate_links_in_text"))
    again = {}
    for i, words in WORDS.items():
        body = (len(parts(words)[1]) + 4) // 5
        away, inside = int(i % 15 == 0), int(i % 3 == 0 and i % 5 != 0)
        c = counts[i]
        assert (c.external, c.internal, c.body_external, c.complementary, c.complementary_external) == (body + away, inside, body, int(i % 3 == 0), away)
        assert (raw[i].raw_urls, raw[i].markdown_links, raw[i].attached) == [(f"https://bare.example/{i}", "", 0), ("https://marked.example)", "[x](https://marked.example)", 0), ("", "", 1)][i % 3]
        # Complementary links to other sites, too many of them, tracking parameters, a link that is no URL.
        major = away + (i % 3 == 0 and body + away > 1) + (i % 4 == 0) + inside
        minor = (body if i % 2 else 0) + away + (body > 1)
        r = judged[i]
        assert (r.status, r.blocking) == (("fail", major) if major else ("warn" if minor else "pass", 0))
        assert r.score == {"fail": 0, "warn": 80, "pass": 100}[r.status]
        assert twice[i].duplicated == (body + (i % 2 == 0) > 1)
        if i % 3 == 0:
            href = f"https://autre.example/{i % 7}" if i % 5 == 0 else f"/interne/{i % 7}"
            again[href] = again.get(href, 0) + 1
    found = {r.href: r.n for r in catalog.queries()["q28_duplicate_links_whole"](spark, folder).collect()}
    assert found == {h: n for h, n in again.items() if n > 1}


def test_keywords_and_replies_of_whole_texts(spark, folder):
    spread = {(r.content_id, r["at"]): r for r in catalog.queries()["q32_section_distribution_whole"](spark, folder).collect()}
    marked = catalog.queries()["q33_keyword_emphasis_whole"](spark, folder).collect()
    judged, replies = (rows_of(spark, folder, f"{q}_whole") for q in ("q37_seo_judge", "q39_evergreen_judge"))
    assert sorted(map(tuple, marked)) == sorted((i, "strong", "the", "the") for i in WORDS)
    for i, words in WORDS.items():
        intro, sections, conclusion = parts(words)
        matched = [[k for k in ("of", "que") if k in (*p1, *h3, *p2)] for _, p1, h3, p2 in sections] + [[k for k in ("of", "que") if k in conclusion]]
        alone = sum(map(bool, matched)) == 1
        assert sum(k[0] == i for k in spread) == len(matched)
        for k, keys in enumerate(matched):
            assert (spread[i, k].matched, spread[i, k].concentrated) == ("|".join(keys), alone)
        heads = [w for h2, _, h3, _ in sections for w in h2 + h3]
        n = (words or []).count("the") + 1
        away = any("the" not in zone for zone in (intro, heads, conclusion))
        uneven = alone or not all(matched)
        lexical = max(0, 90 - 20 * away - 15 * (not 7 <= n <= 10) - 8 * uneven)
        rules = ["semantic_unavailable", "overoptimization_semantic_unavailable"] + ["main_keyword_locations"] * away + ["keyword_occurrences"] * (not 7 <= n <= 10) + ["keyword_distribution"] * uneven + ["formatting_constraints"]
        r = judged[i]
        assert (r.lexical, r.score, r.rules) == (lexical, round(0.65 * lexical), "|".join(f"seo.{x}" for x in rules))
        assert r.status == ("warn" if r.score >= 60 else "fail")
        e = replies[i]
        score = 0 if i % 5 == 4 else i % 101
        assert (e.score, e.status) == (score, "fail" if i % 5 == 4 else "pass" if score >= 70 else "warn" if score >= 50 or i % 2 == 0 else "fail")
        said = {4: ("evergreen.llm_error", ""), 1: ("evergreen.llm.problematic_passage", " ".join(sections[0][0]))}
        assert (e.rules, e.excerpt) == said.get(i % 5, ("", ""))


def test_overoptimisation_of_whole_texts(spark, folder):
    found = rows_of(spark, folder, "q36_overoptimisation_whole")
    band = lambda x, *limits: next((v for v, m in zip((100, 75, 45), limits, strict=True) if x <= m), 20)
    for i, words in WORDS.items():
        intro, sections, conclusion = parts(words)
        zones = [intro] + [p1 + ["étude", "citée"] * (k % 5 == 0) + h3 + p2 + dated(i) + ["the"] * (k == len(sections) - 1) for k, (_, p1, h3, p2) in enumerate(sections)] + [conclusion]
        zones = [z for z in zones if z]
        # These texts have no ends of sentences, so each zone is one.
        hits = [int("the" in z) for z in zones]
        total, words_in = sum(hits), sum(map(len, zones))
        share = sum(map(bool, hits)) / total if total else 1
        score = 100 if not total else round(0.40 * band(total / words_in, 0.025, 0.045, 0.065) + 0.35 * (100 if share >= 0.75 else 20) + 0.25 * band(max(hits), 1, 2, 3))
        assert found[i].overoptimization == score
        assert found[i].overoptimization_risk == ("not_applicable" if not total else "low" if score >= 85 else "medium_low" if score >= 70 else "medium_high" if score >= 50 else "high")


def test_report_counts_every_document(spark, folder):
    counted = {}
    for r in catalog.queries()["q40_dimension_report"](spark, folder).collect():
        counted[r.dimension] = counted.get(r.dimension, 0) + r.n
    assert counted
    assert set(counted.values()) == {len(WORDS)}
    # Judges that have a query of their own are counted there as well.
    by_status = {}
    for r in catalog.queries()["q40_dimension_report"](spark, folder).collect():
        by_status[r.dimension, r.status] = r.n
    structure = [r.status for r in rows_of(spark, folder, "q20_structure_judge_whole").values()]
    seo = [r.status for r in rows_of(spark, folder, "q37_seo_judge_whole").values()]
    for name, own in (("structure", structure), ("seo", seo)):
        assert {s: by_status.get((name, s), 0) for s in ("pass", "warn", "fail")} == {s: own.count(s) for s in ("pass", "warn", "fail")}
