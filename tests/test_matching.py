"""All keywords and expressions in one pass, against one pattern each."""

import random
import re

import pytest
from pyspark.sql import functions as F

from vellum.functions import matching, text
from vellum.operators import evergreen

ODD = ["Café ÉTÉ naïve", "e\u0301te\u0301", "Straße ﬁ ŒUVRE", "İstanbul ǅ", "a\u00a0 b\u2003c\x1cd", "ΑΣ", "Ñandú_x½²", ""]


def test_fold_is_that_of_columns(spark):
    df = spark.createDataFrame([(x,) for x in ODD], "t string")
    assert [r.f for r in df.select(text.fold_plain(F.col("t")).alias("f")).collect()] == [matching.fold(x) for x in ODD]


@pytest.mark.parametrize("n_phrases", [1, 3, 12])
def test_counts_equal_a_pattern_for_each_phrase(n_phrases):
    draw = random.Random(n_phrases)
    words = ["a", "ab", "b", "a a", "b-a", "é", "a.b", "_a", ""]
    for _ in range(200):
        phrases = tuple(" ".join(draw.choice(words) for _ in range(draw.randrange(1, 4))).strip() for _ in range(n_phrases))
        found = "".join(draw.choice(["a", "b", " ", " ", "-", ".", "_", "é", "a b", "a a "]) for _ in range(60))
        want = [len(re.findall(rf"(?<!\w){re.escape(p)}(?!\w)", found)) if p else 0 for p in phrases]
        assert matching.Matcher(phrases).counts(found) == want


@pytest.mark.parametrize("lang", ["fr", "en"])
def test_expressions_equal_a_pattern_each(lang):
    draw = random.Random(5)
    shown = [x for _, x, _ in evergreen._EXPRESSIONS[lang]]
    between = [" ", ", ", "x", "_", "é", "\n", ". ", "'", " News ", "ſ", "İ", "12/03/2019", " mars 2021", " May 2020 "]
    for i in range(300):
        pieces = [draw.choice([str.upper, str.title, str.lower])(draw.choice(shown)) + draw.choice(between[: 9 if i % 2 else len(between)]) for _ in range(8)]
        t = "".join(pieces)
        want = [(kind, m.start(), m.end()) for kind, pattern in evergreen._DATES[lang] for m in pattern.finditer(t)]
        want += [(kind, m.start(), m.end()) for kind, _, pattern in evergreen._EXPRESSIONS[lang] for m in pattern.finditer(t)]
        assert evergreen._places(t, lang) == want
