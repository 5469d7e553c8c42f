import itertools
import math
import os
import random
import zlib
from collections import Counter

import pandas as pd
import public_tokenizers
import pytest

from vellum.llm import common, language, quality, queries, toxicity

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def brute_segments(values):
    """Maximal scoring segments by their definition: the best contiguous run, then the same on either side."""
    best, at = 0, None
    for i, j in itertools.combinations(range(len(values) + 1), 2):
        s = sum(values[i:j])
        if s > best + 1e-12 or (at and abs(s - best) < 1e-12 and j - i < at[1] - at[0]):
            best, at = s, (i, j)
    if at is None:
        return []
    i, j = at
    return [*brute_segments(values[:i]), (i, j, best), *[(a + j, b + j, s) for a, b, s in brute_segments(values[j:])]]


@pytest.mark.parametrize("seed", range(30))
def test_segments_equal_their_definition(seed):
    draw = random.Random(seed)
    n, gap = draw.randrange(1, 14), -0.37
    hits = {i: draw.choice([1.13, 2.71, 0.53, -1.9]) for i in range(n) if draw.random() < 0.5}
    values = [hits.get(i, gap) for i in range(n)]
    # Hits below zero are part of the gaps between positive ones.
    found = [(a, b, round(s, 6)) for a, b, s in toxicity.segments(hits, n, gap)]
    assert found == [(a, b, round(s, 6)) for a, b, s in brute_segments(values)]


def toy_toxic(n):
    draw = random.Random(n)
    clean = [f"word{i}" for i in range(300)]
    out = []
    for i in range(n):
        w = [draw.choice(clean) for _ in range(60)]
        if i % 5 == 0:
            w[10:40:6] = [draw.choice(["Vile", "rotten", "vermin"]) for _ in range(5)]
        out.append((i, " ".join(w), int(i % 5 == 0)))
    return out


def test_toxicity(spark, docs, odd):
    rows = toy_toxic(600)
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows] + [(0, 1, None), (None, 1, 1), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    table = docs([r[:2] for r in rows])
    model = toxicity.train(table, labels)
    assert {"vile", "rotten", "vermin"} <= set(model["lexicon"])
    found = {r.doc_id: r for r in toxicity.score(table, model).collect()}
    assert all((found[i].score >= 0.5) == bool(y) for i, _, y in rows)
    assert found[0].passages[0].first >= 10
    assert found[0].passages[-1].end <= 41
    scored = toxicity.score(docs(odd), model).collect()
    assert len(scored) == len(odd)
    assert all(0 <= r.score < 0.5 for r in scored)
    assert toxicity.clean(docs(odd), model).count() == len(odd)
    assert toxicity.score(docs([]), model).count() == 0
    blank = toxicity.train(docs([]), labels.limit(0))
    assert all(0 <= r.score <= 1 for r in toxicity.score(table, blank).collect())
    only = toxicity.train(table, labels.where("toxic = 0"))
    assert all(0 <= r.score <= 1 for r in toxicity.score(table, only).collect())


@pytest.mark.parametrize("clean_every", [2, 5, 10])
def test_toxicity_at_any_share_of_toxic_labels(clean_every):
    draw = random.Random(clean_every)
    rows = []
    for i in range(800):
        w = [f"word{draw.randrange(300)}" for _ in range(60)]
        y = int(i % clean_every > 0)
        if y:
            w[10:40:6] = [draw.choice(["Vile", "rotten", "vermin"]) for _ in range(5)]
        rows.append((" ".join(w), y))
    model = toxicity.fit(pd.DataFrame(rows, columns=["text", "toxic"]))
    assert {"vile", "rotten", "vermin"} <= set(model["lexicon"])
    scorer = toxicity.Scorer(model)
    assert all((scorer.probability(scorer.evidence(scorer.passages(t))) >= 0.5) == bool(y) for t, y in rows)


def test_forward_sums_all_segmentations():
    pieces = ["a", "ab", "b", "abc", "c", "▁", "▁a"]
    import numpy as np

    lattice = language.Lattice(pieces)
    p = np.array([[0.2, 0.1], [0.1, 0.3], [0.2, 0.2], [0.1, 0.1], [0.1, 0.1], [0.2, 0.1], [0.1, 0.1], [0.0, 0.0]])
    known = dict(zip(pieces, p, strict=False))

    def total(w, g):
        if not w:
            return 1.0
        return sum((known[w[:k]][g] if w[:k] in known else language.FLOOR if k == 1 else 0.0) * total(w[k:], g) for k in range(1, len(w) + 1))

    found = lattice.log_likelihood(["▁abc", "▁xab", "▁a", "▁cabba"], p)
    for w, row in zip(["▁abc", "▁xab", "▁a", "▁cabba"], found, strict=True):
        assert row == pytest.approx([math.log(total(w, g)) for g in (0, 1)])
    # Expected counts: the mean number of uses over all segmentations of a word.
    counts = lattice.expected(["▁abc"], np.array([2.0]), p[:, :1])
    z = total("▁abc", 0)
    assert counts[3] == pytest.approx(2 * p[3, 0] * p[5, 0] / z)


def test_language(spark, docs, odd):
    draw = random.Random(8)
    make = {"en": ["the", "and", "which", "thing", "shower"], "fr": ["les", "eau", "été", "chaque", "oiseau"], None: ["und"]}
    rows = [(i, " ".join(draw.choice(make[lang]) for _ in range(30)), lang) for i in range(120) for lang in [draw.choice(["en", "fr", "en", None])]]
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = language.train(docs(rows), path)
    assert model["langs"] == ["en", "fr"]
    found = {r.doc_id: r for r in language.identify(docs(rows), model).collect()}
    assert all(found[i].lang_pred == lang and 0.5 <= found[i].score <= 1 for i, _, lang in rows if lang)
    for r in language.identify(docs(odd), model).collect():
        assert (r.lang_pred == "und") == (r.doc_id in (1, 2, 3, 10))
        assert 0 <= r.score <= 1
    assert {r.doc_id for r in language.identified(docs(odd), model).collect()}.isdisjoint({1, 2, 3, 10})
    assert language.identify(docs([]), model).count() == 0
    none = language.train(docs([]), path)
    assert {r.lang_pred for r in language.identify(docs(rows), none).collect()} == {"und"}


def test_quality(spark, docs, odd):
    draw = random.Random(7)
    words = ["".join(draw.choice("aeioulmnrst") for _ in range(draw.randrange(2, 8))) for _ in range(400)]
    rows = [(i, (" ".join(draw.choice(words) for _ in range(120)) if i % 4 else " | ".join(draw.choice(words).upper() + "!!" for _ in range(120)))) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i, _ in rows] + [(1, None, 0), (None, 1, 0), (7777, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs(rows), labels)
    found = {r.doc_id: r.score for r in quality.score(docs(rows), model).collect()}
    assert all((found[i] >= 0.3) == bool(i % 4) for i, _ in rows)
    assert all(0 <= r.score <= 1 for r in quality.score(docs(odd), model).collect())
    assert quality.score(docs([]), model).count() == 0
    for part in (labels.limit(0), labels.where("quality = 1")):
        some = quality.train(docs(rows), part)
        assert all(0 <= r.score <= 1 for r in quality.score(docs(rows[:5]), some).collect())
    text = "some text that is long enough to be cut into parts " * 200
    assert b"".join(quality.parts(text)).decode() == text


def labelled(df, column):
    rows = df.toPandas()
    known = pd.read_parquet(f"{SF}/{'documents' if column == 'lang' else 'labels'}.parquet")[["doc_id", column]]
    return rows.merge(known, on="doc_id")


@needs_data
def test_held_out_accuracy(spark):
    rows = labelled(queries.op8_language_id(spark, SF), "lang")
    held = rows[rows.held_out]
    assert (held.held_out.to_numpy() == [zlib.crc32(str(i).encode()) % 4 == 2 for i in held.doc_id]).all()
    assert (held.lang_pred == held.lang).mean() > 0.98
    rows = labelled(queries.op7_quality_classifier(spark, SF), "quality")
    held = rows[rows.held_out]
    assert (held.predicted == held.quality).mean() > 0.9
    rows = labelled(queries.op10_toxicity(spark, SF), "toxic")
    held = rows[rows.held_out]
    assert (held.predicted == held.toxic).mean() > 0.9


@pytest.mark.parametrize("doc_id", [None, 7])
def test_language_of_rows_that_share_a_doc_id_is_learnt(spark, docs, doc_id, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_ROWS", 20)
    rows = [(doc_id, f"heiss {i}", "hot") for i in range(3_000)] + [(i, f"kalt {i}", "cold") for i in range(30)] + [(1, "same text", "one")] * 3_000
    drawn = Counter(r.lang for r in language.sample(docs(rows), 20).collect())
    assert drawn == {"hot": 20, "cold": 20, "one": 1}


def test_sums_of_many_languages_take_small_parts():
    found = ["x" * 10] * 1_000
    assert max(len(p) for _, p in language._parts(found, 8)) == 1_000
    assert max(len(p) for _, p in language._parts(found, 800)) == language.BATCH_CHARS // 1_000
    assert sum(len(p) for _, p in language._parts(found, 800)) == 1_000


def test_training_texts_are_bounded_by_bytes(spark, docs):
    rows = [(i, "a" * 100) for i in range(20)] + [(3, "b" * 100)] * 50 + [(30, "c" * 5_000), (31, None)]
    keys = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    found = common.bounded_texts(docs(rows), keys, 1_000, 1).collect()
    assert len(found) == len({r.doc_id for r in found}) == 10
    assert all(r.toxic == r.doc_id % 2 and len(r.text) == 100 for r in found)
    assert sorted(found) == sorted(common.bounded_texts(docs(rows).repartition(5), keys, 1_000, 1).collect())
    assert {r.doc_id for r in common.bounded_texts(docs(rows), keys, 1 << 20, 1).collect()} == {*range(20), 30}
    assert common.bounded_texts(docs([]), keys, 1_000, 1).count() == 0


def test_chance_is_learnt_from_texts_that_the_list_has_not_seen():
    draw = random.Random(12)
    # Labels by chance: no text has anything toxic about it, so none may look certain.
    rows = [(" ".join(f"w{draw.randrange(2_000)}" for _ in range(40)), draw.randrange(2)) for _ in range(600)]
    model = toxicity.fit(pd.DataFrame(rows, columns=["text", "toxic"]))
    scorer = toxicity.Scorer(model)
    assert max(scorer.probability(scorer.evidence(scorer.passages(t))) for t, _ in rows) < 0.8
