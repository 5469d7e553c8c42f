import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from vellum.llm import mixing


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def exact_targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, total = {}, Fraction(sum(sizes.values()))
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed |= {s: Fraction(cap * sizes[s]) for s in over}


@pytest.mark.parametrize("shard_docs", [4_096, 60])
def test_plan(spark, docs, shard_docs, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_DOCS", shard_docs)
    draw = random.Random(3)
    rows = [(i, " ".join(["w"] * draw.randrange(0, 90)), "en", draw.choice(["a", "a", "a", "b", "é", "Z", None, "tiny"] if i % 9 else ["z\U0001f600"])) for i in range(700)]
    rows = [(i, t if s != "tiny" else ("w" if i % 40 == 0 else None), lang, s) for i, t, lang, s in rows] + [(5, "repeated id", "en", "a"), (None, "no id", "en", "b")]
    found = mixing.plan(docs(rows)).collect()
    assert len(found) == len(rows)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += size(t)
    targets, taken = exact_targets(sizes), defaultdict(int)
    assert Counter((r.doc_id, r.size) for r in found) == Counter((i, size(t)) for i, t, *_ in rows)
    for r in found:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(float(targets[r.source]))
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s, t in targets.items():
        assert abs(taken[s] - float(t)) <= max(mixing.BLOCK_WORDS, 0.03 * float(t))
    assert sorted(map(str, mixing.plan(docs(rows).repartition(7)).collect())) == sorted(map(str, found))


@pytest.mark.parametrize("seed", range(4))
def test_apportion_is_highest_quotients(spark, seed):
    draw = random.Random(seed)
    weights = {f"s{i:02d}": draw.choice([0, 1, 5, 40, 1000, 31.5]) * draw.random() for i in range(draw.randrange(1, 25))} | {"zz": 3.0}
    seats = draw.randrange(0, 300)
    table = spark.createDataFrame([("g", k, float(w)) for k, w in weights.items()], "g string, name string, w double")
    from pyspark.sql import functions as F

    found = {r.name: r.quota for r in mixing.apportion(table, "g", "name", "w", F.lit(seats)).collect()}
    expected = Counter()
    for _ in range(seats):
        expected[min(weights, key=lambda k: (-weights[k] / (2 * expected[k] + 1), k))] += 1
    assert found == {k: expected[k] for k in weights}


def test_mix_repeats_whole_rows(spark, docs):
    rows = [(i, "w " * 30, "en", "a" if i < 40 else "b") for i in range(60)] + [(99, None, "en", "a")]
    table = docs(rows).withColumnsRenamed({"score": "times", "key": "_own"})
    mixed = mixing.mix(table)
    assert mixed.columns == table.columns
    assert {r.times for r in mixed.collect()} == {"clash"}
    n = Counter(r.doc_id for r in mixed.collect())
    assert 99 not in n
    assert max(n.values()) <= 3
    assert abs(sum(v for k, v in n.items() if k >= 40) - 40) <= 2
    assert mixing.plan(docs([])).count() == 0
    assert mixing.mix(docs([])).count() == 0


def test_mix_keeps_rows_without_doc_id(spark, docs):
    rows = [(None if i % 2 else i, f"w{i} " * 30, "en", "a" if i < 40 else "b") for i in range(60)] + [(None, "w1 " * 30, "en", "b"), (None, None, "en", "a")]
    n = Counter((r.doc_id, r.text, r.source) for r in mixing.mix(docs(rows)).collect())
    assert set(n) <= {(i, t, s) for i, t, _, s in rows}
    assert not any(t is None for _, t, _ in n)
    assert max(n.values()) <= 3
    taken = Counter()
    for r in mixing.plan(docs(rows)).collect():
        taken[r.source, r.doc_id is None] += r.taken / 30
    for (source, bare), t in taken.items():
        assert abs(sum(v for k, v in n.items() if (k[2], k[0] is None) == (source, bare)) - t) <= 2
    assert sum(v for k, v in n.items() if k[0] is None) > 15


def test_many_sources_are_ranked_by_ranges(spark, docs):
    draw = random.Random(6)
    rows = [(i, "w " * draw.randrange(1, 40), "en", f"s{draw.randrange(300):03d}") for i in range(1500)]
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += size(t)
    targets = exact_targets(sizes)
    for r in mixing.plan(docs(rows)).collect():
        assert r.target == pytest.approx(float(targets[r.source]))


@pytest.mark.parametrize("block_words", [32, 400, 1_000, 4_000])
def test_blocks_larger_than_shards_still_meet_the_targets(spark, docs, block_words, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_DOCS", 10)
    draw = random.Random(block_words)
    rows = [(i, "w " * draw.randrange(1, 20), "en", "abc"[i % 3] if i % 7 else "a") for i in range(6_000)]
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += size(t)
    targets, taken = exact_targets(sizes), Counter()
    for r in mixing.plan(docs(rows), block_words=block_words).collect():
        assert r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s, t in targets.items():
        assert abs(taken[s] - float(t)) <= max(block_words, 0.005 * float(t))


def test_what_a_shard_cannot_hold_goes_to_others(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_DOCS", 10)
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 1)
    # The last source is wanted three times whole, so that every shard is full.
    rows = [(i, "w " * 10, "en", "a" if i < 900 else "c") for i in range(1_000)]
    taken = Counter()
    for r in mixing.plan(docs(rows), weights=(1, 30), block_words=64).collect():
        assert r.taken <= 30
        taken[r.source] += r.taken
    assert abs(taken["c"] - 3_000) <= 64
    assert abs(taken["a"] - 7_000) <= 64
