"""The pipeline against a plain Python version of what each stage must do to its own input."""

import hashlib
import os
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from test_mixing import exact_targets, size
from test_near_dedup import brute

import corpus_pipeline
from vellum.llm import byte_bpe, common, language, mixing, toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_stages(spark):
    docs = common.table(spark, SF, "documents")
    columns = docs.columns
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.durable(stage(spark, docs, SF), name)
        held[name] = ([r.asDict() for r in before.collect()], [r.asDict() for r in docs.collect()], before)
        assert name == "byte_bpe" or docs.columns == columns

    rows, kept, frame = held["toxicity"]
    model = toxicity.train(frame, common.table(spark, SF, "labels"))
    scorer = toxicity.Scorer(model)
    assert {r["doc_id"] for r in kept} == {r["doc_id"] for r in rows if scorer.probability(scorer.evidence(scorer.passages(r["text"]))) < 0.5}

    rows, kept, frame = held["language_id"]
    identifier = language.Identifier(language.train(frame, public_tokenizers.path("piece_bpe_32k.model")))
    good = [lang != "und" and p >= 0.5 for lang, p in identifier.predict([r["text"] for r in rows])]
    assert Counter(r["doc_id"] for r in kept) == Counter(r["doc_id"] for r, g in zip(rows, good, strict=True) if g)

    rows, kept, _ = held["near_dedup"]
    groups = brute([(r["doc_id"], r["text"]) for r in rows], 5)
    assert sorted(r["doc_id"] for r in kept) == sorted(i for i, (_, root) in groups.items() if i == root)

    rows, kept, frame = held["mixing"]
    n = Counter(r["doc_id"] for r in kept)
    sizes, words = Counter(), {}
    for r in rows:
        words[r["doc_id"]] = size(r["text"])
        sizes[r["source"]] += words[r["doc_id"]]
    taken = defaultdict(int)
    for r in rows:
        assert n[r["doc_id"]] <= 3
        taken[r["source"]] += n[r["doc_id"]] * words[r["doc_id"]]
    largest = max(words.values())
    for s, t in exact_targets(sizes).items():
        assert abs(taken[s] - float(t)) <= largest / 2 + mixing.BLOCK_WORDS
    texts = {r["doc_id"]: r for r in rows}
    assert all(r == texts[r["doc_id"]] for r in kept)

    rows, kept, _ = held["byte_bpe"]
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(public_tokenizers.path(corpus_pipeline.RANKS)), special_tokens={})
    want = Counter()
    for r in rows:
        ids = np.array(encoding.encode_ordinary(r["text"] or ""), "<u4")
        want[r["doc_id"], len(ids), ids.tobytes(), hashlib.sha256((r["text"] or "").encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded_sha256"]) for r in kept) == want
    assert all(hashlib.sha256(r["ids"]).hexdigest() == r["ids_sha256"] for r in kept)


def test_run_is_the_stages(spark):
    found = corpus_pipeline.run(spark, SF)
    assert found.count() > 100
    assert {"doc_id", "n_tokens", "ids_sha256"} <= set(found.columns)


def odd_tables(spark, folder, rows):
    """documents with nulls, repeats and columns whose names the stages use themselves, and labels for them."""
    names = ("times", "text_key", "own", "_times", "score", "n", "root")
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names)
    spark.createDataFrame([(i, t, lang, s, None, *("clash" for _ in names)) for i, t, lang, s in rows], schema).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(i % 10 == 0)) for i, *_ in rows if i is not None] + [(None, 1, 1), (3, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_on_odd_tables(spark, tmp_path):
    words = ["the", "and", "which", "thing", "shower", "garden", "window"]
    plain = [(i, " ".join(f"{words[(i * k) % 7]} {words[(i + k) % 7]}{k}" for k in range(1, 30)) + (" vile rotten vermin" * 3 if i % 10 == 0 else ""), "en", "a" if i % 3 else None) for i in range(1, 90)]
    odd = [(None, "a text of its own without any id", "en", "a"), (None, None, None, None), (200, None, "en", "b"), (201, "", "en", "b"), (202, " \n", None, "b"), (5, "another text under the same id", "en", "a"), plain[6], plain[6], (203, plain[6][1], None, "b"), (204, "123 456", "en", "b")]
    folder = odd_tables(spark, tmp_path / "odd", plain + odd)
    docs = common.table(spark, folder, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.durable(stage(spark, docs, folder), name)
        kept = [(r.doc_id, r.text) for r in docs.collect()] if name != "byte_bpe" else []
        assert name == "byte_bpe" or (docs.columns == columns and {r.times for r in docs.collect()} <= {"clash"})
        if name == "toxicity":
            assert not any("vermin" in (t or "") for _, t in kept)
            assert len(kept) == len(plain) + len(odd) - 8
        if name == "language_id":
            assert not any(t is None or not any(map(str.isalpha, t)) for _, t in kept)
            assert {(None, odd[0][1]), (5, odd[5][1])} <= set(kept)
        if name == "near_dedup":
            assert kept.count((plain[6][0], plain[6][1])) == 1
            assert not any(i == 203 for i, _ in kept)
            assert {(None, odd[0][1]), (5, odd[5][1]), (5, plain[4][1])} <= set(kept)
        if name == "byte_bpe":
            assert docs.count() == before.count() > 0


def test_stages_on_empty_tables(spark, tmp_path):
    folder = odd_tables(spark, tmp_path / "none", [])
    assert corpus_pipeline.run(spark, folder).count() == 0
