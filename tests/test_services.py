"""Encoders and language models over whole tables: each distinct request once, failures as data."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from test_judges import SEO, seo_row

from vellum.operators import evergreen, seo, services

# Workers don't import test modules.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def counting(folder):
    """Calls are counted by files, as they happen in other processes."""
    import os
    import uuid

    def encode(texts):
        with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
            json.dump(texts, f)
        if any("boom" in t for t in texts):
            raise RuntimeError("no boom")
        return [[1.0, 0.0] if "tea" in t.lower() or "téa" in t.lower() else [0.6, 0.8] for t in texts]

    return encode


def calls(folder):
    import os

    return [json.load(open(os.path.join(folder, f))) for f in os.listdir(folder)]


def test_each_distinct_text_is_encoded_once_and_fails_alone(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    rows = [(1, ["tea", "leaf"]), (2, ["leaf", "boom", "tea"]), (3, []), (4, None), (1, ["tea", "leaf"])] + [(10 + i, ["tea"]) for i in range(50)]
    df = spark.createDataFrame(rows, "id int, texts array<string>").repartition(5)
    found = services.embed(df, "texts", services.Encoder(lambda: counting(folder), batch=8), "v", "e").collect()
    assert len(found) == len(rows)
    by_id = {r.id: r for r in found}
    assert (by_id[1].v, by_id[1].e) == ([[1.0, 0.0], [0.6, 0.8]], None)
    assert (by_id[2].v, by_id[2].e) == (None, "RuntimeError: no boom")
    assert (by_id[3].v, by_id[3].e, by_id[4].v, by_id[4].e) == ([], None, None, None)
    asked = calls(folder)
    for text in ("tea", "leaf"):
        # Once in a batch, and once more alone if a batch failed.
        assert sum(text in batch for batch in asked) <= 2
    assert sorted({t for batch in asked for t in batch}) == ["boom", "leaf", "tea"]


@pytest.mark.parametrize("hot", [1, 10_000])
def test_hot_answers_are_looked_up_under_salts(spark, hot, monkeypatch):
    monkeypatch.setattr(services, "HOT_REQUESTS", hot)
    asked = spark.range(300).select("id", services.digest(F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string"))).alias("digest"), F.lit("x").alias("request"))
    answers = services.distinct(asked).withColumn("answer", F.hex("digest"))
    found = services.look_up(asked.drop("request"), answers.drop("request"), F.col("id")).collect()
    assert sorted(r.id for r in found) == list(range(300))
    assert all(r.answer == r.digest.hex().upper() for r in found)


def test_seo_with_a_table_wide_encoder(spark, tmp_path):
    contents = ["<p>Intro.</p><h2>Green</h2><p>A cup of téa. Leaf tea now. More.</p>", "<p>boom</p>", seo_row()["content"], "", "<![x[y]]>"]
    rows = spark.createDataFrame([tuple(seo_row(content=c, main_keyword="blue tea").values()) for c in contents], SEO)
    found = {r.content: r for r in seo.judge(rows, services.Encoder(lambda: counting(str(tmp_path)))).collect()}
    assert len(found) == 5
    good = found[contents[0]]
    assert good.seo_signals.semantic.available
    assert (good.seo_signals.semantic.best_similarity, good.seo_signals.overoptimization.only_near) == (1.0, 2)
    failed = found[contents[1]].seo.findings[:2]
    assert [f.rule_id for f in failed] == ["seo.semantic_unavailable", "seo.overoptimization_semantic_unavailable"]
    assert json.loads(failed[0].evidence) == {"error": "RuntimeError: no boom"}
    assert found[contents[2]].seo_signals.semantic.available
    assert found[contents[4]].seo.error.startswith("html_parse_error:")
    alone = seo.judge(rows.where(F.col("content") == contents[2]), seo.python_encoder(counting(str(tmp_path)))).first()
    assert (alone.seo, alone.seo_signals) == (found[contents[2]].seo, found[contents[2]].seo_signals)


def test_vectors_of_a_table(spark):
    table = spark.createDataFrame([(3, [1.0, 2.0])], "key int, vector array<float>")
    df = spark.createDataFrame([(["abc", "xyz"],), (["long text"],)], "t array<string>")
    found = services.embed(df, "t", services.VectorTable(table, F.length), "v", "e").collect()
    assert sorted(map(tuple, found), key=str) == [(["abc", "xyz"], [[1.0, 2.0]] * 2, None), (["long text"], None, "no vector")]


def model(prompts):
    if "raise" in prompts:
        raise TimeoutError("too slow")
    return [None if p == "mute" else '{"score_global_evergreen": 80}' if "good" in p else "{}" for p in prompts]


@pytest.mark.parametrize(("under_way", "batch"), [(1, 1), (8, 1), (8, 3)])
def test_a_model_that_raises_fails_its_rows_alone(spark, under_way, batch):
    prompts = ["good", "raise", "good", "other", None, "mute", "good 2", "raise"]
    rows = [(i, p, True, "fr-FR", "clash") for i, p in enumerate(prompts)]
    df = spark.createDataFrame(rows, "id int, prompt string, evergreen_required boolean, locale string, digest string").drop("digest")
    found = {r.id: r for r in evergreen.judge(services.ask(df, model, under_way=under_way, batch=batch)).collect()}
    assert [found[i].evergreen.status for i in range(8)] == ["pass", "fail", "pass", "fail", "fail", "fail", "pass", "fail"]
    why = {i: json.loads(found[i].evergreen.findings[0].evidence)["error"] for i in (1, 3, 4, 5, 7)}
    assert why == {1: "TimeoutError: too slow", 3: "the reply holds no score_global_evergreen", 4: "the reply holds no JSON object", 5: "no reply", 7: "TimeoutError: too slow"}
    assert all(found[i].evergreen.findings[0].rule_id == "evergreen.llm_error" for i in why)
    assert [found[i].llm_error for i in (0, 4)] == [None, None]
    assert services.ask(df.limit(0), model).count() == 0


def test_requests_under_way_are_bounded_by_tasks_and_threads(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("prompt"))
    assert services.ask(df, lambda p: p, under_way=3, threads=2).where("llm_raw_response = prompt").count() == 100


def test_closeness_is_that_of_the_vectors(spark, tmp_path):
    """Pairs are measured once each, and rows get numbers: the same ones as from their vectors."""
    table = spark.createDataFrame([(n, [1.0, n / 2, 0.0]) for n in range(1, 6)], "key int, vector array<float>")
    rows = [["a", "bb", "ccc", "bb"], ["a", "bb"], ["bb", "a"], ["a"], ["too long"], ["a", "too long", "bb"], ["", "a"], [], None, ["a", None]] * 3
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t array<string>")
    for encoder in (services.VectorTable(table, F.length), services.Encoder(lambda: lambda texts: [[1.0, float({"bb": 2}.get(t, len(t)) if len(t) < 4 else 1 / 0), 3.0] for t in texts], batch=2)):
        full = services.embed(df, "t", encoder, "v", "e").select("i", F.transform(F.slice("v", F.lit(2), F.greatest(F.size("v") - 1, F.lit(0))), lambda x: seo.cosine(F.get("v", F.lit(0)), x)).alias("near"), "e")
        found = services.closeness(df, "t", encoder, seo.cosine, "near", "e").select("i", "near", "e")
        given = [i for i, r in enumerate(rows) if r is None or None not in r]
        assert sorted(map(tuple, found.where(F.col("i").isin(given)).collect())) == sorted(map(tuple, full.where(F.col("i").isin(given)).collect()))
        assert found.count() == len(rows)
        assert {r.near for r in found.collect() if rows[r.i] == ["a", None]} == {None}
