"""The registered queries over whole tables against SQL, the tokenizer library or plain versions."""

import base64
import hashlib
import math
import os
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
import zstandard
from pyspark.sql import functions as F
from test_media_topk import expected
from test_mixing import exact_targets, size
from test_near_dedup import brute

from vellum.llm import byte_bpe, common, language, quality, queries, toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="module")
def rows():
    return [(int(i), t) for i, t in pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "text"]].itertuples(index=False)]


def test_op1(spark, rows):
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = set()
    for i, t in rows:
        ids = np.array(encoding.encode_ordinary(t or ""), "<u4")
        want.add((i, len(ids), sha(ids.tobytes()), sha((t or "").encode())))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {tuple(r) for r in queries.op1_byte_bpe(spark, SF).collect()} == want
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("vellum")]


def test_op2(spark, rows):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op2_near_dedup(spark, SF).collect()}
    assert found == brute(rows, 4)


def test_op3(spark):
    table = pd.read_parquet(f"{SF}/conversations.parquet").sort_values(["conv_id", "turn"])
    said = defaultdict(list)
    for c, role, text in [*table[["conv_id", "role", "text"]].itertuples(index=False), (-1, "user", queries.FORGED), (-1, "assistant", queries.FORGED)]:
        said[int(c)].append((role, text or ""))
    found = {r.conv_id: r for r in queries.op3_chat_format(spark, SF).collect()}
    assert set(found) == set(said)
    for c, turns in said.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (found[c].n_turns, found[c].turns_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns).encode()))
        assert (found[c].loss_chars, found[c].loss_sha256) == (len(loss), sha(loss.encode()))
        assert found[c].formatted_chars > sum(len(t) for _, t in turns)


@pytest.mark.parametrize("name", ["op4_warc", "op9_topk_search"])
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS FROM '{SF}/{table}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).df()
    found = queries.queries()[name](spark, SF).toPandas()
    plain = lambda f: sorted(map(repr, f[sorted(f.columns)].astype(object).where(f.notna(), None).map(lambda v: int(v) if isinstance(v, float) else v).to_numpy().tolist()))
    assert plain(found) == plain(want)


def test_op5(spark):
    table = pd.read_parquet(f"{SF}/documents.parquet").astype(object)
    sizes, own = Counter(), {}
    for i, t, s in table[["doc_id", "text", "source"]].itertuples(index=False):
        own[i] = (size(t), None if s is None or s != s else s)
        sizes[own[i][1]] += own[i][0]
    found, taken = queries.op5_mixing(spark, SF).collect(), Counter()
    assert sorted(r.doc_id for r in found) == sorted(own)
    targets = exact_targets(sizes)
    for r in found:
        n, s = own[r.doc_id]
        assert (r.size, r.source_size) == (n, sizes[s])
        assert r.target == pytest.approx(float(targets[s]))
        assert 0 <= r.taken <= 3 * n
        taken[s] += r.taken
    assert all(abs(taken[s] - float(t)) <= 64 for s, t in targets.items())


def test_op6(spark, rows):
    found = {(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in queries.op6_media_columns(spark, SF).collect()}
    assert found == {(i, *expected(t)) for i, t in rows}


def test_op7_is_plain_compression(spark, rows):
    """Sizes by the library's one-shot calls, scores by the formula."""
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    model = quality.train(docs, labels.where(~common.held_out(F.col("doc_id"), 5, 0)))
    assert model == quality.train(docs.repartition(7), labels.repartition(3).where(~common.held_out(F.col("doc_id"), 5, 0)))
    dictionaries = [zstandard.ZstdCompressionDict(base64.b64decode(model[k])) if model[k] else None for k in ("good", "bad")]

    def length(part, d):
        options = {"dict_data": d} if d else {}
        return len(zstandard.ZstdCompressor(level=3, write_content_size=False, write_dict_id=False, **options).compress(part))

    found = {r.doc_id: r for r in queries.op7_quality_classifier(spark, SF).collect()}
    assert len(found) == len(rows)
    for i, t in rows:
        data = (t or "").encode()
        cut = [data[k : k + 2048] for k in range(0, len(data), 2048)]
        good, bad, plain = (sum(length(p, d) for p in cut) for d in (*dictionaries, None))
        difference, ratio = ((bad - good) / (bad + good), plain / len(data)) if data else (0.0, 1.0)
        z = model["w"][0] + model["w"][1] * min(6, max(-6, 20 * difference)) + model["w"][2] * 20 * max(0, 0.35 - ratio)
        assert found[i].difference == pytest.approx(difference)
        assert found[i].score == pytest.approx(1 / (1 + math.exp(-z)))
        assert (found[i].predicted, found[i].held_out) == (int(found[i].score >= 0.3), zlib.crc32(str(i).encode()) % 5 == 0)


def test_op8_sums_segmentations(spark, rows):
    docs = common.table(spark, SF, "documents")
    model = language.train(docs.where(~common.held_out(F.col("doc_id"), 4, 2)), public_tokenizers.path("piece_bpe_32k.model"))
    known = {p: model["table"][j] for j, p in enumerate(model["pieces"])}
    none, longest, memo = np.zeros(len(model["langs"])), max(map(len, model["pieces"])), {}
    assert longest > 8

    def total(w):
        if w not in memo:
            sums = [np.ones(len(model["langs"]))]
            for e in range(1, len(w) + 1):
                step = sum(sums[e - k] * known.get(w[e - k : e], none) for k in range(2, min(e, longest) + 1))
                sums.append(step + sums[e - 1] * np.maximum(known.get(w[e - 1], none), language.FLOOR))
            memo[w] = np.log(sums[-1])
        return memo[w]

    found = {r.doc_id: r for r in queries.op8_language_id(spark, SF).collect()}
    for i, t in rows[:60]:
        score = sum(map(total, language.words(t)))
        if isinstance(score, int):
            assert (found[i].lang_pred, found[i].score) == ("und", 0)
        else:
            assert found[i].lang_pred == model["langs"][int(score.argmax())]
            assert found[i].score == pytest.approx(1 / np.exp(score - score.max()).sum())


def test_op10_is_the_scan(spark, rows):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels").where(~common.held_out(F.col("doc_id"), 5, 0))
    model = toxicity.train(docs, labels)
    assert model == toxicity.train(docs.repartition(7), labels.repartition(3))
    lexicon = {k.encode(): v for k, v in model["lexicon"].items()}
    found = {r.doc_id: r for r in queries.op10_toxicity(spark, SF).collect()}
    assert len(found) == len(rows)
    for i, t in rows:
        words = toxicity.tokens(t)
        values = [next((lexicon[x] for x in (w, *toxicity.prefixes(w)) if x in lexicon), 0.0) for w in words]
        found_here = toxicity.segments({j: v for j, v in enumerate(values) if v}, len(words), model["gap"])
        chance = [model["k"] * len(words) * math.exp(-model["lam"] * s) for *_, s in found_here]
        evidence = sum(-math.log(e) for e in chance if e <= toxicity.SIGNIFICANT)
        z = model["a"] + model["b"] * math.log1p(evidence)
        assert found[i].evidence == pytest.approx(evidence)
        assert found[i].score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-12)
        assert found[i].predicted == int(found[i].score >= 0.5)


def test_extreme_values():
    draw = np.random.default_rng(4)
    k, lam, n = 0.0002, 0.7, 400
    best = [(float(max(0, -math.log(-math.log(u) / (k * n)) / lam)), n) for u in draw.random(20_000)]
    found = toxicity.extreme_values(best)
    assert found[1] == pytest.approx(lam, rel=0.1)
    assert found[0] == pytest.approx(k, rel=0.5)


def test_language_count_is_bounded(spark, docs, monkeypatch):
    monkeypatch.setattr(language, "MAX_LANGUAGES", 3)
    with pytest.raises(ValueError, match="languages"):
        language.sample(docs([(i, "text", f"l{i}") for i in range(4)]))


def test_hot_language_keeps_its_sample(spark, docs):
    rows = [(i, f"text {i}", "hot" if i % 10 else "cold") for i in range(3000)]
    found = Counter(r.lang for r in language.sample(docs(rows), rows=100).collect())
    assert found == {"hot": 100, "cold": 100}


def test_scratch_folder_is_named_on_clusters(spark, monkeypatch):
    class Settings:
        conf = type("Conf", (), {"get": staticmethod(lambda name, default=None: default)})
        sparkContext = type("Context", (), {"master": "yarn"})  # noqa: N815

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        common.scratch_dir(Settings)
    Settings.sparkContext.master = "local[8]"
    assert common.scratch_dir(Settings)
