import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import media, topk


def expected(text):
    data = (text or "").encode()
    full = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
    return len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:])


@pytest.mark.parametrize(("broadcast_bytes", "hot"), [(1 << 25, 1_000), (0, 1_000), (0, 1)])
def test_media_come_back(spark, docs, odd, broadcast_bytes, hot, monkeypatch):
    monkeypatch.setattr(media, "BROADCAST_BYTES", broadcast_bytes)
    monkeypatch.setattr(media, "HOT_ROWS", hot)
    draw = random.Random(6)
    common = "".join(draw.choice("abcdefgh ") for _ in range(60_000))
    rows = odd + [(100 + i, common[: 20_000 + 500 * i] + str(i) + common[30_000:]) for i in range(8)] + [(200, common), (201, common), (202, common * 2)]
    found = media.media_columns(docs(rows)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in found) == sorted((str(i), *expected(t)) for i, t in rows)
    listed = media.recipes(docs(rows))
    stored, _ = media.store(docs(rows), listed)
    bytes_stored = stored.select(F.explode("chunks.data").alias("d")).agg(F.sum(F.octet_length("d"))).first()[0]
    texts = {t or "" for _, t in rows}
    assert bytes_stored < sum(expected(t)[1] for t in texts) - 300_000
    assert len({r.media_sha256 for r in found}) == len(texts)
    assert media.media_columns(docs([])).count() == 0


def test_cuts_follow_content():
    data = np.random.default_rng(1).integers(0, 256, 300_000, dtype=np.uint8).tobytes()
    pieces = media.chunks(data)
    assert b"".join(pieces) == data
    assert all(media.LEAST <= len(p) <= media.MOST for p in pieces[:-1])
    shifted = media.chunks(b"some bytes before" + data)
    assert len(set(pieces) & set(shifted)) > 0.9 * len(pieces)
    assert media.cuts(b"") == [0]
    h, marks = 0, []
    for i, b in enumerate(data[:50_000]):
        h = ((h << 1) + int(media._GEAR[b])) & 0xFFFFFFFF
        if h & ((1 << media.BITS) - 1) == 0:
            marks.append(i + 1)
    assert set(media.cuts(data[:50_000])[:-1]) <= set(marks)


def test_wav_round_trip():
    assert media.samples(media.wav(b"\x00\xff\x80")) == b"\x00\xff\x80"
    with pytest.raises(ValueError, match="WAV"):
        media.samples(b"\0" * 60)


def vectors(seed, n, width=16):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, width)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("block_rows", [16_384, 70])
def test_search_is_exact(spark, block_rows):
    x = vectors(9, 400)
    x[10:20] = x[30]  # ties
    rows = [(i, [float(v) for v in x[i]]) for i in range(400)] + [(500, None), (550, [float("nan")] * 16), (600, [None] * 16), (650, [float("inf")] + [0.0] * 15), (None, [1.0] * 16), (700, []), (703, [0.5])]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, score string")
    found = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(table, F.col("vec_id") % 50 == 0, 5, block_rows).collect())
    good = {i: np.floor(256 * np.pad(np.array(v, np.float32).astype(float), (0, 16 - len(v)))) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)}
    want = []
    for q in (i for i in good if i % 50 == 0):
        best = sorted((-int(good[q] @ good[i]), i) for i in good if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert found == sorted(want)


def test_index_stops_early_only_on_proof():
    x = np.floor(256 * vectors(1, 3_000, 64))
    x[5] = x[7] + 1
    index = topk.Index(np.arange(3_000), x)
    for q in range(0, 3_000, 300):
        s = (x @ x[q]).astype(int)
        want = sorted(((-s[i], i) for i in range(3_000) if i != q))[:5]
        assert index.search(q, x[q], 5) == [(i, -v) for v, i in want]


def test_small_tables(spark):
    table = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert topk.search(table([]), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.search(table([(0, [1.0])]), F.col("vec_id") % 50 == 0).count() == 0
    assert [tuple(r) for r in topk.search(table([(0, [1.0]), (1, [0.5])]), F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, 256 * 128)]


def test_scores_beyond_floating_point_are_exact(spark):
    rows = [(0, [2e7, 1.0]), (1, [2e7, 0.0]), (2, [1e12, 3.0]), (3, [-1e300, 0.0]), (4, [0.0, 2.0**60 + 2**8]), (50, [1.5, 0.0]), (100, [3e9, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [int(np.floor(256 * x)) if abs(256 * x) < 2**53 else int(256 * x) for x in v] for i, v in rows}
    want = []
    for q in (0, 50, 100):
        best = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(whole[q], v, strict=True)))), i) for i, v in whole.items() if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(table, F.col("vec_id") % 50 == 0, 5, 3).collect()) == sorted(want)
