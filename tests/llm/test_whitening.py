import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import types as T

from vellum.llm import queries, whitening

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("x", T.StringType()), T.StructField("deviation", T.StringType())])


def matrix(kind, d):
    draw = np.random.default_rng(d)
    b = draw.standard_normal((d, d))
    q, _ = np.linalg.qr(b)
    a = {
        "plain": b @ b.T,
        "equal": np.eye(d) * 3.0,
        "threefold": (q * np.r_[[5.0] * min(d, 3), np.ones(max(0, d - 3))]) @ q.T,
        "close": (q * np.r_[[1e6, 1e6 - 1e-3, 1.0][:d], np.full(max(0, d - 3), 1e-3)]) @ q.T,
        "of rank one": b[:, :1] @ b[:, :1].T,
    }[kind]
    return (a + a.T) / 2


@pytest.mark.parametrize("kind", ["plain", "equal", "threefold", "close", "of rank one"])
@pytest.mark.parametrize("d", [1, 2, 3, 10, 64])
def test_leading_eigenvalues(kind, d):
    a = matrix(kind, d)
    values, vectors = whitening.leading(a, 4)
    known = np.linalg.eigvalsh(a)[::-1]
    assert len(values) == min(4, d, 1 if kind == "of rank one" else d)
    assert np.allclose(values, known[: len(values)], rtol=1e-13, atol=1e-14 * known[0])
    assert np.abs(a @ vectors - vectors * values).max() < 1e-14 * known[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-14


@pytest.mark.parametrize("d", [1, 2, 5, 30])
def test_inertia_counts(d):
    draw = np.random.default_rng(d)
    for _ in range(20):
        a = draw.integers(-3, 4, (d, d)).astype(float)
        a += a.T
        shift = float(draw.uniform(-10, 10))
        assert whitening.count_above(a, shift) == (np.linalg.eigvalsh(a) > shift).sum()
    # A matrix whose diagonal gives no pivots at all.
    assert whitening.count_above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1
    assert whitening.count_above(np.zeros((3, 3)), 0.0) == 0


def plain(rows):
    """n, exact deviations, components, eigenvalues and trace by numpy, of rows that take part."""
    x = np.array([[math.floor(256 * c) for c in v] for v in rows], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    v = centred.T @ centred / n
    e, w = np.linalg.eigh(v)
    off = (n * x.astype(object) - sums) ** 2
    return n, off.sum(axis=1), (x - sums / n) @ w[:, ::-1][:, :4] / np.sqrt(e[::-1][:4]), e[::-1][:4] / np.trace(v)


def same(found, ids, rows):
    n, deviations, whitened, explained = plain(rows)
    by_id = {i: (d, w) for i, d, w in zip(ids, deviations, whitened, strict=True)}
    assert sorted((r.vec_id, r.component) for r in found) == sorted((i, k + 1) for i in ids for k in range(4))
    signs = {}
    for r in found:
        d, w = by_id[r.vec_id]
        assert (r.n, r.deviation) == (n, d)
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9
        assert 0 <= r.identity_error < 1e-9
        own = w[r.component - 1]
        assert abs(abs(r.whitened) - abs(own)) < 1e-9
        if abs(own) > 1e-6:
            signs.setdefault(r.component, set()).add(r.whitened * own > 0)
    assert all(len(s) == 1 for s in signs.values())


def write(spark, tmp_path, rows):
    spark.createDataFrame([(i, v, "clash", "clash") for i, v in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return queries.op12_whitening(spark, str(tmp_path)).collect()


def test_odd_rows(spark, tmp_path):
    draw = np.random.default_rng(3)
    good = [(i, [float(np.float32(c)) for c in draw.normal(7.0, [1, 2, 3, 4, 5, 6])]) for i in range(50)]
    good += [(100 + i, good[i % 3][1]) for i in range(60)] + [(9, good[9][1]), (9, good[9][1]), (500, [-0.0, 0.0, -1e-9, 1e4, -1e4, 3.0])]
    bad = [(900, None), (901, [1.0, None, 3.0, 4.0, 5.0, 6.0]), (902, [float("nan")] * 6), (903, [1.0] * 5 + [float("inf")]), (904, []), (905, [1.0, 2.0])]
    found = write(spark, tmp_path, good + bad)
    once = dict(good)
    same([r for r in {(r.vec_id, r.component): r for r in found}.values()], list(once), list(once.values()))
    assert sum(r.vec_id == 9 for r in found) == 3 * 4


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_without_variance(spark, tmp_path, rows):
    assert write(spark, tmp_path, rows) == []


def test_large_entries_are_exact(spark):
    rows = [(1, [3e15, 0.0]), (2, [-1e15, 1.0]), (3, [7.0, 2e15])]
    vectors = spark.createDataFrame([(i, v, "a", "b") for i, v in rows], SCHEMA)
    model = whitening.fit(vectors)
    x = [[math.floor(256 * float(np.float32(c))) for c in v] for _, v in rows]
    assert model.sums == tuple(map(sum, zip(*x, strict=True)))
    assert len(model.values) == 2
    assert all(r.deviation is None for r in whitening.whiten(vectors, model).collect())


def test_query(spark):
    table = pd.read_parquet("/root/testdata/sf0.001/embeddings.parquet")
    same(queries.op12_whitening(spark, "/root/testdata/sf0.001").collect(), table.vec_id.tolist(), [v.astype(float) for v in table.embedding])
