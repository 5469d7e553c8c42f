import hashlib
import random
import zlib

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm import merkle, queries

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("leaf", "key", "tree", "n", "at"))])


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (text if f == "text" else row[f] for f in FIELDS)))


def levels(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([h(*found[-1][i : i + 16]) for i in range(0, len(found[-1]), 16)])
    return found


def siblings(tree, i):
    for nodes in tree[:-1]:
        first = i // 16 * 16
        yield nodes[first:i], nodes[i + 1 : first + 16]
        i //= 16


def brute(rows):
    """doc_id, leaf, subroot, root, proof digest, folded root and whether that is the root, of each row."""
    by_source = {}
    for r in rows:
        by_source.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    found = []
    for k, s in enumerate(names):
        for i, (_, _, own, r) in enumerate(sorted(by_source[s], key=lambda x: x[:3])):
            path = [*siblings(trees[s], i), *siblings(top, k)]
            text = r["text"]
            if r["doc_id"] is not None and text is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = leaf(r, text)
            for left, right in path:
                folded = h(*left, folded, *right)
            found.append((r["doc_id"], own, trees[s][-1][0], top[-1][0], h(*(x for a, b in path for x in (*a, *b))), folded, folded == top[-1][0]))
    return found


def run(spark, tmp_path, rows):
    spark.createDataFrame([tuple(r.get(f.name) if f.name in FIELDS else "clash" for f in SCHEMA) for r in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in queries.op11_merkle_manifest(spark, str(tmp_path)).collect()), key=str)


def row(i, text, source, lang="en"):
    return {"doc_id": i, "text": text, "lang": lang, "source": source, "n_chars": len(text or "")}


def test_odd_rows(spark, tmp_path, odd):
    rows = [row(i, t, s) for i, t in odd for s in ("a", None)] + [row(1, "Only one", "Z"), row(None, None, "é", None), row(-5, "TEXT", "b"), row(5, "TEXT", "b"), row(5, "TEXT", "b"), row(5, "Other", "b")]
    assert run(spark, tmp_path, rows) == sorted(brute(rows), key=str)


@pytest.mark.parametrize("sizes", [(1,), (16,), (17,), (256, 257, 1, 2), (4_400, 3, 16), (2,) * 40])
def test_trees_of_all_depths(spark, tmp_path, sizes, monkeypatch):
    monkeypatch.setattr(merkle, "MEET", 16)  # ancestors under several salts
    draw = random.Random(len(sizes))
    rows = [row(draw.randrange(10**6), f"Text {draw.random()}", f"s{k}") for k, n in enumerate(sizes) for _ in range(n)]
    assert run(spark, tmp_path, rows) == sorted(brute(rows), key=str)


def test_no_rows(spark, docs):
    found = merkle.proofs(docs([]), fields=("doc_id", "text"))
    assert found.count() == 0
    assert found.columns == ["doc_id", "source", "leaf", "subroot", "root", "path"]


def test_a_path_folds_to_the_root(spark, docs):
    found = merkle.proofs(docs([(i, f"t{i}", None, f"s{i % 3}") for i in range(60)]), fields=("text",)).withColumn("folded", merkle.fold(F.col("leaf"), F.col("path")))
    rows = found.collect()
    assert {r.folded for r in rows} == {rows[0].root}
    assert {r.leaf for r in rows} == {h(f"{len(f't{i}')}:t{i}") for i in range(60)}
    assert all(len(r.path) == 3 for r in rows)


def test_query(spark):
    table = pd.read_parquet("/root/testdata/sf0.001/documents.parquet").astype(object)
    rows = table.where(table.notna(), None).to_dict("records")
    found = sorted((tuple(r) for r in queries.op11_merkle_manifest(spark, "/root/testdata/sf0.001").collect()), key=str)
    assert found == sorted(brute(rows), key=str)
    assert 0 < sum(not r[-1] for r in found) < len(found)


def test_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS FROM '/root/testdata/sf0.001/documents.parquet'")
    found = con.execute(queries.oracle_sql()["op11_merkle_manifest"]).fetchall()
    names = [c[0] for c in con.description]
    ours = queries.op11_merkle_manifest(spark, "/root/testdata/sf0.001").select(*names).collect()
    assert sorted(map(tuple, ours), key=str) == sorted(found, key=str)
