import pytest
from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("score", T.StringType()), T.StructField("key", T.StringType())])


@pytest.fixture(scope="session")
def docs(spark):
    """Rows (doc_id, text[, lang, source]) as documents with two more columns whose names the operators use themselves."""

    def make(rows):
        return spark.createDataFrame([tuple((*r, None, None, None, None)[:4]) + ("clash", "clash") for r in rows], DOC)

    return make


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and blank texts, a very long one, repeated rows and ids, signs, several scripts."""
    long = " ".join(f"word{i % 997} The Quick, brown fox" for i in range(20_000))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "x"), (5, long), (6, "same text here today"), (7, "same text here today"), (7, "same text here today"), (8, "\U0001f600 naïve  café's\r\n\r\n  12345 don't 'S "), (9, "日本語のテキスト。 混ぜる"), (None, "no id at all"), (10, "#" * 5000)]
