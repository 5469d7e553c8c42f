"""Quality by compression with labelled dictionaries.

Two zstandard dictionaries are built from the good and the bad texts of a bounded labelled sample. A text is cut into
parts of a fixed number of bytes (all of it, in order), each compressed with either dictionary and without one; the
difference of the two total sizes, divided by their sum, is the main feature, and the size without a dictionary for each
byte of text the second, as endless repetition leaves no difference. Lines that several sampled documents share take no
part in the dictionaries. Dictionaries come from one half of the sample and a logistic curve, fitted on the other half,
turns the features into the probability of a good text.
"""

from __future__ import annotations

import base64
import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import common
from vellum.llm.common import logistic

#: Labelled rows of either class that training reads at most, and bytes of their texts together.
SAMPLE_ROWS, SAMPLE_BYTES = 3_000, 64 << 20
PART_BYTES = 2_048
DICTIONARY_BYTES = 64 << 10
LEVEL = 3


def parts(text: str | None) -> list[bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return [data[i : i + PART_BYTES] for i in range(0, len(data), PART_BYTES)]


def shared_lines(texts: list[str]) -> set[str]:
    """Lines that stand in more than one of the texts."""
    n = Counter(x for t in texts for x in set(t.split("\n")))
    return {x for x, k in n.items() if k > 1}


def dictionary(texts: list[str], shared: set[str]) -> bytes:
    """A zstandard dictionary of the texts' parts; where there are too few to train on, their bytes themselves."""
    import zstandard

    samples = [p for t in texts for p in parts("\n".join(x for x in t.split("\n") if x not in shared)) if len(p) >= 8]
    size = max(1_024, min(DICTIONARY_BYTES, sum(map(len, samples)) // 8))
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes() if len(samples) >= 8 else b"".join(samples)[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Compressor:
    """Compressed sizes of texts under the good and the bad dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        self.both, self.plain = [], zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        for data in (good, bad):
            if len(data) >= 8:
                d = zstandard.ZstdCompressionDict(data)
                d.precompute_compress(level=LEVEL)
                self.both.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False))
            else:
                self.both.append(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False))

    def features(self, text: str | None) -> tuple[float, float]:
        """((bad - good) / (bad + good), plain size / bytes): the first is positive if the text is nearer to good ones; (0, 1) if it is empty."""
        cut = parts(text)
        if not cut:
            return 0.0, 1.0
        good, bad = (sum(len(c.compress(p)) for p in cut) for c in self.both)
        return (bad - good) / (bad + good), sum(len(self.plain.compress(p)) for p in cut) / sum(map(len, cut))


def design(x: np.ndarray) -> np.ndarray:
    """Columns of the logistic curve: one, the difference, and how far the plain ratio lies under that of running text."""
    return np.column_stack([np.ones(len(x)), np.clip(x[:, 0] * 20, -6, 6), np.clip(0.35 - x[:, 1], 0, None) * 20])


def fit(frame: pd.DataFrame) -> dict:
    """Model of a bounded pandas frame with text and quality (0 or 1); alternate rows of a class build and calibrate."""
    half = frame.groupby("quality").cumcount() % 2
    build, held = frame[half == 0], frame[half == 1]
    shared = shared_lines(build.text.tolist())
    good, bad = (dictionary(build.text[build.quality == y].tolist(), shared) for y in (1, 0))
    w = np.array([2.0, 1.0, 0.0])
    if held.quality.nunique() == 2:
        c = Compressor(good, bad)
        w = logistic(design(np.array([c.features(t) for t in held.text])), held.quality.to_numpy(float))
        # The sample is drawn evenly from the classes; the intercept brings back the share that the labels have.
        prior, drawn = float(frame.prior.iloc[0]), float(held.quality.mean())
        prior = min(max(prior, 1e-3), 1 - 1e-3)
        w[0] += np.log(prior / (1 - prior)) - np.log(drawn / (1 - drawn))
    return {"good": base64.b64encode(good).decode(), "bad": base64.b64encode(bad).decode(), "w": w.tolist()}


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 7) -> dict:
    """Fit on at most `rows` labelled documents of either class (doc_id, quality), chosen by a seeded hash.

    Null labels and texts take no part; a doc_id that is labelled twice counts by its smallest label; of one whose rows repeat
    in docs a single row counts. Texts are read whole, those that fit into SAMPLE_BYTES together; a longer one teaches nothing.
    The sample is sorted, so partitions do not change the model. Without labels, or with
    those of one class only, every text gets a score that rests on no comparison. Other columns are not read.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    prior = known.agg(F.avg("quality")).first()[0]
    keys = common.bounded_sample(known.where("quality = 0"), "doc_id", rows, seed).unionByName(common.bounded_sample(known.where("quality = 1"), "doc_id", rows, seed))
    sample = common.bounded_texts(docs, keys, SAMPLE_BYTES, seed)
    sample = sample.select("doc_id", "text", "quality", F.lit(prior).cast("double").alias("prior"))

    def fit_sorted(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"model": [json.dumps(fit(frame.sort_values(["doc_id", "text"], ignore_index=True)))]})

    found = common.train_once(sample, fit_sorted, "model string")
    return json.loads(found[0].model) if found else {"good": "", "bad": "", "w": [0.0, 0.0, 0.0]}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs (doc_id, text) -> doc_id, score (probability of a good text), difference. Null and empty texts have difference 0.

    One row for each row, repeated ones and those without doc_id too; an empty table gives none. Very long texts are
    compressed whole, part by part. Equal scores need no order. Other columns, also a `score`, are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        compressor = Compressor(base64.b64decode(m["good"]), base64.b64decode(m["bad"]))
        for batch in common.pieces(batches):
            x = np.array([compressor.features(t) for t in batch.column(1).to_pylist()])
            p = 1 / (1 + np.exp(-np.clip(design(x) @ m["w"], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array(x[:, 0], pa.float64())], ["doc_id", "score", "difference"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, difference double")
