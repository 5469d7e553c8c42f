"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every letter piece of a fixed public vocabulary. A word's probability is the sum over
all its segmentations into pieces, found by a forward pass that is linear in the word's length; single characters outside
the vocabulary have a small floor, so each word has a segmentation. Sums are rescaled as they grow small, so that runs of
letters of any length are scored whole. Piece probabilities are estimated by expectation maximisation (forward and
backward passes) on the distinct words of a bounded sample of labelled documents per language. A text's score for a
language is the sum of its words' log probabilities; the prediction is the language of the highest posterior.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm import common

#: Labelled documents read for training, per language at most.
SAMPLE_ROWS = 1_000
#: A model holds one probability for each piece and language and is sent to every task; more languages than this are an error.
MAX_LANGUAGES = 1_000
FLOOR = 1e-8
#: Characters between rescalings of the sums.
STRIDE = 8
#: Words of equal length are summed together, this many characters at a time for up to eight languages, fewer for more.
BATCH_CHARS = 200_000
UNDETERMINED = "und"
_WORDS = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Lower-cased whole runs of letters, each begun by a word mark; runs of other signs that count as letters, such as fractions, are none."""
    return ["▁" + w for w in _WORDS.findall((text or "").lower()) if w.isalpha() or any(map(str.isalpha, w))]


def vocabulary(path: str) -> list[str]:
    """Pieces of letters and word marks of a sentencepiece model, lower-cased and distinct; a fixed list whatever the data."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()))
    return sorted({p for p in found if p and re.fullmatch("▁?[^\\W\\d_]*", p)})


def _codes(group: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(group), length).astype(np.uint64) + np.uint64(1)


class Lattice:
    """Finds the pieces of words of equal length and runs the forward and backward sums over all their segmentations."""

    def __init__(self, pieces: list[str]):
        hashes = np.zeros(len(pieces), np.uint64)
        by_length: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            by_length.setdefault(len(p), []).append(i)
        with np.errstate(over="ignore"):
            for n, at in by_length.items():
                c, h = _codes([pieces[i] for i in at], n), np.zeros(len(at), np.uint64)
                for j in range(n):
                    h = (h + c[:, j]) * _BASE
                hashes[at] = h
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.none = len(pieces)
        self.longest = max(by_length, default=1)

    def ids(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each piece length from 1 on, the piece that stands at each start of each word, or none; as (start, word)."""
        length = codes.shape[1]
        out, h = [], np.zeros((length, len(codes)), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(1, min(self.longest, length) + 1):
                h = (h[: length - k + 1] + codes.T[k - 1 :]) * _BASE
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1) if self.none else np.zeros(h.shape, int)
                out.append(np.where(self.hashes[at] == h, self.order[at], self.none) if self.none else at)
        return out

    def _sums(self, ids: list[np.ndarray], length: int, table: np.ndarray, backward: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(sum, log of its scale) over the segmentations of each beginning, or of each rest from the end, from none to the whole."""
        n = ids[0].shape[1]
        window, log = [np.ones((n, table.shape[1]))], np.zeros((n, table.shape[1]))
        yield window[0], log
        for e in range(1, length + 1):
            total = np.zeros_like(window[0])
            for k in range(1, min(len(ids), e) + 1):
                p = table[ids[k - 1][length - e if backward else e - k]]
                total += window[-k] * (np.maximum(p, FLOOR) if k == 1 else p)
            window = [*window[-(len(ids) - 1) :], total] if len(ids) > 1 else [total]
            if e % STRIDE == 0:
                # The newest sum is above the floor's power of the stride, so the window can be divided by it.
                log = log + np.log(total)
                window = [w / total for w in window]
            yield window[-1], log

    def log_likelihood(self, found: list[str], table: np.ndarray) -> np.ndarray:
        out = np.zeros((len(found), table.shape[1]))
        for length, part in _parts(found, table.shape[1]):
            *_, (total, log) = self._sums(self.ids(_codes([found[j] for j in part], length)), length, table)
            out[part] = np.log(total) + log
        return out

    def expected(self, found: list[str], weights: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Expected piece counts over all segmentations, for one language (table with one column)."""
        counts = np.zeros(self.none + 1)
        for length, part in _parts(found):
            ids = self.ids(_codes([found[j] for j in part], length))
            alpha, beta = ([np.log(x[:, 0]) + log[:, 0] for x, log in self._sums(ids, length, table, backward)] for backward in (False, True))
            for k, at in enumerate(ids, 1):
                for s in range(length - k + 1):
                    p = table[at[s], 0]
                    p = np.maximum(p, FLOOR) if k == 1 else p
                    share = np.exp(np.minimum(alpha[s] + beta[length - s - k] - alpha[length], 700)) * p
                    counts += np.bincount(at[s], weights[part] * share, minlength=self.none + 1) if p.any() else 0
        counts[self.none] = 0
        return counts


def _parts(found: list[str], languages: int = 1) -> Iterator[tuple[int, list[int]]]:
    """Length and places of words of equal length, in parts of a bounded number of characters times languages or of one word."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(found):
        groups.setdefault(len(w), []).append(i)
    for length, at in groups.items():
        step = max(1, BATCH_CHARS // (length * max(1, -(-languages // 8))))
        for i in range(0, len(at), step):
            yield length, at[i : i + step]


def fit(frame: pd.DataFrame, pieces: list[str], rounds: int = 3) -> np.ndarray:
    """Piece probabilities (one column for a language) from one language's sample."""
    counts: dict[str, int] = {}
    for t in frame.text:
        for w in words(t):
            counts[w] = counts.get(w, 0) + 1
    found, weights = list(counts), np.array(list(counts.values()), float)
    lattice = Lattice(pieces)
    table = np.full((len(pieces) + 1, 1), 1 / max(1, len(pieces)))
    table[-1] = 0
    for _ in range(rounds if found else 0):
        c = lattice.expected(found, weights, table)[:-1] + 0.01
        table[:-1, 0] = c / c.sum()
    return table[:, 0]


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 8) -> DataFrame:
    """lang and text of at most `rows` documents of each language: those with the smallest seeded hash of doc_id and text.

    The different hashes of a language are counted first, and only rows under its threshold, half as many again as are
    wanted, are ranked, rows of one hash once; so a language with most of the rows, or with one row most often, sends no
    more of them to a task than any other.
    """
    known = docs.where("text is not null and lang is not null").select("doc_id", "lang", "text", F.xxhash64(F.lit(seed), "doc_id", "text").alias("draw"))
    counted = known.groupBy("lang", "draw").agg(F.lit(1)).groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(counted) > MAX_LANGUAGES:
        raise ValueError(f"there are more than {MAX_LANGUAGES} languages, the most that a model may hold")
    shares = [(r.lang, min(1.0, 1.5 * (rows + 100) / r.n)) for r in counted]
    under = F.broadcast(docs.sparkSession.createDataFrame(shares, "lang string, share double"))
    drawn = known.join(under, "lang").where(F.shiftrightunsigned("draw", 11) < F.col("share") * float(1 << 53))
    ranked = drawn.dropDuplicates(["lang", "draw"]).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id", "text")))
    return ranked.where(F.col("rank") <= rows).select("lang", "text")


def train(docs: DataFrame, vocabulary_path: str, rows: int = SAMPLE_ROWS, seed: int = 8) -> dict:
    """Fit on docs (doc_id, text, lang): per language at most `rows` documents. The same rows give the same model.

    Rows whose text or lang is null take no part; texts without a letter teach nothing; rows that repeat both
    doc_id and text count once, rows without doc_id by their texts. An empty table gives a model without languages. Each language is fitted in
    a task of its own, on whole texts.
    """
    pieces = vocabulary(vocabulary_path)

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        table = fit(frame.sort_values("text"), pieces)
        return pd.DataFrame({"lang": [frame.lang.iloc[0]], "n": [len(frame)], "table": [table.astype(np.float32).tobytes()]})

    found = sorted(sample(docs, rows, seed).groupBy("lang").applyInPandas(one, "lang string, n long, table binary").collect(), key=lambda r: r.lang)
    table = np.stack([np.frombuffer(r.table, np.float32) for r in found], axis=1).astype(np.float64) if found else np.zeros((len(pieces) + 1, 0))
    return {"pieces": pieces, "langs": [r.lang for r in found], "table": table}


class _Ids(dict):
    def __missing__(self, w: str) -> int:
        self[w] = n = len(self)
        return n


class Identifier:
    """Language and posterior of texts; the words of a call are looked up once each."""

    def __init__(self, model: dict):
        self.langs, self.table, self.lattice = model["langs"], model["table"], Lattice(model["pieces"])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        ids, docs = _Ids(), []
        for t in texts:
            found = words(t)
            docs.append(np.fromiter(map(ids.__getitem__, found), np.int64, len(found)))
        known = self.lattice.log_likelihood(list(ids), self.table) if self.langs else None
        out = []
        for d in docs:
            if known is None or not len(d):
                out.append((UNDETERMINED, 0.0))
                continue
            total = known[d].sum(axis=0)
            best = int(total.argmax())
            out.append((self.langs[best], float(1 / np.exp(np.clip(total - total[best], -700, 0)).sum())))
        return out


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """docs (doc_id, text) -> doc_id, lang_pred, score; `und` with score 0 where the text is null or has no letter.

    One row for each row, repeated ones and those without doc_id too; an empty table gives none. Ties between languages go
    to the first by name. Very long texts and runs of letters are scored whole. Other columns, also a `lang_pred`, are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identifier = Identifier(shared.value)
        for batch in common.pieces(batches):
            found = identifier.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identified(docs: DataFrame, model: dict, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that have a language with a posterior of `least` or more; texts without a letter go.

    Null texts go with them. Repeated rows stay or go together, and columns of any name come through as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge():
        identifier = Identifier(shared.value)
        return lambda texts: [x != UNDETERMINED and p >= least for x, p in identifier.predict(texts)]

    return common.keep_rows(docs, judge)
