"""Toxic passages by maximum-scoring segment search.

Tokens are lower-cased runs between white space and ASCII punctuation. From a bounded sample of labelled rows each
token, and each word beginning of 4 to 6 characters, gets the log-odds of toxic against clean documents, smoothed by a
Dirichlet prior that is proportional to the pooled counts. Only tokens whose concentration in toxic documents can't be
chance (a Chernoff bound, corrected for the number of tokens that could pass) keep their score; every other token gets the common,
slightly negative log-odds of a token outside that list. The linear-time scan for all maximal scoring segments then
finds the passages of a whole text; a passage counts if its expected number in clean text of that length, K n exp(-lambda S),
is small. K and lambda are fitted to the best scores of clean texts. Those expectations, summed over the significant
passages, make the document's evidence, which a logistic curve turns into a probability. K, lambda and the curve rest on
texts that the list of tokens has not seen: each tenth of the sample is scored by the list of the others, copies of a text
falling into one tenth; the list that is used then comes from all of it.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import common

#: Labelled rows that training reads at most, and bytes of their texts together.
SAMPLE_ROWS, SAMPLE_BYTES = 12_000, 64 << 20
PRIOR_WEIGHT = 50.0
SIGNIFICANT = 0.05
#: A token's rate in toxic documents is over this multiple of its rate in clean ones.
MARGIN = 2.0
#: Best scores of clean texts from TAIL on show how fast chance scores fall off; TAIL_WEIGHT is how many texts the theory counts for.
TAIL, TAIL_WEIGHT = 1.0, 10
PREFIXES = (6, 5, 4)
#: Parts of the training texts, each scored by the list of tokens of the others.
FOLDS = 10
_TO_SPACE = bytes(i if i >= 128 or chr(i).isalnum() else 32 for i in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words as UTF-8; ASCII characters other than letters and digits separate them."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_TO_SPACE).split()


def prefixes(word: bytes) -> list[bytes]:
    chars = word.decode("utf-8", "surrogatepass")
    return [chars[:k].encode("utf-8", "surrogatepass") + b"*" for k in PREFIXES if len(chars) > k]


def _sketch(words: list[bytes]) -> int:
    """Smallest hash of three successive words: copies of a document mostly share it, so they count once."""
    import xxhash

    return min((xxhash.xxh3_64_intdigest(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))), default=0)


def segments(scores: dict[int, float], length: int, gap: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence whose tokens score `gap` < 0 except at the positions given.

    Works from left to right in time linear in the given positions: each candidate keeps the total score before and up to its end.
    """
    found: list[tuple[int, int, float, float, int]] = []  # start, end, total before, total up to the end, last with a smaller total before
    total, last = 0.0, 0
    for at in sorted(scores):
        total += gap * (at - last)
        start, left = at, total
        total += scores[at]
        last = at + 1
        if scores[at] <= 0:
            continue
        right = total
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= right:
                found.append((start, last, left, right, j))
                break
            start, left = found[j][0], found[j][2]
            del found[j:]
    return [(s, e, r - x) for s, e, x, r, _ in found]


def significant(found: list[tuple[int, int, float]], length: int, k: float, lam: float) -> list[tuple[int, int, float, float]]:
    """The segments that chance would give a clean text of that length rarely, with the number expected of each."""
    scored = ((s, e, x, k * length * math.exp(-lam * x)) for s, e, x in found)
    return [p for p in scored if p[3] <= SIGNIFICANT]


class _WordScores(dict):
    """Word -> its log-odds, or 0 if it has none of its own; words met are remembered up to a bound."""

    def __init__(self, lexicon: dict[bytes, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: bytes) -> float:
        score = self.lexicon.get(word)
        if score is None:
            score = next((self.lexicon[p] for p in prefixes(word) if p in self.lexicon), 0.0)
        if len(self) >= 100_000:
            self.clear()
        self[word] = score
        return score


class Scorer:
    """Passages, evidence and probability of a text under a trained model."""

    def __init__(self, model: dict):
        self.gap, self.k, self.lam, self.a, self.b = (model[x] for x in ("gap", "k", "lam", "a", "b"))
        self.words = _WordScores({k.encode("utf-8", "surrogatepass"): v for k, v in model["lexicon"].items()})

    def passages(self, text: str | None) -> list[tuple[int, int, float, float]]:
        """(first token, end, score, expected number by chance) of every significant passage."""
        words = tokens(text)
        values = np.fromiter(map(self.words.__getitem__, words), np.float64, len(words))
        hits = np.flatnonzero(values)
        if not len(hits):
            return []
        return significant(segments(dict(zip(hits.tolist(), values[hits].tolist(), strict=True)), len(words), self.gap), len(words), self.k, self.lam)

    @staticmethod
    def evidence(passages: list[tuple[int, int, float, float]]) -> float:
        return sum(-math.log(max(e, 1e-300)) for *_, e in passages)

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.a + self.b * math.log1p(evidence)))))


def _needed(found: list[int], share: float) -> float:
    """Log of the odds that a token's concentration must beat, so that about one token in all passes by chance.

    Tokens in too few documents could not pass however they fall, so they don't count as tries.
    """
    by_count = Counter(found)
    left, least = len(found), 0.0
    for y in range(1, max(by_count, default=0) + 1):
        least = math.log(max(2, left))
        if y * -math.log(min(max(share, 1e-6), 0.99)) > least:
            break
        left -= by_count[y]
    return least


def extreme_values(best: list[tuple[float, int]]) -> tuple[float, float]:
    """K and lambda of P(best score >= x) = 1 - exp(-K n exp(-lambda x)) from (best score, tokens n) of clean texts.

    Above TAIL best scores fall off exponentially, so lambda is the inverse of their mean excess; it is drawn to 1, its
    value for log-odds of the true rates, by as much as TAIL_WEIGHT texts would. K makes the expected number above TAIL the one seen.
    """
    tail = [s - TAIL for s, _ in best if s >= TAIL]
    lam = (len(tail) + TAIL_WEIGHT) / (sum(tail) + TAIL_WEIGHT)
    return max(1e-9, min(1.0, (len(tail) + 0.5) * math.exp(lam * TAIL) / max(1, sum(n for _, n in best)))), lam


def weigh(counts: dict[int, Counter]) -> dict[bytes, float]:
    """The tokens that have a score of their own, from the number of toxic (1) and clean (0) texts that hold each."""
    n = {y: sum(c.values()) for y, c in counts.items()}
    share = n[1] / max(1, n[0] + n[1])
    need = _needed([counts[0][w] + n1 for w, n1 in counts[1].items()], share)
    lexicon: dict[bytes, float] = {}
    if 0 < share < 1:
        for w, y1 in counts[1].items():
            y = y1 + counts[0][w]
            p = y1 / y
            # How much more often toxic documents hold the token than clean ones, whatever the share of either class.
            if p * (1 - share) <= MARGIN * (1 - p) * share:
                continue
            if y * (p * math.log(p / share) + ((1 - p) * math.log((1 - p) / (1 - share)) if p < 1 else 0)) > need:
                prior = PRIOR_WEIGHT * y / (n[0] + n[1])
                odds = [math.log((counts[c][w] + prior) / (n[c] + PRIOR_WEIGHT - counts[c][w] - prior)) for c in (1, 0)]
                lexicon[w] = min(odds[0] - odds[1], 12.0)
    return lexicon


def _gap(docs: list[tuple[list[bytes], int, int]], lexicon: dict[bytes, float]) -> float:
    """The log-odds of a token outside the list."""
    scores, rate = _WordScores(lexicon), {}
    for c in (0, 1):
        hits = [(sum(1 for w in words if scores[w] > 0), len(words)) for words, y, _ in docs if y == c]
        rate[c] = (sum(h for h, _ in hits) + 0.5) / (sum(k for _, k in hits) + 1000)
    return min(-1e-4, math.log((1 - min(rate[1], 0.9)) / (1 - min(rate[0], 0.8))))


def fit(frame: pd.DataFrame) -> dict:
    """Model of a bounded pandas frame with text and toxic (0 or 1). Rows in the same order give the same model."""
    docs = [(words, int(y), _sketch(words)) for words, y in ((tokens(t), y) for t, y in zip(frame.text, frame.toxic, strict=True))]
    parts = [{0: Counter(), 1: Counter()} for _ in range(FOLDS)]
    seen = set()
    for words, y, key in docs:
        if (key, y) not in seen:
            seen.add((key, y))
            own = set(words)
            parts[key % FOLDS][y].update(own.union(*map(prefixes, own)) if own else own)
    whole: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for part in parts:
        for y in whole:
            whole[y].update(part[y])
    lexicon = weigh(whole)
    gap = _gap(docs, lexicon)
    # Segments of each text by a list of tokens that it has no part in.
    scores = [_WordScores(weigh({y: whole[y] - part[y] for y in whole})) for part in parts]
    found: list[list[tuple[int, int, float]]] = []
    for words, _, key in docs:
        own = scores[key % FOLDS]
        found.append(segments({i: s for i, w in enumerate(words) if (s := own[w])}, len(words), gap))
    k, lam = extreme_values([(max((x for *_, x in f), default=0.0), max(1, len(words))) for f, (words, y, _) in zip(found, docs, strict=True) if y == 0])
    evidence = [Scorer.evidence(significant(f, len(words), k, lam)) for f, (words, *_) in zip(found, docs, strict=True)]
    a, b = common.logistic(np.column_stack([np.ones(len(docs)), np.log1p(evidence)]), frame.toxic.to_numpy(float))
    return {"lexicon": {w.decode("utf-8", "surrogatepass"): v for w, v in lexicon.items()}, "gap": gap, "k": k, "lam": lam, "a": float(a), "b": float(b)}


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 10) -> dict:
    """Fit on at most `rows` rows of labels (doc_id, toxic), chosen by a seeded hash; null labels and texts take no part.

    A doc_id that is labelled twice counts by its largest label; of one whose rows repeat in docs a single row counts.
    Texts are read whole, those that fit into SAMPLE_BYTES together; a longer one teaches nothing. The sample is sorted before it is used, so partitions do not change the model. Without labels, or with those of one
    class only, every text gets the same score. Other columns of either table are not read.
    """
    keys = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    keys = common.bounded_sample(keys, "doc_id", rows, seed)
    sample = common.bounded_texts(docs, keys, SAMPLE_BYTES, seed)

    def fit_sorted(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"model": [json.dumps(fit(frame.sort_values(["doc_id", "text"], ignore_index=True)))]})

    found = common.train_once(sample.select("doc_id", "text", "toxic"), fit_sorted, "model string")
    return json.loads(found[0].model) if found else {"lexicon": {}, "gap": -0.01, "k": 1.0, "lam": 1.0, "a": -4.0, "b": 0.0}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs (doc_id, text) -> doc_id, score, evidence, n_passages, passages (first token, end, score).

    Null and empty texts have no passage and get the score of a text without evidence. One row for each row, repeated ones
    and those without doc_id too; an empty table gives none. Very long texts are scanned whole. Equal scores need no order,
    as nothing is ranked. Other columns, also a `score`, are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, score double, evidence double, n_passages int, passages array<struct<first:int,end:int,score:double>>"
    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in common.pieces(batches):
            found = [scorer.passages(t) for t in batch.column(1).to_pylist()]
            evidence = [scorer.evidence(x) for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([scorer.probability(e) for e in evidence], pa.float64()),
                    pa.array(evidence, pa.float64()),
                    pa.array([len(x) for x in found], pa.int32()),
                    pa.array([[{"first": s, "end": e, "score": x} for s, e, x, _ in p] for p in found], kind),
                ],
                ["doc_id", "score", "evidence", "n_passages", "passages"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def clean(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose score lies under the threshold; null and empty texts stay.

    Repeated rows stay or go together, and columns of any name come through as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge():
        scorer = Scorer(shared.value)
        return lambda texts: [scorer.probability(scorer.evidence(scorer.passages(t))) < threshold for t in texts]

    return common.keep_rows(docs, judge)
