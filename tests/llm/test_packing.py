import random
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vellum.llm import packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def check(found, rows, tokenizer, window=2048):
    """Every id of every row in one piece, sequences without gaps and within the window; the padding."""
    want = sorted(((i, ids_of(tokenizer, t)) for i, t in rows), key=str)
    pieces = sorted(found, key=lambda r: (str(r.doc_id), r.start))
    whole = {}
    for r in pieces:
        assert 0 < r.length <= window
        whole.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for i, ids in want:
        own = whole[i, len(ids)]
        for start in range(0, len(ids), window):
            part = np.array(ids[start : start + window], "<u4").tobytes()
            assert any((r.start, r.length, r.ids_crc32) == (start, len(part) // 4, zlib.crc32(part)) for r in own)
    assert sum(r.length for r in pieces) == sum(len(ids) for _, ids in want)
    ends = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= window
    return sum(window - n for n in ends.values() if n & (n - 1))


def test_odd_rows(spark, docs, odd, tokenizer):
    mixed = ["É é ́ x", "a b c\x1cd", "ΑΣ ΑΣΑ", "it's  don't\r\n\tx", "<|endof text|> <|x", "İstanbul ǅ", "x" * 3000, "ﬁ ½ ² 12345", "한국어 각"]
    rows = odd + [(100 + i, t) for i, t in enumerate(mixed)]
    found = packing.pack(docs(rows), PATH).withColumn("ids_crc32", F.crc32("ids")).collect()
    check(found, rows, tokenizer)
    assert packing.pack(docs([]), PATH).count() == 0
    again = packing.pack(docs(rows), PATH).withColumn("ids_crc32", F.crc32("ids")).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


def test_special_strings_are_text(tokenizer):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    text = "a <|endoftext|> b<|startoftext|>"
    assert np.frombuffer(packing._Encoder(PATH)([text])[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_chunks_are_encoded_as_in_whole_texts(tokenizer):
    draw = random.Random(2)
    letters = "abAB'’sd .,;\n\t\r\x0b\x85 ́̈é한가ß9٣#"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randrange(60))) for _ in range(3_000)]
    encode = packing._Encoder(PATH)
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_simple_chunks_are_encoded_as_in_whole_texts(tokenizer):
    draw = random.Random(3)
    letters = [chr(c) for c in [*range(0x20, 0x7F), *range(0xC0, 0x250)] if c not in (0xD7, 0xF7)] + ["'S", "'LL ", "\u0301", "ᾳ", "\u212b"]
    texts = ["".join(draw.choice(letters) for _ in range(draw.randrange(80))) for _ in range(4_000)]
    encode = packing._Encoder(PATH)
    assert encode.by_chunk
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_room_for_few_chunks(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "KEPT", 3)
    encode = packing._Encoder(PATH)
    texts = [f"one two three four {i} " + "long" * 40 for i in range(20)]
    for _ in range(2):
        for t in texts:
            assert np.frombuffer(encode([t])[0], "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    for kept in (encode.chunks, encode.words):
        assert not any(len(c) > packing.KEPT_CHARS for c in kept.before)
        assert max(len(kept.now), len(kept.before)) <= 3 + 7


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encode, texts = packing._Encoder(path), ["Two words", "", "  a\n b", "é" * 9]
    assert not encode.by_chunk
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def brute_fit(lengths, window):
    places, free = [0] * len(lengths), []
    offsets = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        fits = [c for c in free if c >= lengths[i]]
        if fits:
            at = len(free) - 1 - free[::-1].index(min(fits))
        else:
            free.append(window)
            at = len(free) - 1
        places[i], offsets[i] = at, window - free[at]
        free[at] -= lengths[i]
    return places, offsets, sorted(free)


@pytest.mark.parametrize(("window", "seed"), [(2048, 0), (10, 1), (1, 2), (64, 3), (100, 4)])
def test_best_fit_is_the_tightest(window, seed):
    draw = random.Random(seed)
    lengths = [draw.randint(1, max(1, window - 1)) for _ in range(400)]
    places, offsets = packing.best_fit(lengths, window)
    used = {}
    for i, (p, o) in sorted(enumerate(zip(places, offsets, strict=True)), key=lambda x: x[1]):
        assert o == used.get(p, 0)
        used[p] = o + lengths[i]
    assert max(used.values()) <= window
    assert sorted(window - u for u in used.values()) == brute_fit(lengths, window)[2]
    assert packing.best_fit([], window) == ([], [])


def test_blocks_and_sequences(spark, docs, tokenizer):
    draw = random.Random(7)
    rows = [(i, " ".join(draw.choice(["one", "two", "three"]) for _ in range(draw.randrange(0, 90)))) for i in range(600)]
    pieces = packing.pack(docs(rows), PATH, window=64, block_rests=50)
    check(pieces.withColumn("ids_crc32", F.crc32("ids")).collect(), rows, tokenizer, 64)
    own = {(r.sequence_id): r for r in packing.sequences(pieces, window=64).collect()}
    for r in own.values():
        n = len(r.ids) // 4
        assert n == (r.used if r.used & (r.used - 1) == 0 else 64)
        assert not any(r.ids[4 * r.used :])
    for r in pieces.collect():
        assert own[r.sequence_id].ids[4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)
    assert packing.sequences(packing.pack(docs([]), PATH)).count() == 0


def test_query(spark, tokenizer):
    table = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(int(i), t) for i, t in table[["doc_id", "text"]].itertuples(index=False)]
    found = queries.op13_packing(spark, "/root/testdata/sf0.001").collect()
    padding = check(found, rows, tokenizer)
    assert padding < 0.02 * sum(r.length for r in found)


def test_texts_get_the_ids_of_their_own_chunks(tokenizer, monkeypatch):
    """Ids come from one buffer for all texts of a call, also while what was kept is thrown out."""
    monkeypatch.setattr(packing, "KEPT", 3)
    encode = packing._Encoder(PATH)
    texts = [None, "", " ", "\n\t\r", "a  b\na", "Été’s  x", "\xa0b \x00", "word-9 " * 50, "a b"]
    for _ in range(3):
        assert encode(texts) == [np.array(ids_of(tokenizer, t)[:-1], "<u4").tobytes() for t in texts]
        assert encode([]) == []
    assert encode.chunks.missing(["a", "neu", "b"]) == ["neu"]


def test_what_is_kept_is_no_python_object(tokenizer):
    """20,000 words took a string, a value and two entries each, and as many look-ups one by one in every batch."""
    draw = random.Random(5)
    texts = [" ".join("".join(draw.choice("abcdefgé'1,") for _ in range(9)) for _ in range(200)) for _ in range(100)]
    encode = packing._Encoder(PATH)
    encode(["a"])
    tracemalloc.start()
    found = encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    del found
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(encode.chunks.now) > 19_000 and kept < 1_000_000
    assert sorted(encode.chunks.now) == sorted({"a", *(w for t in texts for w in t.split(" "))})


def test_small_batches_are_encoded_together():
    batches = [pa.RecordBatch.from_pydict({"doc_id": range(i, i + 10), "text": ["x" * 100] * 9 + [None]}) for i in range(0, 200, 10)]
    size = batches[0].nbytes
    found = list(packing._gathered(iter(batches), 5 * size))
    assert [b.num_rows for b in found] == [50] * 4 and pa.Table.from_batches(found) == pa.Table.from_batches(batches)
    assert [b.num_rows for b in packing._gathered(iter(batches), 0)] == [10] * 20
    assert list(packing._gathered(iter([]), 1)) == []
