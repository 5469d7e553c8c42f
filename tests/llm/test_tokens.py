import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from vellum.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(PATH), special_tokens={})


def test_ids_and_bytes_equal_the_library(spark, docs, odd, encoding):
    found = byte_bpe.decode(byte_bpe.encode(docs(odd), PATH, public_tokenizers.PATTERN), PATH).collect()
    expected = sorted((str(i), np.array(encoding.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in odd)
    assert sorted((str(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in found) == expected


def test_blocks_share_their_words(spark, docs, encoding, monkeypatch):
    monkeypatch.setattr(byte_bpe, "BLOCK_BYTES", 2_000)
    rows = [(i, f"the common words of {i} and the number {i * i} " * 20) for i in range(60)]
    found = {r.doc_id: bytes(r.ids) for r in byte_bpe.encode(docs(rows).repartition(5), PATH, public_tokenizers.PATTERN, buckets=7).collect()}
    assert found == {i: np.array(encoding.encode_ordinary(t), "<u4").tobytes() for i, t in rows}


def test_empty_table(spark, docs):
    assert byte_bpe.encode(docs([]), PATH, public_tokenizers.PATTERN).count() == 0


def test_planes_round_trip():
    x = np.array([0, 1, 255, 256, 70_000, 2**32 - 1], np.uint32)
    assert (byte_bpe._from_planes(byte_bpe._planes(x)) == x).all()
    assert hashlib.sha256(byte_bpe._planes(x[:0])).hexdigest() == hashlib.sha256(b"").hexdigest()
