"""Packing of token sequences by best-fit decreasing.

Documents become ids; what is longer than a window is cut into full windows first, each a sequence of its own. The rests are
dealt by hash to blocks of bounded size; in a block they go, the longest first, to the tightest open window that holds them,
found by a segment tree over remaining capacities. Only rests are shuffled, each once.

White space separates the words of the tokenizer, so that what stands between blanks can be encoded on its own: a worker
encodes each distinct chunk, and each word in it, once and looks it up from then on, all of a batch at a time in Arrow arrays.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm import common

WINDOW, END = 2048, 1
#: Rests in a block, on average; a block is held by one task, at most so many windows of ids.
BLOCK_RESTS = 4_096
#: A worker keeps about twice so many chunks, and as many words, encoded, for longer if they have no more characters than this.
KEPT, KEPT_CHARS = 400_000, 80
#: A task's pieces and sequences are numbered below so many bits.
BITS = 36
_FULL = 1 << 62


#: Chunks of letters that compose with nothing and have one lower case, digits and ASCII marks; others go to the tokenizer itself.
_SIMPLE = r"\A[\x21-\x7e\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}]+\z"
#: The pattern of _SPLIT, for such chunks in lower case.
_PARTS = r"('s|'t|'re|'ve|'m|'ll|'d|[a-z\x{80}-\x{10ffff}]+|[0-9]|[^a-z0-9\x{80}-\x{10ffff}]+)"
#: What a tokenizer must do before its merges for chunks to be encoded one by one.
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def _letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in shown else next(others)) for b in range(256)]


def _ranges(ends: np.ndarray, data: pa.Buffer) -> pa.Array:
    """Binary values that stand one after another in a buffer, the first from 0 on; ends has 0 before their ends."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), data])


def _bounds(values: pa.Array) -> np.ndarray:
    """Where the values of a binary array begin and end in its buffer."""
    return np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]


def _places(first: pa.Array) -> np.ndarray:
    """Where each of some values stands once those that are first are put before the others."""
    first = first.to_numpy(zero_copy_only=False).astype(bool)
    return np.where(first, np.cumsum(first), first.sum() + np.cumsum(~first)) - 1


def _strings(texts: pa.Array) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()


class _Ids:
    """Distinct texts and the ids of each, side by side in Arrow arrays: a tenth of what Python objects would take."""

    def __init__(self, keys: pa.Array | None = None, ids: pa.Array | None = None):
        self.keys = pa.array([], pa.string()) if keys is None else keys
        self.ids = pa.array([], pa.large_binary()) if ids is None else ids

    def __len__(self) -> int:
        return len(self.keys)

    def __iter__(self) -> Iterator[str]:
        return iter(_strings(self.keys))

    def add(self, keys: pa.Array, ids: pa.Array) -> None:
        if len(keys):
            self.keys, self.ids = pa.concat_arrays([self.keys, keys]), pa.concat_arrays([self.ids, ids])


class _Kept:
    """What has been encoded; when there is no more room, what was not asked for since the last time goes."""

    def __init__(self):
        self.now, self.before = _Ids(), _Ids()

    def missing(self, asked: list[str]) -> list[str]:
        """Those of some texts that would have to be encoded."""
        asked = pa.array(asked, pa.string())
        return _strings(asked.filter(pc.invert(pc.or_(pc.is_in(asked, self.now.keys), pc.is_in(asked, self.before.keys)))))

    def of(self, asked: pa.Array, encode: Callable[[pa.Array], pa.Array]) -> pa.Array:
        """The ids of each of some distinct texts; encode gives those of texts that aren't there."""
        if len(self.now) >= KEPT:
            short = pc.less_equal(pc.utf8_length(self.now.keys), KEPT_CHARS)
            self.before, self.now = _Ids(self.now.keys.filter(short), self.now.ids.filter(short)), _Ids()
        n, at = len(self.now), pc.index_in(asked, self.now.keys)
        absent = asked.filter(at.is_null())
        old = pc.index_in(absent, self.before.keys)
        new = absent.filter(old.is_null())
        self.now.add(absent.filter(old.is_valid()), self.before.ids.take(old.drop_null()))
        self.now.add(new, encode(new))
        return self.now.ids.take(pc.replace_with_mask(at, at.is_null(), pa.array(n + _places(old.is_valid()), pa.int32())))


class _Encoder:
    """Texts to ids, unsigned 32-bit little-endian, as tokenizers would encode each as a whole, without special tokens.

    Where the tokenizer splits at white space and at the ends of words, the distinct chunks of some texts, and the words in
    them, are encoded once and looked up from then on, as long as there is room; any other tokenizer encodes whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.merges = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = self.merges.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            read = json.load(f)
        normal, split = (read.get(k) or {} for k in ("normalizer", "pre_tokenizer"))
        suffix = read["model"].get("end_of_word_suffix")
        self.by_chunk = normal.get("normalizers") == _NORMAL and split.get("pretokenizers") == _SPLIT and bool(suffix)
        if self.by_chunk:
            # Words that are normal and split already need only the merges; each ends in a piece that says so.
            self.merges.normalizer, self.merges.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
            self.ends = np.zeros(self.merges.get_vocab_size(), bool)
            self.ends[[i for piece, i in self.merges.get_vocab().items() if piece.endswith(suffix)]] = True
        self.letters, self.chunks, self.words = _letters(), _Kept(), _Kept()

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = (self.tokenizer.encode_batch_fast(texts[at : at + 1_000], add_special_tokens=False) for at in range(0, len(texts), 1_000))
        return [np.array(e.ids, "<u4").tobytes() for part in found for e in part]

    def _merged(self, words: pa.Array) -> pa.Array:
        """Ids of words that are in lower case and parts of their own."""
        found = [np.zeros(0, "<u4")]
        for at in range(0, len(words), 500):
            shown = [w if w.isascii() else "".join([self.letters[b] for b in w.encode()]) for w in _strings(words[at : at + 500])]
            found.append(np.array(self.merges.encode_batch_fast([" ".join(shown)], add_special_tokens=False)[0].ids, "<u4"))
        ids = np.concatenate(found)
        ends = np.r_[0, (np.flatnonzero(self.ends[ids]) + 1) * 4]
        if len(ends) != len(words) + 1:
            raise ValueError("the tokenizer's words don't end where they should")
        return _ranges(ends, pa.py_buffer(ids))

    def _parted(self, chunks: pa.Array) -> pa.Array:
        """Ids of simple chunks: those of their words, one after another."""
        parts = pc.split_pattern(pc.ascii_rtrim(pc.replace_substring_regex(pc.utf8_lower(chunks), _PARTS, r"\1 "), " "), " ")
        coded = parts.flatten().dictionary_encode()
        ids = self.words.of(coded.dictionary, self._merged).take(coded.indices)
        return _ranges(_bounds(ids)[parts.offsets.to_numpy()], ids.buffers()[2])

    def _chunks(self, chunks: pa.Array) -> pa.Array:
        simple = pc.match_substring_regex(chunks, _SIMPLE)
        plain, odd = chunks.filter(simple), chunks.filter(pc.invert(simple))
        return pa.concat_arrays([self._parted(plain), pa.array(self._whole(_strings(odd)), pa.large_binary())]).take(pa.array(_places(simple)))

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_chunk:
            return self._whole([t or "" for t in texts])
        # Only blanks that every tokenizer of words takes for white space cut here; others stay inside chunks.
        plain = pa.array([t or "" for t in texts], pa.string())
        for blank in "\n\t\r":
            plain = pc.replace_substring(plain, blank, " ")
        rows = pc.split_pattern(plain, " ")
        coded = rows.flatten().dictionary_encode()
        # Taken by their numbers, the chunks' ids stand one after another in a single buffer, of which each text has a range.
        ids = self.chunks.of(coded.dictionary, self._chunks).take(coded.indices)
        bounds, data = _bounds(ids)[rows.offsets.to_numpy()].tolist(), memoryview(ids.buffers()[2] or b"")
        return [data[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


@functools.cache
def _encoder(path: str) -> _Encoder:
    """One for each worker, which its tasks share."""
    return _Encoder(path)


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together, as long as they have no more bytes: what is looked up in is hashed once for each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and sum(b.nbytes for b in held) + batch.nbytes > most:
            yield pa.concat_batches(held)
            held = []
        held.append(batch)
    if held:
        yield pa.concat_batches(held)


def _cut(docs: DataFrame, path: str, window: int, end: int) -> DataFrame:
    """docs (doc_id, text) -> its pieces: doc_id, start, length, doc_tokens, ids, piece (a number) and, for full windows, sequence_id."""
    schema = docs.select("doc_id").withColumns({c: F.lit(None).cast(t) for c, t in (("start", "long"), ("length", "long"), ("doc_tokens", "long"), ("ids", "binary"), ("piece", "long"), ("sequence_id", "long"))}).schema
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        encode, base, n = _encoder(path), TaskContext.get().partitionId() << BITS, 0
        last = np.array([end], "<u4").tobytes()
        for batch in _gathered(common.pieces(batches, "text", 8 << 20), 16 << 20):
            of, columns = [], [[] for _ in kinds]
            for i, found in enumerate(encode(batch.column(batch.schema.get_field_index("text")).to_pylist())):
                found += last
                total = len(found) // 4
                for start in range(0, total, window):
                    length = min(window, total - start)
                    of.append(i)
                    for column, value in zip(columns, (start, length, total, found[4 * start : 4 * (start + length)], base | n, (_FULL | base | n) if length == window else None), strict=True):
                        column.append(value)
                    n += 1
            if of:
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")).take(pa.array(of)), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Window and offset of each length, below the window; the longest is placed first, ties in order.

    A binary tree over the capacities 0 to window counts the open windows of each range of capacities: from the leaf of a
    length, the first subtree to the right that has any holds the tightest window.
    """
    leaves = 1 << window.bit_length()
    tree, open_by = [0] * (2 * leaves), [[] for _ in range(leaves)]
    places, offsets, used = [0] * len(lengths), [0] * len(lengths), 0

    def add(capacity: int, by: int) -> None:
        at = capacity + leaves
        while at:
            tree[at] += by
            at >>= 1

    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        length = lengths[i]
        at = length + leaves
        if not tree[at]:
            while at > 1 and (at & 1 or not tree[at + 1]):
                at >>= 1
            if at > 1:
                at += 1
                while at < leaves:
                    at = 2 * at if tree[2 * at] else 2 * at + 1
        if at > 1:
            capacity = at - leaves
            place = open_by[capacity].pop()
            add(capacity, -1)
        else:
            capacity, place = window, used
            used += 1
        places[i], offsets[i] = place, window - capacity
        if capacity > length:
            open_by[capacity - length].append(place)
            add(capacity - length, 1)
    return places, offsets


def pack(docs: DataFrame, path: str, window: int = WINDOW, end: int = END, block_rests: int = BLOCK_RESTS) -> DataFrame:
    """docs (doc_id, text) -> pieces of documents: doc_id, start, length, doc_tokens, ids, sequence_id, offset.

    A document is the ids of its whole text and the id `end`, cut into full windows and a rest; pieces hold ids as unsigned
    32-bit little-endian integers, each id in exactly one. A sequence holds at most `window` ids, its pieces one after
    another from offset 0. Null and empty texts are the id `end` alone. Very long texts are many full windows. Repeated rows,
    and rows without doc_id, are documents one by one; rests of equal length go by the order of their rows. The same files
    and partitions give the same numbers; an empty table gives no rows. Other columns aren't read, whatever their names.
    """
    cut = common.durable(_cut(docs, path, window, end), "packing-pieces")
    full = cut.where(F.col("sequence_id").isNotNull()).withColumn("offset", F.lit(0).cast("long")).drop("piece")
    rests = cut.where(F.col("sequence_id").isNull())
    blocks = max(1, -(-rests.count() // block_rests))
    names, schema = full.columns, full.schema

    def place(key: tuple, block: pa.Table) -> pa.Table:
        block = block.sort_by("piece")
        places, offsets = best_fit(block.column("length").to_pylist(), window)
        ids = pa.array((key[0].as_py() << 32) + np.array(places, np.int64))
        found = block.drop_columns(["block", "piece", "sequence_id"]).append_column("sequence_id", ids).append_column("offset", pa.array(offsets, pa.int64()))
        return found.select(names)

    dealt = rests.withColumn("block", F.pmod(F.xxhash64("piece"), F.lit(blocks).cast("long")))
    return full.unionByName(dealt.groupBy("block").applyInArrow(place, schema))


def padded(used: Column, window: int = WINDOW) -> Column:
    """The length of a sequence with its padding: the window, but a power of two is left as it is."""
    return F.when(F.bit_count(used) == 1, used).otherwise(F.lit(window)).cast("long")


def sequences(pieces: DataFrame, window: int = WINDOW, pad: int = 0) -> DataFrame:
    """Pieces -> sequence_id, used, ids: the ids of each sequence, padded, as unsigned 32-bit little-endian integers. No pieces, no rows."""
    whole = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").cast("long").alias("used"))
    ids = F.aggregate(F.col("p.ids"), F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b))
    filler = F.unhex(F.repeat(F.lit(np.array([pad], "<u4").tobytes().hex()), (padded(F.col("used"), window) - F.col("used")).cast("int")))
    return whole.select("sequence_id", "used", F.concat(ids, filler).alias("ids"))
