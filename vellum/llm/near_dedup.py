"""Near-duplicate groups by min-max hashing.

A document's set holds the 64-bit hashes of its word shingles. Under each of a number of permutations both the smallest
and the largest value are kept, so that half the hash evaluations give a signature of the same length; either value
agrees between two sets with probability equal to their Jaccard similarity. Bands take five values of different
permutations. Documents with equal sets form a class, of which only one row, its node, is compared. Exact set
intersections confirm links in rounds, so that a group of many copies costs in proportion to its size: first each node
meets the leaders (smallest nodes of a band) that it shares most bands with; in bands that then still hold several
components, the nodes outside the largest one meet those of other components; bands with many such nodes leave their
candidate groups to blocks that meet block by block, and groups that chain many bands together are taken apart into
those bands again. Every pair that shares a band is either compared or already connected. With 45 bands of 5 a pair at
a similarity of 0.8 shares none with probability 2e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm import common, graph

BANDS, BAND_ROWS = 45, 5
#: Shingles in a block of a candidate group, or in a part of a hub's partners; two blocks meet in a task.
BLOCK_SHINGLES = 250_000
#: Leaders that a document meets first.
NEAREST_LEADERS = 3
#: Bands with more documents than this outside their largest component are left to blocks.
FEW_OUTSIDE = 8
#: Candidate groups of more blocks than this are taken apart into their bands.
MOST_BLOCKS = 16
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX[0]
    return h ^ (h >> np.uint64(29))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """Sorted distinct 64-bit hashes of the successive `width` words of a text, A-Z lower-cased, words between ASCII white space."""

    def __init__(self, width: int):
        self.width, self.hashes = width, _WordHashes()

    def shingles(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(h))
        if not width:
            return h
        with np.errstate(over="ignore"):
            n = len(h) - width + 1
            # The constant tells a short whole text from the shingles of a longer one.
            total = np.full(n, width * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF, np.uint64)
            for j in range(width):
                total = _finish(total + h[j : j + n] * _MIX[j % len(_MIX)])
        return np.unique(total)


class Signer:
    """Band keys of a shingle set from the smallest and largest values under each permutation."""

    def __init__(self, bands: int = BANDS, rows: int = BAND_ROWS, seed: int = 2):
        draw = np.random.default_rng(seed)
        n = -(-bands * rows // 2)
        n += (-n) % rows  # whole bands of minima, then whole bands of maxima
        self.a = (draw.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
        self.b = draw.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)[:, None]
        self.bands, self.rows = bands, rows
        self.tags = _finish(np.arange(1, bands + 1, dtype=np.uint64) * _MIX[4])

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        low = high = None
        for i in range(0, len(x), 2_048):
            v = x[i : i + 2_048] * self.a + self.b
            lo, hi = v.min(axis=1), v.max(axis=1)
            low, high = (lo, hi) if low is None else (np.minimum(low, lo), np.maximum(high, hi))
        values = np.concatenate([low, high]).astype(np.uint64).reshape(-1, self.rows)[: self.bands]
        h = self.tags.copy()
        with np.errstate(over="ignore"):
            for j in range(self.rows):
                h = _finish(h + (values[:, j] + np.uint64(1)) * _MIX[j])
        return h.view(np.int64)


def signatures(docs: DataFrame, width: int, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, text_key (hash of the text), n_shingles, digest of the set, band keys (null if the set is empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler, signer = Shingler(width), Signer(bands, rows)
        for batch in common.pieces(batches):
            n, digests, keys = [], [], []
            for t in batch.column(2).to_pylist():
                s = shingler.shingles(t)
                n.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(signer.keys(s) if len(s) else None)
            columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "n_shingles", "digest", "keys"])

    return _named(docs).mapInArrow(run, "doc_id long, text_key long, n_shingles long, digest binary, keys array<long>")


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and text: the first two tell rows apart, but for those that repeat a row."""
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")


def links_within(sets: list[np.ndarray], side: np.ndarray, percent: int) -> np.ndarray:
    """For each set the smallest index of its component under links of percent or more; side 0 and 1 are compared across only if both occur."""
    sizes = np.array([len(s) for s in sets], np.int64)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    values, owner_by_value = values[order], owner[order]
    start = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    rank = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(values)]))
    code = np.empty(len(values), np.int64)
    code[order] = rank
    ends = np.r_[start[1:], len(values)]
    offsets = np.r_[0, np.cumsum(sizes)]
    group = np.arange(len(sets))
    across = len(np.unique(side)) == 2
    for i in range(1, len(sets)):
        c = code[offsets[i] : offsets[i + 1]]
        c = c[ends[c] - start[c] > 1]
        if not len(c):
            continue
        n = ends[c] - start[c]
        common_n = np.zeros(len(sets), np.int64)
        for j in range(0, len(c), 4_096):  # postings of a bounded number of shingles at a time
            m = n[j : j + 4_096]
            at = np.repeat(start[c[j : j + 4_096]] - np.r_[0, np.cumsum(m)[:-1]], m) + np.arange(m.sum())
            common_n += np.bincount(owner_by_value[at], minlength=len(sets))
        common_n[i:] = 0
        if across:
            common_n[side == side[i]] = 0
        linked = np.flatnonzero(100 * common_n >= percent * (sizes + sizes[i] - common_n))
        linked = linked[common_n[linked] > 0]
        if len(linked):
            old = np.unique(np.r_[group[linked], group[i]])
            if len(old) > 1:
                group[np.isin(group, old)] = old[0]
    return group


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def _dealt(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (doc_id, n, hub), n the size of doc_id's set -> hub, part, doc_id: who meets where.

    A hub's text meets its partners in parts of bounded size, so a hub with very many partners is spread over tasks.
    """
    parts = pairs.groupBy("hub").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("parts"))
    partners = pairs.join(parts, "hub").select("hub", F.pmod(F.xxhash64("doc_id", F.lit(6)), F.col("parts")).cast("int").alias("part"), "doc_id")
    hubs = parts.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("hub").alias("doc_id"))
    return partners.unionByName(hubs)


def _confirm_pairs(dealt: DataFrame, width: int, percent: int) -> DataFrame:
    """dealt (hub, part, doc_id, text) -> u, v: the pairs whose full sets are similar enough."""
    shingler = Shingler(width)

    # Most groups are a few rows, for which Arrow tables cost less than pandas frames.
    def confirm(rows: pa.Table) -> pa.Table:
        sets = [shingler.shingles(t) for t in rows["text"].to_pylist()]
        ids, hubs = rows["doc_id"].to_numpy(), rows["hub"].to_numpy()
        is_hub = (ids == hubs).tolist()
        centres = [s for s, h in zip(sets, is_hub, strict=True) if h]
        linked = np.array([not h and any(_similar(s, c, percent) for c in centres) for s, h in zip(sets, is_hub, strict=True)], bool)
        return pa.table({"u": ids[linked], "v": hubs[linked]})

    return dealt.select("hub", "part", "doc_id", "text").groupBy("hub", "part").applyInArrow(confirm, "u long, v long")


def _confirm_blocks(members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """members (doc_id, root, n) -> u, v: links between any two members of a root, block against block; transitive ones may be left out."""
    blocks = members.groupBy("root").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    placed = members.join(blocks, "root").select("doc_id", "root", "blocks", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.col("blocks")).cast("int").alias("block"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least("block", other).alias("x"), F.greatest("block", other).alias("y")))
    dealt = placed.join(texts, "doc_id").select("doc_id", "text", "root", "block", F.explode(meets).alias("meet")).select("doc_id", "text", "block", "root", "meet.x", "meet.y")
    shingler = Shingler(width)

    def confirm(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("doc_id")
        found = links_within([shingler.shingles(t) for t in rows["text"].to_pylist()], rows["block"].to_numpy(), percent)
        ids = rows["doc_id"].to_numpy()
        linked = found != np.arange(len(found))
        return pa.table({"u": ids[linked], "v": ids[found[linked]]})

    return dealt.groupBy("root", "x", "y").applyInArrow(confirm, "u long, v long")


def _links(sets: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """sets (row, doc_id, text_key, n_shingles, keys), nodes (node) -> u, v: confirmed links of nodes whose components are those of all links between nodes that share a band.

    From here on doc_id stands for the row, and for the node once copies have left.
    """
    # Keys are cut where the signatures lie. Copies leave in the shared bands, which are few, so that no signature is shuffled
    # for it; they share all bands of their node, whose row is the smallest of theirs, so that leaders are nodes. (A semi-join
    # would be moved below the cut.)
    bands = sets.select(F.col("row").alias("doc_id"), F.col("n_shingles").alias("n"), F.explode("keys").alias("key"))
    # A node's number of shingles goes with it: min_by() keeps both in buffers of fixed size.
    leaders = bands.groupBy("key").agg(F.min("doc_id").alias("leader"), F.min_by("n", "doc_id").alias("leader_n"), F.max("doc_id").alias("last"))
    leaders = leaders.where("leader <> last").select("key", "leader", "leader_n")
    led = bands.join(leaders, "key").where("doc_id <> leader").join(nodes.select(F.col("node").alias("doc_id")), "doc_id")
    led = common.durable(led.select("key", "leader", "leader_n", "doc_id", "n"), "shared-bands")
    shared = led.unionByName(led.select("key", "leader", "leader_n", F.col("leader").alias("doc_id"), F.col("leader_n").alias("n")).distinct())
    # Sets of too different sizes can't be similar enough, whatever they hold: such pairs are not compared.
    sized = lambda n, m: 100 * F.least(F.col(n), F.col(m)) >= percent * F.greatest(F.col(n), F.col(m))
    sizes = led.select("doc_id", "n").unionByName(led.select(F.col("leader").alias("doc_id"), F.col("leader_n").alias("n"))).groupBy("doc_id").agg(F.max("n").alias("n"))

    # First each document meets the leaders that it shares most bands with, which connects most groups.
    counted = led.where(sized("n", "leader_n")).groupBy("doc_id", "leader").agg(F.max("n").alias("n"), F.count("*").alias("bands"))
    nearest = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("bands"), "leader"))
    stars = common.durable(counted.withColumn("at", nearest).where(F.col("at") <= NEAREST_LEADERS).select("doc_id", "n", F.col("leader").alias("hub")), "stars")

    # A text is fetched together with the places where it first meets others: no join brings the two together afterwards.
    meets = _dealt(stars).groupBy("doc_id").agg(F.collect_list(F.struct("hub", "part")).alias("meets")).withColumnRenamed("doc_id", "node")
    rows = sets.select(F.col("row").alias("node"), "doc_id", "text_key").join(sizes.select(F.col("doc_id").alias("node")), "node", "left_semi").join(meets, "node", "left")
    texts = _named(docs).join(rows, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"]).select(F.col("node").alias("doc_id"), "text", "meets")
    texts = common.durable(texts, "shared-texts")
    first = texts.select("doc_id", "text", F.explode("meets").alias("meet")).select("meet.hub", "meet.part", "doc_id", "text")
    joined = graph.components(_confirm_pairs(first, width, percent), "stars-linked")
    texts = texts.select("doc_id", "text")

    # Only bands that still hold several components are open, and in those only pairs of different components.
    named = shared.join(joined.withColumnsRenamed({"node": "doc_id", "root": "part"}), "doc_id", "left").withColumn("part", F.coalesce("part", "doc_id"))
    named = common.durable(named, "named-bands")
    in_part = named.groupBy("key", "part").agg(F.countDistinct("doc_id").alias("m"))
    largest = in_part.groupBy("key").agg(F.max(F.struct("m", "part")).alias("top"), F.sum("m").alias("total"))
    open_bands = largest.where("total > top.m").select("key", F.col("top.part").alias("main"), (F.col("total") - F.col("top.m")).alias("outside"))
    few = open_bands.where(F.col("outside") <= FEW_OUTSIDE)
    outside = named.join(few, "key").where("part <> main").select("key", "main", F.col("doc_id").alias("hub"), F.col("n").alias("hub_n"), F.col("part").alias("hub_part"))
    crossing = named.join(outside, "key").where("part <> hub_part and (part = main or doc_id > hub)").where(sized("n", "hub_n")).groupBy("doc_id", "hub").agg(F.max("n").alias("n"))
    met = stars.select(F.col("doc_id").alias("high"), F.col("hub").alias("low"))
    untried = crossing.join(met, (F.greatest("doc_id", "hub") == F.col("high")) & (F.least("doc_id", "hub") == F.col("low")), "left_anti")
    across = _confirm_pairs(_dealt(common.durable(untried, "crossing")).join(texts, "doc_id"), width, percent)

    # Bands with many documents outside their largest component: blocks of their candidate groups meet.
    many = open_bands.where(F.col("outside") > FEW_OUTSIDE).select("key")
    touching = named.join(many, "key", "left_semi").where("doc_id <> leader").select(F.col("doc_id").alias("u"), F.col("leader").alias("v"))
    candidates = graph.components(touching, "candidates").withColumnsRenamed({"node": "doc_id"}).join(sizes, "doc_id")
    wide = candidates.groupBy("root").agg(F.sum("n").alias("total")).where(F.col("total") > MOST_BLOCKS * BLOCK_SHINGLES).select("root")
    apart = candidates.join(wide, "root", "left_semi").select("doc_id")
    by_band = named.join(many, "key", "left_semi").join(apart, "doc_id", "left_semi").select("doc_id", F.col("key").alias("root"), "n")
    members = candidates.join(wide, "root", "left_anti").select("doc_id", "root", "n").unionByName(by_band)
    within = _confirm_blocks(common.durable(members, "block-members"), texts, width, percent)
    return joined.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(across).unionByName(within)


def _grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """A row for each row of docs: doc_id, text_key, n_shingles, root (its component's node) and component_id; the last two null without doc_id or words."""
    signed = signatures(docs, width).withColumn("row", F.monotonically_increasing_id())
    signed = common.durable(signed, "signatures")
    sets = signed.where("digest is not null and doc_id is not null")
    classes = common.durable(sets.groupBy("digest").agg(F.min("doc_id").alias("smallest"), F.min("row").alias("node")), "classes")
    linked = graph.components(_links(sets, classes.select("node"), docs, width, percent), "linked")
    # Only linked nodes look up their component's smallest doc_id, salted, as a component may hold a large share of them.
    members = linked.join(classes.select("node", "smallest"), "node")
    names = members.groupBy("root").agg(F.min("smallest").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(graph.SALT - 1))))
    members = members.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(graph.SALT)).cast("int")).join(names, ["root", "salt"]).select("node", "root", "component_id")
    named = classes.join(members, "node", "left").select("digest", F.coalesce("root", "node").alias("root"), F.coalesce("component_id", "smallest").alias("component_id"))
    own = signed.select("doc_id", "text_key", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    return own.join(named, "digest", "left").drop("digest")


def groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id, the smallest doc_id reachable by links of `percent` % similarity.

    Null texts and texts without a word have the empty set and are linked with nothing. Every input row gives one row;
    rows that repeat a doc_id are documents of their own that share that name. Rows without doc_id stay, without
    component. An empty table gives no rows. Very long texts are shingled whole. Links of equal similarity need no order:
    a component is the same whichever is found first. Other columns, whatever their names, are not read.
    """
    found = _grouped(docs, width, percent)
    return found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay if one document of each near-duplicate group does; all columns, of any names.

    Of a group the smallest doc_id stays; of several texts under it that of the smallest text_key. Of rows that repeat
    both doc_id and text one stays; other texts under the same doc_id are judged by themselves. Null texts and texts
    without a word are groups of their own. Rows without doc_id all stay. An empty table gives no rows.
    """
    found = common.durable(_grouped(docs, width, percent).where("doc_id is not null"), "grouped")
    kept = found.where("doc_id = component_id").groupBy("root").agg(F.min("doc_id").alias("_id"), F.min("text_key").alias("_key")).select("_id", "_key")
    kept = kept.unionByName(found.where("root is null").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct())
    key = common.fresh(docs, "text_key")
    named = docs.where("doc_id is not null").withColumn(key, F.xxhash64("text"))
    named = named.join(kept, (named["doc_id"] == kept["_id"]) & (named[key] == kept["_key"]), "left_semi")
    return named.dropDuplicates(["doc_id", key]).select(*docs.columns).unionByName(docs.where("doc_id is null"))
