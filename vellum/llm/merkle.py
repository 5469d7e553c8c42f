"""Merkle manifest of a dataset: a tree of digests for each source, a tree over the sources' roots, and a proof for every row.

Leaves get their place in their source from ranges of the order, never from one task. Each level hashes runs of `2 ** BITS`
consecutive nodes. Proofs come by pointer jumping: a node begins with a pointer to its parent and one segment, the siblings to
its left and right; a self-join gives each node the pointer of the node that its own points to and appends that one's segments,
so that distances double until all nodes point to the root of their source. A row's leaf takes the last jump, over its parent,
while 16 leaves still share a row; the few segments above a source's root are appended to the parents before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm import common, mixing

#: Consecutive nodes that are hashed together: 16.
BITS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes that may meet under one key of a join; the ancestors of more are repeated under as many salts as are needed.
MEET = 256

_SEGMENTS = "array<struct<left:binary,right:binary>>"
#: Nodes of a tree of n leaves at a level.
_COUNT = "((n + shiftleft(1L, {bits} * ({level})) - 1) div shiftleft(1L, {bits} * ({level})))"


def _count(level: str | int) -> str:
    return _COUNT.format(bits=BITS, level=level)


def digest(*fields: Column) -> Column:
    """Lower-case hex SHA-256 of the fields: each `-` if null, else its number of UTF-8 bytes, a colon and its value."""
    values = (f.cast("string") for f in fields)
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values)), 256)


def _hex(binary: Column) -> Column:
    return F.lower(F.hex(binary))


def _joined(digests: Column) -> Column:
    return F.array_join(F.transform(digests, _hex), "")


def _beside(digests: Column, i: Column) -> Column:
    """The digests before and after place i (from 0) of a run, each side joined."""
    whole = F.array_join(F.transform(digests, F.hex), "")
    return F.struct(F.unhex(F.substring(whole, F.lit(1), i * 64)).alias("left"), F.unhex(F.substring(whole, i * 64 + 65, F.lit(64 << BITS))).alias("right"))


def _placed(leaves: DataFrame) -> DataFrame:
    """leaves (key, source, doc_id, leaf, tie) -> also tree (rank of the source from 0), at (place in it from 0), n (its leaves).

    Tasks hold ranges of (source, doc_id, leaf); beyond a range only counts by range and source travel.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("tie")]
    dealt = leaves.repartitionByRange(F.col("source").asc_nulls_first(), *order).withColumn("range", F.spark_partition_id())
    dealt = common.durable(dealt, "merkle-ranges")
    parts = dealt.groupBy("range", "key").agg(F.count("*").alias("size"), F.first("source").alias("source"))
    parts = common.durable(parts, "merkle-parts")
    by_range = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sources = mixing.running(parts.groupBy("key", "source").agg(F.sum("size").alias("n")), [F.col("source").asc_nulls_first()])
    sources = sources.select("key", "n", (F.col("rank") - 1).cast("long").alias("tree"))
    parts = parts.withColumn("_before", F.coalesce(F.sum("size").over(by_range), F.lit(0))).drop("size", "source").join(sources, "key")
    inside = Window.partitionBy("range", "key").orderBy(*order)
    at = (F.row_number().over(inside) - 1).cast("long")
    return dealt.withColumn("_at", at).join(parts, ["range", "key"]).withColumn("at", F.col("_at") + F.col("_before")).drop("range", "key", "_at", "_before", "tie")


def _climb(nodes: DataFrame, level: int, most: int) -> tuple[DataFrame, DataFrame]:
    """nodes (tree, n, at, digest) of a level -> pointers of all nodes from there up, and the trees' roots (tree, n, digest).

    A pointer: tree, n, level, at, segments, anc_level, anc_at. Roots point to nothing and aren't among them. `most` is
    the largest n, which bounds the levels.
    """
    pointers, roots = [], []
    while True:
        roots.append(nodes.where(f"{_count(level)} = 1").select("tree", "n", "digest"))
        if most <= 1 << (BITS * level):
            break
        run = nodes.where(f"{_count(level)} > 1").groupBy("tree", "n", F.shiftright("at", BITS).alias("anc_at"))
        run = run.agg(F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("members"))
        digests = F.col("members.digest")
        child = F.transform("members", lambda m, i: F.struct(m["at"].alias("at"), F.array(_beside(digests, i)).cast(_SEGMENTS).alias("segments")))
        pointers.append(run.select("tree", "n", F.lit(level).alias("level"), F.lit(level + 1).alias("anc_level"), "anc_at", F.explode(child).alias("c")).select("tree", "n", "level", "c.at", "c.segments", "anc_level", "anc_at"))
        nodes = run.select("tree", "n", F.col("anc_at").alias("at"), F.unhex(F.sha2(_joined(digests), 256)).alias("digest"))
        level += 1
    union = roots[0]
    for r in roots[1:]:
        union = union.unionByName(r)
    found = None
    for p in pointers:
        found = p if found is None else found.unionByName(p)
    if found is None:
        found = nodes.where("false").select("tree", "n", F.lit(0).alias("level"), "at", F.array().cast(_SEGMENTS).alias("segments"), F.lit(0).alias("anc_level"), F.col("at").alias("anc_at"))
    return found, union


def _salts(level: str, dist: int) -> str:
    """How many salts an ancestor of so many nodes `dist` levels below, which are at that level, is repeated under."""
    return f"cast((least(shiftleft(1L, {min(62, BITS * dist)}), {_count(level)}) + {MEET - 1}) div {MEET} as int)"


def _jump(pointers: DataFrame, levels: int, label: str) -> DataFrame:
    """Pointers whose distances double until every node points to the root of its tree; trees have so many levels at most above the first."""
    now, dist = common.durable(pointers, f"{label}-pointers"), 1
    while dist < levels:
        done = f"{_count('anc_level')} = 1"
        open_ = now.where(f"NOT {done}").withColumn("salt", F.expr(f"cast(pmod(at, {_salts('level', dist)}) as int)"))
        steps = now.where(f"{_count('level - ' + str(dist))} > 1 AND level >= {dist}")
        steps = steps.withColumn("salt", F.explode(F.expr(f"sequence(0, greatest(1, {_salts(f'level - {dist}', dist)}) - 1)")))
        steps = steps.select("tree", "salt", F.col("level").alias("anc_level"), F.col("at").alias("anc_at"), F.col("segments").alias("_more"), F.col("anc_level").alias("_level"), F.col("anc_at").alias("_at"))
        moved = open_.join(steps, ["tree", "anc_level", "anc_at", "salt"])
        moved = moved.select("tree", "n", "level", "at", F.concat("segments", "_more").alias("segments"), F.col("_level").alias("anc_level"), F.col("_at").alias("anc_at"))
        now = common.durable(now.where(done).unionByName(moved), f"{label}-jump{dist}")
        dist *= 2
    return now


def _levels(n: int) -> int:
    """Levels above the leaves of a tree."""
    found = 0
    while n > 1:
        n, found = -(-n >> BITS), found + 1
    return found


def proofs(docs: DataFrame, fields: tuple[str, ...] = FIELDS, carry: dict[str, Column] | None = None) -> DataFrame:
    """docs -> doc_id, source, leaf, subroot, root and path of each row; also the columns of `carry`.

    The path holds for each level from the leaf up to the root the siblings left and right of the row's node as binary
    digests one after another; fold() rebuilds the root from it. A leaf is the digest of `fields`, which doc_id and source
    need not be among. In its source a row stands by doc_id, null first, then by leaf; repeated rows are leaves one by one,
    and which of equal ones comes first is the same to every digest. Null is a source of its own, the first. Empty, null
    and very long texts are values like others. A source of one row has its leaf for subroot, one source its subroot for
    root; an empty table gives no rows. Other columns aren't read, whatever their names.
    """
    carried = carry or {}
    leaves = docs.select(
        F.col("doc_id"), F.col("source").cast("string").alias("source"), F.unhex(digest(*(F.col(f) for f in fields))).alias("leaf"), F.struct(*(c.alias(k) for k, c in carried.items()), F.lit(None).cast("boolean").alias("_")).alias("carried"),
    )
    leaves = leaves.withColumns({"key": F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")), "tie": F.monotonically_increasing_id()})
    placed = _placed(common.durable(leaves, "merkle-leaves"))
    runs = placed.groupBy("tree", "n", F.shiftright("at", BITS).alias("run")).agg(F.array_sort(F.collect_list(F.struct("at", "doc_id", "source", "leaf", "carried"))).alias("members"))
    runs = common.durable(runs, "merkle-runs")
    size = runs.agg(F.max("n").alias("n"), F.max("tree").alias("tree")).first()
    most, trees = size.n or 0, (size.tree + 1) if size.n else 0
    # A source of one row has no level of its own: its leaf is the node.
    node = F.when(F.col("n") == 1, F.get("members.leaf", F.lit(0))).otherwise(F.unhex(F.sha2(_joined(F.col("members.leaf")), 256)))
    pointers, subroots = _climb(runs.select("tree", "n", F.col("run").alias("at"), node.alias("digest")), 1, most)
    subroots = common.durable(subroots.withColumnsRenamed({"digest": "subroot", "n": "leaves"}), "merkle-subroots")
    above, root = _climb(subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(trees).cast("long").alias("n"), F.col("tree").alias("at"), F.col("subroot").alias("digest")), 0, trees)
    top = _jump(above, _levels(trees), "merkle-top").where("level = 0").select(F.col("at").alias("tree"), F.col("segments").alias("above"))
    root = root.first()
    # A source's root is under one key for all its runs: repeated under salts.
    salts = f"cast((({_count(1)}) + {MEET - 1}) div {MEET} as int)"
    tops = subroots.withColumnRenamed("leaves", "n").join(top, "tree", "left").withColumn("above", F.coalesce("above", F.array().cast(_SEGMENTS)))
    tops = tops.withColumn("salt", F.explode(F.expr(f"sequence(0, {salts} - 1)"))).drop("n")
    paths = _jump(pointers, _levels(most) - 1, "merkle").where("level = 1").select("tree", F.col("at").alias("run"), "segments")
    whole = runs.join(paths, ["tree", "run"], "left").withColumn("salt", F.expr(f"cast(pmod(run, {salts}) as int)")).join(tops, ["tree", "salt"])
    whole = whole.withColumn("_path", F.concat(F.coalesce("segments", F.array().cast(_SEGMENTS)), "above"))
    own = lambda i: F.when(F.col("n") > 1, F.array(_beside(F.col("members.leaf"), i))).otherwise(F.array()).cast(_SEGMENTS)
    shown = whole.select("subroot", "_path", F.explode(F.transform("members", lambda m, i: F.struct(m.alias("m"), own(i).alias("own")))).alias("x"))
    return shown.select(
        "x.m.doc_id", "x.m.source", _hex(F.col("x.m.leaf")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), F.lit(root.digest.hex() if root else None).cast("string").alias("root"),
        F.concat("x.own", "_path").alias("path"), *(F.col(f"x.m.carried.{k}") for k in carried),
    )


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(_hex(p["left"]), _hex(p["right"]))), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of a path give."""
    return F.aggregate(path, leaf, lambda acc, p: F.sha2(F.concat(_hex(p["left"]), acc, _hex(p["right"])), 256))
