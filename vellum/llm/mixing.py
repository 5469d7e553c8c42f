"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets share all words by weight, none above a multiple of its source's size (water filling). Words are given out in
blocks of equal size: sources get them by the highest quotients target / (2 k + 1), and each source's shards the same way
by their size, which makes an integer quota for each shard. In a shard (a bounded share of a source, dealt by a seeded
hash, of many blocks) the documents are laid out in a seeded order and cut into such blocks, a document belonging to the block that it
begins in; a seeded draw of whole blocks then fills the quota, after whole passes over the shard, and only the last
document drawn is taken in part. Ranks over all sources come from ranges of the order, never from one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm import common

WORD = r"[^\x20\x09-\x0D]+"
#: Words in a block at least; larger tables have larger blocks, so that there are about so many blocks at most.
BLOCK_WORDS, MOST_BLOCKS = 32, 1 << 20
#: Documents in a shard, until a source has the most shards that are ranked together; blocks in a shard at least, on average.
SHARD_DOCS, MOST_SHARDS, SHARD_BLOCKS = 4_096, 4_096, 64


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running(rows: DataFrame, order: list[Column], sums: tuple[str, ...] = ()) -> DataFrame:
    """rows with `rank` from 1 and, for each column of `sums`, `before_...`, its sum over all rows before, in a total order of the whole table.

    Tasks hold ranges of the order; only one row for each range, its counts and sums, comes together.
    """
    dealt = common.durable(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    inside, over = Window.partitionBy("range").orderBy(*order), Window.partitionBy(F.lit(0)).orderBy("range")
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = dealt.groupBy("range").agg(F.count("*").alias("rank"), *(F.sum(c).alias(c) for c in sums))
    ranges = ranges.select("range", *(before(over, c).alias(f"_{c}") for c in ("rank", *sums)))
    own = dealt.select("*", F.row_number().over(inside).alias("rank"), *(before(inside, c).alias(f"before_{c}") for c in sums))
    joined = own.join(ranges, "range")
    whole = {"rank": F.col("rank") + F.col("_rank")} | {f"before_{c}": F.col(f"before_{c}") + F.col(f"_{c}") for c in sums}
    return joined.withColumns(whole).drop("range", "_rank", *(f"_{c}" for c in sums))


def targets(sources: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """sources (key, source, source_size) -> also target. Weights repeat over the sources by code point, null last.

    A target of cap times the size is final; the first source, by size / weight, whose fair share lies under its cap
    fixes the share of it and of all after it.
    """
    by_name = F.col("source").asc_nulls_last()
    cycle = F.array(*map(F.lit, weights))
    named = running(sources, [by_name]).withColumn("weight", F.element_at(cycle, (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    capped = running(named.drop("rank").withColumn("limit", F.col("source_size") * cap), [F.col("limit") / F.col("weight"), by_name], ("limit", "weight"))
    capped = common.durable(capped.drop("rank"), "capped")
    whole = capped.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level = (F.lit(whole.size or 0) - F.col("before_limit")) / (F.lit(whole.weight or 1) - F.col("before_weight"))
    # Levels fall along the order from the first that fits on, so that one is the largest of those that fit.
    fits = capped.select(F.max(F.when(level * F.col("weight") <= F.col("limit"), level)).alias("level")).first().level
    share = F.col("limit") if fits is None else F.least(F.col("limit"), F.lit(fits) * F.col("weight"))
    return capped.withColumn("target", share.cast("double")).drop("limit", "before_limit", "before_weight")


def apportion(rows: DataFrame, group: str | None, order: str, weight: str, seats: Column) -> DataFrame:
    """Adds `quota`: the seats of each group, given to its rows by the highest quotients weight / (2 k + 1), ties to the smaller `order`.

    Without a group all rows are one, ranked by ranges. Only quotients near a row's exact share can be in doubt: with n rows
    the divisor that fills the seats moves a row of share p by at most p (1.5 n + 1) seats. Lower ones are granted at once,
    so a row ranks few quotients whatever the seats.
    """
    if group is None:
        all_rows = rows.agg(F.sum(weight).alias("w"), F.count("*").alias("n")).first()
        over = lambda name: F.lit({"w": float(all_rows.w or 0), "n": all_rows.n}[name])
    else:
        over = lambda name: {"w": F.sum(weight), "n": F.count("*")}[name].over(Window.partitionBy(group))
    share = F.when(over("w") > 0, F.col(weight) / over("w")).otherwise(F.lit(0.0))
    base = rows.withColumns({"seats": seats.cast("long"), "share": share})
    base = base.withColumn("doubt", F.ceil(F.col("share") * (over("n") * 1.5 + 1)).cast("long") + 2)
    base = base.withColumn("sure", F.greatest(F.lit(0).cast("long"), F.floor(F.col("share") * F.col("seats")) - F.col("doubt")))
    keys = [order] if group is None else [group, order]
    best = [(F.col(weight) / (2 * F.col("k") + 1)).desc(), F.col(order), F.col("k")]
    tries = F.explode(F.sequence(F.col("sure"), F.col("sure") + 2 * F.col("doubt") + 2)).alias("k")
    if group is None:
        base = common.durable(base, "seats")
        granted = base.agg(F.sum("sure")).first()[0] or 0
        tried = running(base.where(f"{weight} > 0").select(order, weight, (F.col("seats") - granted).alias("open"), tries), best)
    else:
        base = base.withColumn("open", F.col("seats") - F.sum("sure").over(Window.partitionBy(group)))
        tried = base.where(f"{weight} > 0").select(group, order, weight, "open", tries)
        tried = tried.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*best)))
    won = tried.where("rank <= open").groupBy(*keys).agg(F.count("*").alias("more"))
    return base.join(won, keys, "left").withColumn("quota", F.col("sure") + F.coalesce("more", F.lit(0))).drop("share", "doubt", "sure", "open", "more")


def _own(doc_id: Column, source: Column, text: Column) -> Column:
    """What stands for a row without doc_id: its text and source. Null for all others; hashes pass over it there."""
    return F.when(doc_id.isNull(), F.concat(F.sha2(F.coalesce(text, F.lit("")), 256), F.coalesce(F.concat(F.lit("="), source), F.lit(""))))


def plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, block_words: int | None = None, seed: int = 5) -> DataFrame:
    """docs (doc_id, text, source) -> doc_id, source, size, source_size, target, taken: the words of each document that the mix takes.

    Null texts and texts without a word have size 0 and nothing is taken from them; a null source is a source of its own.
    taken is at most cap times the size. The same rows give the same mix, however they are partitioned: ties of the seeded
    order go by doc_id, size and text. Repeated rows count one by one, and rows without doc_id by their text and source;
    an empty table gives no rows. Very long texts are documents like others, longer than a block. Other columns are not read.
    """
    return _planned(docs, weights, cap, block_words, seed).drop("own")


def _planned(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, block_words: int | None = None, seed: int = 5) -> DataFrame:
    sized = docs.select("doc_id", "source", words(F.col("text")).alias("size"), _own(F.col("doc_id"), F.col("source"), F.col("text")).alias("own"))
    sized = common.durable(sized.withColumn("key", F.when(F.col("source").isNull(), "null").otherwise(F.concat(F.lit("="), "source"))), "sizes")
    sources = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    aimed = targets(sources, weights, cap)
    total = sized.agg(F.sum("size")).first()[0] or 0
    block = block_words or max(BLOCK_WORDS, -(-total // MOST_BLOCKS))
    seats = (min(total, total * cap) + block // 2) // block
    aimed = apportion(aimed, None, "key", "target", F.lit(seats))
    n_shards = F.greatest(F.lit(1), F.least(F.lit(MOST_SHARDS), F.ceil(F.col("n") / SHARD_DOCS), F.floor(F.col("source_size") / (block * SHARD_BLOCKS)))).cast("int")
    aimed = common.durable(aimed.select("key", "source_size", "target", n_shards.alias("shards"), F.col("quota").alias("source_quota")), "targets")
    dealt = sized.join(aimed, "key").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "own"), F.col("shards")).cast("int"))
    shards = dealt.groupBy("key", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"))
    shards = apportion(shards, "key", "shard", "shard_size", F.col("source_quota"))
    # What a shard can't hold goes to the others of its source, in order, as far as they have room.
    of = Window.partitionBy("key")
    shards = shards.withColumn("_goal", F.least(F.col("quota") * block, F.col("shard_size") * cap)).withColumn("_room", F.col("shard_size") * cap - F.col("_goal"))
    cut_off = F.sum(F.col("quota") * block - F.col("_goal")).over(of)
    filled = F.coalesce(F.sum("_room").over(of.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = shards.withColumn("_goal", F.col("_goal") + F.greatest(F.lit(0).cast("long"), F.least(F.col("_room"), cut_off - filled)))
    goal = F.col("_goal")
    passes = F.when(F.col("shard_size") > 0, F.floor(goal / F.col("shard_size"))).otherwise(0)
    shards = shards.withColumn("passes", passes.cast("long")).select("key", "shard", "passes", (goal - F.col("passes") * F.col("shard_size")).alias("rest"))
    shard, before = Window.partitionBy("key", "shard"), (Window.unboundedPreceding, -1)
    laid = shard.orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "own"), "doc_id", "size", "own")
    placed = dealt.withColumn("start", F.coalesce(F.sum("size").over(laid.rowsBetween(*before)), F.lit(0)))
    placed = placed.withColumn("block", F.floor(F.col("start") / block))
    drawn = shard.orderBy(F.xxhash64(F.lit(seed + 2), "shard", "block"), "block", "start", "size")
    placed = placed.withColumn("at", F.coalesce(F.sum("size").over(drawn.rowsBetween(*before)), F.lit(0))).join(shards, ["key", "shard"])
    part = F.greatest(F.lit(0).cast("long"), F.least("size", F.col("rest") - F.col("at")))
    return placed.select("doc_id", "own", "source", "size", "source_size", "target", (F.col("passes") * F.col("size") + part).cast("long").alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, each as often as the plan takes it, to the nearest whole document.

    Rows of one doc_id share a plan: together they are repeated as often as their words are taken. Of rows without doc_id
    only those of the same text and source do. Rows without a word are never taken. Columns of any name come through.
    An empty table gives no rows.
    """
    times = _planned(docs, **options).groupBy("doc_id", "own").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    times = times.where("taken > 0").select(F.col("doc_id").alias("_of"), F.col("own").alias("_own"), F.round(F.col("taken") / F.col("size")).cast("int").alias("_times")).where("_times > 0")
    own, n = common.fresh(docs, "own"), common.fresh(docs, "n")
    keyed = docs.withColumn(own, _own(docs["doc_id"], docs["source"], docs["text"]))
    repeated = keyed.join(times, keyed["doc_id"].eqNullSafe(times["_of"]) & keyed[own].eqNullSafe(times["_own"]))
    repeated = repeated.select(*(keyed[c] for c in docs.columns), F.explode(F.sequence(F.lit(1), times["_times"])).alias(n))
    return repeated.drop(n)
