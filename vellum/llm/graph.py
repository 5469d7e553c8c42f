"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import common

#: A hub's edges are dealt over so many tasks.
SALT = 16


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 2147483647)).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to the smallest node around it."""
    both = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(edges.select(F.col("v").alias("a"), F.col("u").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    spread = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    dealt = both.where("b > a").withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALT)).cast("int"))
    return dealt.join(spread, ["a", "salt"]).select(F.col("b").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, label: str, rounds: int = 60) -> DataFrame:
    """edges (u, v) -> (node, root): each node that has an edge and the smallest node that it is connected with.

    Loops and null ends are ignored, repeated edges count once, an edgeless table gives no rows. Each round is written
    to the shared folder, so that no lineage grows.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = common.durable(now, f"{label}-edges")
    seen = _fingerprint(now)
    for i in range(rounds):
        if not seen[0]:
            break
        now = common.durable(_small_star(_large_star(now)), f"{label}-round{i}")
        new = _fingerprint(now)
        if new == seen:
            break
        seen = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
