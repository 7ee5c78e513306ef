"""Connected components, and looking rows up by keys that may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: A key with more than this share of the rows is hot; so there are fewer than 1 / HOT_SHARE hot keys.
HOT_SHARE = 1e-4


def look_up(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """`rows` joined with `groups`, which has each value of `key` once and in `size` how many rows have it.

    Keys that hold more than HOT_SHARE of the rows (10,000 keys at most, whatever the input) are broadcast, so their
    rows stay where they are; the others go through a shuffle that no single key can fill.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.where(F.col(size) > total * HOT_SHARE)
    few = rows.join(F.broadcast(hot), key)
    return few.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups, key))


def with_least(links: DataFrame) -> DataFrame:
    """u, v, m of `links` (u, v): the least v of each u.

    The least is combined before its shuffle; then both sides of the join are shuffled, so that Spark can split the rows
    of a node with many links, or the small side is broadcast.
    """
    return links.join(cut(links.groupBy("u").agg(F.min("v").alias("m"))), "u")


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) of all nodes in `links` (a, b long, in any order).

    Large-star and small-star steps alternate until the links no longer change. In a step each node learns its least
    neighbour, combined before the shuffle, and hands it on; nothing is gathered in one task or on the driver.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        near = with_least(cut(near.distinct()))
        # A node keeps its least neighbour, and its other neighbours get that one in its place.
        edges = cut(near.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct(), free=True)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).distinct().unionByName(roots)
