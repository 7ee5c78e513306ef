"""Sharding: best-fit-decreasing bin packing of groups of equal texts into shards of near-equal bytes.

Equal texts stay together. What best-fit decreasing does depends on the sizes of the groups alone, so it is planned from
the number of groups of each size, all groups of a size at once: the largest go first, each into the tightest shard that
has room, which after it is still the tightest. A group then finds its shard by its rank among those of its size. Sizes
below 2 ** EXACT are told apart exactly, larger ones to one part in 2 ** (EXACT - 1); so the driver holds some
2 ** (EXACT - 1) counts for each doubling of the size, however many groups there are.
"""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, number_within, table
from .graph import look_up

SHARDS = 24
#: Sizes below two to the power of this are told apart exactly.
EXACT = 15
#: Extra bytes that a row takes in a shard.
ROW_BYTES = 8


class Tree:
    """A balanced search tree (a treap with a fixed seed) of the bins' remaining capacities."""

    __slots__ = ("root", "rng")

    def __init__(self) -> None:
        self.root: list | None = None  # [key, priority, left, right]
        self.rng = random.Random(7)

    def add(self, key: tuple[int, int]) -> None:
        low, high = self._split(self.root, key)
        self.root = self._merge(self._merge(low, [key, self.rng.random(), None, None]), high)

    def take_at_least(self, key: tuple[int, int]) -> tuple[int, int] | None:
        """Removes and returns the smallest key that is not below `key`."""
        low, high = self._split(self.root, key)
        first, high = self._pop_first(high)
        self.root = self._merge(low, high)
        return first

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            node[3], high = self._split(node[3], key)
            return node, high
        low, node[2] = self._split(node[2], key)
        return low, node

    def _merge(self, low, high):
        if low is None or high is None:
            return low or high
        if low[1] < high[1]:
            low[3] = self._merge(low[3], high)
            return low
        high[2] = self._merge(low, high[2])
        return high

    def _pop_first(self, node):
        if node is None:
            return None, None
        if node[2] is None:
            return node[0], node[3]
        first, node[2] = self._pop_first(node[2])
        return first, node


def best_fit_decreasing(sizes: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int]] | None:
    """(place in `sizes`, items, bin) of all items, in the order in which they are packed; sizes are (size, items).

    The largest items go first, each into the fullest bin that has room, or a new one. An item larger than `capacity`
    gets a bin of its own. With more than `most` bins there is no plan.
    """
    tree, out, bins = Tree(), [], 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i][0], i)):
        size, items = sizes[i]
        while items:
            found = tree.take_at_least((size, -1)) if size <= capacity else None
            if found is None:
                if bins == most:
                    return None
                found = max(capacity, size), bins
                bins += 1
            left, b = found
            n = min(items, left // size) if size else items
            out.append((i, n, b))
            tree.add((left - n * size, b))
            items -= n
    return out


def near_equal(sizes: list[tuple[int, int]], n: int) -> list[tuple[int, int, int]]:
    """best_fit_decreasing into bins 0 to n - 1 under the least capacity that it finds to need no more.

    Items that are larger than the mean of the bins left have bins for themselves.
    """
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i][0], i))
    total, alone, out = sum(s * k for s, k in sizes), 0, []
    rest = dict(enumerate(k for _, k in sizes))
    for i in order:
        while rest[i] and n - alone > 1 and sizes[i][0] * (n - alone) >= total > 0:
            out.append((i, 1, alone))
            total, rest[i], alone = total - sizes[i][0], rest[i] - 1, alone + 1
        if rest[i]:
            break
    own = [(i, sizes[i][0], rest[i]) for i in order if rest[i]]
    if not own:
        return out
    room, fit = n - alone, [(s, k) for _, s, k in own]
    low = max(-(-total // room), own[0][1])
    width, high = max(low, 1), low
    while (best := best_fit_decreasing(fit, high, room)) is None:
        low, high = high + 1, high + max(1, width // 64)
    while low < high and (high - low) * 100_000 >= high:
        mid = (low + high) // 2
        made = best_fit_decreasing(fit, mid, room)
        if made is None:
            low = mid + 1
        else:
            best, high = made, mid
    return out + [(own[i][0], k, alone + b) for i, k, b in best]


def size_class(size: Column) -> Column:
    """The size with its highest EXACT bits only."""
    drop = F.greatest(F.floor(F.log2(size.cast("double"))).cast("int") - (EXACT - 1), F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", size, drop), drop)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, key (the text's digest)."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("key"))


def placed_rows(docs: DataFrame, n_shards: int) -> DataFrame:
    """doc_id, size, text_crc32, key, shard of each row."""
    spark, rows = docs.sparkSession, cut(sized(docs))
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).withColumn("class", size_class(F.col("bytes")))
    groups = cut(groups)
    found = groups.groupBy("class").agg(F.count(F.lit(1)).alias("groups"), F.sum("bytes").alias("all")).orderBy("class").toArrow()  # see EXACT
    classes, counts, sums = (found.column(c).to_pylist() for c in ("class", "groups", "all"))
    plan = near_equal([(a // k, k) for a, k in zip(sums, counts, strict=True)], n_shards)
    upto, lows = [0] * len(classes), []
    for i, k, b in plan:
        lows.append((classes[i], upto[i], upto[i] + k, b))
        upto[i] += k
    names = ("class", "low", "high", "shard")
    columns = [pa.array(c, pa.int64()) for c in zip(*lows, strict=True)] if lows else [pa.array([], pa.int64())] * 4
    ranges = spark.createDataFrame(pa.table(columns, names=list(names))).withColumn("shard", F.col("shard").cast("int"))
    # A rank by the digest: which groups of one size go together is as good as random, and the same each time.
    ranked = number_within(groups.select("key", "rows", "class"), ["class"], ["key"], "rank")
    homes = ranked.join(F.broadcast(ranges), "class").where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).select("key", "rows", "shard")
    return look_up(rows, cut(homes), "key", "rows").select("doc_id", "size", "text_crc32", "key", "shard")


def shards_by_bytes(docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    Shards have near-equal sums of size (UTF-8 bytes of the text, none for a null, plus 8), unless one group of
    equal texts alone is larger than the mean. Null and empty texts count as equal; a text of any length is whole in its
    shard. Rows that repeat, or have no doc_id, take a slot each. An empty table gives an empty result; other columns,
    whatever their names, play no part.
    """
    placed = cut(placed_rows(docs, n_shards).drop("key"))
    out = number_within(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, n_shards: int = SHARDS) -> None:
    """Writes `docs` as Parquet, a folder shard=N for each shard, with all rows and columns.

    A column named shard, in any case, would clash with the folders and is an error; an empty table writes no folder.
    """
    if "shard" in (c.lower() for c in docs.columns):
        raise ValueError("the column shard has the name of the folders")
    key, home, n = fresh(docs, 3)
    homes = placed_rows(docs, n_shards).groupBy("key", "shard").agg(F.count(F.lit(1)).alias(n)).toDF(key, home, n)
    text = F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    rows = look_up(docs.withColumn(key, text), cut(homes), key, n).withColumn("shard", F.col(home)).drop(key, home, n)
    rows.write.partitionBy("shard").parquet(path)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards_by_bytes(table(spark, sf_dir, "documents"))
