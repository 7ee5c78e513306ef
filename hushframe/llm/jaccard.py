"""Exact n-gram Jaccard join by a token-group matrix.

Documents with equal shingle sets are one node. Counts of all shingles over all documents give a global order, rare
ones first; two sets of Jaccard similarity 0.75 or more then share a shingle among the first quarter of both. Shingles
of one document only can't be shared and are left out, so a text without relatives costs nothing further.

First round: the nodes that hold a shingle early are compared with one of them, and what links forms groups of
similar documents. Second round: groups are split into blocks of bounded size. The matrix says which blocks hold
which early shingles; a node asks for a block of another group only if they share one. The block's token union bounds
the overlap with any of its members, and only a block that can still reach the threshold is opened. Pairs within
a group are linked already and are never looked at again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, release, steps, table, trim
from .exact_dedup import one_each, repeats
from .graph import components, look_up
from .slots import WANTED_BITS, bucket_count, drop_rows, in_map, mixed_bits, slot_map, wanted_map, whole

WORDS = 5
#: Two sets link when SCALE * overlap >= LEAST * union.
LEAST, SCALE = 75, 100
#: Members of a block of the matrix, and requests that are answered together.
BLOCK = 128
#: Shingles of all requests that are answered together: 8 bytes each.
LOT = 1 << 20
#: Rounds in which one node of each group is compared with one of another, before all others are.
ROUNDS = 1
#: Shingle hashes that a task gathers before it counts and sends them.
GATHER = 1 << 21
#: Slots of the map from shingles to their commonness, half a byte each: 32 MB, whatever the input.
LEVEL_BITS = 26

_random = np.random.default_rng(5)
_MULTIPLIERS = _random.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
#: A number for each byte, the same for both cases of a letter of A-Z, and one for each place in a word.
_BYTES = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[65:91] = _BYTES[97:123]
_PLACES = _random.integers(0, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Bytes of words that are hashed at once.
_HASHED = 1 << 19


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all texts, and where each text's words begin (with the end as the last entry)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    space = _SPACE[data]
    before, after = np.ones(len(data) + 1, bool), np.ones(len(data) + 1, bool)
    before[1:], after[:-1] = space if len(data) else True, space if len(data) else True
    before[at[:-1]] = True  # a word ends with its text
    after[at[1:]] = True
    starts, ends = np.flatnonzero(~space & before[:-1]), np.flatnonzero(~space & after[1:]) + 1
    sizes = ends - starts
    hashes = np.empty(len(starts), np.uint64)
    done = 0
    while done < len(starts):
        upto = max(done + 1, int(np.searchsorted(ends, starts[done] + _HASHED, side="right")))
        own = sizes[done:upto]
        first = np.concatenate([[0], np.cumsum(own)[:-1]])
        place = np.arange(int(own.sum())) - np.repeat(first, own)
        letters = data[place + np.repeat(starts[done:upto], own)]
        value = _BYTES[letters] * _PLACES[place & 4095]
        if own.max() > 4096:
            value *= (place >> 12).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        hashes[done:upto] = np.add.reduceat(value, first)
        done = upto
    return mixed_bits(hashes), np.searchsorted(starts, at)


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted 64-bit hashes of the distinct shingles of each text.

    Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased. A text of fewer words than a shingle has its
    whole sequence as its one shingle; one without words has none.
    """
    flat, at = word_hashes(texts)
    n = max(0, len(flat) - words + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(words):
        rolled += flat[k : k + n] * _MULTIPLIERS[k]
    rolled = mixed_bits(rolled)
    out = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if hi - lo >= words:
            own = np.sort(rolled[lo : hi - words + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif hi > lo:
            whole = (flat[lo:hi] * _MULTIPLIERS[32 : 32 + hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo)
            out.append(mixed_bits(np.array([whole], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def node_of(shingles: np.ndarray, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes(), seed) - (1 << 63)


def nodes(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """doc_id, n, node (null where n is 0), check, sha (of the text): equal sets have equal nodes; `check` would betray a collision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            sets = shingle_sets(batch.column(1), words)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([node_of(s, seed) if len(s) else None for s in sets], pa.int64()),
                pa.array([node_of(s, seed + 1) if len(s) else None for s in sets], pa.int64()),
                batch.column(2),
            ], names=["doc_id", "n", "node", "check", "sha"])

    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    return docs.select(F.col("doc_id").cast("long"), "text", sha).mapInArrow(run, "doc_id long, n long, node long, check long, sha string")


def levels(docs: DataFrame, words: int) -> list[tuple[int, bytes]]:
    """The commonness of shingles by their first LEVEL_BITS bits, half a byte each, counted over all documents.

    0: only one document has it. Else 1 and the binary logarithm of the number of unlike documents that have it, 15 at
    most; documents with the same least hash count as alike. So what a large group of near copies shares stays rare,
    and a passage of many unlike documents is common.
    """
    buckets = bucket_count(docs.sparkSession)
    bits = buckets.bit_length() - 1
    kinds = np.uint64(16)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in steps(batches):
            sets = {node_of(s, 0): s for s in shingle_sets(batch.column(0), words) if len(s)}
            for s in sets.values():  # bucket, 32 bits, and the kind of document: s[0] is its least hash
                held.append(((s >> np.uint64(32 - bits)) << kinds) | (s[0] & np.uint64(0xFFFF)))
                n += len(s)
                if n >= GATHER:
                    yield send(held)
                    held, n = [], 0
        if n:
            yield send(held)

    def send(held: list[np.ndarray]) -> pa.RecordBatch:
        h = np.sort(np.concatenate(held))
        h = h[np.concatenate([[True, True], h[2:] != h[:-2]])[: len(h)]]  # of each value two at most
        ends = np.searchsorted(h, np.arange(1, buckets, dtype=np.uint64) << np.uint64(48))
        shingle, kind = np.split((h >> kinds).astype(np.uint32), ends), np.split(h.astype(np.uint16), ends)
        full = [i for i, p in enumerate(shingle) if len(p)]
        return pa.RecordBatch.from_pydict({"bucket": full, "data": [shingle[i].tobytes() + kind[i].tobytes() for i in full]}, schema=schema)

    schema = pa.schema([("bucket", pa.int32()), ("data", pa.binary())])
    each = LEVEL_BITS - bits

    def fill(bucket: int, held: list[bytes]) -> bytes:
        h = np.concatenate([
            (np.frombuffer(x, np.uint32, len(x) // 6).astype(np.uint64) << kinds) | np.frombuffer(x, np.uint16, len(x) // 6, len(x) // 6 * 4)
            for x in held
        ])
        h.sort()
        new_kind = np.concatenate([[True], h[1:] != h[:-1]])
        shingle = (h >> kinds).astype(np.uint32)
        first = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]]))
        many = np.diff(np.append(first, len(h))) > 1
        unlike = np.add.reduceat(new_kind.astype(np.int64), first)[many]
        level = np.minimum(15, 1 + np.ceil(np.log2(unlike))).astype(np.uint8)
        part = np.zeros(1 << each, np.uint8)
        np.maximum.at(part, (shingle[first[many]] >> np.uint32(32 - each)).astype(np.int64), level)
        return (part[0::2] | (part[1::2] << 4)).tobytes()

    return slot_map(docs.select("text").mapInArrow(gather, "bucket int, data binary"), buckets, 1 << (LEVEL_BITS - 1), fill)


def level_of(level_map: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = (h >> np.uint64(64 - LEVEL_BITS)).astype(np.int64)
    both = level_map[slot >> 1]
    return np.where(slot & 1, both >> 4, both & 15)


def early(level_map: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles among the rarest n - ceil(0.75 n) + 1 that other documents may have, and for each its rest: how
    many of the set's shingles do not come before it."""
    level = level_of(level_map, h)
    first = len(h) + (-LEAST * len(h)) // SCALE + 1
    pick = np.lexsort((h, level))[:first]
    at = np.flatnonzero(level[pick] > 0)
    return h[pick[at]], len(h) - at


def postings(docs: DataFrame, words: int, seed: int, level_map) -> DataFrame:
    """token, node, n, rest: the early shingles of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = whole(level_map.value, 1 << (LEVEL_BITS - 1))
        for batch in steps(batches):
            own = {}
            for s in shingle_sets(batch.column(0), words):
                if len(s):
                    own.setdefault(node_of(s, seed), s)
            found = [early(known, s) for s in own.values()]
            sizes = [len(t) for t, _ in found]
            if sum(sizes):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([t for t, _ in found]).view(np.int64)), pa.array(np.repeat(np.fromiter(own, np.int64, len(own)), sizes)),
                    pa.array(np.repeat(np.fromiter(map(len, own.values()), np.int64, len(own)), sizes)),
                    pa.array(np.concatenate([r for _, r in found]).astype(np.int64)),
                ], names=["token", "node", "n", "rest"])

    return docs.select("text").mapInArrow(run, "token long, node long, n long, rest long").distinct()


def sets_of(docs: DataFrame, bits, words: int, seed: int) -> DataFrame:
    """node, shingles (64-bit hashes, sorted) of the wanted nodes (and of few others), each once, made again from the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = whole(bits.value, 1 << (WANTED_BITS - 3))
        for batch in steps(batches):
            own = {}
            for s in shingle_sets(batch.column(0), words):
                if len(s):
                    own.setdefault(node_of(s, seed), s)
            if own:
                node = np.fromiter(own, np.int64, len(own))
                hit = np.flatnonzero(in_map(known, node))
                sets = list(own.values())
                yield pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array([sets[i].tobytes() for i in hit], pa.binary())], names=["node", "shingles"])

    return docs.select("text").mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"])


def answers(ask: list[np.ndarray], members: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """(asker, member) that link. The members' token union bounds an asker's overlap with each of them; the block is
    opened only if the bound allows a link with a member of fitting size."""
    sizes = np.array([len(m) for m in members])
    flat = np.concatenate(members)
    owner = np.repeat(np.arange(len(members)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    for i, x in enumerate(ask):
        lo, hi = np.searchsorted(flat, x), np.searchsorted(flat, x, side="right")
        bound = int(np.count_nonzero(hi > lo))  # |x and the union|
        fits = (SCALE * np.minimum(sizes, len(x)) >= LEAST * np.maximum(sizes, len(x))) & (SCALE * bound >= LEAST * (len(x) + sizes - bound))
        if not fits.any():
            continue
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        common = np.bincount(owner[at], minlength=len(members))
        for j in np.flatnonzero(SCALE * common >= LEAST * (len(x) + sizes - common)):
            yield i, int(j)


def spanning(pairs: Iterator[tuple[int, int]], ask: list[int], members: list[int]) -> Iterator[tuple[int, int]]:
    """Of the links between nodes that ask and members, those that connect what earlier ones leave apart: fewer than
    there are nodes, and the same components."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    for i, j in pairs:
        x, y = top(ask[i]), top(members[j])
        if x != y:
            up[x] = y
            yield ask[i], members[j]


def open_blocks(docs: DataFrame, requests: DataFrame, blocks: DataFrame, words: int, seed: int) -> DataFrame:
    """a, b: links between the nodes that ask (requests: node, n, block) and the blocks' members (blocks: block, node),
    as many as it takes to connect what links connect.

    Requests for one block are dealt to lots by their number and by the size of their sets, and the block goes to each
    of them; a task gets lots of a bounded sum of sizes.
    """
    bits = docs.sparkSession.sparkContext.broadcast(wanted_map(requests.select("node").unionByName(blocks.select("node"))))
    sets = cut(sets_of(docs, bits, words, seed))
    bits.destroy()
    asked = cut(requests.groupBy("block").agg(F.count(F.lit(1)).alias("asked"), F.sum("n").alias("size")))
    lots = F.ceil(F.greatest(F.col("asked") / (4 * BLOCK), F.col("size") / LOT)).cast("int")
    total = asked.agg(F.sum("size")).first()[0] or 0
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // LOT)
    deal = F.pmod(F.xxhash64("block", "lot"), F.lit(tasks)).cast("int")
    left = (
        look_up(requests.select("node", "block"), asked, "block", "asked")
        .withColumn("lot", F.pmod(F.xxhash64("node"), lots).cast("int"))
        .join(sets, "node").select(deal.alias("asked_task"), *(F.col(c).alias(f"asked_{c}") for c in ("block", "lot", "node", "shingles")))
    )
    right = (
        blocks.join(asked, "block").withColumn("lot", F.explode(F.sequence(F.lit(0), lots - 1)))
        .join(sets, "node").select(deal.alias("held_task"), *(F.col(c).alias(f"held_{c}") for c in ("block", "lot", "node", "shingles")))
    )

    def answer(asking: pa.Table, held: pa.Table) -> pa.Table:
        trim()
        by: dict = {}
        for side, t in enumerate((asking, held)):
            columns = [t.column(c).to_pylist() for c in t.column_names[1:]]
            for block, lot, node, data in zip(*columns, strict=True):
                by.setdefault((block, lot), ([], []))[side].append((node, np.frombuffer(data, np.uint64)))
        a, b = [], []
        for ask, members in by.values():
            if ask and members:
                for i, j in spanning(answers([s for _, s in ask], [s for _, s in members]), [n for n, _ in ask], [n for n, _ in members]):
                    a.append(i)
                    b.append(j)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    found = cut(left.groupBy("asked_task").cogroup(right.groupBy("held_task")).applyInArrow(answer, "a long, b long"))
    del left, right, sets, asked
    release(docs.sparkSession)
    return found


def links(docs: DataFrame, words: int = WORDS, seed: int = 1) -> DataFrame:
    """node, component of all nodes that link with another; the components are those of all links."""
    spark = docs.sparkSession
    level_map = spark.sparkContext.broadcast(levels(docs, words))
    posts = cut(postings(docs, words, seed, level_map))

    level_map.destroy()
    release(spark)
    group = spark.createDataFrame([], "node long, component long")
    found = None
    placed = posts.withColumn("component", F.col("node"))
    for turn in range(ROUNDS):
        # For each shingle and group one of the group's nodes, another for each shingle; all against the first group's.
        pick = F.min(F.struct(F.xxhash64("node", "token", F.lit(turn)).alias("by"), "node", "n", "rest"))
        ones = placed.groupBy("token", "component").agg(pick.alias("one"))
        heads = ones.groupBy("token").agg(F.min(F.struct("component", "one")).alias("head"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
        stars = ones.join(heads, "token").where((F.col("component") != F.col("head.component")) & may_link("one.n", "one.rest", "head.one.n", "head.one.rest"))
        stars = cut(stars.select("one.node", "one.n", F.col("head.one.node").alias("block")).distinct())
        new = open_blocks(docs, stars, stars.select("block", F.col("block").alias("node")).distinct(), words, seed)
        found = found.unionByName(new) if found else new
        group = grown(group, new)
        placed = cut(mixed(posts if turn == 0 else placed.drop("component"), group))
        del ones, heads, stars
        posts = None
        release(spark)

    blocked = cut(blocks(placed, group), free=True)
    asking = placed.join(blocked, "node")
    matrix = asking.groupBy("token", "part", "block").agg(F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.max("rest").alias("most_rest"))
    matrix = matrix.withColumnsRenamed({"part": "other", "block": "asked_block"})
    fitting = F.greatest(F.col("least_n"), F.ceil(F.col("n") * LEAST / SCALE))  # the smallest that a member of use can be
    could = (F.col("most_n") >= fitting) & may_link("n", "rest", fitting, "most_rest")
    # Of two parts the one with the larger number is asked, and in a part of several groups later blocks by earlier ones.
    apart = (F.col("part") < F.col("other")) | ((F.col("part") == F.col("other")) & F.col("several") & (F.col("block") <= F.col("asked_block")))
    requests = cut(asking.join(matrix, "token").where(apart & could).select("node", "n", F.col("asked_block").alias("block")).distinct(), free=True)
    members = blocked.select("node", "block").join(requests.select("block").distinct(), "block", "left_semi")
    return merged(group, found.unionByName(open_blocks(docs, requests, cut(members), words, seed)))


def blocks(placed: DataFrame, group: DataFrame) -> DataFrame:
    """node, part, several, block of all nodes in `group` and `placed`: blocks of about BLOCK nodes at most.

    A group of BLOCK nodes or more is a part of its own, dealt to blocks by hash. Nodes of smaller groups and of none are
    put with those that share the commonest of their early shingles, so that many texts that share a passage and yet
    don't link fill few blocks: a shingle of k nodes then meets some k / BLOCK blocks, not k nodes.
    """
    sizes = group.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    large = sizes.where(F.col("members") >= BLOCK)
    lot = F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / BLOCK))
    own = look_up(group, large, "component", "members").select("node", F.col("component").alias("part"), F.lit(False).alias("several"), F.xxhash64("component", lot).alias("block"))
    common = placed.groupBy("token").agg(F.count(F.lit(1)).alias("nodes"))
    rest = placed.select("token", "node").join(own.select("node"), "node", "left_anti").join(common, "token")
    rest = cut(rest.groupBy("node").agg(F.max(F.struct("nodes", "token")).alias("most")).select("node", F.col("most.token").alias("token")))
    near = rest.groupBy("token").agg(F.count(F.lit(1)).alias("members"))
    near = look_up(rest, near, "token", "members").select("node", F.xxhash64("token").alias("part"), F.lit(True).alias("several"), F.xxhash64("token", lot).alias("block"))
    return own.unionByName(near)


def may_link(n, rest, other_n, other_rest) -> Column:
    """Whether sets of these sizes can link if a shingle with these rests is the first that they share.

    The overlap is at most the rest in either set, and a link needs 75 / 175 of the sum of the sizes.
    """
    n, rest, other_n, other_rest = (F.col(x) if isinstance(x, str) else x for x in (n, rest, other_n, other_rest))
    enough = F.least(rest, other_rest) * (SCALE + LEAST) >= (n + other_n) * LEAST
    return enough & (F.least(n, other_n) * SCALE >= F.greatest(n, other_n) * LEAST)


def mixed(posts: DataFrame, group: DataFrame) -> DataFrame:
    """`posts` with the nodes' components, only of the shingles that several components have, one of them so early
    that it suits a partner of equal size: the smaller set of a pair has its first shared shingle there."""
    placed = posts.join(group, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max(F.col("rest") * (SCALE + LEAST) >= F.col("n") * 2 * LEAST).alias("first")).where("lo <> hi and first").select("token")
    return placed.join(several, "token", "left_semi")


def between(group: DataFrame, new: DataFrame) -> DataFrame:
    """a, b: the components that the links `new` (a, b) connect."""
    a, b = (group.select(F.col("node").alias(c), F.col("component").alias(f"g{c}")) for c in "ab")
    ends = new.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ga", "a").alias("a"), F.coalesce("gb", "b").alias("b"))
    return ends.where("a <> b")


def renamed(group: DataFrame, root: DataFrame) -> DataFrame:
    """`group` after its components, and new nodes, have moved to the component that `root` (node, component) names."""
    named = root.select(F.col("node").alias("component"), F.col("component").alias("root"))
    old = group.join(named, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    return cut(old.unionByName(root.join(group.select("node"), "node", "left_anti")), free=True)


def grown(group: DataFrame, new: DataFrame) -> DataFrame:
    """node, component after each component has gone to the least one that a link names, and on to that one's own.

    This needs no loop and may leave links between components, which `merged` follows in the end.
    """
    ends = cut(between(group, new))
    one, other = ends.select(F.col("a").alias("node"), F.least("a", "b").alias("up")), ends.select(F.col("b").alias("node"), F.least("a", "b").alias("up"))
    up = cut(one.unionByName(other).groupBy("node").agg(F.min("up").alias("up")))
    over = up.select(F.col("node").alias("up"), F.col("up").alias("over"))
    return renamed(group, cut(up.join(over, "up", "left").select("node", F.coalesce("over", "up").alias("component"))))


def merged(group: DataFrame, links: DataFrame) -> DataFrame:
    """node, component (by all links) of all nodes in `group` and `links`."""
    return renamed(group, cut(components(between(group, links))))


def near_groups(docs: DataFrame, words: int = WORDS, seed: int = 1) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Two documents link when 100 * overlap >= 75 * union of their sets of distinct shingles; component_id is the
    smallest doc_id that links reach, the document's own included. A null text, or one without words, has no
    shingles and links with nothing. Rows that repeat get a row each; a row whose doc_id is null counts for links
    and gets the smallest doc_id of its component. Other columns play no part; an empty table gives an empty result.
    """
    return grouped(docs, words, seed).select("doc_id", "n_shingles", "component_id")


def grouped(docs: DataFrame, words: int = WORDS, seed: int = 1) -> DataFrame:
    """near_groups with sha, the digest of each text, and keep_sha: that of the component's first row, null ids last."""
    rows = cut(nodes(docs, words, seed))
    by_node = rows.where("node is not null").groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sha")).alias("first_id"), F.count(F.lit(1)).alias("copies"), F.min("check").alias("lo"), F.max("check").alias("hi")
    )
    by_node = cut(by_node)
    if not by_node.where("lo <> hi").isEmpty():  # two sets with one number: take other numbers
        return grouped(docs, words, seed + 2)
    group = cut(links(docs, words, seed))
    named = by_node.join(group, "node", "left").select("node", "first_id", "copies", F.coalesce("component", "node").alias("component"))
    named = cut(named, free=True)
    firsts = named.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("members"))
    by_node = look_up(named, firsts, "component", "members").select("node", "copies", F.col("component_id.doc_id").alias("component_id"), F.col("component_id.sha").alias("keep_sha"))
    some = look_up(rows.where("node is not null"), by_node, "node", "copies").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "sha", "keep_sha")
    none = rows.where("node is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "sha", F.col("sha").alias("keep_sha"))
    return some.unionByName(none)


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each component, that with the smallest doc_id (null last), then digest; all columns stay.

    A row is known by doc_id and text, so others of its doc_id, or without one too, are judged by their own text. Of rows
    that repeat both one stays; those without words stay all.
    """
    same = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("sha") == F.col("keep_sha"))
    gone = grouped(docs).where(~same).select("doc_id", "sha").distinct()
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    out = drop_rows(docs, [F.col("doc_id").cast("long"), sha], gone)
    if not repeats(docs):
        return out
    worded = F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return one_each(out.where(worded), sha).unionByName(out.where(~worded))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
