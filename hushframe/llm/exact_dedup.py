"""Exact dedup by content-defined chunk recipes.

Each text is cut where a rolling hash of its last 32 bytes says so. A chunk's content goes through the shuffle once
for each task that holds it, to prove that its digest stands for one content only; from then on the digest is the
chunk's identifier, and documents are compared by their ordered lists of identifiers. A long document is never
moved: its recipe is some 16 bytes for every 4 KB.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, fresh, map_rows, table
from .graph import look_up
from .slots import drop_rows

MIN_CHUNK, MASK, MAX_CHUNK = 2048, (1 << 12) - 1, 32768
#: Random words for each byte value, from a fixed seed.
GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


def boundaries(data: bytes) -> list[int]:
    """Ends of the chunks of `data`; the last is its length. Empty data has none."""
    n = len(data)
    if n <= MIN_CHUNK:
        return [n] if n else []
    h = GEAR[np.frombuffer(data, np.uint8)]
    for w in (1, 2, 4, 8, 16):  # h[i]: sum of gear[data[i-k]] << k over the last 2w bytes
        g = h.copy()
        g[w:] += h[:-w] << np.uint32(w)
        h = g
    marks = np.flatnonzero(((h >> np.uint32(8)) & np.uint32(MASK)) == 0) + 1
    ends, at = [], 0
    while n - at > MIN_CHUNK:
        i = np.searchsorted(marks, at + MIN_CHUNK)
        end = int(marks[i]) if i < len(marks) else n
        at = min(end, at + MAX_CHUNK, n)
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def chunks(data: bytes, digest_bytes: int) -> Iterator[tuple[bytes, bytes]]:
    at = 0
    for end in boundaries(data):
        piece = data[at:end]
        yield hashlib.blake2b(piece, digest_size=digest_bytes).digest(), piece
        at = end


def recipes(docs: DataFrame, digest_bytes: int = 16) -> DataFrame:
    """doc_id, text_sha256, recipe (the chunks' digests in order) of each row; a null text counts as empty."""

    def f(columns: list[list]) -> list[list]:
        sha, made = [], []
        for text in columns[1]:
            data = (text or "").encode()
            sha.append(hashlib.sha256(data).hexdigest())
            made.append(b"".join(d for d, _ in chunks(data, digest_bytes)))
        return [columns[0], sha, made]

    return map_rows(docs, ["doc_id", "text"], "doc_id long, text_sha256 string, recipe binary", f)


def chunk_contents(docs: DataFrame, digest_bytes: int) -> DataFrame:
    """digest, data of the chunks: each content once from each task, since `distinct` drops repeats before the shuffle."""

    def f(columns: list[list]) -> list[list]:
        out: dict[tuple[bytes, bytes], None] = {}
        for text in columns[0]:
            out.update(dict.fromkeys(chunks((text or "").encode(), digest_bytes)))
        return [[d for d, _ in out], [p for _, p in out]]

    return map_rows(docs, ["text"], "digest binary, data binary", f).distinct()


def exact_groups(docs: DataFrame, digest_bytes: int = 16) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. The row with the largest doc_id stays (a null doc_id is
    below all others). Rows that repeat a doc_id and its text count each in group_size and share one decision.
    Other columns of `docs`, whatever their names, play no part; an empty table gives an empty one.
    `digest_bytes` under 16 exists to try what happens when digests collide: contents then get numbered
    identifiers, and the result is the same.
    """
    rows = cut(recipes(docs, digest_bytes))
    contents = chunk_contents(docs, digest_bytes)
    clashing = contents.groupBy("digest").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1").select("digest")
    clashing = cut(clashing, free=True)  # contents went through a shuffle
    if not clashing.isEmpty():
        rows = cut(numbered_recipes(docs, rows, contents.join(clashing, "digest", "left_semi"), digest_bytes))
    groups = cut(rows.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.first("text_sha256").alias("sha")))
    # Equal recipes are equal texts; their digest finds a hot group's row without moving its documents.
    return look_up(rows.withColumnRenamed("text_sha256", "sha"), groups.select("sha", "keep_id", "group_size"), "sha", "group_size").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def numbered_recipes(docs: DataFrame, rows: DataFrame, contents: DataFrame, digest_bytes: int) -> DataFrame:
    """Recipes in which digests of several contents are followed by the content's number (others by 0)."""
    order = Window.partitionBy("digest").orderBy("data")
    numbers = contents.select("digest", "data", F.row_number().over(order).alias("number"))

    def f(columns: list[list]) -> list[list]:
        out: list[list] = [[], [], [], [], []]
        for doc_id, text in zip(*columns, strict=True):
            data = (text or "").encode()
            sha = hashlib.sha256(data).hexdigest()
            for i, (digest, piece) in enumerate(chunks(data, digest_bytes)):
                for column, value in zip(out, (doc_id, sha, i, digest, piece), strict=True):
                    column.append(value)
        return out

    uses = map_rows(docs, ["doc_id", "text"], "doc_id long, text_sha256 string, i int, digest binary, data binary", f)
    part = F.concat(F.hex("digest"), F.lit(":"), F.coalesce("number", F.lit(0)).cast("string"))
    named = uses.join(numbers, ["digest", "data"], "left").select("doc_id", "text_sha256", F.struct("i", part.alias("part")).alias("p"))
    # Rows that repeat doc_id and text give the same parts; the set drops the repeats and the recipe stays right.
    lists = named.groupBy("doc_id", "text_sha256").agg(F.array_sort(F.collect_set("p")).alias("ps"))
    lists = lists.select(F.col("doc_id").alias("__d"), F.col("text_sha256").alias("__s"), F.array_join(F.transform("ps", lambda p: p["part"]), ",").cast("binary").alias("__r"))
    joined = rows.join(lists, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("text_sha256") == F.col("__s")), "left")
    return joined.select("doc_id", "text_sha256", F.coalesce("__r", F.lit(b"")).alias("recipe"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """`docs` without the rows that exact dedup drops; all columns stay, whatever their names.

    Rows are known by doc_id and text, a null text being an empty one. Of rows that repeat both one stays, also where
    they have no doc_id. An empty table stays empty.
    """
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    gone = exact_groups(docs).where("not kept").select("doc_id", "text_sha256").distinct()
    out = drop_rows(docs, [F.col("doc_id").cast("long"), sha], gone)
    return one_each(out, sha) if repeats(docs) else out


def one_each(docs: DataFrame, sha: Column) -> DataFrame:
    """One row of those that have the same doc_id and digest."""
    (name,) = fresh(docs, 1)
    return docs.withColumn(name, sha).dropDuplicates(["doc_id", name]).drop(name)


def repeats(docs: DataFrame) -> bool:
    """Whether some doc_id comes more than once."""
    return not docs.groupBy("doc_id").count().where("count > 1").isEmpty()


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
"""
