"""Approximate nearest neighbours by inner product: score-aware (anisotropic) quantisation, table scans, exact ranking.

Vectors are cut into pairs of components, each coded by one of 16 centres, four bits. Centres and codes minimise a loss
that weighs the part of the residual that is parallel to the vector more than the rest, since it is that part which
changes large inner products. Vectors stay in place and are scanned tile by tile: two codes make a byte, a table of 256
partial sums a byte is looked up and added, and the best by table are ranked by the exact inner product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, table

NEIGHBOURS = 20
#: Vectors on which centres are fitted; all vectors are coded and searched.
SAMPLE = 16_384
CENTRES, WIDTH = 16, 2
#: Vectors of a tile, and how many different vectors of a tile are ranked exactly for a query.
TILE_VECTORS, RANKED = 16_384, 256
#: Bytes of the queries that go to all tasks at a time.
QUERY_BYTES = 16 << 20
#: Inner products from this share of the largest upwards count in the loss.
THRESHOLD = 0.2


def eta(dim: int) -> float:
    """How much more the parallel residual weighs, for queries uniform on the sphere."""
    return max(1.0, (dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))


def _shaped(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and their directions as (row, part, WIDTH), padded with zeros."""
    pad = -x.shape[1] % (2 * WIDTH)
    x = np.pad(x.astype(np.float32), ((0, 0), (0, pad)))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return x.reshape(len(x), -1, WIDTH), u.reshape(len(x), -1, WIDTH)


def encode(x: np.ndarray, centres: np.ndarray, weight: float, rounds: int = 2) -> np.ndarray:
    """(row, part) codes: part by part the centre of least loss, the other parts' codes held."""
    x, u = _shaped(x)
    codes = np.empty(x.shape[:2], np.uint8)
    own = np.empty(x.shape[:2], np.float32)  # the parallel residual of each part
    for m in range(x.shape[1]):
        r = x[:, m, None, :] - centres[m][None]
        codes[:, m] = (r**2).sum(axis=2).argmin(axis=1)
        own[:, m] = ((x[:, m] - centres[m][codes[:, m]]) * u[:, m]).sum(axis=1)
    along = own.sum(axis=1)
    for _ in range(rounds):
        for m in range(x.shape[1]):
            r = x[:, m, None, :] - centres[m][None]
            parallel = (r * u[:, m, None, :]).sum(axis=2)
            rest = along - own[:, m]
            codes[:, m] = ((r**2).sum(axis=2) + (weight - 1) * (rest[:, None] + parallel) ** 2).argmin(axis=1)
            own[:, m] = np.take_along_axis(parallel, codes[:, m, None].astype(np.int64), axis=1)[:, 0]
            along = rest + own[:, m]
    return codes


def fit(sample: np.ndarray, rounds: int = 6) -> tuple[np.ndarray, float]:
    """Centres (part, CENTRES, WIDTH) and the parallel weight, by turns of coding and solving for the centres."""
    weight = eta(sample.shape[1])
    x, u = _shaped(sample)
    rng = np.random.default_rng(11)
    centres = np.stack([x[rng.choice(len(x), CENTRES, replace=len(x) < CENTRES), m] for m in range(x.shape[1])])
    eye = np.eye(WIDTH, dtype=np.float32)
    for turn in range(rounds):
        codes = encode(sample, centres, weight, rounds=int(turn > 1))
        residual = np.stack([x[:, m] - centres[m][codes[:, m]] for m in range(x.shape[1])], axis=1)
        own = (residual * u).sum(axis=2)
        along = own.sum(axis=1)
        for m in range(x.shape[1]):
            a = eye + (weight - 1) * u[:, m, :, None] * u[:, m, None, :]
            b = (a @ x[:, m, :, None])[..., 0] + (weight - 1) * (along - own[:, m])[:, None] * u[:, m]
            for c in range(CENTRES):
                held = codes[:, m] == c
                if held.any():
                    centres[m, c] = np.linalg.solve(a[held].sum(axis=0) + 1e-6 * eye, b[held].sum(axis=0))
    return centres, weight


def scan(queries: np.ndarray, packed: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(query, vector) sums of table entries: a table for each byte, that is for two parts' codes."""
    q = np.pad(queries.astype(np.float32), ((0, 0), (0, len(centres) * WIDTH - queries.shape[1]))).reshape(len(queries), len(centres), WIDTH)
    part = np.einsum("qmw,mcw->mqc", q, centres)
    total = np.zeros((len(queries), len(packed)), np.float32)
    for j in range(packed.shape[1]):
        both = (part[2 * j + 1][:, :, None] + part[2 * j][:, None, :]).reshape(len(queries), -1)  # high half, low half
        total += np.take(both, packed[:, j], axis=1)
    return total


def best_of_tile(qid, queries, ids, vectors, packed, centres, k: int, ranked: int) -> Iterator[tuple]:
    """(query_id, vec_id, score) arrays of each query's k best in the tile. Equal vectors are scanned once."""
    order = np.lexsort((ids, *vectors.T[::-1]))
    ids, vectors, packed = ids[order], vectors[order], packed[order]
    new = np.concatenate([[True], (vectors[1:] != vectors[:-1]).any(axis=1)])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(ids)))
    wide = vectors[first].astype(np.float64)
    r = min(ranked, len(first))
    for at in range(0, len(queries), 64):
        own = queries[at : at + 64].astype(np.float64)
        table_sums = scan(queries[at : at + 64], packed[first], centres)
        pick = np.argpartition(-table_sums, r - 1, axis=1)[:, :r]
        score = np.zeros(pick.shape)
        for d in range(own.shape[1]):  # one component after the other: equal vectors get equal sums
            score += own[:, d, None] * wide[pick, d]
        for i in range(len(own)):
            n = np.minimum(size[pick[i]], k + 1)  # the k + 1 smallest ids of equal vectors, the query's own among them
            row = np.repeat(first[pick[i]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            s, v = np.repeat(score[i], n), ids[row]
            other = v != qid[at + i]
            s, v = s[other], v[other]
            top = np.lexsort((v, -s))[:k]
            yield np.full(len(top), qid[at + i]), v[top], s[top]


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, v: rows that take part, those of the most common length (the longest of several), each once; v is an array
    of float if the column is one, else of double."""
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{kind}>").alias("v")).where("vec_id is not null and v is not null")
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    dim = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return rows.where(F.size("v") == (dim["dim"] if dim else 0))


def sampled(rows: DataFrame, n: int) -> list:
    """v, lo, hi: some SAMPLE different vectors of `rows`, those with the least hashes, and the least and largest vec_id
    that each has; all, if there are fewer.

    Copies of one vector have one hash, so a sample by hash may miss them all: a larger share is tried then.
    """
    share = 1.0 if n <= SAMPLE else SAMPLE / n
    while True:
        some = rows.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
        found = some.groupBy("v").agg(F.min("vec_id").alias("lo"), F.max("vec_id").alias("hi")).limit(4 * SAMPLE).collect()  # the sample's documented bound
        if share >= 1 or len(found) >= SAMPLE // 4:
            return found
        share = min(1.0, share * 16)


def least_scores(qid: np.ndarray, q: np.ndarray, sample: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int) -> np.ndarray:
    """For each query a score that its k best all reach: that of the k-th best in the sample, a little less.

    Vectors that only the query's own vec_id has are no candidates. Without k others there is no bound.
    """
    out = np.full(len(q), -np.inf)
    if len(sample) < k:
        return out
    for at in range(0, len(q), 256):
        score = q[at : at + 256].astype(np.float64) @ sample.T
        own = qid[at : at + 256, None]
        score[(lo[None] == own) & (hi[None] == own)] = -np.inf
        best = np.partition(score, len(sample) - k, axis=1)[:, len(sample) - k]
        out[at : at + 256] = best - 1e-6 * (1 + np.abs(np.where(np.isfinite(best), best, 0)))
    return out


def merged_best(parts: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query_id, vec_id, score of each query's k best of all parts, ties to the smaller vec_id."""
    q, v, s = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return q[rank < k], v[rank < k], s[rank < k]


def search(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, ranked: int = RANKED) -> DataFrame:
    """query_id, rank, vec_id, score of the k largest inner products found for each query, ties to the smaller vec_id.

    `vectors` and `queries` have vec_id and embedding; other columns, whatever their names, play no part. A query's own
    vec_id is no candidate. Vectors that are null, zero, of another length than most, or hold null or non-finite
    components take no part, and so with a null vec_id; rows that repeat count once. With too few candidates all are
    returned; empty tables give an empty result.

    The index stays where it is: a bounded lot of queries goes to all tasks at a time, each scans its vectors in tiles
    and keeps the k best of a query. Of these it sends on those that reach the k-th best of the sample, so what is merged
    grows with the queries and with how much larger the table is than the sample, not with the tasks.
    """
    spark = vectors.sparkSession
    result = "query_id long, vec_id long, score double"
    rows = valid(vectors)
    n = rows.count()
    sample = sampled(rows, n) if n else []
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    centres, weight = fit(np.unique(np.array([r["v"] for r in sample], np.float32), axis=0))
    dim = len(sample[0]["v"])
    number = np.float32 if "float" in rows.schema["v"].dataType.elementType.typeName() else np.float64

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, dim)
                codes = encode(x.astype(np.float32), centres, weight)
                packed = codes[:, 0::2] | (codes[:, 1::2] << 4)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in packed], pa.binary())], names=["vec_id", "v", "code"])

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // TILE_VECTORS))
    index = cut(rows.mapInArrow(code, "vec_id long, v binary, code binary").repartition(tasks, "vec_id", "v").dropDuplicates(["vec_id", "v"]), free=True)
    vectors_ = np.array([r["v"] for r in sample], np.float64)
    seen = spark.sparkContext.broadcast((vectors_, np.array([r["lo"] for r in sample]), np.array([r["hi"] for r in sample])))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, dim)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(least_scores(batch.column(0).to_numpy(), q, *seen.value, k))], names=["vec_id", "v", "least"])

    own = valid(queries).where(F.size("v") == dim).select("vec_id", "v").distinct()
    own = cut(own.mapInArrow(bounded, f"vec_id long, v {own.schema['v'].dataType.simpleString()}, least double"))
    lots = -(-max(1, own.count()) * dim * 8 // QUERY_BYTES)

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, TILE_VECTORS):
                part = batch.slice(at, TILE_VECTORS)
                if held and n + part.num_rows > TILE_VECTORS:
                    yield pa.Table.from_batches(held)
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if n:
            yield pa.Table.from_batches(held)

    def scanned(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qid, q, least = shared.value
            order = np.argsort(qid, kind="stable")
            ids = qid[order]
            first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            ids, least = ids[first], np.minimum.reduceat(least[order], first)  # of a vec_id that comes with several vectors
            best: list[tuple] = []
            for tile in tiles(batches):
                x = np.frombuffer(b"".join(tile.column("v").to_pylist()), number).reshape(tile.num_rows, dim)
                packed = np.frombuffer(b"".join(tile.column("code").to_pylist()), np.uint8).reshape(tile.num_rows, -1)
                best = [merged_best(best + list(best_of_tile(qid, q, tile.column("vec_id").to_numpy(), x, packed, centres, k, ranked)), k)]
            for found in best:
                kept = found[2] >= least[np.searchsorted(ids, found[0])]
                yield pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in found], names=["query_id", "vec_id", "score"])

        return run

    found = None
    for lot in range(lots):
        asked = own.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(lots)) == lot).orderBy("vec_id", "v").toArrow()  # some QUERY_BYTES of vectors
        if not asked.num_rows:
            continue
        q = asked.column("v").combine_chunks().flatten().to_numpy().reshape(asked.num_rows, dim)
        shared = spark.sparkContext.broadcast((asked.column("vec_id").to_numpy(), q, asked.column("least").to_numpy()))
        part = index.mapInArrow(scanned(shared), result)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        part = part.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if lots > 1:
            part = cut(part)
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return found


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 20 = 0"))
