"""Maps of fixed size, made by all tasks and small enough for each: a bit or some for each hash."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import cut, fresh, trim

#: Slots of a set of wanted numbers, a bit each: 4 MB, whatever the input.
WANTED_BITS = 25
#: Partitions from which the driver gathers a map, one job after the other; a map of 32 MB comes in some 2 MB each.
GATHERED = 16


def mixed_bits(h: np.ndarray) -> np.ndarray:
    """The 64-bit numbers with their bits well mixed."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slot_map(blobs: DataFrame, buckets: int, slots: int, fill) -> list[tuple[int, bytes]]:
    """A map of fixed size, made by bucket: fill(bucket, [blob, ...]) gives the bucket's part. See `whole`.

    blobs: bucket int, data binary. The parts' sum is fixed, so gathering them is bounded. They are filled in as many
    partitions as a shuffle has, then dealt to GATHERED, since the driver takes a job for each that it gathers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket != now and held:
                    yield pa.RecordBatch.from_pydict({"bucket": [now], "part": [zlib.compress(fill(now, held), 1)]}, schema=schema)
                    held = []
                now = bucket
                held.append(data)
        if held:
            yield pa.RecordBatch.from_pydict({"bucket": [now], "part": [zlib.compress(fill(now, held), 1)]}, schema=schema)

    schema = pa.schema([("bucket", pa.int32()), ("part", pa.binary())])
    parts = blobs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "bucket int, part binary")
    each = slots // buckets
    return [(row["bucket"] * each, bytes(row["part"])) for row in parts.repartition(GATHERED).toLocalIterator()]


def whole(parts: list[tuple[int, bytes]], slots: int) -> np.ndarray:
    """The map's bytes, put together where it is used; the driver holds compressed parts only."""
    out = np.zeros(slots, np.uint8)
    for at, part in parts:
        own = np.frombuffer(zlib.decompress(part), np.uint8)
        out[at : at + len(own)] = own
    return out


def bucket_count(spark: SparkSession) -> int:
    """A power of two: four buckets for each shuffle partition, so that their size stays the same as data grow."""
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return 1 << max(4, min(16, n.bit_length()))


def wanted_map(wanted: DataFrame) -> list[tuple[int, bytes]]:
    """A bit for each number in the one column of `wanted` (long), by its hash; other numbers may share it."""
    buckets = bucket_count(wanted.sparkSession)
    each = (1 << WANTED_BITS) // buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = wanted_slot(batch.column(0).to_numpy())
            slot = np.unique(slot)
            bucket = slot // each
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            parts = np.split(slot % each, first[1:])
            yield pa.RecordBatch.from_pydict({"bucket": bucket[first], "data": [p.astype(np.uint32).tobytes() for p in parts]}, schema=schema)

    schema = pa.schema([("bucket", pa.int32()), ("data", pa.binary())])

    def fill(bucket: int, held: list[bytes]) -> bytes:
        part = np.zeros(each, np.uint8)
        part[np.concatenate([np.frombuffer(x, np.uint32) for x in held])] = 1
        return np.packbits(part).tobytes()

    return slot_map(wanted.mapInArrow(lambda b: run(x for x in b if x.num_rows), "bucket int, data binary"), buckets, 1 << (WANTED_BITS - 3), fill)


def wanted_slot(node: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mixed_bits(node.view(np.uint64)) >> np.uint64(64 - WANTED_BITS)).astype(np.int64)


def in_map(known: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Whether each number (int64) may be among those of which `known` is the map; never false for one that is."""
    slot = wanted_slot(numbers)
    return ((known[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1).astype(bool)


def may_have(rows: DataFrame, number: str, bits, name: str) -> DataFrame:
    """`rows` with the column `name`: whether the number (long, not null) may be in the broadcast map."""

    @pandas_udf("boolean")
    def may(every: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trim()
        known = whole(bits.value, 1 << (WANTED_BITS - 3))
        for numbers in every:
            yield pd.Series(in_map(known, numbers.to_numpy(np.int64)))

    return rows.withColumn(name, may(number))


def drop_rows(docs: DataFrame, keys: list[Column], gone: DataFrame) -> DataFrame:
    """`docs` without the rows whose keys are a row of `gone` (distinct, as many columns; nulls equal nulls).

    All columns stay, whatever their names. Most rows are not in a map of the keys' hashes and stay where they are; only
    the others are joined.
    """
    number, may, *names = fresh(docs, 2 + len(keys))
    gone = gone.toDF(*names)
    gone = cut(gone.withColumn(number, F.xxhash64(*names)))
    bits = docs.sparkSession.sparkContext.broadcast(wanted_map(gone.select(number)))
    marked = may_have(docs.withColumn(number, F.xxhash64(*keys)), number, bits, may)
    same = F.lit(True)
    for key, name in zip(keys, names, strict=True):
        same = same & key.eqNullSafe(F.col(name))
    left = marked.where(F.col(may)).hint("merge").join(gone.drop(number), same, "left_anti")
    return marked.where(~F.col(may)).unionByName(left).drop(may, number)
