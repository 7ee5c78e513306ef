"""What the operators of this subpackage share: reading tables, cutting lineage, numbering rows."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Rows of a table that a driver may gather or a broadcast may hold; every use names the reason for its bound.
SMALL_ROWS = 1 << 16
#: Text that one step of Python code takes at once, in characters (a longer text is taken alone and whole).
STEP_CHARS = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table of this name; Spark alone opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, n: int) -> list[str]:
    """`n` names that no column of `df` has."""
    taken = {c.lower() for c in df.columns}
    return [name for name in (f"__{i}" for i in range(len(taken) + n)) if name not in taken][:n]


def cut(df: DataFrame, free: bool = False) -> DataFrame:
    """`df`, computed once and kept in the shared folder of spark.checkpoint.dir, so that lost executors lose nothing.

    `free` removes at once what led here, which is worth its while after large shuffles; other files go as the driver
    collects its garbage. Where the session names no folder, one in the working folder is taken and left for later
    sessions to reuse; on a cluster that is an error, as a folder of one machine can't be read by the others.
    """
    spark = df.sparkSession
    shared_folder(spark)
    kept = df.checkpoint(eager=True)
    if free:
        del df
        release(spark)
    return kept


def shared_folder(spark: SparkSession) -> str:
    """The folder of this session's checkpoints, in the one that spark.checkpoint.dir names."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(folder or os.path.abspath(".checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """`df`, written as Parquet to a new folder of the shared one and read again."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    release(df.sparkSession)
    return df.sparkSession.read.parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark remove shuffle, checkpoint and broadcast files to which nothing refers any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def number_within(df: DataFrame, keys: list[str], order: list[str], name: str, spread: int = 1024) -> DataFrame:
    """`df` with the column `name`: 0, 1, 2, ... without gaps within each value of `keys`.

    A key may hold any share of the rows: its rows are dealt to `spread` lots by a hash of `order`, counted by
    lot, and numbered within their lot after the rows of earlier lots. No task sees a key's rows together.
    `df` is read twice and must be the same both times (see `cut`).
    """
    lot = "__lot"
    dealt = df.withColumn(lot, F.pmod(F.xxhash64(*order), F.lit(spread)).cast("int"))
    counts = dealt.groupBy(*keys, lot).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy(lot).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, lot, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    rank = F.row_number().over(Window.partitionBy(*keys, lot).orderBy(*order)) - 1
    return (
        dealt.withColumn("__rank", rank)
        .join(starts, [*keys, lot])
        .withColumn(name, (F.col("__start") + F.col("__rank")).cast("long"))
        .drop(lot, "__rank", "__start")
    )


@cache
def _malloc_trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):  # another C library than glibc
        return None


def trim() -> None:
    """Gives back the memory that this process has freed but kept. Workers serve one task after the other and share their
    executor's memory, so what one keeps of past tasks the others lack."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim():
        _malloc_trim()(0)


def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of at most STEP_CHARS bytes of data, one row at least; freed memory is given back meanwhile."""
    trim()
    for batch in batches:
        n = max(1, -(-batch.nbytes // STEP_CHARS))
        size = max(1, batch.num_rows // n)
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)
            trim()


def map_rows(df: DataFrame, columns: list[str], schema: str, f: Callable[[list[list]], list[list]]) -> DataFrame:
    """`f` turns lists of the columns' values, in pieces of bounded size, into lists of the result's columns."""
    struct = T._parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(struct)
        for batch in steps(batches):
            made = f([batch.column(i).to_pylist() for i in range(batch.num_columns)])
            if made[0]:
                yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(made, out, strict=True)], schema=out)

    return df.select(*columns).mapInArrow(run, struct)
