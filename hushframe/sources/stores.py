"""Writing results to a key-value store and to a database, from the executors."""

from __future__ import annotations

import contextlib
import itertools
import random
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StreamingQuery

from hushframe.operators.gateway import current_values

#: Writes that one round trip carries.
STEP = 1000


class Pipe(Protocol):
    def set(self, key: str, value: str, ex: int | None = None) -> object: ...
    def execute(self) -> object: ...


class Client(Protocol):
    """What is asked of a store's client; the usual Python client of Redis has it."""

    def pipeline(self, transaction: bool = ...) -> Pipe: ...
    def mget(self, keys: list[str]) -> list: ...
    def close(self) -> None: ...


def write_keys(rows: DataFrame, connect: Callable[[], Client], key: str, value: str, order: list[str], ttl_s: int | None = None) -> None:
    """Sets each key to its last value by `order`. A task that is run again sets the same values again."""

    def send(part: Iterator[Row]) -> None:
        client = connect()
        try:
            pipe, n = client.pipeline(transaction=False), 0
            for n, row in enumerate(part, 1):
                pipe.set(row[0], row[1], ex=ttl_s)
                if n % STEP == 0:
                    pipe.execute()
            if n % STEP:
                pipe.execute()
        finally:
            client.close()

    last = current_values(rows.select(key, value, *(c for c in order if c not in (key, value))), key, order)
    last.select(last[key].cast("string"), last[value].cast("string")).foreachPartition(send)


def stream_keys(rows: DataFrame, connect: Callable[[], Client], key: str, value: str, order: list[str], checkpoint: str, ttl_s: int | None = None) -> StreamingQuery:
    """`write_keys` for each micro-batch of a stream; a batch that is run again sets the same values."""
    writer = rows.writeStream.foreachBatch(lambda batch, _: write_keys(batch, connect, key, value, order, ttl_s))
    return writer.option("checkpointLocation", checkpoint).start()


def read_keys(rows: DataFrame, connect: Callable[[], Client], key: str, load: Callable[[list[str]], list[str | None]] | None = None, ttl_s: int | None = None) -> DataFrame:
    """`key` and `value` of each row: what the store holds, null for what it lacks.

    With `load` it is a read-through cache: what is lacking is asked of `load`, and put into the store if that knows it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = connect()
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, STEP):
                    keys = batch.column(0).slice(at, STEP).to_pylist()
                    asked = [k for k in dict.fromkeys(keys) if k is not None]
                    held = dict(zip(asked, map(_text, client.mget(asked)), strict=True)) if asked else {}
                    lacking = [k for k, v in held.items() if v is None]
                    if load and lacking:
                        held.update(zip(lacking, load(lacking), strict=True))
                        pipe = client.pipeline(transaction=False)
                        for k in lacking:
                            if held[k] is not None:
                                pipe.set(k, held[k], ex=ttl_s)
                        pipe.execute()
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([held.get(k) for k in keys], pa.string())], names=[key, "value"])
        finally:
            client.close()

    return rows.select(rows[key].cast("string")).mapInArrow(run, f"`{key}` string, value string")


def _text(value: bytes | str | None) -> str | None:
    return value.decode() if isinstance(value, bytes) else value


def each_key(rows: DataFrame, connect: Callable[[], Client], command: str, key: str, *columns: str) -> None:
    """A command for each row, in pipelines: delete, expire, incrby, hset, sadd, lpush and others of a key and values.

    Spark may run a task again, so only commands that may be repeated keep their meaning for certain.
    """

    def send(part: Iterator[Row]) -> None:
        client = connect()
        try:
            pipe, n = client.pipeline(transaction=False), 0
            for n, row in enumerate(part, 1):
                getattr(pipe, command)(*row)
                if n % STEP == 0:
                    pipe.execute()
            if n % STEP:
                pipe.execute()
        finally:
            client.close()

    rows.select(rows[key].cast("string"), *columns).foreachPartition(send)


def retried(call: Callable[[], None], attempts: int = 4, base_s: float = 0.1, most_s: float = 5.0, sleep: Callable[[float], object] = time.sleep) -> None:
    """Calls until it works, at most `attempts` times, after pauses that double and have full jitter."""
    for n in range(attempts):
        try:
            return call()
        except Exception:
            if n + 1 == attempts:
                raise
            sleep(random.uniform(0, min(most_s, base_s * 2**n)))


def upsert_sql(table: str, columns: list[str], keys: list[str], mark: str = "%s") -> str:
    """Inserts a row, or gives the row of its keys these values: the same if it is done twice."""
    rest = [c for c in columns if c not in keys]
    then = "UPDATE SET " + ", ".join(f"{c} = excluded.{c}" for c in rest) if rest else "NOTHING"
    return f"INSERT INTO {table} ({', '.join(columns)}) VALUES ({', '.join([mark] * len(columns))}) ON CONFLICT ({', '.join(keys)}) DO {then}"


def upsert(rows: DataFrame, connect: Callable[[], object], table: str, keys: list[str], most: int = 32, mark: str = "%s") -> None:
    """Writes rows by their keys over at most `most` connections of Python's database interface; each step is one
    transaction, tried again if it fails, and a task that is run again writes the same."""
    statement, columns = upsert_sql(table, rows.columns, keys, mark), rows.columns

    def send(part: Iterator[Row]) -> None:
        while step := [tuple(r) for r in itertools.islice(part, STEP)]:

            def write(step=step) -> None:
                with contextlib.closing(connect()) as connection:
                    connection.cursor().executemany(statement, step)
                    connection.commit()

            retried(write)

    rows.dropDuplicates(keys).select(*columns).coalesce(most).foreachPartition(send)


def read_database(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 64, **options: str) -> DataFrame:
    """A table over JDBC. With an integer `key` and its bounds it is read in `parts` ranges, else in one task."""
    read = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and bounds:
        read = read.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return read.load()


def write_database(rows: DataFrame, url: str, table: str, most: int = 32, **options: str) -> None:
    """Appends rows over JDBC, over at most `most` connections at a time."""
    rows.coalesce(most).write.format("jdbc").options(url=url, dbtable=table, batchsize=STEP, **options).mode("append").save()
