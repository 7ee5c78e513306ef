"""Chat requests: bodies of conversations, their texts by path, and whether a stream is wanted."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.functions import jsontext as J

from .bodies import fields


def chat_body(turns: DataFrame) -> DataFrame:
    """request_id, body: a chat-completions request of each conversation (conv_id, turn, role, text)."""
    message = F.struct("turn", F.struct("role", F.col("text").alias("content")).alias("m"))
    lists = turns.groupBy(F.col("conv_id").alias("request_id")).agg(F.sort_array(F.collect_list(message)).alias("ms"))
    return lists.select("request_id", F.to_json(F.struct(F.lit("m").alias("model"), F.transform("ms", lambda x: x["m"]).alias("messages"))).alias("body"))


def chat_fields(bodies: DataFrame) -> DataFrame:
    """request_id, ord, path, text of a chat-completions request: content (or its text parts), then call arguments."""
    return fields(bodies, "chat_completions", "request").select("request_id", F.col("text_idx").alias("ord"), "path", "text")


def stream_wanted(body: str | None) -> bool:
    """Whether `stream` is true, a number but zero, or the string "1", "t" or "true" in any case."""
    value = J.find(J.read(body)[0], "stream") if body else None
    if value is None:
        return False
    said = body[value.start : value.end]
    if value.kind == '"':
        return J.decode(said).lower() in ("1", "t", "true")
    try:
        return said == "true" or float(said) != 0
    except ValueError:  # null, false, an object or an array
        return False


def wants_stream(bodies: DataFrame) -> DataFrame:
    """request_id, wants_stream: see `stream_wanted`; false for a null body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(stream_wanted, batch.column(1).to_pylist()), pa.bool_())], names=["request_id", "wants_stream"])

    return bodies.select(F.col("request_id").cast("long"), "body").mapInArrow(run, "request_id long, wants_stream boolean")
