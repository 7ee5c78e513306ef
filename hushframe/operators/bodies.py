"""Texts inside the JSON bodies of three wire formats, with their places, and bodies with those texts replaced.

What a format holds is declared by visitors: each takes a value and its path and gives the fields below it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.functions import jsontext as J


class Field(NamedTuple):
    path: J.Path
    start: int
    end: int
    text: str
    is_raw: bool


Visit = Callable[[str, J.Value, J.Path], Iterator[Field]]


def text(*keys: str) -> Visit:
    """The string at these keys, unless it is empty."""

    def visit(body, value, path):
        found = J.find(value, *keys)
        if found and found.kind == '"' and found.end - found.start > 2:
            yield Field((*path, *keys), found.start, found.end, J.decode(body[found.start : found.end]), False)

    return visit


def each(key: str, *visits: Visit) -> Visit:
    """All visits on every element of the array at the key."""

    def visit(body, value, path):
        for i, x in enumerate(J.elements(J.find(value, key))):
            for v in visits:
                yield from v(body, x, (*path, key, i))

    return visit


def text_or_each(key: str, *visits: Visit) -> Visit:
    return lambda body, value, path: (yield from (v for way in (text(key), each(key, *visits)) for v in way(body, value, path)))


def typed(other: Visit | None = None, **kinds: list[Visit]) -> Visit:
    """The visits for what the value's `type` says; `other` for every other type."""

    def visit(body, value, path):
        kind = J.find(value, "type")
        name = J.decode(body[kind.start : kind.end]) if kind and kind.kind == '"' else ""
        for v in kinds.get(name, [other] if other else []):
            yield from v(body, value, path)

    return visit


def leaves(key: str) -> Visit:
    """Every string below the key that is not empty."""

    def visit(body, value, path):
        for at, x in J.string_leaves(J.find(value, key), (*path, key)):
            if x.end - x.start > 2:
                yield Field(at, x.start, x.end, J.decode(body[x.start : x.end]), False)

    return visit


def raw(key: str) -> Visit:
    """The object at the key as it stands, unless it is {}."""

    def visit(body, value, path):
        x = J.find(value, key)
        if x and x.kind == "{" and body[x.start : x.end] != "{}":
            yield Field((*path, key), x.start, x.end, body[x.start : x.end], True)

    return visit


CALLS = (text("function_call", "arguments"), each("tool_calls", text("function", "arguments")))
TEXT_PART = typed(text=[text("text")])
ITEM_PART = typed(output_text=[text("text")], input_text=[text("text")], text=[text("text")])
# The fields of an item of a response.
RESPONSE_ITEM = typed(
    message=[each("content", typed(output_text=[text("text")]))], function_call=[text("arguments")],
    reasoning=[each("summary", typed(summary_text=[text("text")])), each("content", typed(reasoning_text=[text("text")]))],
)
# The fields of each format, in the order in which they are given.
FORMATS: dict[tuple[str, str], list[Visit]] = {
    ("chat_completions", "request"): [each("messages", text_or_each("content", TEXT_PART), *CALLS)],
    ("chat_completions", "response"): [each("choices", lambda b, v, p: (f for m in [J.find(v, "message")] if m for go in (text("content"), text("reasoning"), text("reasoning_content"), text("refusal"), *CALLS) for f in go(b, m, (*p, "message"))))],
    ("messages", "request"): [
        text_or_each("system", TEXT_PART),
        each("messages", text_or_each("content", typed(text=[text("text")], tool_use=[leaves("input")], tool_result=[text_or_each("content", TEXT_PART)]))),
    ],
    ("messages", "response"): [each("content", typed(text=[text("text")], thinking=[text("thinking")], tool_use=[raw("input")]))],
    ("responses", "request"): [
        text("instructions"),
        text_or_each("input", typed(text_or_each("content", ITEM_PART), function_call_output=[text_or_each("output", ITEM_PART)], function_call=[text("arguments")])),
    ],
    ("responses", "response"): [each("output", RESPONSE_ITEM)],
}


def extract(format: str, direction: str, body: str | None) -> list[Field] | None:
    """The body's fields; None if the format, or a request without what the format asks for, is not supported."""
    visits = FORMATS.get((format, direction))
    if visits is None or body is None:
        return None
    root, _ = J.read(body)
    if direction == "request":
        messages = J.find(root, "messages")
        if format == "chat_completions" and (not messages or messages.kind != "["):
            return None
        if format == "responses" and not (J.find(root, "input") or J.find(root, "instructions")):
            return None
    return [f for v in visits for f in v(body, root, ())] if root else []


FIELDS = "request_id long, text_idx int, path string, start int, end int, text string, is_raw boolean"


def fields(bodies: DataFrame, format: str, direction: str) -> DataFrame:
    """One row per field: see FIELDS; text_idx counts a body's fields. `bodies`: request_id, body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                (key, i, ".".join(map(str, f.path)), *f[1:])
                for key, body in zip(*(c.to_pylist() for c in batch.columns), strict=True)
                for i, f in enumerate(extract(format, direction, body) or [])
            ]
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_())
            columns = zip(*out, strict=True) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["request_id", "text_idx", "path", "start", "end", "text", "is_raw"])

    return bodies.select(F.col("request_id").cast("long"), "body").mapInArrow(run, FIELDS)


def patch(bodies: DataFrame, edits: DataFrame) -> DataFrame:
    """request_id, body: the bodies with the fields of `edits` (request_id, start, end, text, is_raw) replaced, all else as it was."""
    lists = edits.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "text", "is_raw"))).alias("edits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, edits = (c.to_pylist() for c in batch.columns)
            done = [t if t is None or not es else J.splice(t, [(e["start"], e["end"], e["text"] if e["is_raw"] else J.encode(e["text"])) for e in es]) for t, es in zip(texts, edits, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(done, pa.string())], names=["request_id", "body"])

    joined = bodies.select(F.col("request_id").cast("long"), "body").join(lists, "request_id", "left")
    return joined.mapInArrow(run, "request_id long, body string")
