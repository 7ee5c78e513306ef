"""Restoring originals inside event streams of three wire formats, whose texts come in pieces.

A dialect reads frames and gives frames out. All that it keeps between two chunks is text and numbers (`dump`, `load`):
the frame that has not ended, and for each field the end of its text, bounded by the longest placeholder. Values that
are not changed stay as they were written, since frames are edited in place.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hushframe.functions import jsontext as J
from hushframe.operators import bodies
from hushframe.operators.restore import Restorer, restore_json, with_known

BREAK = re.compile(r"\r\n\r\n|\n\n")


class Closing:
    """Whether the JSON object of a text that comes in pieces has ended; braces inside strings don't count."""

    def __init__(self, depth: int = 0, inside: bool = False, escaped: bool = False) -> None:
        self.state = [depth, inside, escaped]

    def feed(self, piece: str) -> bool:
        depth, inside, escaped = self.state
        closed = False
        for c in piece:
            if inside:
                inside, escaped = c != '"' or escaped, c == "\\" and not escaped
            elif c == '"':
                inside = True
            elif c in "{[":
                depth += 1
            elif c in "}]":
                depth -= 1
                closed |= depth == 0
        self.state = [depth, inside, escaped]
        return closed


class EventStream:
    """One stream, passed on as it is; the dialects below override `event` and `frame_of`. `recorded` gets each field's text before it is restored, arguments left out."""

    def __init__(self, known: list[tuple[str, str]] = (), kinds: list[str] = (), record: bool = False) -> None:
        self.pairs, self.kinds = list(known), list(kinds)
        self.restorers = Restorer(self.pairs, self.kinds), Restorer(self.pairs, self.kinds, in_json=True)
        self.tail, self.held, self.notes = "", {}, {}
        self.recorded: dict[str, str] | None = {} if record else None

    def dump(self) -> str:
        return json.dumps([self.tail, self.held, self.notes])

    def load(self, said: str) -> None:
        self.tail, self.held, self.notes = json.loads(said)

    def feed(self, chunk: str, end: bool = False) -> str:
        """What can be given out now; everything at the end."""
        text, at, out = self.tail + chunk, 0, []
        for m in BREAK.finditer(text, max(0, len(self.tail) - 3)):
            out.append(self._frame(text[at : m.end()]))
            at = m.end()
        self.tail = text[at:]
        if end:
            out.append(self._frame(self.tail) if self.tail else "")
            self.tail = ""
            out.append(self.flush())
        return "".join(out)

    def _frame(self, raw: str) -> str:
        lines = re.split(r"\r?\n", raw.rstrip("\r\n"))
        said = [x[5:].removeprefix(" ") for x in lines if x.startswith("data:")]
        if not said:
            return raw
        data = "\n".join(said)
        if data == "[DONE]":
            return self.flush() + raw
        before = self.dump()
        try:
            root, whole = J.read(data)
            out = self.event(data, root) if whole and root.kind == "{" else None
        except Exception:  # a stream is never broken off for a frame that cannot be read: it is passed on as it came
            self.load(before)
            return raw
        if out is None:
            return raw
        kept = "".join(f"{x}\n" for x in lines if not x.startswith("data:"))
        return "".join(f if isinstance(f, str) else raw if f[0] == data else build(f[0], kept) for f in out)

    def event(self, data: str, root: J.Value) -> list[str | tuple[str]] | None:
        """The frames for an event: whole frames as text, and in tuples the data of frames like the given one; None for the frame itself."""
        return None

    def frame_of(self, key: str, text: str) -> str:
        """A frame that adds this text to the field."""
        raise NotImplementedError

    def take(self, key: str, text: str, in_json: bool = False, end: bool = False) -> str:
        if self.recorded is not None and not in_json and text:
            self.recorded[key] = self.recorded.get(key, "") + text
        restorer = self.restorers[in_json]
        restorer.pending = self.held.get(key, ["", in_json])[0]
        out = restorer.feed(text, end)
        self.held[key] = [restorer.pending, in_json]
        if end:
            del self.held[key]
        return out

    def flush(self, *starts: str) -> str:
        """Frames with what is held of all fields, or of those whose key starts so."""
        out = []
        for key, (_, in_json) in list(self.held.items()):
            if not starts or key.startswith(starts):
                text = self.take(key, "", in_json, True)
                out.append(self.frame_of(key, text) if text else "")
        return "".join(out)


def build(data: str, before: str = "") -> str:
    return before + "".join(f"data: {x}\n" for x in data.split("\n")) + "\n"


def said(data: str, value: J.Value | None) -> str:
    """A string's text; nothing for any other value."""
    return J.decode(data[value.start : value.end]) if value and value.kind == '"' else ""


def written(data: str, value: J.Value | None, other: str = "null") -> str:
    return data[value.start : value.end] if value else other


class ChatCompletions(EventStream):
    """Fields by choice: content, reasoning, and arguments of tool calls, which end as soon as their object does.

    The first content ends the reasoning. A frame with text and an end is split into the text and the rest.
    """

    def event(self, data, root):
        choices = J.elements(J.find(root, "choices"))
        if choices:
            self.notes["meta"] = ",".join(f"{J.encode(k)}:{written(data, v)}" for k, v in root.items if k not in ("choices", "usage"))
        edits, before, ended, more = [], "", [], False
        for c in choices:
            i, delta = written(data, J.find(c, "index"), "0"), J.find(c, "delta")
            for name in ("reasoning", "reasoning_content", "content"):
                value = J.find(delta, name)
                if text := said(data, value):
                    last = name != "content" and said(data, J.find(delta, "content")) != ""
                    if name == "content" and i not in self.notes.setdefault("answered", []):
                        self.notes["answered"].append(i)
                        before += self.flush(f"{i}|reasoning")
                    edits.append((value, self.take(f"{i}|{name}", text, end=last)))
            for call, value in self.arguments(data, delta):
                if text := said(data, value):
                    edits.append((value, self.fragment(f"{i}|{call}", text)))
            if written(data, J.find(c, "finish_reason")) != "null":
                ended.append(i)
            more |= any(k not in ("reasoning", "reasoning_content", "content") and self.tells(data, k, v) for k, v in (delta.items if delta else []))
        if not edits and not ended:
            return None
        rest = self.flush(*(f"{i}|" for i in ended)) if ended else ""
        if not edits:
            return [before, rest, (data,)]
        usage, out = J.find(root, "usage"), [before]
        ends = [J.find(c, "finish_reason") for c in choices] + [usage]
        split = bool(ended) or written(data, usage) != "null"
        if more or any(new for _, new in edits):
            nulls = [(v.start, v.end, "null") for v in ends if v] if split else []
            out.append((J.splice(data, [(v.start, v.end, J.encode(new)) for v, new in edits] + nulls),))
        out.append(rest)
        if split:
            out.append((J.splice(data, [(d.start, d.end, "{}") for c in choices if (d := J.find(c, "delta"))]),))
        return out

    @staticmethod
    def arguments(data: str, delta: J.Value | None) -> Iterator[tuple[str, J.Value | None]]:
        yield "call-1", J.find(delta, "function_call", "arguments")
        for n, call in enumerate(J.elements(J.find(delta, "tool_calls"))):
            yield f"call{written(data, J.find(call, 'index'), str(n))}", J.find(call, "function", "arguments")

    @staticmethod
    def tells(data: str, key: str, value: J.Value) -> bool:
        """Whether a part of a delta says something besides texts that are held back."""
        if key == "tool_calls":
            return any(J.find(x, "id") or J.find(x, "function", "name") for x in J.elements(value))
        return J.find(value, "name") is not None if key == "function_call" else written(data, value) != "null"

    def fragment(self, key: str, text: str) -> str:
        closing = Closing(*self.notes.setdefault("open", {}).get(key, ()))
        closed = closing.feed(text)
        self.notes["open"][key] = closing.state
        return self.take(key, text, True, closed)

    def frame_of(self, key, text):
        i, name = key.split("|", 1)
        value = J.encode(text)
        if name == "call-1":
            delta = f'{{"function_call":{{"arguments":{value}}}}}'
        elif name.startswith("call"):
            delta = f'{{"tool_calls":[{{"index":{name[4:]},"function":{{"arguments":{value}}}}}]}}'
        else:
            delta = f'{{"{name}":{value}}}'
        meta = self.notes.get("meta", "")
        return build(f'{{{meta}{"," if meta else ""}"choices":[{{"index":{i},"delta":{delta},"finish_reason":null}}]}}')


class Messages(EventStream):
    """Fields by content block; the end of a block ends its fields."""

    # Where each kind of delta has its text.
    DELTAS = {"text_delta": "text", "thinking_delta": "thinking", "input_json_delta": "partial_json"}

    def event(self, data, root):
        kind, i = said(data, J.find(root, "type")), written(data, J.find(root, "index"), "0")
        if kind == "content_block_stop":
            return [self.flush(f"{i}|"), (data,)]
        name = said(data, J.find(root, "delta", "type"))
        value = J.find(root, "delta", self.DELTAS.get(name, ""))
        if kind != "content_block_delta" or not (text := said(data, value)):
            return None
        new = self.take(f"{i}|{name}", text, name == "input_json_delta")
        return [(J.splice(data, [(value.start, value.end, J.encode(new))]),)] if new else []

    def frame_of(self, key, text):
        i, name = key.split("|")
        delta = f'{{"type":"{name}","{self.DELTAS[name]}":{J.encode(text)}}}'
        return build(f'{{"type":"content_block_delta","index":{i},"delta":{delta}}}', "event: content_block_delta\n")


class Responses(EventStream):
    """Fields by item and part. Events that repeat a whole text get it restored as a whole; events are numbered anew."""

    # Kinds of events whose texts come in pieces, and where the closing event has the whole text.
    PIECES = {"response.output_text": "text", "response.reasoning_text": "text", "response.function_call_arguments": "arguments"}
    PARTS = ("response.content_part.done", "response.reasoning_part.done")
    WHOLE = ("response.completed", "response.incomplete", "response.failed")
    PLACE = ("item_id", "output_index", "content_index")

    def event(self, data, root):
        kind, number = said(data, J.find(root, "type")), J.find(root, "sequence_number")
        if number:
            self.notes.setdefault("next", int(written(data, number)))
        stem, _, last = kind.rpartition(".")
        place = ",".join(f'"{k}":{written(data, v)}' for k in self.PLACE if (v := J.find(root, k)))
        key, before, edits = f"{stem}|{place}|", "", []
        if stem in self.PIECES and last == "delta":
            value = J.find(root, "delta")
            if text := said(data, value):
                new = self.take(key, text, "arguments" in stem)
                if not new:
                    return []
                edits = [(value.start, value.end, J.encode(new))]
        elif stem in self.PIECES and last == "done":
            before, edits = self.flush(key), self.whole(data, J.find(root, self.PIECES[stem]), "arguments" in stem)
        elif kind in self.PARTS:
            edits = self.whole(data, J.find(root, "part", "text"))
        elif kind == "response.output_item.done":
            edits = self.fields(data, J.find(root, "item"), bodies.RESPONSE_ITEM)
        elif kind in self.WHOLE:
            before, edits = self.flush(), self.fields(data, J.find(root, "response"), bodies.each("output", bodies.RESPONSE_ITEM))
        if number:
            edits = [*edits, (number.start, number.end, self.number())]
        return [before, (J.splice(data, edits),)]

    def number(self) -> str:
        self.notes["next"] += 1
        return str(self.notes["next"] - 1)

    def whole(self, data: str, value: J.Value | None, in_json: bool = False) -> list[tuple[int, int, str]]:
        text = said(data, value)
        new = restore_json(text, self.pairs, self.kinds) if in_json else self.restorers[0].whole(text)
        return [(value.start, value.end, J.encode(new))] if new != text else []

    def fields(self, data: str, value: J.Value | None, visit: bodies.Visit) -> list[tuple[int, int, str]]:
        out = []
        for f in visit(data, value, ()) if value else ():
            new = restore_json(f.text, self.pairs, self.kinds) if f.path[-1] == "arguments" else self.restorers[0].whole(f.text)
            out += [(f.start, f.end, J.encode(new))] if new != f.text else []
        return out

    def frame_of(self, key, text):
        stem, place = key[:-1].split("|", 1)
        number = f',"sequence_number":{self.number()}' if "next" in self.notes else ""
        return build(f'{{"type":"{stem}.delta"{"," if place else ""}{place},"delta":{J.encode(text)}{number}}}', f"event: {stem}.delta\n")


DIALECTS = {"chat_completions": ChatCompletions, "messages": Messages, "responses": Responses}


def dialect(format: str | None, known: list | None, kinds: list | None) -> EventStream:
    """The format's reader; streams of other formats, and those without anything to restore, are passed on as they are."""
    pairs = [(k["placeholder"], k["original"]) for k in (known if known is not None else [])]
    return DIALECTS.get(format if pairs else None, EventStream)(pairs, list(kinds) if kinds is not None else [])


def restore_streams(streams: DataFrame, found: DataFrame) -> DataFrame:
    """stream_id, body: whole event streams (stream_id, format, body) with the originals of `found` in place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, formats, texts, known, kinds = (c.to_pylist() for c in batch.columns)
            done = [t if t is None else dialect(f, k, n).feed(t, True) for f, t, k, n in zip(formats, texts, known, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(done, pa.string())], names=["stream_id", "body"])

    rows = with_known(streams.select(F.col("stream_id").cast("long"), "format", "body"), found, "stream_id")
    return rows.select("stream_id", "format", "body", "known", "kinds").mapInArrow(run, "stream_id long, body string")


def restore_event_chunks(chunks: DataFrame, found: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """stream_id, seq, body: what each chunk of a stream (stream_id, format, seq, chunk, flush) lets out.

    `chunks` is a stream, `found` a table. Chunks of one micro-batch are taken by seq; the state is `dump`'s text, its
    length bounded by one frame and the longest placeholder for each open field. With `idle_ms`, a stream that gets no
    chunk for so long ends: what it holds comes out under its last seq, and its state goes. The query then needs a
    processing-time trigger.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            kept, format, known, last = state.get
            state.remove()
            reader = dialect(format, [{"placeholder": p, "original": o} for p, o in json.loads(known)["known"]], json.loads(known)["kinds"])
            reader.load(kept)
            yield pd.DataFrame([(*key, last, reader.feed("", True))], columns=["stream_id", "seq", "body"])
            return
        out, reader = [], None
        for row in pd.concat(list(frames)).sort_values("seq", kind="stable").itertuples():
            if reader is None:
                reader = dialect(row.format, row.known, row.kinds)
                if state.exists:
                    reader.load(state.get[0])
                format = row.format
                known = json.dumps({"known": [(k["placeholder"], k["original"]) for k in (row.known if row.known is not None else [])], "kinds": list(row.kinds) if row.kinds is not None else []}) if idle_ms else ""
            out.append((*key, row.seq, reader.feed(row.chunk or "", bool(row.flush))))
            ended = bool(row.flush)
        if not ended:
            state.update((reader.dump(), format, known, int(out[-1][1])))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["stream_id", "seq", "body"])

    rows = with_known(chunks, found, "stream_id")
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return rows.groupBy("stream_id").applyInPandasWithState(run, "stream_id long, seq long, body string", "kept string, format string, known string, seq long", "append", timeout)
