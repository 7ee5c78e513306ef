import json

import pytest

from hushframe.operators.restore import Restorer, restore_json
from hushframe.streaming import dialects as d

KNOWN = [("<EMAIL_1>", 'a"b@x.example'), ("<PHONE_RU_2>", "+7 900"), ("<TOKEN_1>", "t\\k")]
KINDS = ["EMAIL", "PHONE_RU", "TOKEN"]
TEXTS = ["to <EMAIL_1> or < email - 01 >, call <PHONE_RU_2>.", "none", "<EMAIL_9> <EMAIL_1><EMAIL_1>", "a < b and <EMA", "é<EMAIL_1> "]
ARGS = ['{"to":"<EMAIL_1>","n":{"b":"} <TOKEN_1>"}}', "{}", '{"x":"< token 1 >"}']


def event(data, name=None):
    return (f"event: {name}\n" if name else "") + f"data: {json.dumps(data, ensure_ascii=False)}\n\n"


def pieces(text, n):
    return [text[i : i + n] for i in range(0, len(text), n)]


def chat(text, thought, args, n):
    base = {"id": "c", "model": "m", "created": 10**30}
    made = [event(base | {"choices": [{"index": 0, "delta": {"role": "assistant"}, "finish_reason": None}]}), ": keep\n\n"]
    for name, said in (("reasoning", thought), ("content", text)):
        made += [event(base | {"choices": [{"index": 0, "delta": {name: p}, "finish_reason": None}]}) for p in pieces(said, n)]
    call = [{"index": 0, "id": "t", "function": {"name": "f", "arguments": ""}}]
    made.append(event(base | {"choices": [{"index": 0, "delta": {"tool_calls": call}}]}))
    made += [event(base | {"choices": [{"index": 0, "delta": {"tool_calls": [{"index": 0, "function": {"arguments": p}}]}}]}) for p in pieces(args, n)]
    last = {"choices": [{"index": 0, "delta": {"content": "<EMAIL_1"}, "finish_reason": "stop"}], "usage": {"n": 1}}
    return "".join(made) + event(base | last) + "data: [DONE]\n\n"


def chat_fields(out):
    got = {"content": "", "reasoning": "", "arguments": ""}
    for frame in out.split("\n\n"):
        if frame.startswith("data: {"):
            one = json.loads(frame[6:])
            assert one["created"] == 10**30 and one["id"] == "c"
            for c in one["choices"]:
                for k in ("content", "reasoning"):
                    got[k] += c["delta"].get(k) or ""
                for t in c["delta"].get("tool_calls", []):
                    got["arguments"] += t["function"]["arguments"]
    return got


def messages(text, thought, args, n):
    made = [event({"type": "message_start"}, "message_start")]
    for i, (kind, delta, key, said) in enumerate((("thinking", "thinking_delta", "thinking", thought), ("text", "text_delta", "text", text), ("tool_use", "input_json_delta", "partial_json", args))):
        made.append(event({"type": "content_block_start", "index": i, "content_block": {"type": kind}}, "content_block_start"))
        made += [event({"type": "content_block_delta", "index": i, "delta": {"type": delta, key: p}}, "content_block_delta") for p in pieces(said, n)]
        made.append(event({"type": "content_block_stop", "index": i}, "content_block_stop"))
    return "".join(made) + event({"type": "message_stop"}, "message_stop")


def messages_fields(out):
    got = {"thinking": "", "text": "", "partial_json": ""}
    stopped = set()
    for frame in filter(None, out.split("\n\n")):
        name, data = frame.split("\n", 1)
        one = json.loads(data[6:])
        assert name == f"event: {one['type']}"
        if one["type"] == "content_block_stop":
            stopped.add(one["index"])
        for k, v in one.get("delta", {}).items():
            assert one["index"] not in stopped
            got[k] = got.get(k, "") + v
    return got


def responses(text, thought, args, n):
    made, number = [], iter(range(3, 10**6))

    def add(kind, **more):
        made.append(event({"type": kind, **more, "sequence_number": next(number)}, kind))

    items = []
    for i, (stem, key, said) in enumerate((("reasoning_text", "text", thought), ("output_text", "text", text), ("function_call_arguments", "arguments", args))):
        place = {"item_id": f"i{i}", "output_index": i} | ({"content_index": 0} if i < 2 else {})
        for p in pieces(said, n):
            add(f"response.{stem}.delta", **place, delta=p)
        add(f"response.{stem}.done", **place, **{key: said})
        items.append([{"type": "reasoning", "content": [{"type": "reasoning_text", "text": said}]}, {"type": "message", "content": [{"type": "output_text", "text": said}]}, {"type": "function_call", "arguments": said}][i])
        add("response.output_item.done", output_index=i, item=items[-1])
    add("response.completed", response={"output": items})
    return "".join(made)


@pytest.mark.parametrize("n", [1, 2, 5, 200])
def test_pieces_of_any_size_give_the_same_texts(n):
    whole = Restorer(KNOWN, KINDS).whole
    for k, text in enumerate(TEXTS):
        for args in ARGS[k % 3 : k % 3 + 1]:
            thought = TEXTS[0] + text
            for chunk in (1 if n == 5 and k == 0 else 13, 10**6):
                outs = {}
                for name, make in (("chat_completions", chat), ("messages", messages), ("responses", responses)):
                    stream = d.DIALECTS[name](KNOWN, KINDS)
                    sent = pieces(make(text, thought, args, n), chunk)
                    out = []
                    for i, c in enumerate(sent):  # the state is written and read between any two chunks
                        out.append(stream.feed(c, i == len(sent) - 1))
                        kept = stream.dump()
                        stream = d.DIALECTS[name](KNOWN, KINDS)
                        stream.load(kept)
                    outs[name] = "".join(out)
                got = chat_fields(outs["chat_completions"])
                assert got["content"] == whole(text + "<EMAIL_1") and got["reasoning"] == whole(thought)
                assert json.loads(got["arguments"]) == json.loads(restore_json(args, KNOWN, KINDS))
                assert outs["chat_completions"].count('"finish_reason": "stop"') == 1 and outs["chat_completions"].endswith("data: [DONE]\n\n")
                got = messages_fields(outs["messages"])
                assert got["text"] == whole(text) and got["thinking"] == whole(thought)
                assert json.loads(got["partial_json"]) == json.loads(restore_json(args, KNOWN, KINDS))
                check_responses(outs["responses"], whole(thought), whole(text), json.loads(restore_json(args, KNOWN, KINDS)))


def check_responses(out, thought, text, args):
    got, numbers = {}, []
    for frame in filter(None, out.split("\n\n")):
        one = json.loads(frame.split("\n", 1)[1][6:])
        numbers.append(one["sequence_number"])
        kind, last = one["type"].rsplit(".", 1)
        if last == "delta":
            got[kind] = got.get(kind, "") + one["delta"]
        elif kind == "response.output_text":
            assert one["text"] == text == got[kind]
        elif kind == "response.reasoning_text":
            assert one["text"] == thought == got[kind]
        elif kind == "response.function_call_arguments":
            assert json.loads(one["arguments"]) == args == json.loads(got[kind])
        elif last == "completed":
            items = one["response"]["output"]
            assert items[0]["content"][0]["text"] == thought and items[1]["content"][0]["text"] == text and json.loads(items[2]["arguments"]) == args
    assert numbers == list(range(3, 3 + len(numbers)))


def test_other_frames_and_formats_pass_as_they_are():
    body = 'data: {"choices":[{"index":0,"delta":{"refusal":"<EMAIL_1>"}}]}\r\n\r\n: ping\n\ndata: not json <EMAIL_1>\n\ndata: {"error": 1.50}\n\ndata: {"type":"response.created","sequence_number":0.5}\n\nid: 4'
    for made in (d.EventStream, d.ChatCompletions, d.Messages, d.Responses):
        assert made(KNOWN, KINDS).feed(body, True) == body
    assert d.dialect("other", [{"placeholder": "<EMAIL_1>", "original": "x"}], ["EMAIL"]).feed("data: <EMAIL_1>\n\n", True) == "data: <EMAIL_1>\n\n"


def test_a_frame_between_does_not_let_out_what_is_held():
    s = d.ChatCompletions(KNOWN, KINDS, record=True)
    part = lambda text: event({"choices": [{"index": 0, "delta": {"content": text}}]})
    assert s.feed(part("<EMA")) == ""
    keep = event({"choices": [{"index": 0, "delta": {}}]})
    assert s.feed(keep) == keep
    out = s.feed(part("IL_1>"), True)
    assert "a\\\"b@x.example" in out and s.recorded == {"0|content": "<EMAIL_1>"}
    c = d.Closing()
    assert [c.feed(x) for x in ('{"a', '}"', ':"\\"}"', "}")] == [False, False, False, True]


def test_streaming_query_equals_whole_streams(spark, tmp_path):
    rows = [(k, "chat_completions" if k % 2 else "messages", (chat if k % 2 else messages)(TEXTS[k % 5], TEXTS[0], ARGS[k % 3], 4)) for k in range(6)]
    found = spark.createDataFrame([(k, i, p, o) for k in range(6) for i, (p, o) in enumerate(KNOWN)], "request_id long, ord int, placeholder string, original string")
    whole = {r.stream_id: r.body for r in d.restore_streams(spark.createDataFrame(rows, "stream_id long, format string, body string"), found).collect()}
    schema = "stream_id long, format string, seq long, chunk string, flush boolean"
    for part in range(2):
        some = []
        for k, f, body in rows:
            cuts = pieces(body, 50)
            half = len(cuts) // 2
            some += [(k, f, i, c, i == len(cuts) - 1) for i, c in enumerate(cuts) if (i >= half) == bool(part)]
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    chunks = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = d.restore_event_chunks(chunks, found).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination(120)
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("stream_id", "seq").collect():
        got[r.stream_id] = got.get(r.stream_id, "") + r.body
    assert got == whole
