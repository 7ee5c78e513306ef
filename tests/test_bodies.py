import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hushframe.functions import jsontext as J
from hushframe.operators import bodies, mask, restore, scan
from hushframe.operators.restore import Restorer, restore_json
from hushframe.sources.catalog import load_rules
from hushframe.streaming.restore import restore_chunks

DOCS = st.recursive(st.none() | st.booleans() | st.integers() | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(DOCS, st.integers(0, 3))
def test_reading_json(doc, indent):
    text = json.dumps(doc, indent=indent or None, ensure_ascii=indent == 1)
    root, whole = J.read(text)
    assert whole and json.loads(text[root.start : root.end]) == doc
    for _, leaf in J.string_leaves(root):
        assert J.decode(text[leaf.start : leaf.end]) == json.loads(text[leaf.start : leaf.end])
    assert not J.valid(text + ",") and not J.valid("[" + text) and not J.valid("")


@pytest.mark.parametrize("text", ["[1,]", "{,}", '{"a":1,}', "[,1]", "01", "1.", "NaN", "+1", '"\t"', '"\\x"', "tru", "{} {}", '{"a" 1}', "[1 2]", "-", "1e", "[}"])
def test_not_json(text):
    assert not J.valid(text)


def test_broken_documents_keep_what_was_whole():
    root = J.read('{"a":[1,"x",{"b":"y"}],"a":2, !')[0]
    assert J.find(root, "a", 1).start == 8 and J.find(root, "a", 2, "b").kind == '"' and J.find(root) is None
    assert len(J.elements(J.find(J.read('{"a":[1,2],'.ljust(20))[0], "a"))) == 2
    assert J.decode('"\\ud83d\\ude00 \\ud83d \\u0041"') == "\U0001f600 � A"
    assert J.encode("a\"\\\n\x01 </>&") == '"a\\"\\\\\\n\\u0001\\u2028</>&"'
    assert J.valid("[" * 1000 + "]" * 1000)
    with pytest.raises(ValueError):
        J.splice("abc", [(0, 2, ""), (1, 3, "")])


BODIES = [
    ("chat_completions", "request", {"messages": [{"content": [{"type": "text", "text": "p"}, {"type": "image"}]}, {"content": "q", "tool_calls": [{"function": {"arguments": "{}"}}], "function_call": {"arguments": "z"}}, {"content": ""}]}, ["p", "q", "z", "{}"]),
    ("chat_completions", "request", {"messages": 3}, None),
    ("chat_completions", "response", {"choices": [{"message": {"refusal": "r", "content": "c", "reasoning": "t"}}, {}]}, ["c", "t", "r"]),
    ("messages", "request", {"system": "s", "messages": [{"content": [{"type": "tool_use", "input": {"a": ["x", ""], "b": {"c": "y"}}}, {"type": "tool_result", "content": [{"type": "text", "text": "w"}]}]}, {"content": "m"}]}, ["s", "x", "y", "w", "m"]),
    ("messages", "response", {"content": [{"type": "thinking", "thinking": "h", "signature": "g"}, {"type": "tool_use", "input": {}}, {"type": "tool_use", "input": {"k": 1}}, {"type": "text", "text": "e"}]}, ["h", '{"k": 1}', "e"]),
    ("responses", "request", {"input": [{"type": "function_call_output", "output": "o"}, {"type": "function_call", "arguments": "a"}, {"content": [{"type": "input_text", "text": "i"}]}], "instructions": "n"}, ["n", "o", "a", "i"]),
    ("responses", "request", {"model": "m"}, None),
    ("responses", "response", {"output": [{"type": "reasoning", "content": [{"type": "reasoning_text", "text": "u"}], "summary": [{"type": "summary_text", "text": "v"}]}, {"type": "message", "content": [{"type": "output_text", "text": "j"}, {"type": "refusal", "text": "no"}]}]}, ["v", "u", "j"]),
]


@pytest.mark.parametrize("format, direction, body, want", BODIES)
def test_extraction(format, direction, body, want):
    text = json.dumps(body)
    got = bodies.extract(format, direction, text)
    assert (got and [f.text for f in got]) == want
    for f in got or []:
        assert f.is_raw or json.loads(text[f.start : f.end]) == f.text


KNOWN = [("<EMAIL_1>", "a@b.example"), ("<EMAIL_12>", 'q"\\'), ("<API_KEY_1>", "kéy"), ("<EMAIL_1>", "second")]
KINDS = ["EMAIL", "API_KEY"]


@pytest.mark.parametrize("text, want", [
    ("x <EMAIL_1>!", "x a@b.example!"), ("< email - 1 >", "a@b.example"), ("<EMAIL-001>", "a@b.example"), ("<email_1><Api Key1>", "a@b.examplekéy"),
    ("<EMAIL_2> <EMAIL_0>", "<EMAIL_2> <EMAIL_0>"), ("<    EMAIL_1>", "<    EMAIL_1>"), ("<EMA", "<EMA"), ("", ""), ("<EMAIL_12>", 'q"\\'),
])
def test_restoring(text, want):
    assert Restorer(KNOWN, KINDS).whole(text) == want
    long = f"é {text} plain words after it, longer than any placeholder can be {text} <"
    for size in range(1, len(long) + 1):
        r = Restorer(KNOWN, KINDS)
        assert "".join([*(r.feed(long[i : i + size]) for i in range(0, len(long), size)), r.feed("", True)]) == Restorer(KNOWN, KINDS).whole(long)
        assert r.pending == ""


def test_restoring_json():
    assert restore_json('{"a":"<EMAIL_1>", "n":1e400}', KNOWN, KINDS) == '{"a":"a@b.example", "n":1e400}'
    assert restore_json('{"a":"<EMAIL_12>","a":"<EMAIL_1>" }', KNOWN, KINDS) == '{"a":"q\\"\\\\","a":"a@b.example" }'
    assert restore_json('{"a":"<EMAIL_12>', KNOWN, KINDS) == '{"a":"<EMAIL_12>'


def test_bodies_round_trip(spark):
    body = '{ "messages" : [{"content":"mail a@b.example \\u00e9"},{"content":"10.0.0.1 and a@b.example","n":1.50}] }'
    frame = spark.createDataFrame([(1, body), (2, "no json"), (3, None)], "request_id long, body string")
    found = bodies.fields(frame, "chat_completions", "request")
    texts = found.select("request_id", "text_idx", "text")
    rules = [r for r in load_rules().rules if r.rule_id in ("pii.email", "ip-addrs.ipv4")]
    masked, used = mask.mask(texts, scan.coalesce(scan.scan(texts, rules), texts))
    place = found.drop("text").join(masked.withColumnRenamed("masked_text", "text"), ["request_id", "text_idx"])
    done = {r.request_id: r.body for r in bodies.patch(frame, place).collect()}
    assert done == {1: '{ "messages" : [{"content":"mail <EMAIL_1> é"},{"content":"<IPV4_1> and <EMAIL_1>","n":1.50}] }', 2: "no json", 3: None}
    back = restore.restore(masked, used)
    assert {(r.request_id, r.text_idx, r.text) for r in back.collect()} == {(r.request_id, r.text_idx, r.text) for r in texts.collect()}


def test_streamed_chunks(spark, tmp_path):
    used = spark.createDataFrame([(1, 1, "<EMAIL_1>", "a@b.example"), (2, 1, "<API_KEY_1>", 'k"')], "request_id long, ord int, placeholder string, original string")
    says = {(1, "content"): "mail < email-1 > and <EMAIL_1>, then much more text to let it out", (2, "x.arguments"): '{"k":"<API_KEY_1>"}', (3, "content"): "no <EMAIL_1> known"}
    rows = [(s, f, i, t[i : i + 3], i + 3 >= len(t)) for (s, f), t in says.items() for i in range(0, len(t), 3)]
    schema = "stream_id long, field string, seq long, chunk string, flush boolean"
    for part in range(2):
        spark.createDataFrame([r for r in rows if (r[2] >= 12) == bool(part)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = restore_chunks(stream, used).writeStream.format("memory").queryName("restored").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    got: dict = {}
    for r in spark.table("restored").orderBy("seq").collect():
        got[(r.stream_id, r.field)] = got.get((r.stream_id, r.field), "") + r.text
    assert got == {(1, "content"): "mail a@b.example and a@b.example, then much more text to let it out", (2, "x.arguments"): '{"k":"k\\""}', (3, "content"): "no <EMAIL_1> known"}
