import random

import pytest

from hushframe.functions import validators as v
from hushframe.operators import extract, mask, restore, scan
from hushframe.sources.catalog import Rule, load_rules
from hushframe.sources.prefilter import guarantees_keyword


def texts(spark, rows):
    return spark.createDataFrame(rows, "request_id long, text_idx int, text string")


def test_validators():
    assert v.luhn("4111111111111111") and not v.luhn("4111111111111112") and not v.luhn("")
    assert v.snils("11223344595") and not v.snils("11223344596") and not v.snils("1122334459")
    assert v.inn_org("7707083893") and not v.inn_org("7707083894")
    assert v.inn_person("500100732259") and not v.inn_person("500100732258")
    assert v.ogrn("1027700132195") and v.ogrnip("304500116000157")
    assert v.iban_mod97("GB82 WEST 1234 5698 7654 32") and not v.iban_mod97("GB82")
    assert v.email_ascii("a.b@x.example") and not any(map(v.email_ascii, ("a..b@x.example", "a@x", "a@-x.example", "a@x.1")))
    ip = lambda x, *names: v.passes(x, Rule("r", "x", validators=names))
    assert all(ip(x, "ip_v4") for x in ("10.0.0.1", "10.0.0.0/8", "::ffff:1.2.3.4"))
    assert not any(ip(x, "ip_v4") for x in ("010.1.2.3", "1.2.3", "10.0.0.0/33", "::1"))
    assert all(ip(x, "ip_private") for x in ("127.0.0.1", "224.0.0.1", "169.254.1.1", "0.0.0.0", "fc00::1"))
    assert ip("8.8.8.8", "ip_public") and not ip("8.8.8.8", "ip_private")
    assert not ip("x", "nonsense") and ip("x", "entropy") and round(v.entropy("aabb"), 6) == 1
    assert not v.passes("ABC", Rule("r", "x", validators=("banlist",), banlist=("abc",)))
    assert v.card_shape("4" * 13) and not v.card_shape("4" * 14) and v.card_shape("34" + "0" * 13)


@pytest.mark.parametrize("text, rule, want", [
    ("ab cab ab", Rule("r", r"\bab"), [(0, 2), (7, 9)]),
    ("жab ab", Rule("r", r"\bab"), [(1, 3), (4, 6)]),
    ("k=aa k=", Rule("r", r"k=(a*)", capture_groups=(1,)), [(2, 4)]),
    ("xéé xé", Rule("r", "xé+", min_length=5), [(0, 3)]),
    ("a\nb", Rule("r", "^b"), [(2, 3)]),
    ("", Rule("r", "a*"), []),
    ("baab", Rule("r", "a*"), [(1, 3)]),
])
def test_matches(text, rule, want):
    assert list(scan.matches(text, rule)) == want


def test_coalescing_equals_a_sweep(spark):
    rng = random.Random(3)
    rows = [(g, 0, s := rng.randrange(30), s + rng.randrange(1, 8), f"r{rng.randrange(4)}", 1, "X", "") for g in range(30) for _ in range(6)]
    done = scan.coalesce(spark.createDataFrame(rows, scan.CANDIDATES), texts(spark, [(g, 0, "x" * 60) for g in range(30)]))
    want = set()
    for g in range(30):
        run: list = []
        for r in [*sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[2] - r[3], r[4])), None]:
            if run and (r is None or r[2] >= max(x[3] for x in run)):
                want.add((g, run[0][2], max(x[3] for x in run), min(run, key=lambda x: (x[2] - x[3], x[2], x[4]))[4]))
                run = []
            run.append(r)
    assert {(r.request_id, r.start, r.end, r.rule_id) for r in done.collect()} == want


def test_coalescing_equal_spans(spark):
    rng = random.Random(5)
    rows = [(g, 0, s := 3 * rng.randrange(4), s + rng.randrange(1, 3), "r", 1, "X", "") for g in range(100) for _ in range(12)]
    conf = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().conf()
    conf.set("spark.shuffle.spill.numElementsForceSpillThreshold", "23")  # sorts that spill leave equal rows in any order
    try:
        done = scan.coalesce(spark.createDataFrame(rows, scan.CANDIDATES), texts(spark, [(g, 0, "x" * 60) for g in range(100)])).collect()
    finally:
        conf.remove("spark.shuffle.spill.numElementsForceSpillThreshold")
    want = {(g, s): max(r[3] for r in rows if (r[0], r[2]) == (g, s)) for g, s in {(r[0], r[2]) for r in rows}}
    assert sorted((r.request_id, r.start, r.end) for r in done) == sorted((g, s, e) for (g, s), e in want.items())


def test_masking(spark):
    t = texts(spark, [(1, 0, "mail a@b.example and c@d.example"), (1, 1, "again a@b.example <EMAIL_1> 10.0.0.1"), (2, 0, None), (3, 0, "a@b.example <EMAIL_01>")])
    rules = [r for r in load_rules().rules if r.rule_id in ("pii.email", "ip-addrs.ipv4")]
    found = scan.coalesce(scan.scan(t, rules), t)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, scan.findings(t, rules).collect()))
    done, used = mask.mask(t, found)
    got = {(r.request_id, r.text_idx): r.masked_text for r in done.collect()}
    assert got == {(1, 0): "mail <EMAIL_2> and <EMAIL_3>", (1, 1): "again <EMAIL_2> <EMAIL_1> <IPV4_1>", (2, 0): None, (3, 0): "<EMAIL_1> <EMAIL_01>"}
    back = {(r.request_id, r.text_idx): r.text for r in restore.demask(done, used).collect()}
    assert back == {(r.request_id, r.text_idx): r.text for r in t.collect()}
    state = {r.request_id: (r.triggered_rule_ids, r.triggered_data_types, len(r.replacements)) for r in mask.state(t, found).collect()}
    assert state[1] == (["ip-addrs.ipv4", "pii.email"], [4, 5], 3)


@pytest.mark.parametrize("pattern, keywords, want", [
    ("abc", ("B",), True), ("(?i)abs", ("abs",), False), ("(?i)abc", ("abc",), True), ("ab|ac", ("ab",), False), ("(?:xab|yabc)+z", ("ab",), True),
    ("(ab)*", ("ab",), False), ("(ab){2,}", ("ab",), True), (r"\d{12}", ("inn",), False), ("[[:alpha:]]ab", ("ab",), False), ("a[bc]", ("ab",), False), ("(", ("(",), False), ("инн", ("инн",), True), ("(?i)инн", ("инн",), False), ("ab", (), False),
])
def test_prover(pattern, keywords, want):
    assert guarantees_keyword(pattern, keywords) == want


def test_prefilter_loses_nothing(spark):
    """Without a proof, as for bare digits, the keywords gate nothing."""
    t = texts(spark, [(1, 0, "ИНН 500100732259 key=abc"), (2, 0, "no 500100732259"), (3, 0, None)])
    rules = [load_rules().by_id("pii.docs.inn-person"), Rule("k", "KEY=[a-z]+|key=[a-z]+", keywords=("key=",))]
    rows = lambda p: sorted((r.request_id, r.start, r.rule_id) for r in scan.scan(t, rules, prefilter=p).collect())
    assert rows(True) == rows(False) == [(1, 4, "pii.docs.inn-person"), (1, 17, "k"), (2, 3, "pii.docs.inn-person")]


def test_chat_fields(spark):
    body = '{"stream":"T","messages":[{"role":"u","content":[{"type":"text","text":"p"},{"type":"image"}]},{"role":"a","content":"q","tool_calls":[{"function":{"arguments":"{}"}}]},{"content":""}]}'
    bodies = spark.createDataFrame([(1, body), (2, '{"stream":2}')], "request_id long, body string")
    got = [(r.path, r.text) for r in extract.chat_fields(bodies).orderBy("request_id", "ord").collect()]
    assert got == [("messages.0.content.0.text", "p"), ("messages.1.content", "q"), ("messages.1.tool_calls.0.function.arguments", "{}")]
    assert all(r.wants_stream for r in extract.wants_stream(bodies).collect())


@pytest.mark.parametrize("text", ["k=aa;k=bb;", "\ue000k=aa;\ue001k=b", "k=" + "a" * 500 + "é;k=" + "b" * 70 + "$", ("k=a\n" * 300) + "k=" + "c" * 63, "xk=a k=😀"])
def test_groups_are_where_a_search_finds_them(text):
    """Against a search of the rest of the text for each match, however long the match or what follows."""
    import re

    rule = Rule("r", r"(?:^|[^x])(k)=([a-z]*)(?:;|$)", capture_groups=(2, 1))
    want, at = [], 0
    pattern = re.compile("(?m)" + rule.regex)
    while m := pattern.search(text, at):
        want.append(m.span(2) if m[2] else m.span(1))
        at = max(m.end(), at + 1)
    assert list(scan.matches(text, rule)) == want


def test_many_matches_take_linear_time():
    import time

    rule = Rule("r", r"\b(a+)@b", capture_groups=(1,))
    took = []
    for n in (20_000, 200_000):
        began = time.process_time()
        assert sum(1 for _ in scan.matches("aa@b xx " * n, rule)) == n
        took.append(time.process_time() - began)
    assert took[1] < 40 * took[0] + 1


def test_one_pass_equals_many(spark):
    """Requests of one text: numbered and replaced at once, as by the plan for requests of several texts."""
    rows = [(1, 0, "a@b.example <EMAIL_1> c@d.example a@b.example 10.0.0.1"), (2, 0, None), (3, 0, ""), (4, 0, "x <IPV4_2> <IPV4_1> 10.0.0.1 10.0.0.2 10.0.0.3")]
    t, rules = texts(spark, rows), [r for r in load_rules().rules if r.rule_id in ("pii.email", "ip-addrs.ipv4")] + [Rule("none", "x")]
    once = scan.mask_texts(t, rules).collect()
    done, used = mask.mask(t, scan.findings(t, rules))
    assert {(r.request_id, r.masked_text) for r in once} == {(r.request_id, r.masked_text) for r in done.collect()}
    assert sorted((r.request_id, *x) for r in once for x in r.replacements) == sorted(map(tuple, used.collect()))
    plan = scan.mask_texts(t, rules)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan


def test_restoring_exactly(spark):
    """With U+0000 in the text, rows that repeat and types of any characters."""
    masked = spark.createDataFrame([(1, 0, "<EMAIL_1> \0 x <e-mail ü_2> <EMAIL_3>"), (2, 0, "<EMAIL_1>"), (3, 0, None)], "request_id long, text_idx int, masked_text string")
    used = spark.createDataFrame([(1, 1, "<EMAIL_1>", "a"), (1, 2, "<EMAIL_1>", "b"), (1, 1, "<EMAIL_1>", "a"), (1, 3, "<e-mail ü_2>", "<EMAIL_1>")], "request_id long, ord int, placeholder string, original string")
    assert {r.request_id: r.text for r in restore.demask(masked, used).collect()} == {1: "a \0 x <EMAIL_1> <EMAIL_3>", 2: "<EMAIL_1>", 3: None}


@pytest.mark.parametrize("value, want", [
    ('"2"', False), ('"-1"', False), ('"T"', True), ('"1"', True), ("2", True), ("-0.0", False), ("1e-3", True), ("true", True), ("false", False), ("null", False), ("[1]", False), ('{"a":1}', False),
])
def test_wanting_a_stream(value, want):
    assert extract.stream_wanted(f'{{"a":1,"stream":{value}}}') is want and not extract.stream_wanted(None)


def test_contents_that_look_like_json_are_text(spark):
    body = '{"messages":[{"content":"[{\\"type\\":\\"x\\",\\"text\\":\\"secret\\"}]"},{"content":5}]}'
    got = [(r.path, r.text) for r in extract.chat_fields(spark.createDataFrame([(1, body)], "request_id long, body string")).collect()]
    assert got == [("messages.0.content", '[{"type":"x","text":"secret"}]')]


@pytest.mark.parametrize("name, n", [("luhn", 15), ("snils", 9), ("inn_org", 9), ("inn_person", 10), ("ogrn", 12), ("ogrnip", 14)])
def test_completing(name, n):
    rng = random.Random(6)
    for _ in range(20):
        whole = v.completed("".join(rng.choice("0123456789") for _ in range(n)), name)
        assert whole is None or v.passes(whole, Rule("r", "x", validators=(name,)))


def test_errors_hold_what_was_not_given_out(monkeypatch):
    rest = restore.Restorer([("<A_1>", "x")], ["A"])
    monkeypatch.setattr(rest, "tolerant", lambda text: 1 // 0)
    with pytest.raises(restore.RestoreError) as e:
        rest.feed("say <A_1> and <A")
    assert e.value.unemitted == "say x and <A" and rest.pending == ""
