import pytest

from hushframe.operators import scan
from hushframe.sources import catalog
from hushframe.sources.catalog import Rule, RuleError


def test_builtin_rules_load_and_choose():
    rules = catalog.load_rules()
    assert rules.by_id("pii.email").placeholder == "EMAIL"
    assert {r.data_type for r in rules.for_data_types([4])} == {4}
    assert len(rules.for_data_types([4, 4])) == 2 * len(rules.for_data_types([4]))


@pytest.mark.parametrize("rule, code", [
    (Rule("Bad Id", "a"), "InvalidId"), (Rule("a", "a", validators=("no",)), "UnknownValidator"), (Rule("a", "(?!x)"), "BadRegex"),
    (Rule("a", "(a)", capture_groups=(2,)), "BadCaptureGroup"), (Rule("a", "(a)", capture_groups=(0,)), "BadCaptureGroup"),
])
def test_faults(rule, code):
    with pytest.raises(RuleError) as e:
        catalog.check(rule)
    assert e.value.code == code


def test_files(tmp_path):
    one = tmp_path / "a.yaml"
    one.write_text("guardrails_regex_rules: [{data_type: 9, rules: [{rule_id: a, regex: x, keywords: [AB]}]}, {data_type: 1}]")
    two = tmp_path / "b.yaml"
    two.write_text(one.read_text())
    rules = catalog.load_rules([one, f" {one} ", ""])
    assert [(r.rule_id, r.data_type, r.keywords) for r in rules.rules] == [("a", 9, ("ab",))]
    for paths, code in (([one, two], "DuplicateId"), ([], "ParseError")):
        with pytest.raises(RuleError) as e:
            catalog.load_rules(paths)
        assert e.value.code == code
    assert catalog.read_rules("other: 1") == []
    with pytest.raises(RuleError):
        catalog.read_rules("guardrails_regex_rules: 5")


def test_groups_are_named():
    assert catalog.groups_in(r"(a)(?:b)\((?P<x>c)[(]([]()])") == 3
    assert catalog.named(r"(a)(?P<x>c)") == "(?P<g1>a)(?P<g2>c)"
    assert catalog.data_type("ip_addresses") == 4 and catalog.data_type("3") == 3 and catalog.data_type("no") == 0


def test_candidates_of_all_rules(spark):
    from hushframe.plans import queries

    small = "/root/testdata/sf0.001"
    got = {r.rule_id: r.n for r in queries.QUERIES["candidates_all_rules"](spark, small).collect()}
    assert set(got) == {r.rule_id for r in catalog.load_rules().rules}
    assert all(got[r.rule_id] == r.n for r in queries.QUERIES["candidates_by_rule"](spark, small).collect()) and sum(got.values()) > 0


@pytest.mark.parametrize("text", ["guardrails_regex_rules: [x]", "guardrails_regex_rules: [{rules: [x]}]", "guardrails_regex_rules: [{rules: [{masking: [1]}]}]", "guardrails_regex_rules: {a: 1}"])
def test_what_is_no_mapping(text):
    with pytest.raises(RuleError) as e:
        catalog.read_rules(text)
    assert e.value.code == "ParseError"


def test_the_built_in_catalogue():
    rules = catalog.load_rules()
    assert len(rules.rules) == 46 and [len(rules.for_data_types([t])) for t in range(1, 6)] == [13, 2, 6, 8, 17]
    found = lambda rule, text: [text[s:e] for s, e in scan.matches(text, rules.by_id(rule))]
    assert found("access_tokens.generic-long-token", "A" + "b" * 31 + " " + "c" * 40) == ["A" + "b" * 31]
    assert found("credentials.db_connection", "to postgres://u:secret@h/db, then") == ["postgres://u:secret@h/db"]
    assert found("credentials.http_auth_bearer", "Authorization: Bearer abcdefghijkl;") == ["abcdefghijkl"]
    assert found("ip-addrs.ipv6-private", "at fe80::1 now") == ["fe80::1"] and found("ip-addrs.ipv6-public", "at fe80::1 now") == []


def test_catalogues_are_checked():
    with pytest.raises(RuleError) as e:
        catalog.Catalog([Rule("a", "x"), Rule("a", "y")])
    assert e.value.code == "DuplicateId"
    with pytest.raises(RuleError) as e:
        catalog.Catalog([Rule("a", "(")])
    assert e.value.code == "BadRegex"
    made = catalog.Catalog([Rule("b", r"\d+", keywords=("n",)), Rule("a", "key=x", keywords=("key",)), Rule("c", "x|y", keywords=("x",))])
    assert made.ineligible() == ["b", "c"] and made.by_id("a").regex == "key=x"
