import pytest

from hushframe.sources import generator as g
from hushframe.sources.catalog import RuleError, load_rules

TOML = r"""
[[rules]]
id = "acme-api-key"
regex = '''(?i)acme=([a-z0-9]{8})(?:[\x60'"\s;]|\\[nr]|$)'''
keywords = ["ACME"]
entropy = 2.5
[[rules]]
id = "acme-client-secret"
regex = '''acs_[0-9]{4}'''
[[rules]]
id = "Acme.Client-Secret"
regex = '''(a)(acs2_[0-9]{4})'''
[[rules]]
id = "acme-client-secret"
regex = '''acs3_[0-9]{4}'''
[[rules]]
id = "generic-api-key"
regex = '''x'''
[[rules]]
id = "paths-only"
path = '''x'''
[[rules]]
id = "acme-pat"
regex = '''pat'''
"""


def test_rules_are_made_and_read_back(tmp_path):
    rules = g.generate(TOML, captures={"Acme.Client-Secret": [2]}, regexes={"acme-pat": "pat_[0-9]+"})
    assert [r.rule_id for r in rules] == ["credentials.acme-client-secret.gl", "credentials.acme-client-secret_2.gl", "credentials.acme.client-secret.gl", "api_keys.acme-api-key.gl", "access_tokens.acme-pat.gl"]
    key = rules[3]
    assert key.regex.endswith(g.IN_PROMPT) and key.keywords == ("acme",) and key.entropy == 2.5 and key.capture_groups == (1,) and key.placeholder == "ACME_API_KEY"
    assert rules[2].capture_groups == (2,) and rules[4].regex == "pat_[0-9]+"
    (tmp_path / "made.yaml").write_text(g.to_yaml(rules))
    assert load_rules([tmp_path / "made.yaml"]).rules == rules
    with pytest.raises(RuleError):
        g.generate(TOML, regexes={"acme-pat": "(?=x)"})
    assert g.generate("") == []


def test_catalogues_that_a_session_names(spark, tmp_path):
    from hushframe.sources.catalog import SETTING, session_rules

    (tmp_path / "more.toml").write_text(TOML)
    (tmp_path / "own.yaml").write_text("guardrails_regex_rules: [{data_type: 6, name: OWN, rules: [{rule_id: own, regex: 'x{9}'}]}]")
    spark.conf.set(SETTING, f"{tmp_path}/more.toml, {tmp_path}/own.yaml")
    try:
        made = session_rules(spark)
    finally:
        spark.conf.unset(SETTING)
    assert made.by_id("own").data_type == 6 and made.by_id("api_keys.acme-api-key.gl") and len(made.rules) == len(load_rules().rules) + len(g.generate(TOML)) + 1
