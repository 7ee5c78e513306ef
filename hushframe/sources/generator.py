"""Making a rule catalogue in YAML from a secret scanner's rules in TOML."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Mapping

import yaml

from hushframe.sources import catalog

# The class that ends a secret in code, and the one that ends it in a prompt.
IN_CODE = r"""(?:[\x60'"\s;]|\\[nr]|$)"""
IN_PROMPT = r"""(?:[\x60'"\s,;:!?()\[\]{}]|\\[nr]|$)"""
#: Rules too broad for prose.
SKIPPED = ("generic-api-key",)
#: The first pattern found in an id names its data type; ids without one are access tokens. Exceptions are a parameter.
KINDS = ((r"client-(id|secret)|password|oauth|session|cookie|refresh|jwt|auth-|-secret$|secret-yaml|access-id", 1), (r"(^|-)api(-|$)|bearer", 2), (r"", 3))


def kind_of(name: str) -> int:
    return next(kind for pattern, kind in KINDS if re.search(pattern, name.lower()))


def generate(
    text: str,
    regexes: Mapping[str, str] = {},
    captures: Mapping[str, list[int]] = {},
    kinds: Mapping[str, int] = {},
    skipped: tuple[str, ...] = SKIPPED,
) -> list[catalog.Rule]:
    """The checked rules of a TOML document, by data type and id. `regexes`, `captures`, `kinds`: exceptions by TOML id.

    Rules without a pattern (they look at paths) and `skipped` ones are left out. A pattern with groups captures its
    first one, unless `captures` says otherwise. RuleError for a pattern that the engine cannot run.
    """
    made, used = [], set()
    for r in tomllib.loads(text).get("rules", []):
        name, regex = r.get("id", ""), regexes.get(r.get("id", ""), r.get("regex", ""))
        if not regex or name in skipped:
            continue
        regex = regex.replace(IN_CODE, IN_PROMPT)
        kind = kinds.get(name, kind_of(name))
        stem = f"{catalog.DATA_TYPES[kind].lower()}.{re.sub(r'[^a-z0-9_.-]', '-', name.lower())}"
        rule_id, n = f"{stem}.gl", 2
        while rule_id in used:
            rule_id, n = f"{stem}_{n}.gl", n + 1
        used.add(rule_id)
        groups = captures.get(name, [1] if catalog.groups_in(regex) else [])
        placeholder = re.sub(r"[^A-Z0-9]+", "_", name.upper()).strip("_")
        keywords = tuple(k.lower() for k in r.get("keywords", []))
        rule = catalog.Rule(rule_id, regex, kind, catalog.DATA_TYPES[kind], placeholder, tuple(groups), keywords=keywords, entropy=float(r.get("entropy", 0)))
        catalog.check(rule)
        made.append(rule)
    return sorted(made, key=lambda r: (r.data_type, r.rule_id))


def to_yaml(rules: list[catalog.Rule]) -> str:
    """The rules as a document that `load_rules` reads back to the same."""
    groups: dict[int, dict] = {}
    for r in rules:
        group = groups.setdefault(r.data_type, {"data_type": r.data_type, "name": r.group, "rules": []})
        said = {"rule_id": r.rule_id, "regex": r.regex, "keywords": list(r.keywords), "validators": list(r.validators), "min_length": r.min_length, "entropy": r.entropy, "banlist": list(r.banlist)}
        masking = {"capture_groups": list(r.capture_groups)} if r.capture_groups else {}
        group["rules"].append({k: v for k, v in said.items() if v} | ({} if r.default_on else {"default_on": False}) | {"masking": masking | {"placeholder": r.placeholder}})
    return yaml.safe_dump({catalog.ROOT_KEY: list(groups.values())}, sort_keys=False, allow_unicode=True, width=1 << 20)
