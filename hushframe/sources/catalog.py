"""Rule catalogues: loading YAML, checking rules, choosing among them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
import yaml

from .prefilter import guarantees_keyword

DATA_TYPES = ("UNSPECIFIED", "CREDENTIALS", "API_KEYS", "ACCESS_TOKENS", "IP_ADDRESSES", "PERSONAL_DATA", "CUSTOM")
VALIDATORS = frozenset(
    "luhn snils inn_person inn_org ogrn ogrnip iban_mod97 email_ascii payment_card payment_card_no_luhn entropy banlist ip_v4 ip_v6 ip_public ip_private".split()
)
ROOT_KEY = "guardrails_regex_rules"
BUILTIN = Path(__file__).with_name("rules.yaml")


class RuleError(ValueError):
    """A catalogue's fault; `code` is one of InvalidId, DuplicateId, UnknownValidator, BadRegex, BadCaptureGroup, ParseError."""

    def __init__(self, code: str, detail: str) -> None:
        super().__init__(f"{code}: {detail}")
        self.code = code


@dataclass(frozen=True)
class Rule:
    rule_id: str
    regex: str
    data_type: int = 0
    group: str = ""
    placeholder: str = ""
    capture_groups: tuple[int, ...] = ()
    validators: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    min_length: int = 0
    entropy: float = 0.0
    banlist: tuple[str, ...] = ()
    default_on: bool = True


@dataclass
class Catalog:
    """Checked rules of different ids, in order."""

    rules: list[Rule] = field(default_factory=list)

    def __post_init__(self) -> None:
        rules, self.rules, self._ids = self.rules, [], {}
        for rule in rules:
            self.add(rule)

    def add(self, rule: Rule) -> None:
        if rule.rule_id in self._ids:
            raise RuleError("DuplicateId", rule.rule_id)
        check(rule)
        self._ids[rule.rule_id] = rule
        self.rules.append(rule)

    def by_id(self, rule_id: str) -> Rule | None:
        return self._ids.get(rule_id)

    def ineligible(self) -> list[str]:
        """Ids, sorted, of the rules whose keywords can't gate them: not every match is proven to hold one."""
        return sorted(r.rule_id for r in self.rules if r.keywords and not guarantees_keyword(r.regex, r.keywords))

    def for_data_types(self, types: list[int]) -> list[Rule]:
        """By the given types' order, then the catalogue's; a type given twice comes twice."""
        return [r for t in types for r in self.rules if r.data_type == t]

    def frame(self, spark):
        rows = [(i, r.rule_id, r.regex, r.data_type, r.group, r.placeholder, list(r.capture_groups), list(r.validators), list(r.keywords), r.min_length) for i, r in enumerate(self.rules)]
        return spark.createDataFrame(rows, "ordinal int, rule_id string, regex string, data_type int, `group` string, placeholder string, capture_groups array<int>, validators array<string>, keywords array<string>, min_length int")


def data_type(value: int | str) -> int:
    """A data type's number from its number or its name in any case; 0 for what is neither."""
    text = str(value).strip()
    if text.isdigit():
        return int(text) if int(text) < len(DATA_TYPES) else 0
    return DATA_TYPES.index(text.upper()) if text.upper() in DATA_TYPES else 0


def groups_in(regex: str) -> int:
    """How many capture groups a pattern has."""
    return len(list(_openings(regex)))


def _openings(regex: str):
    """Places of the parentheses that open a capture group."""
    at, inside = 0, False
    while at < len(regex):
        c = regex[at]
        if c == "\\":
            if regex.startswith("\\Q", at):
                at = regex.find("\\E", at) if "\\E" in regex[at:] else len(regex)
            at += 2
            continue
        if inside:
            if c == "[" and regex.startswith("[:", at) and ":]" in regex[at:]:
                at = regex.index(":]", at) + 1
            elif c == "]":
                inside = False
        elif c == "[":
            inside = True
            at += 1 + regex.startswith("^", at + 1)
            if at < len(regex) and regex[at] == "]":
                at += 1
            continue
        elif c == "(" and (not regex.startswith("(?", at) or regex.startswith("(?P<", at) or re.match(r"\(\?<[A-Za-z]", regex[at:])):
            yield at
        at += 1


def named(regex: str) -> str:
    """The pattern with its capture groups named g1, g2, ..."""
    out, last = "", 0
    for n, at in enumerate(_openings(regex), 1):
        out += regex[last:at] + f"(?P<g{n}>"
        last = at + (re.match(r"\(\??P?<?(?:[A-Za-z]\w*>)?", regex[at:]).end() if regex.startswith("(?", at) else 1)
    return out + regex[last:]


def check(rule: Rule) -> None:
    """Raises RuleError for the first fault: id, validators, pattern, capture groups."""
    if not re.fullmatch(r"[a-z0-9_.-]{1,128}", rule.rule_id):
        raise RuleError("InvalidId", rule.rule_id)
    for name in rule.validators:
        if name not in VALIDATORS:
            raise RuleError("UnknownValidator", f"{rule.rule_id}: {name}")
    try:
        pc.match_substring_regex(pa.array([""]), f"(?m){rule.regex}")
    except pa.ArrowInvalid as e:
        raise RuleError("BadRegex", f"{rule.rule_id}: {e}") from e
    for g in rule.capture_groups:
        if not 1 <= g <= groups_in(rule.regex):
            raise RuleError("BadCaptureGroup", f"{rule.rule_id}: {g}")
    if rule.placeholder.strip():
        from hushframe.operators.restore import tolerant_pattern

        try:
            pc.match_substring_regex(pa.array([""]), f"(?i){tolerant_pattern(rule.placeholder)}")
        except pa.ArrowInvalid as e:
            raise RuleError("BadRegex", f"{rule.rule_id}: placeholder {rule.placeholder}: {e}") from e


def read_rules(text: str) -> list[Rule]:
    try:
        data = yaml.safe_load(text) or {}
    except yaml.YAMLError as e:
        raise RuleError("ParseError", str(e)) from e
    groups = data.get(ROOT_KEY) if isinstance(data, dict) else None
    if groups is None:
        return []
    if not isinstance(groups, list):
        raise RuleError("ParseError", f"{ROOT_KEY} is no sequence")
    out = []
    for g in groups:
        if not isinstance(g, dict):
            raise RuleError("ParseError", "a group is no mapping")
        rules = g.get("rules")
        if rules is None:
            continue
        if not isinstance(rules, list):
            raise RuleError("ParseError", "rules is no sequence")
        for r in rules:
            if not isinstance(r, dict) or not isinstance(r.get("masking") or {}, dict):
                raise RuleError("ParseError", "a rule, or its masking, is no mapping")
            masking = r.get("masking") or {}
            out.append(Rule(
                rule_id=str(r.get("rule_id", "")), regex=str(r.get("regex", "")), data_type=int(g.get("data_type", 0)), group=str(g.get("name", "")),
                placeholder=str(masking.get("placeholder", "")), capture_groups=tuple(masking.get("capture_groups") or ()), validators=tuple(r.get("validators") or ()),
                keywords=tuple(str(k).lower() for k in r.get("keywords") or ()), min_length=int(r.get("min_length") or 0), entropy=float(r.get("entropy") or 0),
                banlist=tuple(str(b).lower() for b in r.get("banlist") or ()), default_on=bool(r.get("default_on", True)),
            ))
    return out


def load_rules(paths: list[str | Path] | None = None) -> Catalog:
    """The checked rules of the files, in order; without files named, the built-in ones. A path counts once."""
    paths = [BUILTIN] if paths is None else list(dict.fromkeys(str(p).strip() for p in paths if str(p).strip()))
    if not paths:
        raise RuleError("ParseError", "no files")
    return Catalog([rule for path in paths for rule in read_rules(Path(path).read_text(encoding="utf-8"))])


#: The session's setting that names further catalogues, YAML or TOML, by path and parted by commas.
SETTING = "spark.hushframe.rules"


def session_rules(spark) -> Catalog:
    """The built-in rules, then those of the catalogues that the session names; a catalogue in TOML is made into rules."""
    from .generator import generate

    made = load_rules()
    for path in (p.strip() for p in (spark.conf.get(SETTING, "") or "").split(",")):
        if path:
            text = Path(path).read_text(encoding="utf-8")
            for rule in generate(text) if path.endswith(".toml") else read_rules(text):
                made.add(rule)
    return made
