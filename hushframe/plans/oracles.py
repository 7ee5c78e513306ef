"""DuckDB SQL for what the engine's own code computes: validators, scanning, overlaps, numbering and masking.

None of it shares code with the engine. Matches are found by DuckDB's RE2, which writes marks around them; validators are
sums over lists of digits; masked texts are put together from pieces.
"""

from __future__ import annotations

from hushframe.sources.catalog import Rule

BEGIN, END = "chr(57344)", "chr(57345)"


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _weighted(v: str, weights: tuple[int, ...]) -> str:
    return f"list_sum(list_transform(string_split(left({v}, {len(weights)}), ''), lambda c, i: c::INT * {list(weights)}[i]))"


def _octet(v: str, i: int) -> str:
    return f"string_split({v}, '.')[{i}]::INT"


def luhn(v: str) -> str:
    return f"(length({v}) > 0 AND list_sum(list_transform(list_reverse(string_split({v}, '')), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT WHEN c > '4' THEN 2 * c::INT - 9 ELSE 2 * c::INT END)) % 10 = 0)"


def snils(v: str) -> str:
    s = f"({_weighted(v, (9, 8, 7, 6, 5, 4, 3, 2, 1))} % 101)"
    return f"(CASE WHEN length({v}) <> 11 THEN false ELSE substr({v}, 10)::INT = (CASE WHEN {s} = 100 THEN 0 ELSE {s} END) END)"


def inn_org(v: str) -> str:
    return f"(CASE WHEN length({v}) <> 10 THEN false ELSE {_weighted(v, (2, 4, 10, 3, 5, 9, 4, 6, 8))} % 11 % 10 = substr({v}, 10)::INT END)"


def inn_person(v: str) -> str:
    one, two = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8), (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
    return f"(CASE WHEN length({v}) <> 12 THEN false ELSE {_weighted(v, one)} % 11 % 10 = substr({v}, 11, 1)::INT AND {_weighted(v, two)} % 11 % 10 = substr({v}, 12)::INT END)"


def ogrn(v: str) -> str:
    return f"(CASE WHEN length({v}) <> 13 THEN false ELSE left({v}, 12)::BIGINT % 11 % 10 = substr({v}, 13)::INT END)"


def ogrnip(v: str) -> str:
    return f"(CASE WHEN length({v}) <> 15 THEN false ELSE left({v}, 14)::BIGINT % 13 % 10 = substr({v}, 15)::INT END)"


def card(v: str) -> str:
    """Brand by the leading digits, then whether the length is one of the brand's."""
    n = f"length({v})"
    return (
        f"(CASE WHEN NOT regexp_full_match({v}, '[0-9]{{13,19}}') THEN false WHEN {v} LIKE '4%' THEN {n} IN (13, 16, 19) WHEN regexp_matches({v}, '^3[47]') THEN {n} = 15"
        f" WHEN regexp_matches({v}, '^5[1-5]') OR left({v}, 4) BETWEEN '2221' AND '2720' THEN {n} = 16"
        f" ELSE {n} >= 16 AND regexp_matches({v}, '^(6011|64[4-9]|65|62|220[0-4])') END)"
    )


def iban(v: str) -> str:
    x = f"upper(replace({v}, ' ', ''))"
    values = f"list_transform(string_split(substr({x}, 5) || left({x}, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)"
    return f"(CASE WHEN regexp_full_match({x}, '[A-Z0-9]{{4,}}') THEN list_reduce(list_concat([0], {values}), lambda a, b: (a * (CASE WHEN b > 9 THEN 100 ELSE 10 END) + b) % 97) = 1 ELSE false END)"


def email(v: str) -> str:
    x = f"trim({v}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    atom = "[A-Za-z0-9!#$%&''*+/=?^_`{|}~-]+"
    label = "[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
    return f"(length({x}) <= 254 AND instr({x}, '@') <= 65 AND length({x}) - instr({x}, '@') <= 253 AND regexp_full_match({x}, '{atom}(\\.{atom})*@({label}\\.)+[A-Za-z]{{1,63}}'))"


_PART = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_QUAD = rf"{_PART}(\.{_PART}){{3}}"


def _base(v: str) -> str:
    return f"regexp_replace(CASE WHEN contains({v}, '/') THEN regexp_extract({v}, '^([^/]*)/[0-9]+$', 1) ELSE trim({v}, '[]') END, '(?i)^::ffff:(.*[.])', '\\1')"


def ip_v4(v: str) -> str:
    bits = f"(NOT contains({v}, '/') OR coalesce(try_cast(regexp_extract({v}, '/([0-9]+)$', 1) AS INT), 999) <= CASE WHEN contains({v}, ':') THEN 128 ELSE 32 END)"
    return f"(regexp_full_match({_base(v)}, '{_QUAD}') AND {bits})"


def ip_v6(v: str) -> str:
    x = _base(v)
    groups = f"string_split({x}, ':')"
    bits = f"(NOT contains({v}, '/') OR coalesce(try_cast(regexp_extract({v}, '/([0-9]+)$', 1) AS INT), 999) <= 128)"
    filled = f"len(list_filter({groups}, lambda g: g <> ''))"
    shape = f"(CASE WHEN contains({x}, '::') THEN {filled} <= 7 AND len(string_split({x}, '::')) = 2 AND NOT contains({x}, ':::') AND NOT regexp_matches({x}, '^:[^:]|[^:]:$') ELSE {filled} = 8 AND len({groups}) = 8 END)"
    return f"({shape} AND regexp_full_match({x}, '([0-9A-Fa-f]{{0,4}}:)+[0-9A-Fa-f]{{0,4}}') AND {bits})"


def ip_private(v: str) -> str:
    x = _base(v)
    four = f"({_octet(x, 1)} IN (10, 127) OR {_octet(x, 1)} BETWEEN 224 AND 239 OR {_octet(x, 1)} = 172 AND {_octet(x, 2)} BETWEEN 16 AND 31 OR regexp_matches({x}, '^(192\\.168|169\\.254)\\.') OR {x} = '0.0.0.0')"
    six = f"(regexp_matches(lower({x}), '^(f[cdf]..|fe[89ab].):') OR regexp_full_match({x}, '[0:]*:[01]?') AND contains({x}, ':'))"
    return f"(CASE WHEN {ip_v4(v)} THEN {four} WHEN {ip_v6(v)} THEN {six} ELSE false END)"


def ip_public(v: str) -> str:
    return f"(({ip_v4(v)} OR {ip_v6(v)}) AND NOT {ip_private(v)})"


def entropy(v: str, least: float) -> str:
    n = f"length({v})"
    each = f"list_transform(list_distinct(string_split({v}, '')), lambda c: len(list_filter(string_split({v}, ''), lambda d: d = c)) / {n}::DOUBLE)"
    return f"(CASE WHEN {v} = '' THEN 0 >= {least} ELSE -list_sum(list_transform({each}, lambda p: p * log2(p))) >= {least} - 1e-12 END)"


DIGITS = {"luhn": luhn, "snils": snils, "inn_org": inn_org, "inn_person": inn_person, "ogrn": ogrn, "ogrnip": ogrnip, "payment_card_no_luhn": card, "payment_card": lambda v: f"({card(v)} AND {luhn(v)})"}
OTHERS = {"iban_mod97": iban, "email_ascii": email, "ip_v4": ip_v4, "ip_v6": ip_v6, "ip_private": ip_private, "ip_public": ip_public}


def passes(v: str, rule: Rule) -> str:
    """SQL for whether the value passes the rule's length and validators."""
    tests = [f"strlen({v}) >= {rule.min_length}"]
    for name in rule.validators:
        if name in DIGITS:
            tests.append(DIGITS[name](f"regexp_replace({v}, '[^0-9]', '', 'g')"))
        elif name == "banlist":
            tests.append(f"NOT list_contains({list(rule.banlist)}::VARCHAR[], lower({v}))")
        elif name == "entropy":
            tests.append(entropy(v, rule.entropy) if rule.entropy > 0 else "true")
        else:
            tests.append(OTHERS[name](v))
    return " AND ".join(tests)


def _candidates(rule: Rule, number: int) -> str:
    pattern = quoted(f"(?m-s){rule.regex}")
    value = f"coalesce({', '.join(f'''nullif(regexp_extract(w, {pattern}, {g}), '')''' for g in rule.capture_groups)}, '')" if rule.capture_groups else "w"
    return f"""
  SELECT k, i, {number} AS rule, lead_n + instr(w, v) - 1 AS s, lead_n + instr(w, v) - 1 + length(v) AS e FROM (
    SELECT *, {value} AS v FROM (
      SELECT k, i, string_split(p[j], {END})[1] AS w, (list_sum(list_transform(p[1:j - 1], lambda x: length(x))) - (j - 2))::BIGINT AS lead_n FROM (
        SELECT *, unnest(range(2, len(p) + 1)) AS j FROM (
          SELECT k, i, string_split(regexp_replace(text, {pattern}, {BEGIN} || '\\0' || {END}, 'g'), {BEGIN}) AS p FROM t WHERE regexp_matches(text, {pattern})))))
  WHERE v <> '' AND {passes('v', rule)}"""


def scanned(texts: str, rules: list[Rule]) -> str:
    """CTEs: t (k, i, text), r (rule, rule_id, data_type, kind), c (candidates k, i, rule, s, e) and f, the findings
    (k, i, s, e, rule, rule_id, data_type, kind, original)."""
    listed = ", ".join(f"({n}, {quoted(r.rule_id)}, {r.data_type}, {quoted(r.placeholder)})" for n, r in enumerate(rules))
    return f"""WITH t AS MATERIALIZED ({texts}),
r(rule, rule_id, data_type, kind) AS (VALUES {listed}),
c AS MATERIALIZED ({' UNION ALL '.join(_candidates(r, n) for n, r in enumerate(rules))}),
reach AS (SELECT c.*, rule_id, max(e) OVER (PARTITION BY k, i ORDER BY s, s - e, rule_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c JOIN r USING (rule)),
island AS (SELECT *, sum(CASE WHEN before IS NULL OR s >= before THEN 1 ELSE 0 END) OVER (PARTITION BY k, i ORDER BY s, s - e, rule_id ROWS UNBOUNDED PRECEDING) AS g FROM reach),
one AS (SELECT k, i, min(s) AS s, max(e) AS e, first(rule ORDER BY s - e, s, rule_id) AS rule FROM island GROUP BY k, i, g),
f AS MATERIALIZED (SELECT one.*, rule_id, data_type, kind, substr(text, s + 1, e - s) AS original, i::BIGINT * 4294967296 + s AS place FROM one JOIN r USING (rule) JOIN t USING (k, i))"""


def masked(texts: str, rules: list[Rule]) -> str:
    """CTEs of `scanned`, and firsts (k, original, rule_id, data_type, kind, ord, placeholder) and m (k, i, masked)."""
    return f"""{scanned(texts, rules)},
whole AS (SELECT k, original, min(place) AS met, arg_min(rule_id, place) AS rule_id, arg_min(data_type, place) AS data_type, arg_min(kind, place) AS kind FROM f WHERE kind <> '' GROUP BY k, original),
there AS (SELECT k, list(p) AS ps FROM (SELECT k, unnest(regexp_extract_all(text, '<[A-Za-z0-9_]+_[0-9]+>')) AS p FROM t) GROUP BY k),
counted AS (SELECT whole.*, coalesce(ps, []) AS ps, row_number() OVER (PARTITION BY k, kind ORDER BY met) AS n, row_number() OVER (PARTITION BY k ORDER BY met) AS ord FROM whole LEFT JOIN there USING (k)),
firsts AS (SELECT *, list_filter(list_transform(range(1, n + len(ps) + 1), lambda x: '<' || kind || '_' || x || '>'), lambda p: NOT list_contains(ps, p))[n] AS placeholder FROM counted),
put AS (SELECT f.k, f.i, s, e, placeholder, coalesce(lag(e) OVER (PARTITION BY f.k, f.i ORDER BY s), 0) AS before FROM f JOIN firsts USING (k, original) WHERE f.kind <> ''),
done AS (SELECT k, i, string_agg(substr(text, before + 1, s - before) || placeholder, '' ORDER BY s) AS head, max(e) AS upto FROM put JOIN t USING (k, i) GROUP BY k, i),
m AS (SELECT k, i, coalesce(head || substr(text, upto + 1), text) AS masked FROM t LEFT JOIN done USING (k, i))"""
