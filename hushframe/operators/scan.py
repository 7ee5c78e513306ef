"""Scanning: every rule's matches in every text, then disjoint findings.

The patterns are RE2's, and Arrow's RE2 runs them, on a whole batch at a time: one pass for each rule says which texts
have a match at all, a second one marks all matches of these, and a third one finds the capture groups of all matches
at once. A text is read a fixed number of times for each rule that it has, however many matches there are. Scanning,
merging overlaps and, where a request is one text, masking need nothing but the text, and so stay in one task without
a shuffle. Offsets are code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hushframe.functions.validators import passes
from hushframe.sources.catalog import Rule, groups_in, named
from hushframe.sources.prefilter import guarantees_keyword

CANDIDATES = "request_id long, text_idx int, start int, end int, rule_id string, data_type int, placeholder_type string, original string"
#: Code points of private use, of which two that a text lacks mark its matches.
MARKS = range(0xE000, 0xF8FF, 2)
#: Characters after a match that are read with it at first; all that follow it, if that does not give the same match.
AHEAD = 64
LITERAL = r"<[A-Za-z0-9_]+_[0-9]+>"
_literal = re.compile(r"<([A-Za-z0-9_]+)_([1-9][0-9]{0,8})>")


class Span(NamedTuple):
    start: int
    end: int
    rule: Rule


def _marked(texts: pa.Array, pattern: str) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(place, spans of all whole matches) of each text: leftmost, the search going on where the last one ended."""
    left = list(range(len(texts)))
    for mark in MARKS:
        begin, end = chr(mark), chr(mark + 1)
        own = texts.take(pa.array(left))
        has = pc.or_(pc.match_substring(own, begin), pc.match_substring(own, end)).to_pylist()
        free = [i for i, x in zip(left, has, strict=True) if not x]
        for i, text in zip(free, pc.replace_substring_regex(texts.take(pa.array(free, pa.int64())), pattern=pattern, replacement=f"{begin}\\0{end}").to_pylist(), strict=True):
            spans, at = [], 0
            for k, part in enumerate(text.split(begin)):
                if k:
                    value, part = part.split(end)
                    if value:
                        spans.append((at, at + len(value)))
                    at += len(value)
                at += len(part)
            yield i, spans
        left = [i for i, x in zip(left, has, strict=True) if x]
        if not left:
            return
    raise ValueError("a text holds all marks")  # 3,200 pairs of code points of private use


def _grouped(text: list[str], found: list[tuple[int, int, int]], rule: Rule) -> list[tuple[int, int] | None]:
    """The span of the first capture group that has any of each match (place of its text, start, end).

    A match is read again from the character before it, on a few characters beyond its end. If that gives the same end,
    no way to match that comes before it in the pattern's order can have used the cut, so the groups are the same too.
    """
    head, pattern, n = r"\A(?s:.)", named(rule.regex), groups_in(rule.regex)
    out: list[tuple[int, int] | None] = [None] * len(found)
    left, ahead = list(range(len(found))), AHEAD
    while left:
        parts = [text[found[k][0]][max(0, found[k][1] - 1) : found[k][2] + ahead] for k in left]
        inner = [k for k in left if found[k][1] > 0]
        spans: dict[int, dict] = {}
        by = dict(zip(left, parts, strict=True))
        for own, lead in ((inner, head), ([k for k in left if found[k][1] == 0], r"\A")):
            if own:
                spans.update(zip(own, pc.extract_regex_span(pa.array([by[k] for k in own]), f"(?m){lead}(?P<g0>{pattern})").to_pylist(), strict=True))
        again = []
        for k in left:
            i, start, end = found[k]
            begin = max(0, start - 1)
            data = by[k].encode()
            place = lambda span: (begin + len(data[: span[0]].decode()), begin + len(data[: span[0] + span[1]].decode()))  # noqa: B023, E731
            got = spans[k]
            whole = end + ahead >= len(text[i])
            if not whole and (got is None or place(got["g0"])[1] != end):
                again.append(k)
                continue
            got = got or {}
            out[k] = next((place(got[f"g{g}"]) for g in rule.capture_groups if 1 <= g <= n and got.get(f"g{g}") and got[f"g{g}"][1] > 0), None)
        left, ahead = again, ahead * 16
    return out


_RUN = re.compile(r"(?:\(\?-i\))?\\b\((?:\[(?:[A-Za-z0-9]-[A-Za-z0-9])+\][*+?]?)+\)\\b")


def gate(rule: Rule) -> str | None:
    """A cheap pattern that every text with a value of the rule matches, where one is known: a pattern that is a run of
    ASCII letters and digits, with a least length, asks for such a run of that length."""
    if rule.min_length > 0 and rule.capture_groups in ((), (1,)) and _RUN.fullmatch(rule.regex):
        return f"[A-Za-z0-9]{{{rule.min_length}}}"
    return None


def batch_matches(texts: pa.Array, rule: Rule, searched: pa.Array | None = None) -> Iterator[tuple[int, int, int, str]]:
    """(place of the text, start, end, value) of the rule's values in `texts`, text by text in order."""
    pattern = f"(?m){rule.regex}"
    searched = texts if searched is None else searched
    if first := gate(rule):
        searched = pc.if_else(pc.match_substring_regex(searched, first), searched, None)
    at = pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(searched, pattern), False))
    if not len(at):
        return
    some = texts.take(at)
    values = some.to_pylist()
    found = [(i, s, e) for i, spans in sorted(_marked(some, pattern)) for s, e in spans]
    chosen = _grouped(values, found, rule) if rule.capture_groups else [(s, e) for _, s, e in found]
    for (i, _, _), span in zip(found, chosen, strict=True):
        if span and span[1] > span[0]:
            value = values[i][span[0] : span[1]]
            if (rule.min_length <= 0 or len(value.encode()) >= rule.min_length) and passes(value, rule):
                yield at[i].as_py(), span[0], span[1], value


def matches(text: str, rule: Rule) -> Iterator[tuple[int, int]]:
    """(start, end) of the rule's values in one text."""
    for _, s, e, _ in batch_matches(pa.array([text], pa.string()), rule):
        yield s, e


class Scanner:
    """Rules made ready for batches. `prefilter` skips texts without a rule's keywords where each match is proven to
    hold one, so it loses none."""

    def __init__(self, rules: list[Rule], prefilter: bool = False) -> None:
        self.rules = rules
        self.proven = {r.rule_id for r in rules if guarantees_keyword(r.regex, r.keywords)} if prefilter else set()

    def found(self, texts: pa.Array) -> Iterator[tuple[int, int, int, str, Rule]]:
        """(place of the text, start, end, value, rule) of all candidates; a null text has none."""
        lower = pc.utf8_lower(texts) if self.proven else None
        for rule in self.rules:
            searched = texts
            if rule.rule_id in self.proven:
                has = reduce(pc.or_, [pc.match_substring(lower, k.lower()) for k in rule.keywords if k])
                searched = pc.if_else(has, texts, None)
            for i, s, e, value in batch_matches(texts, rule, searched):
                yield i, s, e, value, rule

    def findings(self, texts: pa.Array) -> list[list[Span]]:
        """The disjoint findings of each text, in order."""
        out: list[list[Span]] = [[] for _ in range(len(texts))]
        for i, s, e, _, rule in self.found(texts):
            out[i].append(Span(s, e, rule))
        return [merged(spans) for spans in out]


def merged(spans: list[Span]) -> list[Span]:
    """Overlapping spans become their union, told by the longest (then first, then least id); touching ones stay apart."""
    out: list[tuple[int, int, tuple]] = []
    for s in sorted(spans, key=lambda s: (s.start, -s.end, s.rule.rule_id)):
        best = (s.start - s.end, s.start, s.rule.rule_id, s.rule)
        if out and s.start < out[-1][1]:
            start, end, held = out[-1]
            out[-1] = start, max(end, s.end), min(held, best, key=lambda x: x[:3])
        else:
            out.append((s.start, s.end, best))
    return [Span(start, end, best[3]) for start, end, best in out]


def keyed(texts: DataFrame) -> DataFrame:
    return texts.select(F.col("request_id").cast("long"), F.col("text_idx").cast("int"), "text")


def _rows(columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_SPANS = pa.schema([("request_id", pa.int64()), ("text_idx", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("rule_id", pa.string()), ("data_type", pa.int32()), ("placeholder_type", pa.string()), ("original", pa.string())])


def scan(texts: DataFrame, rules: list[Rule], prefilter: bool = False) -> DataFrame:
    """Candidates, one row per match of a rule: see CANDIDATES. `texts`: request_id, text_idx, text.

    A null or empty text has no matches; rows that repeat are scanned each; other columns play no part.
    """
    scanner = Scanner(rules, prefilter)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            request, idx = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = [(request[i], idx[i], s, e, r.rule_id, r.data_type, r.placeholder, value) for i, s, e, value, r in scanner.found(batch.column(2))]
            yield _rows(list(zip(*out, strict=True)) if out else [[]] * len(_SPANS), _SPANS)

    return keyed(texts).mapInArrow(run, CANDIDATES)


def findings(texts: DataFrame, rules: list[Rule], prefilter: bool = False) -> DataFrame:
    """Disjoint findings, with the columns of CANDIDATES, in one pass and without a shuffle; the rows of
    `coalesce(scan(...))`, except that rows of `texts` that repeat are merged each by itself."""
    scanner = Scanner(rules, prefilter)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            request, idx, text = (batch.column(i).to_pylist() for i in range(3))
            out = [
                (request[i], idx[i], s.start, s.end, s.rule.rule_id, s.rule.data_type, s.rule.placeholder, text[i][s.start : s.end])
                for i, spans in enumerate(scanner.findings(batch.column(2))) for s in spans
            ]
            yield _rows(list(zip(*out, strict=True)) if out else [[]] * len(_SPANS), _SPANS)

    return keyed(texts).mapInArrow(run, CANDIDATES)


REPLACEMENT = "struct<ord:int,rule_id:string,data_type:int,original:string,placeholder:string>"
MASKED = f"request_id long, text_idx int, masked_text string, replacements array<{REPLACEMENT}>"
_MASKED = pa.schema([("request_id", pa.int64()), ("text_idx", pa.int32()), ("masked_text", pa.string()), ("replacements", pa.list_(pa.struct([("ord", pa.int32()), ("rule_id", pa.string()), ("data_type", pa.int32()), ("original", pa.string()), ("placeholder", pa.string())])))])


def masked(text: str, spans: list[Span]) -> tuple[str, list[dict]]:
    """The text with numbered placeholders, and the replacements as first met; see `mask.replacements`."""
    taken: dict[str, set[int]] = {}
    for kind, n in _literal.findall(text):
        taken.setdefault(kind, set()).add(int(n))
    by: dict[str, str] = {}
    last: dict[str, int] = {}
    out, made, at = [], [], 0
    for s in spans:
        value, kind = text[s.start : s.end], s.rule.placeholder
        if not kind:
            continue
        if value not in by:
            n = last.get(kind, 0) + 1
            while n in taken.get(kind, ()):
                n += 1
            last[kind] = n
            by[value] = f"<{kind}_{n}>"
            made.append({"ord": len(made) + 1, "rule_id": s.rule.rule_id, "data_type": s.rule.data_type, "original": value, "placeholder": by[value]})
        out += [text[at : s.start], by[value]]
        at = s.end
    return "".join(out) + text[at:], made


def mask_texts(texts: DataFrame, rules: list[Rule], prefilter: bool = False) -> DataFrame:
    """MASKED, for requests of one text each: scanned, merged, numbered and replaced in one pass, without a shuffle.

    A null text stays null. Requests of several texts are for `mask.mask`; here each row counts as a request.
    """
    scanner = Scanner(rules, prefilter)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [(None, []) if t is None else masked(t, spans) for t, spans in zip(batch.column(2).to_pylist(), scanner.findings(batch.column(2)), strict=True)]
            yield _rows([batch.column(0).to_pylist(), batch.column(1).to_pylist(), [d[0] for d in done], [d[1] for d in done]], _MASKED)

    return keyed(texts).mapInArrow(run, MASKED)


def coalesce(candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """Disjoint findings: overlapping candidates become their union, told by the longest (then first, then least id).

    Spans that only touch stay apart. The columns are those of `candidates`. An island is known by its start, and frames
    are ranges of starts, so that the order of rows that compare equal, which sorting leaves open, plays no part.
    """
    key = ["request_id", "text_idx"]
    order = Window.partitionBy(*key).orderBy("start")
    reach = F.max("end").over(order.rangeBetween(Window.unboundedPreceding, -1))
    island = F.max(F.when(F.col("reach").isNull() | (F.col("start") >= F.col("reach")), F.col("start"))).over(order.rangeBetween(Window.unboundedPreceding, 0))
    runs = candidates.withColumn("reach", reach).withColumn("island", island)
    first = F.min_by(F.struct("rule_id", "data_type", "placeholder_type"), F.struct(F.col("start") - F.col("end"), "start", "rule_id"))
    merged = runs.groupBy(*key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), first.alias("r"))
    value = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
    found = merged.join(texts.select(*(F.col(k).cast(t) for k, t in zip(key, ("long", "int"), strict=True)), "text"), key)
    return found.select(*key, "start", "end", "r.rule_id", "r.data_type", "r.placeholder_type", value.alias("original"))
