"""Restoring originals from placeholders, also from ones that a language model has written a little differently."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.functions import jsontext as J

GAP, DIGITS = 3, 9
_BLANK = r"[\t\n\f\r ]"


def tolerant_pattern(kind: str) -> str:
    """The pattern of a type's placeholders: any case, some blanks, tokens joined by blanks, _ or - or nothing."""
    tokens = [re.escape(t) for t in kind.split("_") if t]
    joint = rf"[\t\n\f\r _-]{{0,{GAP}}}"
    return f"<{_BLANK}{{0,{GAP}}}{''.join(t + joint for t in tokens)}([0-9]{{1,{DIGITS}}}){_BLANK}{{0,{GAP}}}>"


def longest(kind: str) -> int:
    """The most characters that `tolerant_pattern` can match."""
    tokens = [t for t in kind.split("_") if t]
    return 2 + 2 * GAP + DIGITS + sum(len(t) + GAP for t in tokens)


class RestoreError(RuntimeError):
    """The tolerant pass failed. `unemitted` is all that was held, exactly restored: the caller must give it out, as
    nothing else holds it any more."""

    def __init__(self, detail: str, unemitted: str) -> None:
        super().__init__(detail)
        self.unemitted = unemitted


class Restorer:
    """One stream of text. `known`: (placeholder, original) in order; `kinds`: the types to be recognised tolerantly.

    Of equal placeholders the first counts. What replaces an exact placeholder is not read again, but the tolerant
    pass then reads the whole text. With `in_json` originals are escaped.
    """

    def __init__(self, known: list[tuple[str, str]], kinds: list[str] = (), in_json: bool = False) -> None:
        self.known: dict[str, str] = {}
        for placeholder, original in known:
            if placeholder:
                self.known.setdefault(placeholder, J.encode(original, quotes=False) if in_json else original)
        self.exact = re.compile("|".join(map(re.escape, self.known))) if self.known else None
        self.kinds = [(k, re.compile(tolerant_pattern(k), re.IGNORECASE)) for k in dict.fromkeys(kinds) if k.strip()]
        self.hold = max([0, *map(len, self.known), *(longest(k) for k, _ in self.kinds)])
        self.pending = ""

    def whole(self, text: str) -> str:
        if self.exact is None or "<" not in text and not any("<" not in p for p in self.known):
            return text
        text = self.exact.sub(lambda m: self.known[m[0]], text)
        try:
            return self.tolerant(text)
        except Exception as e:
            raise RestoreError(f"placeholder pass failed: {e}", text) from e

    def tolerant(self, text: str) -> str:
        """The placeholders that were written a little differently replaced."""
        found = []
        for order, (kind, pattern) in enumerate(self.kinds):
            for m in pattern.finditer(text):
                if int(m[1]) and (original := self.known.get(f"<{kind}_{int(m[1])}>")) is not None:
                    found.append((m.start(), -m.end(), order, original))
        out, last = [], 0
        for start, end, _, original in sorted(found):
            if start >= last:
                out += [text[last:start], original]
                last = -end
        return "".join(out) + text[last:]

    def feed(self, chunk: str, flush: bool = False) -> str:
        """What can be given out: all but the last `hold` characters, or everything at a flush."""
        held, self.pending = self.pending + chunk, ""  # cleared first: see RestoreError
        done = self.whole(held)
        keep = len(done) if flush else max(0, len(done) - self.hold)
        self.pending = done[keep:]
        return done[:keep]


def restore_json(raw: str, known: list[tuple[str, str]], kinds: list[str] = ()) -> str:
    """JSON text restored so that it stays JSON: as plain text if that does it, else string by string, else unchanged."""
    plain = Restorer(known, kinds)
    naive = plain.whole(raw)
    if J.valid(naive):
        return naive
    edits = []
    for _, leaf in J.string_leaves(J.read(raw)[0]):
        said = J.decode(raw[leaf.start : leaf.end])
        if (new := plain.whole(said)) != said:
            edits.append((leaf.start, leaf.end, J.encode(new)))
    done = J.splice(raw, edits)
    return done if J.valid(done) else raw


def with_known(rows: DataFrame, found: DataFrame, key: str = "request_id") -> DataFrame:
    """`rows` with the column `known`: the replacements of their request, in order, and their types in `kinds`."""
    kind = F.regexp_extract("placeholder", "^<(.*)_[0-9]+>$", 1)
    lists = found.groupBy(F.col("request_id").alias(key)).agg(
        F.sort_array(F.collect_list(F.struct("ord", "placeholder", "original"))).alias("known"), F.sort_array(F.collect_set(kind)).alias("kinds")
    )
    return rows.join(lists, key, "left")


def restored(rows: DataFrame, json: bool = False) -> DataFrame:
    """request_id, text_idx, text of `rows` (request_id, text_idx, masked_text, known, kinds), without a shuffle.

    `known` is an array of structs with placeholder and original, in order; of equal placeholders the first counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, known, kinds in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                pairs = [(k["placeholder"], k["original"]) for k in known or []]
                out.append(text if text is None or not pairs else restore_json(text, pairs, kinds or []) if json else Restorer(pairs, kinds or []).whole(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["request_id", "text_idx", "text"])

    rows = rows.select(F.col("request_id").cast("long"), F.col("text_idx").cast("int"), "masked_text", "known", "kinds")
    return rows.mapInArrow(run, "request_id long, text_idx int, text string")


def restore(masked: DataFrame, found: DataFrame, json: bool = False) -> DataFrame:
    """request_id, text_idx, text: all of each masked_text restored, tolerantly. `json`: the texts are JSON documents."""
    return restored(with_known(masked, found), json)


def demask(masked: DataFrame, found: DataFrame) -> DataFrame:
    """request_id, text_idx, text: placeholders, of any type, replaced by their originals exactly as they stand.

    What was put in is not read again. Of rows of `found` that repeat a placeholder the first in order counts.
    """
    return restored(with_known(masked, found).withColumn("kinds", F.array().cast("array<string>")))
