"""Personal data: fixed patterns, and a semi-Markov conditional random field for what they miss.

The field scores whole spans: a candidate segment's features (digits, separators, cue word before it, checksum) times
the weights of its type. Dynamic programming over the tokens near a digit or an at sign chooses boundaries and types
together, with segments of at most LONGEST tokens. Weights maximise the conditional likelihood of seeded synthetic
sentences, which also hold dates, prices, versions and numbers that are nobody's.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
import string
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, table, trim

KINDS = ("email", "ip", "card", "phone")
# The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# The same patterns in parts that read a text once, however long its runs of letters or digits are: an address is looked
# for around each at sign, a number from the beginning of its run of digits, from which any match must start.
_LOCAL = string.ascii_letters + string.digits + "._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_QUAD = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")

LONGEST = 14
#: Characters around a digit or an at sign that the model reads.
REACH = 48
#: How much more likely than no entity a span must be, as a log ratio, to be added.
SURE = 2.0
SENTENCES, ROUNDS, RATE, DECAY = 240, 12, 0.5, 1e-3

_TRIGGER = re.compile(r"[0-9@]|[\[(]at[\])]")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s+|[^\sA-Za-z0-9]")
_DIGIT = re.compile(r"[0-9]")
_CUES = {w: c for c, ws in enumerate(("email mail e contact", "call phone tel telephone mobile cell fax", "card visa mastercard payment", "ip server host address"), 1) for w in ws.split()}
_NEVER = {w: 5 for w in "order invoice version page date id ref total year item number".split()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def is_octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def addresses(text: str):
    """(start, end) of what EMAIL finds."""
    before, last, at = 0, 0, text.find("@")
    while at >= 0:
        begin = max(before, last)
        start = begin + len(text[begin:at].rstrip(_LOCAL))
        if start < at and (m := _DOMAIN.match(text, at)):
            last = m.end()
            yield start, last
        before, at = at + 1, text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns: leftmost, not overlapping within a kind, in the order of the kinds."""
    out = [("email", s, e) for s, e in addresses(text)]
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", *m.span()) for m in _QUAD.finditer(text) if all(map(is_octet, m[0].split(".")))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return out


N_FEATURES = 40


def features(text: str, start: int, end: int, cue: int, tokens: int) -> list[int] | None:
    """Numbers of the features that hold for the span; None if no entity can have this form."""
    span = text[start:end]
    digits = digits_of(span)
    n, at = len(digits), "@" in span or "at]" in span or "at)" in span
    if not n and not at or span[-1].isspace() or span[0].isspace() or "\n" in span:
        return None
    before = text[start - 1] if start else " "
    after = text[end] if end < len(text) else " "
    words = sum(c.isalpha() for c in span)
    dots, dashes, blanks, brackets = span.count("."), span.count("-"), span.count(" "), span.count("(")
    out = [0, 1 + (0, 1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 5, 5, 5, 5, 6, 6, 6, 6)[n] if n < 20 else 8, 9 + cue]
    out.append(15 + (2 if at and words >= 4 else 1 if at else 0))
    out.append(18 + min(3, dots))
    out.append(22 + (dashes == 2) + 2 * (blanks > 0))
    if words and not at:
        out.append(26)
    if 13 <= n <= 19 and luhn(digits) and not words:
        out.append(27)
    if dots == 3 and not words and all(p.isdigit() and is_octet(p) for p in span.split(".")):
        out.append(28)
    if span[0] == "+":
        out.append(29)
    if brackets == 1 and span.count(")") == 1:
        out.append(30)
    if before.isalnum() or before in "@+#$€.-_/":
        out.append(31)
    if after.isalnum() or after in "@%$€-_/":
        out.append(32)
    if at and dots and span[-1].isalpha() and span[0].isalnum():
        out.append(33)
    if not span[-1].isalnum():
        out.append(34)
    if span[0] not in "+(" and not span[0].isalnum():
        out.append(35)
    if n and not words and not at and len(span) - n - dashes - blanks - dots - 2 * brackets - (span[0] == "+"):
        out.append(36)
    if 10 <= n <= 12 and (dashes + blanks + dots >= 2) and not words and not at:
        out.append(37)
    if any(c.isdigit() for c in span) and re.search(r"[0-9]{5}", span) and not at:
        out.append(38)
    out.append(39 if tokens > 10 else 0)
    return out


def candidates(text: str, spans: list[tuple[int, int]]) -> list[list[tuple[int, list[int]]]]:
    """For each token, the segments that start there as (one past the last token, features)."""
    out, cue = [], 0
    for i, (start, end) in enumerate(spans):
        own, word = [], text[start:end].lower()
        if not word.isspace():
            for j in range(i + 1, min(len(spans), i + LONGEST) + 1):
                held = features(text, start, spans[j - 1][1], cue, j - i)
                if held:
                    own.append((j, held))
        out.append(own)
        cue = _CUES.get(word, _NEVER.get(word, cue if not word.isalpha() else 0))
    return out


def best_segments(found, weights: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(first token, one past the last, type, score over no entity) of the best segmentation."""
    n = len(found)
    best, back = [0.0] + [-math.inf] * n, [None] * (n + 1)
    for i in range(n):
        if best[i] >= best[i + 1]:
            best[i + 1], back[i + 1] = best[i], (i, -1, 0.0)
        for j, held in found[i]:
            scores = weights[:, held].sum(axis=1)
            kind = int(scores.argmax())
            if best[i] + scores[kind] > best[j]:
                best[j], back[j] = best[i] + float(scores[kind]), (i, kind, float(scores[kind]))
    out, j = [], n
    while j:
        i, kind, score = back[j]
        if kind >= 0:
            out.append((i, j, kind, score))
        j = i
    return out[::-1]


def gradient(found, gold: set, weights: np.ndarray) -> np.ndarray:
    """Of the log likelihood: features of the true segments minus their expectation over all segmentations."""
    n = len(found)
    scored = [[(j, held, weights[:, held].sum(axis=1)) for j, held in own] for own in found]
    alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    alpha[0] = beta[n] = 0.0
    for i in range(n):
        alpha[i + 1] = np.logaddexp(alpha[i + 1], alpha[i])
        for j, _, s in scored[i]:
            alpha[j] = np.logaddexp(alpha[j], alpha[i] + np.logaddexp.reduce(s))
    out = np.zeros_like(weights)
    for i in range(n - 1, -1, -1):
        beta[i] = beta[i + 1]
        for j, held, s in scored[i]:
            beta[i] = np.logaddexp(beta[i], np.logaddexp.reduce(s) + beta[j])
            p = np.exp(alpha[i] + s + beta[j] - alpha[n])
            for kind in range(len(KINDS)):
                np.add.at(out[kind], held, ((i, j, kind) in gold) - p[kind])
    return out


def sentence(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A synthetic sentence and its entities (start, end, type)."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    w = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8)))

    def card() -> str:
        body = d(15)
        body += next(c for c in "0123456789" if luhn(body + c))
        sep = rng.choice(["", " ", "-"])
        return sep.join(body[i : i + 4] for i in range(0, 16, 4))

    makers = (
        lambda: rng.choice([f"{w()}.{w()}@{w()}.com", f"{w()}{d(2)}@{w()}.example.org", f"{w()} @ {w()}.com", f"{w()} [at] {w()}.org", f"{w()}(at){w()}.net"]),
        lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        card,
        lambda: rng.choice([f"+{rng.randint(1, 99)} ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(3)} {d(3)}"]),
    )
    cues = (["mail", "contact", "email"], ["server", "host", "ip"], ["card", "visa"], ["call", "phone", "tel"])
    others = (
        lambda: f"{rng.randint(1900, 2030)}-{d(2)}-{d(2)}", lambda: f"order {d(rng.randint(3, 12))}", lambda: f"${d(2)}.{d(2)}", lambda: f"version {rng.randint(0, 9)}.{d(1)}.{d(1)}",
        lambda: d(rng.randint(1, 16)), lambda: f"invoice {d(3)}-{d(3)}-{d(4)}", lambda: f"@{w()}", lambda: f"{d(2)}/{d(2)}/{d(4)}", lambda: f"{d(3)} {d(3)}", lambda: f"page {d(3)}", lambda: f"id {d(4)}-{d(4)}",
    )
    text, gold = w() + " ", []
    for _ in range(rng.randint(1, 3)):
        text += " ".join(w() for _ in range(rng.randint(1, 3))) + " "
        if rng.random() < 0.5:
            kind = rng.randrange(len(KINDS))
            if rng.random() < 0.7:
                text += rng.choice(cues[kind]) + rng.choice([" ", ": "])
            value = makers[kind]()
            gold.append((len(text), len(text) + len(value), kind))
        else:
            value = rng.choice(others)()
        text += value + rng.choice([" ", ". ", ", "])
    return text + w(), gold


@functools.lru_cache(maxsize=1)
def trained() -> np.ndarray:
    """Weights (type, feature), by stochastic gradient ascent; the same on every machine."""
    rng, weights = random.Random(17), np.zeros((len(KINDS), N_FEATURES))
    made = []
    for _ in range(SENTENCES):
        text, gold = sentence(rng)
        spans = [m.span() for m in _TOKEN.finditer(text)]
        first, last = {s: i for i, (s, _) in enumerate(spans)}, {e: i + 1 for i, (_, e) in enumerate(spans)}
        made.append((candidates(text, spans), {(first[s], last[e], k) for s, e, k in gold}))
    for turn in range(ROUNDS):
        for found, gold in made:
            weights += RATE / (1 + turn) * (gradient(found, gold, weights) - DECAY * weights)
    return weights


def added_spans(text: str, base: list[tuple[str, int, int]], weights: np.ndarray) -> list[tuple[str, int, int]]:
    """What the model finds apart from the base spans, in the stretches around digits and at signs."""
    out, until = [], 0
    taken = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    stretches: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        low, high = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if stretches and low <= stretches[-1][1]:
            stretches[-1][1] = high
        else:
            stretches.append([low, high])
    for low, high in stretches:
        while low and text[low - 1].isalnum() and low > until:
            low -= 1
        while high < len(text) and text[high].isalnum():
            high += 1
        until = high
        part = text[low:high]
        spans = [m.span() for m in _TOKEN.finditer(part)]
        for i, j, kind, score in best_segments(candidates(part, spans), weights):
            s, e = low + spans[i][0], low + spans[j - 1][1]
            at = bisect_left(starts, e)
            if score >= SURE and not any(x < e and y > s for x, y in taken[max(0, at - 4) : at]):
                out.append((KINDS[kind], s, e))
    return out


def find(text: str, weights: np.ndarray) -> tuple[list, list]:
    """The base spans and all spans, each by kind and start."""
    base = base_spans(text)
    every = base + added_spans(text, base, weights) if _TRIGGER.search(text) else base
    return base, sorted(every, key=lambda x: (KINDS.index(x[0]), x[1]))


def said(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, comma-joined by kind and start. Counts and the digest are
    of the fixed patterns; `spans` has theirs and the model's. A null text counts as empty, with no spans; a text of any
    length is read whole, in time linear in it. Rows that repeat, or have no doc_id, get a row each; an empty table gives
    an empty result; other columns, whatever their names, play no part.
    """
    weights = trained()

    def f(columns: list[list]) -> list[list]:
        out: list[list] = [columns[0], *([] for _ in range(6))]
        for text in columns[1]:
            base, every = find(text or "", weights)
            for k, kind in enumerate(KINDS):
                out[1 + k].append(sum(x[0] == kind for x in base))
            out[5].append(hashlib.sha256(said(base).encode()).hexdigest())
            out[6].append(said(every))
        return out

    return map_rows(docs, ["doc_id", "text"], "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", f)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """`text` with each span replaced by its kind; of overlapping spans the whole stretch, by the first's kind."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def mask_pii(docs: DataFrame) -> DataFrame:
    """`docs` with the spans in `text` replaced by <EMAIL>, <IP>, <CARD>, <PHONE>; other columns stay, whatever their
    names, and n_chars, if there is one, is that of the new text. Null and empty texts stay as they are; rows that repeat
    are masked each; an empty table stays empty."""
    weights = trained()
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def mask(texts):
        trim()
        return texts.map(lambda t: masked(t, find(t, weights)[1]) if t else t)

    out = docs.withColumn("text", mask("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
