"""Secrets: fixed patterns, and character Markov models that tell random strings from ordinary identifiers.

Two models of the next character given the last two, of random keys and of ordinary names, are trained from labelled
samples that are made from a seed: names of known words, and of words put together from syllables, so that the model of
names knows what words look like, and not just those it was given. Contexts that were seldom seen lean on shorter ones.
A part of a token of LONG characters at least is added if its log-likelihood ratio for a character is high enough; the
ratio alone decides.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import map_rows, table

KINDS = ("assign", "access", "hex", "random")
# The base patterns.
_WORDS = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""({_WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are whole, so a run of 24 or more is the same as `+` and a length of 24

#: Stretches of characters that the models judge; a random part of LONG characters at least counts.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Log-likelihood ratio, in nats a character, from which a part of a token counts as random.
LEAST = 1.2
LONG = 20
SEPARATORS = "+/_=-"
SAMPLES = 4000
CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_INDEX = {c: i for i, c in enumerate(CHARS)}
#: Words that names in code are made of.
NAMES = """get set user name value index count list array map key data file path read write load save open close start
stop init config option default error message time date year month day hour size length width height color image page
view model table column row field type class object method function request response server client host port query
result cache buffer stream socket thread process memory system admin account group role test debug version update
delete insert create remove add find search filter sort order total number string format parse encode decode token
session event handler service manager factory builder helper util common base main item node tree graph link parent
child root left right top bottom first last next previous current old new temp local global public private""".split()


#: How words begin, go on and end; a third of the samples' words are made of these.
ONSETS = "b br c ch cl cr d dr f fl fr g gl gr h j k l m n p ph pl pr qu r s sc sh sl sm sn sp st str t th tr v w wh".split()
VOWELS = "a e i o u a e i o u ai ea ee ie io oa oo ou ue y".split()
CODAS = "b ck ct d f ft g l ld ll lt m mp n nd ng nk ns nt p r rd rk rm rn rt s sh ss st t th tch x".split()


def word(rng: random.Random) -> str:
    if rng.random() < 0.67:
        return rng.choice(NAMES)
    return "".join(rng.choice(ONSETS) + rng.choice(VOWELS) for _ in range(rng.randint(1, 3))) + rng.choice([*CODAS, "e", "er", "ing", "ed", "ion", "s", ""])


def ordinary(rng: random.Random, words=word) -> str:
    words = [words(rng) for _ in range(rng.randint(2, 5))]
    style = rng.randrange(5)
    text = (
        "_".join(words) if style == 0 else "-".join(words) if style == 1 else "".join(w.capitalize() for w in words) if style == 2
        else "/".join(words) if style == 3 else "_".join(words).upper()
    )
    return text + (rng.choice(["", "_", "-"]) + str(rng.randint(0, 99999)) if rng.random() < 0.5 else "")


def key(rng: random.Random) -> str:
    letters = rng.choice([CHARS[:62], CHARS[:64], CHARS[26:62], "0123456789abcdef", CHARS[:26] + CHARS[52:62]])
    return "".join(rng.choice(letters) for _ in range(rng.randint(20, 48)))


#: Weight of the shorter context's probabilities, in counts.
LEAN = 4.0


def model(samples: list[str]) -> np.ndarray:
    """Log probabilities (last character but one or start, last character or start, next character)."""
    n, start = len(CHARS), len(CHARS)
    counts = np.zeros((n + 1, n + 1, n))
    for text in samples:
        codes = np.array([start, start, *(_INDEX[c] for c in text)])
        np.add.at(counts, (codes[:-2], codes[1:-1], codes[2:]), 1)
    one = counts.sum(axis=(0, 1)) + 0.5
    one /= one.sum()
    two = counts.sum(axis=0)
    two = (two + LEAN * one) / (two.sum(axis=1, keepdims=True) + LEAN)
    return np.log((counts + LEAN * two) / (counts.sum(axis=2, keepdims=True) + LEAN))


@functools.lru_cache(maxsize=1)
def trained() -> np.ndarray:
    """The difference of the two models' log probabilities."""
    rng = random.Random(23)
    return model([key(rng) for _ in range(SAMPLES)]) - model([ordinary(rng) for _ in range(SAMPLES)])


def ratios(codes: np.ndarray, difference: np.ndarray) -> np.ndarray:
    """The log ratio of each character, the first ones after the start."""
    padded = np.concatenate([[len(CHARS)] * 2, codes])
    return difference[padded[:-2], padded[1:-1], codes]


def ratio(text: str, difference: np.ndarray) -> float:
    """Nats a character by which the model of random keys is the likelier."""
    return float(ratios(np.array([_INDEX[c] for c in text]), difference).mean()) if text else -math.inf


def random_parts(text: str, difference: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the parts of `text` that are random.

    Each LONG characters whose own ratio is LEAST at least are a part, and those that overlap or touch are one. A part
    is narrowed to where its sum over half of LEAST a character is highest, then widened to the separators around it.
    A text whose ratio is LEAST at least as a whole is a part if none is in it.
    """
    if len(text) < LONG:
        return []
    codes = np.array([_INDEX[c] for c in text])
    each = ratios(codes, difference)
    total = np.concatenate([[0.0], np.cumsum(each)])  # up to each place
    # A stretch by itself begins after a start: its first two characters have other ratios than in the text.
    begin = difference[len(CHARS), len(CHARS), codes[:-1]] + difference[len(CHARS), codes[:-1], codes[1:]]
    at = np.arange(len(text) - LONG + 1)
    parts: list[list[int]] = []
    for i in np.flatnonzero(begin[at] + total[at + LONG] - total[at + 2] >= LEAST * LONG).tolist():
        if parts and i <= parts[-1][1]:
            parts[-1][1] = i + LONG
        else:
            parts.append([i, i + LONG])
    out = []
    for low, high in parts:
        over = total[low + 1 : high + 1] - np.arange(high - low) * (LEAST / 2)
        least = np.minimum.accumulate(over)
        to = int((over - least).argmax())
        begin, end = low + int(over[: to + 1].argmin()), low + to + 1
        while begin < end and text[begin] in SEPARATORS:
            begin += 1
        while end > begin and text[end - 1] in SEPARATORS:
            end -= 1
        while begin and text[begin - 1] not in SEPARATORS:
            begin -= 1
        while end < len(text) and text[end] not in SEPARATORS:
            end += 1
        if end - begin < LONG:  # a random part with separators in it
            begin, end = low, high
        if out and begin < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out or ([(0, len(text))] if total[-1] >= LEAST * len(text) else [])


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, leftmost and not overlapping within a kind, by start, then kind."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def find(text: str, difference: np.ndarray) -> tuple[list, list]:
    """The base spans and all spans, by start, then kind."""
    base = base_spans(text)
    added = []
    for m in TOKEN.finditer(text):
        at, ends = m.start(), sorted((s, e) for _, s, e in base if s < m.end() and e > m.start())
        for s, e in [*ends, (m.end(), m.end())]:  # what the base spans leave of the token
            added += [("random", at + i, at + j) for i, j in random_parts(text[at:s], difference)]
            at = max(at, e)
    return base, sorted(base + added, key=lambda x: (x[1], KINDS.index(x[0])))


def said(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are kind:start:end of whole matches in code points, end exclusive, comma-joined by start, then kind. Counts
    and the digest are of the fixed patterns; `spans` has theirs and, as kind random, the models'. A null text counts
    as empty; a text of any length is read whole. Rows that repeat, or have no doc_id, get a row each; an empty table gives
    an empty result; other columns, whatever their names, play no part.
    """
    difference = trained()

    def f(columns: list[list]) -> list[list]:
        out: list[list] = [columns[0], *([] for _ in range(5))]
        for text in columns[1]:
            base, every = find(text or "", difference)
            for k, kind in enumerate(KINDS[:3]):
                out[1 + k].append(sum(x[0] == kind for x in base))
            out[4].append(hashlib.sha256(said(base).encode()).hexdigest())
            out[5].append(said(every))
        return out

    return map_rows(docs, ["doc_id", "text"], "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", f)


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
