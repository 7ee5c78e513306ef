"""JSON as text: where its values stand, what its strings say, and edits that leave all other characters as they are.

Places are code points of the document. A document that breaks off keeps what was whole before the break.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

SPACE = re.compile(r"[ \t\n\r]*")
STRING = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"')
PLAIN = re.compile(r"(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)(?![0-9A-Za-z.+-])")
ESCAPE = re.compile(r"\\(?:u([dD][89abAB][0-9a-fA-F]{2})\\u([dD][c-fC-F][0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|(.))", re.DOTALL)
SHORT = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
WRITTEN = {'"': '\\"', "\\": "\\\\", " ": "\\u2028", " ": "\\u2029"} | {c: f"\\{k}" for k, c in SHORT.items()}

Path = tuple[str | int, ...]


@dataclass(slots=True)
class Value:
    """A value: its kind ({, [, ", or p for numbers and words), its place, its items; end is -1 if it breaks off."""

    kind: str
    start: int
    end: int = -1
    items: list[tuple[str | int, Value]] = field(default_factory=list)


def read(text: str) -> tuple[Value | None, bool]:
    """The value that the text begins with, and whether the whole text is one JSON value."""
    root, open_values, at, key = None, [], 0, None
    while True:
        at = SPACE.match(text, at).end()
        c = text[at : at + 1]
        inside = open_values[-1] if open_values else None
        if inside and inside.end == -2:  # a value ends here
            inside.end = -1
            if c == ",":
                at = SPACE.match(text, at + 1).end()
                c = text[at : at + 1]
            elif c != {"{": "}", "[": "]"}[inside.kind]:
                return root, False
            else:
                c = "close"
        elif inside and not inside.items and c == {"{": "}", "[": "]"}[inside.kind]:
            c = "close"
        if c == "close":
            open_values.pop().end = at + 1
            at += 1
        else:
            if inside and inside.kind == "{":
                name = STRING.match(text, at)
                at = SPACE.match(text, name.end()).end() if name else at
                if not name or text[at : at + 1] != ":":
                    return root, False
                key = decode(name[0])
                at = SPACE.match(text, at + 1).end()
                c = text[at : at + 1]
            elif inside:
                key = len(inside.items)
            plain = None if c in ("{", "[") else (STRING if c == '"' else PLAIN).match(text, at)
            if not plain and (not c or c not in "{["):
                return root, False
            made = Value(c if c in ("{", "[", '"') else "p", at, plain.end() if plain else -1)
            root = root or made
            if inside:
                inside.items.append((key, made))
            at = plain.end() if plain else at + 1
            if not plain:
                open_values.append(made)
                continue
        if not open_values:
            return root, SPACE.match(text, at).end() == len(text)
        open_values[-1].end = -2


def valid(text: str) -> bool:
    """Whether the text is one JSON value and nothing else (RFC 8259)."""
    return read(text)[1]


def find(value: Value | None, *path: str | int) -> Value | None:
    """The whole value at a path of keys and indices; of equal keys the first counts."""
    for step in path:
        value = next((v for k, v in value.items if k == step and value.kind == ("[" if isinstance(step, int) else "{")), None) if value else None
    return value if value and value.end >= 0 else None


def elements(value: Value | None) -> list[Value]:
    """The whole elements of an array; none of anything else."""
    return [v for _, v in value.items if v.end >= 0] if value and value.kind == "[" else []


def string_leaves(value: Value | None, at: Path = ()) -> Iterator[tuple[Path, Value]]:
    """Every string below a value (keys are none), in the document's order, without recursion."""
    todo = [(at, value)] if value else []
    while todo:
        path, v = todo.pop()
        if v.kind == '"':
            yield path, v
        todo.extend(((*path, k), x) for k, x in reversed(v.items))


def decode(quoted: str) -> str:
    """What a JSON string says; half a surrogate pair becomes U+FFFD, an unknown escape what follows the backslash."""

    def said(m: re.Match) -> str:
        high, low, one, short = m.groups()
        if high:
            return chr(0x10000 + ((int(high, 16) & 0x3FF) << 10) + (int(low, 16) & 0x3FF))
        if one:
            return "�" if 0xD800 <= int(one, 16) < 0xE000 else chr(int(one, 16))
        return SHORT.get(short, short)

    inner = quoted[1:-1] if len(quoted) > 1 and quoted[0] == quoted[-1] == '"' else quoted
    return ESCAPE.sub(said, inner) if "\\" in inner else inner


def encode(raw: str, quotes: bool = True) -> str:
    """A text as a JSON string; < > & and / stay as they are."""
    body = re.sub(r'["\\\x00-\x1f  ]', lambda m: WRITTEN.get(m[0]) or f"\\u{ord(m[0]):04x}", raw)
    return f'"{body}"' if quotes else body


def splice(text: str, edits: list[tuple[int, int, str]]) -> str:
    """The text with its spans (start, end, new) replaced. ValueError for spans that overlap or lie outside."""
    out, last = [], 0
    for start, end, new in sorted(edits, key=lambda e: e[:2]):
        if not last <= start <= end <= len(text):
            raise ValueError(f"span {start}:{end} overlaps another or lies outside")
        out += [text[last:start], new]
        last = end
    return "".join(out) + text[last:]
