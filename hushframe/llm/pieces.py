"""Encoding and decoding with the pieces of a SentencePiece model: Aho-Corasick and one Viterbi pass.

An automaton over all pieces reads a text once; at each position its output links name the pieces that end there,
longest first, and each relaxes the best score of the position; of ways with one score the one that ends in the longest
piece stays. A character that no piece covers costs ten more than the worst piece and is written as its UTF-8 bytes'
pieces.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from array import array

import ahocorasick
from pyspark.sql import DataFrame, SparkSession

from .common import map_rows, table

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_COST = 10.0
#: Stretches of text whose pieces are remembered; a worker forgets all beyond that.
REMEMBERED = 1 << 18


def fields(data: bytes):
    """(number, value) of a protocol buffer's fields: ints, or bytes for the fixed and delimited kinds."""
    at = 0

    def varint() -> int:
        nonlocal at
        value, shift = 0, 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + n]
            at += n


def read_model(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) by id. A model that asks for another normalisation than none is refused."""
    with open(path, "rb") as file:
        model = file.read()
    out = []
    for number, value in fields(model):
        if number == 3 and dict(fields(value)).get(2):  # a table of replacements
            raise ValueError(f"{path} normalises texts, which is not built")
        if number == 1:
            own = dict(fields(value))
            out.append((own[1].decode(), struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0], own.get(3, NORMAL)))
    return out


class Pieces:
    """A model's pieces: encode(text) -> ids, decode(ids) -> text."""

    def __init__(self, pieces: list[tuple[str, float, int]]) -> None:
        self.pieces = pieces
        self.automaton = ahocorasick.Automaton()
        scores = [s for _, s, kind in pieces if kind == NORMAL]
        self.unknown = min(scores, default=0.0) - UNKNOWN_COST
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.unknown_id = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        inner = False
        for i, (piece, score, kind) in enumerate(pieces):
            if kind in (NORMAL, USER) and piece:
                if kind == USER:  # preferred to whatever covers the same characters
                    score = len(piece) * max(scores, default=0.0) - 0.1
                self.automaton.add_word(piece, (i, len(piece), score))
                inner |= SPACE in piece.lstrip(SPACE)
        self.automaton.make_automaton()
        # Where no piece has a space mark behind another character, stretches that begin with marks are independent.
        self.stretches = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if not inner else r"(?s).+").findall
        self.known: dict[str, tuple[int, ...]] = {}
        self.said = [self._bytes_of(p, kind) for p, _, kind in pieces]

    def _bytes_of(self, piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return b"" if kind == CONTROL else piece.replace(SPACE, " ").encode()

    def viterbi(self, text: str) -> tuple[int, ...]:
        n = len(text)
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        done = 0  # positions up to here are final

        def close(upto: int) -> None:
            """Gives each position without a one-character piece the unknown character as a last choice."""
            nonlocal done
            for end in range(done + 1, upto + 1):
                if single[end]:
                    continue
                score = best[end - 1] + self.unknown
                if back[end] is None or score > best[end]:
                    best[end], back[end] = score, (-1, 1)
            done = upto

        single = bytearray(n + 1)
        for last, (i, length, score) in self.automaton.iter(text):
            end = last + 1
            if end > done + 1:
                close(end - 1)
            score += best[end - length]
            single[end] |= length == 1
            if back[end] is None or score > best[end]:
                best[end], back[end] = score, (i, length)
        close(n)
        out, end = [], n
        while end:
            i, length = back[end]
            if i >= 0:
                out.append(i)
            else:
                data = text[end - 1].encode()
                out += [self.bytes[b] for b in reversed(data)] if self.bytes else [self.unknown_id]
            end -= length
        return tuple(reversed(out))

    def encode(self, text: str) -> array:
        """The ids of the text after a space mark for its beginning; nothing for an empty text."""
        out = array("I")
        if not text:
            return out
        known = self.known
        for stretch in self.stretches(SPACE + text.replace(" ", SPACE)):
            ids = known.get(stretch)
            if ids is None:
                ids = self.viterbi(stretch)
                if len(stretch) <= 40:
                    if len(known) > REMEMBERED:
                        known.clear()
                    known[stretch] = ids
            out.extend(ids)
        return out

    def decode(self, ids) -> str:
        said = self.said
        return b"".join([said[i] for i in ids]).decode("utf-8", "replace")[1:]


_loaded: dict[str, Pieces] = {}


def load(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(read_model(path))
    return _loaded[path]


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int). A null text counts as empty and has no ids; a text of any length is encoded whole. Rows
    that repeat get a row each; an empty table gives an empty result; other columns, whatever their names, play no part."""
    path = path or model_path()
    return map_rows(docs, ["doc_id", "text"], "doc_id long, ids array<int>", lambda c: [c[0], [load(path).encode(t or "").tolist() for t in c[1]]])


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text. A space mark of the original (U+2581) comes back as a space; all else as it was. Null or empty ids
    give an empty text; rows that repeat get a row each; an empty table gives an empty result."""
    path = path or model_path()
    return map_rows(encoded, ["doc_id", "ids"], "doc_id long, text string", lambda c: [c[0], [load(path).decode(i or []) for i in c[1]]])


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document, rows that repeat and null texts, which count as empty, included: doc_id, n_ids, ids_crc32 (unsigned, little-endian unsigned 32
    bits an id), decoded_sha256 and round_trip (whether decoding the ids gives the text again, U+2581 as a space)."""
    path = path or model_path()

    def f(columns: list[list]) -> list[list]:
        model = load(path)
        out: list[list] = [columns[0], [], [], [], []]
        for text in columns[1]:
            text = text or ""
            ids = model.encode(text)
            decoded = model.decode(ids)
            for column, value in zip(out[1:], (len(ids), zlib.crc32(ids.tobytes()), hashlib.sha256(decoded.encode()).hexdigest(), decoded == text.replace(SPACE, " ")), strict=True):
                column.append(value)
        return out

    return map_rows(docs, ["doc_id", "text"], "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean", f)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
