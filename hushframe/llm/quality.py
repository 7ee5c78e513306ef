"""Quality classifier: an interpolated modified Kneser-Ney model of character four-grams, trained on trusted text.

Characters are code points as they are: there is no fixed alphabet, and the n-grams counted grow with the text. Counts
stay sharded: order by order they are joined with what their contexts have in all, and from the shortest order up with
the n-grams that the documents hold, which gives each of these its log probability. The documents' n-grams, counted
within each document, are then joined to these by number, and the products are summed by document.

Texts fall into two halves by their hash. A text is scored by the model of the other half's trusted texts, so that none
is scored by a model that has seen it, and trusted and other texts compare. A document is rejected if its mean bits a
character lie outside the quantiles of its language's trusted documents, widened by a margin.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SMALL_ROWS, cut, steps, table
from .graph import look_up
from .slots import drop_rows, may_have, mixed_bits, wanted_map

ORDER = 4
#: Bits of a code point, and what stands before a text.
POINT, START = 21, 0x110000
#: Quantiles of the trusted documents' scores, and by how much of their distance from the median they are widened.
LOW, HIGH, MARGIN = 0.01, 0.99, 0.25
#: The mean of few characters is uncertain: limits are wider by this many bits over the root of a text's characters.
SHORT = 3.0
#: Scores are counted in steps of this many bits for the quantiles.
STEP = 1e-4
#: Below this many trusted documents a language is judged by the quantiles of all languages.
LEAST_TRUSTED = 30
#: Documents' n-grams are dealt to so many turns, by number, so that no more than a turn's are on disk.
TURNS = 3
#: Values are summed as whole numbers of this part of a bit, so that the order of sums plays no part.
UNIT = 1 << 16
#: A piece, of which n-grams are sorted together, has so many characters and texts at most; longer texts are parted.
PIECE_CHARS, TEXT_BITS = 1 << 21, 12
#: Characters of which a task makes n-grams at once; some 20 numbers of 8 bytes are held for each meanwhile.
BLOCK_CHARS = 1 << 18
#: Sums, or n-grams, that a task holds before it sends them on.
HELD = 1 << 18
#: Slots in which a task remembers the n-grams that it has sent; one that was displaced is sent again.
SENT_BITS = 20
_MULTIPLIERS = np.random.default_rng(31).integers(1, 1 << 63, 2, dtype=np.uint64) | np.uint64(1)


def key_of() -> Column:
    """A text's number; a null text counts as empty."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("key")


def half_of() -> Column:
    """The half that a text is in, 0 or 1; equal texts are in the same."""
    return F.pmod(F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.lit("half")), F.lit(2)).cast("int").alias("half")


def grams(texts: list[str], before: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, context and character of all characters of `texts`, each of which goes on after `before` (3 characters).

    The context is the three characters before, of POINT bits each, the nearest last; "" is the start of a text.
    """
    reach = ORDER - 1
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    lead = [b if b else chr(0) * reach for b in before]
    x = np.frombuffer("".join([p for both in zip(lead, texts, strict=True) for p in both]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    first = np.cumsum(size + reach) - size - reach
    fresh = first[[not b for b in before]]
    for k in range(reach):
        x[fresh + k] = START
    own = np.ones(len(x), bool)
    for k in range(reach):
        own[first + k] = False
    at = np.flatnonzero(own)
    context = np.zeros(len(at), np.int64)
    for k in range(reach, 0, -1):
        context = context << POINT | x[at - k]
    return np.repeat(np.arange(len(texts)), size), context, x[at]


def mixed(context: np.ndarray, point: np.ndarray) -> np.ndarray:
    """The n-grams' 64-bit numbers."""
    return mixed_bits(context.view(np.uint64) * _MULTIPLIERS[0] + point.view(np.uint64) * _MULTIPLIERS[1])


def number(context: np.ndarray, point: np.ndarray) -> np.ndarray:
    """The n-grams' numbers without the lowest TEXT_BITS bits, where a place in a piece fits.

    Two n-grams might share a number, of which there are 2 ** 52; they would then share a value.
    """
    return mixed(context, point) & ~np.uint64((1 << TEXT_BITS) - 1)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list, list]]:
    """(texts, what is before each, keys, halves) of bounded size from rows of text, key, half; each text once a piece.

    A text of more than PIECE_CHARS characters comes in parts; only its first has nothing before it.
    """
    texts, before, keys, halves, n, seen = [], [], [], [], 0, set()
    for batch in steps(batches):
        for text, key, half in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if not text or key in seen:
                continue
            for at in range(0, len(text), PIECE_CHARS):
                part = text[at : at + PIECE_CHARS]
                if texts and (n + len(part) > PIECE_CHARS or len(texts) >= 1 << TEXT_BITS):
                    yield texts, before, keys, halves
                    texts, before, keys, halves, n, seen = [], [], [], [], 0, set()
                texts.append(part)
                before.append(text[max(0, at - ORDER + 1) : at])
                keys.append(key)
                halves.append(half)
                n += len(part)
            seen.add(key)
    if texts:
        yield texts, before, keys, halves


def blocks(texts: list[str], before: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """What `grams` gives for all texts, in blocks of BLOCK_CHARS characters at most; longer texts are parted."""
    which, own, lead, n = [], [], [], 0
    for i, (text, b) in enumerate(zip(texts, before, strict=True)):
        for at in range(0, len(text), BLOCK_CHARS):
            part = text[at : at + BLOCK_CHARS]
            if own and n + len(part) > BLOCK_CHARS:
                yield _numbered(which, own, lead)
                which, own, lead, n = [], [], [], 0
            which.append(i)
            own.append(part)
            lead.append(text[at - ORDER + 1 : at] if at else b)
            n += len(part)
    if own:
        yield _numbered(which, own, lead)


def _numbered(which: list[int], own: list[str], lead: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    text, c, w = grams(own, lead)
    return np.array(which)[text], c, w


def trusted_counts(texts: DataFrame) -> DataFrame:
    """c, w, n0, n1: n-grams (context, character) of `texts` (text, key, half), and how often they come in texts that
    are not of half 0, and not of half 1. Rows that repeat count each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def summed():
            c, w, n0, n1 = (np.concatenate(x) for x in zip(*held, strict=True))
            _, first, back = np.unique(mixed(c, w), return_index=True, return_inverse=True)
            return c[first], w[first], np.bincount(back, n0).astype(np.int64), np.bincount(back, n1).astype(np.int64)

        def sent(made):
            return pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=["c", "w", "n0", "n1"])

        for batch in batches:
            rows = pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.arange(batch.num_rows)), batch.column(2)], names=["text", "key", "half"])
            for own, before, _, halves in pieces(iter([rows])):  # each row has a key of its own here
                for text, c, w in blocks(own, before):
                    half = np.array(halves)[text]
                    _, first, back = np.unique(mixed(c, w), return_index=True, return_inverse=True)
                    held.append((c[first], w[first], np.bincount(back, half == 1).astype(np.int64), np.bincount(back, half == 0).astype(np.int64)))
                    if sum(len(x[0]) for x in held[1:]) > HELD:
                        held = [summed()]
                        if len(held[0][0]) > HELD:
                            yield sent(held[0])
                            held = []
        if held:
            yield sent(summed())

    return texts.mapInArrow(run, "c long, w long, n0 long, n1 long").groupBy("c", "w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def shorter(c: Column, order: int) -> Column:
    """The context of the n-gram of `order` that ends a longer one."""
    return c.bitwiseAND((1 << POINT * (order - 1)) - 1)


def discounts(counts: DataFrame) -> list[list[float]]:
    """The three discounts of modified Kneser-Ney for n0 and for n1, from how many n-grams were seen once to four times."""
    of = counts.agg(*(F.count_if(F.col(n) == k) for n in ("n0", "n1") for k in (1, 2, 3, 4))).first()
    out = []
    for i in (0, 4):
        n1, n2, n3, n4 = of[i : i + 4]
        y = n1 / (n1 + 2 * n2) if n1 else 0.0
        d = [k - (k + 1) * y * b / a if a and y else 0.5 * k for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        out.append([min(max(x, 0.05 * k), 0.95 * k) for k, x in enumerate(d, 1)])
    return out


def less(n: str, d: list[float]) -> Column:
    """The count less its discount; 0 for what was not seen."""
    c = F.col(n)
    return F.when(c >= 3, c - d[2]).when(c == 2, 2 - d[1]).when(c == 1, 1 - d[0]).otherwise(0.0)


def probabilities(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """`wanted` (c, w and others) with p0 and p1: the probability of w after c by the counts n0 and by n1.

    From the highest order down, counts become numbers of different characters before an n-gram. From the lowest up,
    each order's wanted n-grams are joined with their counts, their contexts' totals and the shorter order's values.
    The lowest rests on equal shares of all characters that were seen and one that was not. Where one half has no text
    both models are of all.
    """
    n = counts.agg(F.sum("n0"), F.sum("n1")).first()
    if not (n[0] and n[1]):
        counts = counts.select("c", "w", (F.col("n0") + F.col("n1")).alias("n0"), (F.col("n0") + F.col("n1")).alias("n1"))
    by_order = {}
    for order in range(ORDER, 0, -1):
        counts = cut(counts)
        by_order[order] = counts
        seen = [F.count_if(F.col(n) > 0).alias(n) for n in ("n0", "n1")]
        if order > 1:
            counts = counts.groupBy(shorter(F.col("c"), order - 1).alias("c"), "w").agg(*seen)
    known = by_order[1].agg(F.count_if(F.col("n0") > 0), F.count_if(F.col("n1") > 0)).first()
    made = None
    for order in range(1, ORDER + 1):
        asked = wanted.withColumn("c", shorter(F.col("c"), order)).select("c", "w").distinct() if order < ORDER else wanted
        own, d = by_order[order], discounts(by_order[order])
        totals = own.groupBy("c").agg(*(F.sum(f"n{h}").alias(f"all{h}") for h in (0, 1)), *(F.sum(F.col(f"n{h}") - less(f"n{h}", d[h])).alias(f"held{h}") for h in (0, 1)))
        rows = asked.join(totals, "c", "left").join(own, ["c", "w"], "left")
        if made is None:
            lower = [F.lit(1.0 / (known[h] + 1)) for h in (0, 1)]
        else:
            made = made.select(F.col("c").alias("shorter"), "w", F.col("p0").alias("q0"), F.col("p1").alias("q1"))
            rows = rows.withColumn("shorter", shorter(F.col("c"), order - 1)).join(made, ["shorter", "w"])
            lower = [F.col("q0"), F.col("q1")]
        p = [
            F.when(F.col(f"all{h}") > 0, (less(f"n{h}", d[h]) + F.col(f"held{h}") * lower[h]) / F.col(f"all{h}")).otherwise(lower[h]).alias(f"p{h}")
            for h in (0, 1)
        ]
        made = cut(rows.select(*asked.columns, *p))
    return made


def wanted_grams(docs: DataFrame) -> DataFrame:
    """c, w, gram: the different n-grams of `docs` (text, key, half)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = np.zeros(1 << SENT_BITS, np.uint64)
        for texts, before, _, _ in pieces(batches):
            found = []
            for _, c, w in blocks(texts, before):
                gram = number(c, w)
                slot = (gram >> np.uint64(64 - SENT_BITS)).astype(np.int64)
                new = np.flatnonzero(sent[slot] != gram)
                gram, first = np.unique(gram[new], return_index=True)
                sent[slot[new[first]]] = gram
                found.append((gram, c[new[first]], w[new[first]]))
            gram, c, w = (np.concatenate(x) for x in zip(*found, strict=True))
            gram, first = np.unique(gram, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(c[first]), pa.array(w[first]), pa.array(gram.view(np.int64))], names=["c", "w", "gram"])

    return docs.mapInArrow(run, "c long, w long, gram long").distinct()


def _planes(x: np.ndarray) -> bytes:
    """The numbers byte by byte, all first bytes first, which compresses better."""
    return zlib.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), 1)


def _numbers(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.array(np.frombuffer(zlib.decompress(data), np.uint8).reshape(size, -1).T, order="C").view(kind).ravel()


#: A bucket's n-grams: of the model (values a, b by half), or of a piece's texts (a: how many texts each n-gram has and
#: which; b: how often; those before `half` are of half 0).
_PART = "bucket int, piece long, half int, grams binary, a binary, of binary, b binary"
_NAMES = ["bucket", "piece", "half", "grams", "a", "of", "b"]


def _buckets(gram: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of the sorted numbers."""
    bucket = (gram >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(gram) else np.zeros(0, np.int64)
    return list(zip(bucket[first].tolist(), first.tolist(), [*first[1:].tolist(), len(gram)], strict=True))


def _mine(gram: np.ndarray, turn: int) -> np.ndarray:
    return np.flatnonzero((gram >> np.uint64(TEXT_BITS)) % np.uint64(TURNS) == turn)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows one by one, so that a batch of large values is not copied at once."""
    for i in range(batch.num_rows):
        yield tuple(column[i].as_py() for column in batch.columns)


def _steps(gram: np.ndarray) -> np.ndarray:
    return np.diff(gram, prepend=np.uint64(0))


def model_parts(model: DataFrame, turn: int, bits: int) -> DataFrame:
    """Rows of _PART, with no piece, from `model` (gram, p0, p1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            gram = batch.column(0).to_numpy().view(np.uint64)
            mine = _mine(gram, turn)
            mine = mine[np.argsort(gram[mine])]
            gram = gram[mine]
            value = [np.round(np.log2(batch.column(k).to_numpy()[mine]) * UNIT).astype(np.int32) for k in (1, 2)]
            out = [(b, None, 0, _planes(_steps(gram[i:j])), _planes(value[0][i:j]), b"", _planes(value[1][i:j])) for b, i, j in _buckets(gram, bits)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _types, strict=True)], names=_NAMES)

    return model.mapInArrow(run, _PART)


_types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
#: The bucket of rows that say which texts a piece has, from which their piece is dealt on.
WHO = -1


def document_parts(docs: DataFrame, turn: int, bits: int) -> DataFrame:
    """Rows of _PART: the n-grams of `docs` (text, key, half) that are this turn's, counted within each text; and, in
    buckets below 0, each piece's keys (a) and whether each is the beginning of its text (b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for no, (texts, before, keys, halves) in enumerate(pieces(batches)):
            order = np.argsort(halves, kind="stable").tolist()
            texts, before = [texts[i] for i in order], [before[i] for i in order]
            key = np.array(keys, np.int64)[order]
            piece = xxhash.xxh3_64_intdigest(key.tobytes(), task << 32 | no) >> 1
            half = len(halves) - sum(halves)
            both = []
            for text, c, w in blocks(texts, before):
                gram = number(c, w)
                mine = _mine(gram, turn)
                both.append(gram[mine] | text[mine].astype(np.uint64))
            both = np.sort(np.concatenate(both))
            first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(both))).astype(np.uint32)
            both = both[first]
            text = (both & np.uint64((1 << TEXT_BITS) - 1)).astype(np.uint16)
            gram = both >> np.uint64(TEXT_BITS) << np.uint64(TEXT_BITS)
            out = [(WHO - piece % (1 << bits), piece, half, b"", _planes(key), b"", _planes(np.array([not b for b in before], np.uint8)))]
            for b, i, j in _buckets(gram, bits):
                new = np.flatnonzero(np.concatenate([[True], gram[i + 1 : j] != gram[i : j - 1]]))
                sizes = np.diff(np.append(new, j - i)).astype(np.uint32)
                out.append((b, piece, half, _planes(_steps(gram[i:j][new])), _planes(sizes), _planes(text[i:j]), _planes(times[i:j])))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _types, strict=True)], names=_NAMES)

    return docs.mapInArrow(run, _PART)


def summed_parts(parts: DataFrame) -> DataFrame:
    """piece, who, sums: the sums of the texts of each piece, in rows that add up; or, in one row, who they are."""
    schema = pa.schema([("piece", pa.int64()), ("who", pa.bool_()), ("keys", pa.binary()), ("sums", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, model = None, []
        known = worth = None
        sums: dict[int, np.ndarray] = {}

        def sent():
            rows = list(sums.items())
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int64()), pa.array([False] * len(rows)), pa.nulls(len(rows), pa.binary()), pa.array([_planes(s) for _, s in rows], pa.binary())], schema=schema)

        held = 0
        for batch in steps(batches):
            for bucket, piece, half, grams_, a, of, b in _rows(batch):
                if bucket < 0:
                    yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), pa.array([True]), pa.array([a], pa.binary()), pa.array([b], pa.binary())], schema=schema)
                    continue
                if bucket != now:
                    now, model, known = bucket, [], None
                gram = np.cumsum(_numbers(grams_, np.uint64), dtype=np.uint64)
                if piece is None:
                    model.append((gram, _numbers(a, np.int32), _numbers(b, np.int32)))
                    continue
                if known is None:
                    known, at = np.unique(np.concatenate([x[0] for x in model]), return_index=True)
                    worth = [np.concatenate([x[k] for x in model])[at].astype(np.float64) for k in (1, 2)]
                    model = []
                at = np.repeat(np.searchsorted(known, gram), _numbers(a, np.uint32))
                text = _numbers(of, np.uint16)
                value = np.where(text < half, worth[0][at], worth[1][at]) * _numbers(b, np.uint32)
                total = np.bincount(text, value).astype(np.int64)  # whole numbers, exact below 2 ** 53
                if piece in sums and len(sums[piece]) >= len(total):
                    sums[piece][: len(total)] += total
                else:
                    if piece in sums:
                        total[: len(sums[piece])] += sums[piece]
                    held += len(total) - len(sums.get(piece, ()))
                    sums[piece] = total
                if held > HELD:
                    yield sent()
                    held = 0
        if sums:
            yield sent()

    return parts.repartition("bucket").sortWithinPartitions("bucket", F.col("piece").asc_nulls_first()).mapInArrow(run, "piece long, who boolean, keys binary, sums binary")


def totals(parts: DataFrame) -> DataFrame:
    """key, total, copies: sums over pieces by text, and over how many copies of the text they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, who, total = None, None, None

        def sent():
            keys, begins = who
            total_ = np.zeros(len(keys), np.int64)
            total_[: len(total)] = total
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(total_), pa.array(begins.astype(np.int64))], names=["key", "total", "copies"])

        for batch in steps(batches):
            for piece, own, keys, sums in _rows(batch):
                if piece != now:
                    if now is not None:
                        yield sent()
                    now, total = piece, np.zeros(0, np.int64)
                if own:
                    who = _numbers(keys, np.int64), _numbers(sums, np.uint8)
                    continue
                more = _numbers(sums, np.int64)
                if len(more) < len(total):
                    more, total = total, more
                more[: len(total)] += total
                total = more
        if now is not None:
            yield sent()

    return parts.repartition("piece").sortWithinPartitions("piece", F.col("who").desc()).mapInArrow(run, "key long, total long, copies long")


def scores(docs: DataFrame, model: DataFrame) -> DataFrame:
    """doc_id, lang, key, n, bits: characters, and minus the mean log2 probability of one; null for a text without any.

    The n-grams are dealt in TURNS, each of which reads the texts anew, so that no more than a turn's are on disk.
    """
    texts = docs.select("text", key_of(), half_of()).where("text is not null")
    bits = max(4, min(14, (2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()))
    total = None
    for turn in range(TURNS):
        part = totals(summed_parts(model_parts(model.select("gram", "p0", "p1"), turn, bits).unionByName(document_parts(texts, turn, bits))))
        part = cut(part.groupBy("key").agg((F.sum("total") / F.sum("copies")).alias("total")), free=True)
        total = part if total is None else total.unionByName(part)
    total = total.groupBy("key").agg(F.sum("total").alias("total"))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), key_of(), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"))
    # Equal texts may be many: their total goes to where they are.
    groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).join(total, "key", "left").select("key", "size", F.coalesce("total", F.lit(0.0)).alias("total"))
    bits_ = F.when(F.col("n") > 0, -F.col("total") / UNIT / F.col("n"))
    return look_up(rows, cut(groups), "key", "size").select("doc_id", "lang", "key", "n", bits_.alias("bits"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of the documents that labels call good and not toxic, and no label calls otherwise."""
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return said.where("q = 1 and t = 0").select(F.col("doc_id").cast("long"))


def limits(trusted: DataFrame) -> DataFrame:
    """lang, lower, upper (bits) by the quantiles of `trusted` (lang, bits); the row of null lang is that of all.

    Quantiles are taken from counts of scores in steps of STEP, so no order of rows plays a part.
    """
    binned = trusted.where("bits is not null").select("lang", F.round(F.col("bits") / STEP).cast("long").alias("bin"))
    binned = binned.groupBy("lang", "bin").agg(F.count(F.lit(1)).alias("n"))
    each = binned.where("lang is not null").unionByName(binned.groupBy("bin").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "bin", "n"))
    order = Window.partitionBy("lang").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ranked = each.select("lang", "bin", F.sum("n").over(order).alias("upto"), F.sum("n").over(Window.partitionBy("lang")).alias("all"))
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * q), F.col("bin"))) * STEP
    found = ranked.groupBy("lang").agg(at(LOW).alias("low"), at(0.5).alias("mid"), at(HIGH).alias("high"), F.max("all").alias("n"))
    found = found.where((F.col("n") >= LEAST_TRUSTED) | F.col("lang").isNull())
    return found.select("lang", (F.col("low") - (F.col("mid") - F.col("low")) * MARGIN).alias("lower"), (F.col("high") + (F.col("high") - F.col("mid")) * MARGIN).alias("upper"))


def train(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """c, w, gram, p0, p1 of all n-grams of `docs` by the text of the documents in `trusted` (doc_id).

    A map of the trusted ids' hashes lets the texts of most others stay where they are; the rest is joined by id.
    """
    bits = docs.sparkSession.sparkContext.broadcast(wanted_map(trusted.select(F.xxhash64("doc_id").alias("number"))))
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long"), "text").withColumn("number", F.xxhash64("doc_id"))
    likely = may_have(rows, "number", bits, "may").where("may").select("doc_id", "text")
    texts = likely.hint("merge").join(trusted, "doc_id", "left_semi").select("text", F.lit(0).alias("key"), half_of())
    counts = cut(trusted_counts(texts), free=True)
    bits.destroy()
    return probabilities(counts, cut(wanted_grams(docs.select("text", key_of(), half_of())), free=True))


def kept_by(bits: Column, n: Column, lower: Column, upper: Column) -> Column:
    """Whether a text is kept by these limits."""
    unsure = F.lit(SHORT) / F.sqrt(F.greatest(n, F.lit(1)))
    return F.coalesce((bits >= lower - unsure) & (bits <= upper + unsure), F.lit(True))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, key, bits, lower, upper, kept of each document."""
    trusted = cut(trusted_ids(labels))
    rows = cut(scores(docs, train(docs, trusted)))
    found = cut(limits(rows.hint("merge").join(trusted, "doc_id", "left_semi").select("lang", "bits")))
    every = found.where("lang is null").first()
    by_lang = found.where("lang is not null").select("lang", F.col("lower").alias("__lower"), F.col("upper").alias("__upper"))
    # Languages are few as a rule, and then no text is dealt by its language, which may be that of most texts.
    out = rows.join(F.broadcast(by_lang) if by_lang.count() <= SMALL_ROWS else by_lang, "lang", "left")
    lower, upper = (F.coalesce(F.col(f"__{c}"), F.lit(every[c] if every else None).cast("double")) for c in ("lower", "upper"))
    return out.select("doc_id", "lang", "key", "bits", lower.alias("lower"), upper.alias("upper"), kept_by(F.col("bits"), F.col("n"), lower, upper).alias("kept"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, lang, bits, perplexity, lower, upper, kept.

    A text without characters, or null, has no bits and is kept. A text of any length is scored whole, in parts of
    bounded size. A language without LEAST_TRUSTED trusted documents, or null, is judged by all languages' quantiles;
    without any trusted document all are kept. Rows that repeat are judged each; other columns play no part, whatever
    their names; an empty table gives an empty result.
    """
    return judged(docs, labels).select("doc_id", "lang", "bits", F.pow(F.lit(2.0), "bits").alias("perplexity"), "lower", "upper", "kept")


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without those that the classifier rejects; all columns stay. Few texts move, if few are rejected.

    Rows are known by text and lang, so rows that repeat go or stay together, also without a doc_id; cases are those of
    `judge`, and an empty table stays empty.
    """
    gone = judged(docs, labels).where(~F.col("kept")).select("key", "lang").distinct()
    return drop_rows(docs, [F.xxhash64(F.coalesce(F.col("text"), F.lit(""))), F.col("lang").cast("string")], gone)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
