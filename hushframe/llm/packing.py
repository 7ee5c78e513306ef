"""Best-fit packing of token pieces into sequences under several capacities at once.

A bin has three capacities: tokens, pieces and attention cost (the sum of squared lengths). A piece goes into the
open bin that has room in all three and the best score: the weighted dot product of the piece's demands and the bin's
residuals, or the weighted norm of what would remain. Demands depend on a piece's length alone, so the packing is
made from the counts of the lengths, at most as many as a sequence has tokens: bins in the same state are one entry
with ranges of sequence numbers. Pieces then find their place by their rank among pieces of their length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, map_rows, number_within, table

TOKENS = 1024
END = 2
TOKENIZER = "byte_bpe_50k"
#: Plan rows (48 bytes each) that are broadcast; a longer plan is joined by shuffle.
PLAN_ROWS = 200_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{TOKENIZER}.json")


_encoders: dict = {}


def encoder(path: str):
    """text -> ids, as the tokenizer file gives them without added special tokens.

    A byte-level BPE file is run by tiktoken, which gives the same ids in a quarter of the time: the merges' order is
    the ranks' order. Added tokens are looked for in the text as the file's own library does.
    """
    if path not in _encoders:
        import json

        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in kept)}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
        import public_tokenizers

        encoding = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
        _encoders[path] = lambda text: encoding.encode(text, allowed_special="all")
    return _encoders[path]


def cuts(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: one if it fits, else a first piece that may be shorter and full ones."""
    if n <= most:
        return [(0, n)]
    first = n % most or most
    return [(0, first), *((at, most) for at in range(first, n, most))]


def token_pieces(docs: DataFrame, path: str, most: int, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each document's pieces."""

    def f(columns: list[list]) -> list[list]:
        encode = encoder(path)
        out: list[list] = [[], [], [], [], [], []]
        for doc_id, text in zip(*columns, strict=True):
            ids = np.asarray([*encode(text or ""), END], dtype="<u4")
            for i, (start, length) in enumerate(cuts(len(ids), most)):
                data = ids[start : start + length].tobytes()
                for column, value in zip(out, (doc_id, i, start, length, zlib.crc32(data), data), strict=True):
                    column.append(value)
        return out if keep_ids else out[:5]

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return map_rows(docs, ["doc_id", "text"], schema + ", ids binary" * keep_ids, f)


def best_fit_plan(
    counts: dict[int, int], tokens: int, pieces: int | None = None, attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.1, 0.1), rule: str = "norm",
) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, one past the last rank, first sequence, offset) for all pieces, longest first.

    counts: pieces of each length. Among the states with room for the length in every capacity, `rule` "norm" takes
    the least weighted norm of what remains, "dot" the greatest weighted dot product of demand and residual.
    """
    pieces, attention = pieces or tokens, attention or tokens * tokens
    cap = np.array([tokens, pieces, attention], dtype=np.float64)
    w = np.asarray(weights) / cap**2
    open_bins: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    states = np.empty((0, 3), dtype=np.int64)
    stale, plan, sequences = True, [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        need = np.array([length, 1, length * length])
        while left:
            if stale:
                states, stale = np.array(list(open_bins), dtype=np.int64).reshape(-1, 3), False
            room = states[(states >= need).all(axis=1)]
            if len(room):
                if rule == "norm":
                    best = np.argmin((((room - need) ** 2) * w).sum(axis=1))
                else:
                    best = np.argmax((room * need * w).sum(axis=1))
                state = tuple(int(x) for x in room[best])
                ranges = open_bins[state]
                at = ranges.pop()
                stale = not ranges
                if stale:
                    del open_bins[state]
            else:
                # New bins hold this piece alone at first; as many as fit go into the same bin in later rounds.
                each = max(1, min(tokens // length, pieces, attention // (length * length)))
                n = -(-left // each)
                state, at = (tokens, pieces, attention), (sequences, sequences + n)
                sequences += n
            used = min(left, at[1] - at[0])
            plan.append((length, rank, rank + used, at[0], tokens - state[0]))
            if used < at[1] - at[0]:
                stale |= state not in open_bins
                open_bins.setdefault(state, []).append((at[0] + used, at[1]))
            after = (state[0] - length, state[1] - 1, state[2] - length * length)
            if min(after) > 0:
                stale |= after not in open_bins
                open_bins.setdefault(after, []).append((at[0], at[0] + used))
            left, rank = left - used, rank + used
    return plan


def place(pieces: DataFrame, plan: list[tuple[int, int, int, int, int]], broadcast_rows: int = PLAN_ROWS) -> DataFrame:
    """`pieces` (with `length` and `rank`) with sequence_id and offset. A plan of over `broadcast_rows` is joined."""
    if len(plan) > broadcast_rows:
        # Blocks of ranks make an equal-key join of what is a range join; a block meets few plan rows.
        block = 1 << 10
        rows = pieces.sparkSession.createDataFrame(plan, "length long, lo long, hi long, seq long, offset long")
        rows = rows.select(F.col("length").alias("l"), "lo", "hi", "seq", "offset", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))).alias("b"))
        on = (F.col("length") == F.col("l")) & (F.floor(F.col("rank") / block) == F.col("b")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
        return pieces.join(rows, on).select(*pieces.columns, (F.col("seq") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset").drop("rank")
    by: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for length, lo, _, seq, offset in plan:
        by[length].append((lo, seq - lo, offset))
    shared = pieces.sparkSession.sparkContext.broadcast({k: tuple(np.array(x, dtype=np.int64) for x in zip(*sorted(v))) for k, v in by.items()})
    names = [c for c in pieces.columns if c != "rank"]
    fields = ", ".join(f"{n} {t}" for n, t in pieces.select(*names).dtypes)

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            seq, off = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for k in np.unique(length):
                lo, base, offset = shared.value[int(k)]
                own = np.flatnonzero(length == k)
                i = np.searchsorted(lo, rank[own], side="right") - 1
                seq[own], off[own] = base[i] + rank[own], offset[i]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    return pieces.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack(
    docs: DataFrame, tokens: int = TOKENS, pieces: int | None = None, attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.1, 0.1), rule: str = "norm", path: str | None = None,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every document is the ids of its text (null: empty) and the end token; only those of over `tokens` ids are cut.
    `pieces` and `attention` bound a sequence's pieces and sum of squared lengths; by default neither binds before
    `tokens` does. Rows that repeat, or have no doc_id, are packed each; a text of any length is packed whole; an empty
    table gives an empty result; other columns, whatever their names, play no part.
    """
    path = path or tokenizer_path()
    if attention:
        largest = int(attention**0.5)
        if largest < tokens:
            raise ValueError(f"a full piece costs {tokens**2}, more than the attention capacity {attention}")
    made = cut(token_pieces(docs, path, tokens))
    counts = {r["length"]: r["count"] for r in made.groupBy("length").count().collect()}  # at most `tokens` rows
    plan = best_fit_plan(counts, tokens, pieces, attention, weights, rule)
    ranked = number_within(made, ["length"], ["doc_id", "piece", "ids_crc32"], "rank", spread=256)
    return place(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank"), plan)


def sequences(docs: DataFrame, path: str | None = None, **capacities) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (array of int). A sequence's pieces come together; they fit.

    Cases are those of `pack`; rows that repeat are in as often as they come, and an empty table gives no sequence.
    """
    path = path or tokenizer_path()
    placed = pack(docs, path=path, **capacities).select("doc_id", "piece", "ids_crc32", "sequence_id", "offset")
    ids = token_pieces(docs, path, capacities.get("tokens", TOKENS), keep_ids=True).select("doc_id", "piece", "ids_crc32", "ids")
    key = ["doc_id", "piece", "ids_crc32"]
    copies = F.row_number().over(Window.partitionBy(*key).orderBy(key[0]))
    held = ids.withColumn("c", copies).toDF(*(f"own_{c}" for c in (*ids.columns, "c")))
    same = F.col("c") == F.col("own_c")
    for k in key:  # a row may have no doc_id
        same = same & F.col(k).eqNullSafe(F.col(f"own_{k}"))
    both = placed.withColumn("c", copies).join(held, same).withColumnRenamed("own_ids", "ids")
    rows = both.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))

    def f(columns: list[list]) -> list[list]:
        return [columns[0], [np.frombuffer(b"".join(x["ids"] for x in p), "<u4").astype(int).tolist() for p in columns[1]]]

    return map_rows(rows, ["sequence_id", "p"], "sequence_id long, ids array<int>", f)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
