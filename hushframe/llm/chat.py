"""Chat formatting with Spark expressions only.

A conversation becomes `<|=user|>text<|.|><|=assistant|>text<|+assistant|>text<|.|>`: adjacent turns of one role are
merged into one block whose texts are parted by a mark. In texts, `%` and `<` are written `%25` and `%3C` (in roles
also `|` and `>`), so a text can hold no mark; reading back undoes it. The loss mask is the list of byte ranges of
the assistant's texts in the UTF-8 output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ASSISTANT = "assistant"
TEXT_ESCAPES = (("%", "%25"), ("<", "%3C"))
#: Elements of which the sums are taken one by one.
CHUNK = 128
ROLE_ESCAPES = (*TEXT_ESCAPES, ("|", "%7C"), (">", "%3E"))


def escape(value: Column, pairs=TEXT_ESCAPES) -> Column:
    for plain, code in pairs:
        value = F.replace(value, F.lit(plain), F.lit(code))
    return value


def unescape(value: Column, pairs=TEXT_ESCAPES) -> Column:
    for plain, code in reversed(pairs):
        value = F.replace(value, F.lit(code), F.lit(plain))
    return value


def running_sum(sizes: Column) -> Column:
    """The sums of an array (long) up to each element, in blocks, so that n elements take some n * CHUNK / 2 steps."""
    add = lambda values: F.aggregate(values, F.lit(0).cast("long"), lambda x, y: x + y)
    many = F.size(sizes)
    chunks = F.when(many > 0, F.sequence(F.lit(0), F.floor((many - 1) / CHUNK).cast("int"))).otherwise(F.array().cast("array<int>"))
    own = lambda c: F.slice(sizes, c * CHUNK + 1, F.lit(CHUNK))
    whole = F.transform(chunks, lambda c: add(own(c)))
    each = lambda c: F.transform(F.sequence(F.lit(1), F.size(own(c))), lambda k: add(F.slice(own(c), F.lit(1), k)))
    before = F.transform(chunks, lambda c: add(F.slice(whole, F.lit(1), c)))
    return F.flatten(F.zip_with(before, F.transform(chunks, each), lambda b, xs: F.transform(xs, lambda x: x + b)))


def format_chat(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (array of struct start, length; bytes, in order).

    A conversation's turns are collected and sorted as structs, adjacent ones of one role merged into blocks with array
    functions, and the blocks concatenated. `turns` has conv_id, turn, role, text; other columns, whatever their names,
    play no part. Turns go by turn, then role, then text, nulls first; rows that repeat are turns each. A null role or
    text counts as empty, a null conv_id as one conversation; texts may be of any length that a row can hold. An empty
    table gives an empty result.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    sorted_turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", role.alias("role"), text.alias("text")))).alias("turns"))
    t = lambda i: F.get("turns", i)["role"]
    places = F.sequence(F.lit(0), F.size("turns") - 1)
    marked = sorted_turns.withColumn("firsts", F.filter(places, lambda i: (i == 0) | (t(i) != t(i - 1))))
    block = lambda first, n: F.struct(
        escape(t(first), ROLE_ESCAPES).alias("role"), (t(first) == ASSISTANT).alias("loss"),
        F.transform(F.slice("turns", first + 1, F.coalesce(F.get("firsts", n + 1), F.size("turns")) - first), lambda x: escape(x["text"])).alias("bodies"),
    )
    merged = marked.select("conv_id", F.transform("firsts", block).alias("blocks"))
    said = F.transform("blocks", lambda b: F.concat(F.lit("<|="), b["role"], F.lit("|>"), F.call_function("array_join", b["bodies"], F.concat(F.lit("<|+"), b["role"], F.lit("|>"))), F.lit("<|.|>")))
    # Each body stands behind a mark of five signs and the role; the end of the block before has five signs too.
    size = lambda b, n: F.transform(b["bodies"], lambda x, k: F.struct((F.octet_length(x) + F.octet_length(b["role"]) + 5 + F.when((k == 0) & (n > 0), 5).otherwise(0)).cast("long").alias("all"), F.octet_length(x).alias("own"), b["loss"].alias("loss")))
    sized = merged.select("conv_id", F.array_join(said, "").alias("formatted"), F.flatten(F.transform("blocks", size)).alias("sizes"))
    placed = sized.withColumn("ends", running_sum(F.transform("sizes", lambda x: x["all"])))
    spans = F.zip_with("sizes", "ends", lambda x, end: F.struct((end - x["own"]).cast("int").alias("start"), x["own"].alias("length"), x["loss"].alias("loss")))
    return placed.select("conv_id", "formatted", F.transform(F.filter(spans, lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("loss_spans"))


def read_chat(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of struct role, text), loss_texts (array), formatted: what the output says by itself."""
    parts = F.filter(F.split("formatted", "<"), lambda p: p.startswith("|=") | p.startswith("|+"))
    at = lambda p: F.instr(p, "|>")

    def turn(p: Column) -> Column:
        role = F.substring(p, F.lit(3), at(p) - 3)
        return F.struct(unescape(role, ROLE_ESCAPES).alias("role"), unescape(F.substring(p, at(p) + 2, F.length(p))).alias("text"))

    data = F.col("formatted").cast("binary")
    masked = F.transform("loss_spans", lambda s: unescape(F.decode(F.substring(data, s["start"] + 1, s["length"]), "UTF-8")))
    return formatted.select("conv_id", F.transform(parts, turn).alias("turns"), masked.alias("loss_texts"), "formatted")


def digest(formatted: DataFrame) -> DataFrame:
    """The figures by which an output can be compared with its input, all read back from the output."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read_chat(formatted).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, ASSISTANT, "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digest(format_chat(turns.unionByName(probe)))


OP8_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS prev,
    length(replace(replace(text, '%', '%25'), '<', '%3C'))
    + length(replace(replace(replace(replace(role, '%', '%25'), '<', '%3C'), '|', '%7C'), '>', '%3E')) + 5 AS n
  FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(n + CASE WHEN prev <> role THEN 5 ELSE 0 END) + 5)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""
