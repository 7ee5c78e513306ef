"""Masking findings with numbered placeholders, with SQL functions only; restoring them is in `restore`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scan import LITERAL


def numbered(texts: DataFrame, findings: DataFrame) -> DataFrame:
    """The findings that are masked, each with `at` (where its request first has its value), ord and placeholder.

    A finding whose rule names no placeholder type is left as it is. Numbers count from 1 by type, in the order in
    which values are first met; one whose placeholder stands literally in any text of the request is passed over.
    Findings go through one shuffle by request; of the texts only the literals do.
    """
    place = F.struct("text_idx", "start")
    value = Window.partitionBy("request_id", "original")
    rows = findings.where("placeholder_type <> ''").repartition("request_id").withColumn("at", F.min(place).over(value))
    rows = rows.withColumn("first", F.min_by(F.struct("rule_id", "data_type", "placeholder_type"), place).over(value)).withColumn("kind", F.col("first.placeholder_type"))
    rows = rows.withColumn("n", F.dense_rank().over(Window.partitionBy("request_id", "kind").orderBy("at"))).withColumn("ord", F.dense_rank().over(Window.partitionBy("request_id").orderBy("at")))
    literal = texts.where(F.contains("text", F.lit("<"))).select(F.col("request_id").cast("long"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(LITERAL), F.lit(0)))).alias("p"))
    number = F.regexp_extract("p", "_([0-9]+)>$", 1)
    taken = (
        literal.select("request_id", F.expr("substring(p, 2, length(p) - 2 - length(regexp_extract(p, '(_[0-9]+)>$', 1)))").alias("kind"), number.alias("number"))
        .where("number rlike '^[1-9][0-9]{0,8}$'")
        .groupBy("request_id", "kind").agg(F.array_sort(F.collect_set(F.col("number").cast("int"))).alias("taken"))
    )
    # Numbers that are taken, from the least up, push what stands at or above them one further.
    free = F.expr("aggregate(coalesce(taken, array()), n, (to, t) -> if(t <= to, to + 1, to))")
    placeholder = F.concat(F.lit("<"), "kind", F.lit("_"), free.cast("string"), F.lit(">"))
    return rows.join(taken, ["request_id", "kind"], "left").withColumn("placeholder", placeholder)


def replacements(texts: DataFrame, findings: DataFrame) -> DataFrame:
    """request_id, ord, rule_id, data_type, original, placeholder: one row for each value of a request, as first met."""
    return listed(numbered(texts, findings))


def listed(rows: DataFrame) -> DataFrame:
    first = rows.where(F.struct("text_idx", "start") == F.col("at")).dropDuplicates(["request_id", "original"])
    return first.select("request_id", "ord", "first.rule_id", "first.data_type", "original", "placeholder")


def mask(texts: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(request_id, text_idx, masked_text of every text, and the replacements).

    For requests of any number of texts; where each is one text, `scan.mask_texts` needs no shuffle.
    """
    rows = numbered(texts, findings)
    lists = rows.groupBy("request_id", "text_idx").agg(F.sort_array(F.collect_set(F.struct("start", "end", "placeholder"))).alias("spans"))
    pieces = F.expr("transform(spans, (s, i) -> concat(substring(text, (CASE WHEN i = 0 THEN 0 ELSE spans[i - 1].end END) + 1, s.start - (CASE WHEN i = 0 THEN 0 ELSE spans[i - 1].end END)), s.placeholder))")
    tail = F.expr("substring(text, element_at(spans, -1).end + 1, length(text))")
    done = texts.join(lists, ["request_id", "text_idx"], "left").select("request_id", "text_idx", F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.concat(F.array_join(pieces, ""), tail)).alias("masked_text"))
    return done, listed(rows)


def state(texts: DataFrame, findings: DataFrame) -> DataFrame:
    """request_id, triggered_rule_ids, triggered_data_types, replacements, of requests with a masked finding.

    The triggered rules and types are those of all masked findings, also of values that another rule met first.
    """
    rows = numbered(texts, findings)
    item = F.when(F.struct("text_idx", "start") == F.col("at"), F.struct("ord", F.col("first.rule_id"), F.col("first.data_type"), "original", "placeholder"))
    return rows.groupBy("request_id").agg(
        F.sort_array(F.collect_set("rule_id")).alias("triggered_rule_ids"),
        F.sort_array(F.collect_set(F.when(F.col("data_type").between(1, 6), F.col("data_type")))).alias("triggered_data_types"),
        F.sort_array(F.collect_set(item)).alias("replacements"),
    )
