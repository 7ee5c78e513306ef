"""What a gateway asks around masking: formats by path, narrowed types, rule merging, the audit log, event streams."""

from __future__ import annotations

import base64

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hushframe.functions import scalars
from hushframe.sources.catalog import DATA_TYPES

# Formats of paths; upper bounds of the latency buckets in seconds.
PATHS = {"/v1/chat/completions": "chat_completions", "/v1/messages": "messages", "/v1/responses": "responses"}
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)
PAGE, LONGEST_PAGE, TOP = 50, 500, 20


def format_of(path: Column, more: dict[str, str] | None = None) -> Column:
    """The format of a path without its query: an equal key first, then the longest key that it ends in; else null."""
    keys = {**PATHS, **(more or {})}
    bare = F.substring_index(path, "?", 1)
    tests = [(bare == k, v) for k, v in keys.items()] + [(bare.endswith(k), keys[k]) for k in sorted(keys, key=len, reverse=True)]
    return F.coalesce(*(F.when(test, F.lit(v)) for test, v in tests))


def narrowed(types: Column, header: Column) -> Column:
    """The data types (array<int>) that a header leaves: those that it names too; `none` leaves none.

    Names and numbers count, in any case; a header with anything else, or without one, is ignored.
    """
    parts = scalars.split_csv(F.lower(header))
    known = F.create_map(*(x for i, name in enumerate(DATA_TYPES) for k in (name.lower(), str(i)) for x in (F.lit(k), F.lit(i))))
    numbers = F.transform(parts, lambda p: known[p])
    unread = header.isNull() | (F.size(parts) == 0) | F.exists(numbers, lambda n: n.isNull())
    return F.when(F.trim(F.lower(header)) == "none", F.array().cast("array<int>")).when(unread, types).otherwise(F.array_intersect(types, numbers))


def merged_rules(builtin: DataFrame, custom: DataFrame, disabled: DataFrame) -> DataFrame:
    """Built-in and custom rules without the disabled ones; of equal ids the built-in rule counts. All have rule_id."""
    own = custom.join(builtin.select("rule_id"), "rule_id", "left_anti")
    return builtin.unionByName(own, allowMissingColumns=True).join(disabled.select("rule_id"), "rule_id", "left_anti")


def toggled(rules: DataFrame, disabled: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rule_id of the rules disabled afterwards, and what became of each change: rule_id, enabled, done).

    changes: rule_id, enabled; of several for one rule any that disables counts. A rule that isn't known is not done.
    """
    asked = changes.groupBy("rule_id").agg(F.min("enabled").alias("enabled"))
    results = asked.join(rules.select("rule_id", F.lit(True).alias("known")).distinct(), "rule_id", "left").select("rule_id", "enabled", F.coalesce("known", F.lit(False)).alias("done"))
    kept = disabled.select("rule_id").join(results.where("done and enabled"), "rule_id", "left_anti")
    return kept.unionByName(results.where("done and not enabled").select("rule_id")).distinct(), results


def forwarded(texts: DataFrame, masked: DataFrame, mode: str) -> DataFrame:
    """request_id, text_idx, text that goes on: masked if the mode is enforce; as it came if it is detect."""
    if mode not in ("enforce", "detect"):
        raise ValueError(f"mode {mode}")
    if mode == "detect":
        return texts.select(F.col("request_id").cast("long"), F.col("text_idx").cast("int"), "text")
    return masked.select("request_id", "text_idx", F.col("masked_text").alias("text"))


def quantiles(buckets: DataFrame, by: list[str], at: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """`by` and p50, p95, ...: quantiles interpolated within the buckets (le, n up to it) that `histogram` gives.

    The last bound below the infinite one stands for what lies beyond it; a group without values has nulls.
    """
    held = F.sort_array(F.collect_list(F.struct("le", "n")))
    rows = buckets.groupBy(*by).agg(held.alias("b"))  # as many as there are bounds
    out = []
    for q in at:
        total = F.element_at("b", -1)["n"]
        rank = total * q
        i = F.size(F.filter("b", lambda x: x["n"] < rank))  # noqa: B023
        low, before = F.when(i > 0, F.get("b", i - 1)["le"]).otherwise(0.0), F.when(i > 0, F.get("b", i - 1)["n"]).otherwise(0)
        up, upto = F.get("b", i)["le"], F.get("b", i)["n"]
        inner = low + (up - low) * (rank - before) / F.greatest(upto - before, F.lit(1))
        out.append(F.when(total > 0, F.when(up == float("inf"), low).otherwise(inner)).alias(f"p{round(q * 100)}"))
    return rows.select(*by, *out)


def summary(records: DataFrame) -> DataFrame:
    """kind, name, n: how many requests were masked by mode, the TOP rules and types, and what was passed on unread.

    records: mode, format, replacements, rule_ids, data_types; a record without a format was passed on.
    """
    modes = records.where("replacements > 0").groupBy(F.lit("masked").alias("kind"), F.col("mode").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    passed = records.where("format is null").groupBy(F.lit("passthrough").alias("kind"), F.col("mode").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    out = modes.unionByName(passed)
    for kind, column in (("rule", "rule_ids"), ("type", "data_types")):
        each = records.select(F.explode(F.col(column).cast("array<string>")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(TOP)
        out = out.unionByName(each.select(F.lit(kind).alias("kind"), "name", "n"))
    return out


def cursor(ts: Column, key: Column) -> Column:
    """Where a page ended, as text: base64url of nanoseconds and id."""
    return scalars.base64url(F.concat((F.unix_micros(ts) * 1000).cast("string"), F.lit(":"), key.cast("string")))


def position(after: str) -> tuple[int, str]:
    """The nanoseconds and the id that a cursor says; a ValueError if it is none."""
    data = base64.urlsafe_b64decode(after + "=" * (-len(after) % 4)).decode()
    nanos, _, last = data.partition(":")
    return int(nanos), last


def audit(log: DataFrame, key: str, after: str | None = None, limit: int = PAGE, since=None, until=None, **equal: object) -> DataFrame:
    """A page of `log` (ts, the key, further columns), newest first, with the column `cursor` for the next page.

    `equal` filters columns; of an array column it asks for an element. The page is the feature: 500 rows at most.
    """
    for name, value in equal.items():
        log = log.where(F.array_contains(name, value) if dict(log.dtypes)[name].startswith("array") else F.col(name) == F.lit(value))
    log = log.where(F.col("ts") >= F.lit(since)) if since is not None else log
    log = log.where(F.col("ts") < F.lit(until)) if until is not None else log
    if after:
        nanos, last = position(after)
        ts, last = F.timestamp_micros(F.lit(nanos // 1000)), F.lit(last).cast(dict(log.dtypes)[key])
        log = log.where((F.col("ts") < ts) | ((F.col("ts") == ts) & (F.col(key) < last)))
    return log.orderBy(F.desc("ts"), F.desc(key)).limit(max(1, min(limit, LONGEST_PAGE))).withColumn("cursor", cursor(F.col("ts"), F.col(key)))


def retained(log: DataFrame, key: str, hours: int = 24) -> DataFrame:
    """The rows of the last hours before the newest one."""
    newest = log.agg(F.max("ts").alias("newest"))  # one row
    return log.join(F.broadcast(newest)).where(F.col("ts") >= F.col("newest") - F.expr(f"interval {hours} hours")).drop("newest")


def histogram(rows: DataFrame, seconds: Column, by: list[str]) -> DataFrame:
    """`by`, le, n: how many rows take up to each bound, the last one infinite."""
    each = [F.count(F.when(seconds <= b, 1)).alias(f"b{i}") for i, b in enumerate(BUCKETS)] + [F.count(seconds).alias(f"b{len(BUCKETS)}")]
    bounds = [*map(F.lit, BUCKETS), F.lit(float("inf"))]
    pairs = F.explode(F.array(*(F.struct(b.cast("double").alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)))).alias("p")
    return rows.groupBy(*by).agg(*each).select(*by, pairs).select(*by, "p.le", "p.n")


def current_values(writes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last write of each key, as a key-value store would hold them. Writes are combined before the shuffle."""
    rest = [c for c in writes.columns if c != key]
    return writes.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("w")).select(key, "w.*")


def frames(streams: DataFrame) -> DataFrame:
    """stream_id, seq, kind, data of each event-stream frame of `streams` (stream_id, body): event, done or passthrough.

    Frames end with an empty line; `data:` lines of a frame are joined.
    """
    raw = streams.select("stream_id", F.posexplode(F.split("body", r"\r?\n\r?\n")).alias("seq", "raw")).where("raw <> ''")
    lines = F.filter(F.split("raw", r"\r?\n"), lambda x: x.startswith("data:"))
    data = F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, "^data: ?", "")), "\n")
    kind = F.when(F.size(lines) == 0, F.lit("passthrough")).when(data == "[DONE]", F.lit("done")).otherwise(F.lit("event"))
    return raw.select("stream_id", "seq", kind.alias("kind"), data.alias("data"))


def frame(data: Column) -> Column:
    """An event-stream frame that says this."""
    return F.concat(F.lit("data: "), F.replace(data, F.lit("\n"), F.lit("\ndata: ")), F.lit("\n\n"))


def sealed(value: Column, key: bytes) -> Column:
    """AES-256-GCM of a text, with a fresh vector in front."""
    return F.aes_encrypt(value, F.lit(bytearray(key)), F.lit("GCM"))


def unsealed(value: Column, key: bytes) -> Column:
    return F.aes_decrypt(value, F.lit(bytearray(key)), F.lit("GCM")).cast("string")


def newest(log: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The `most` first rows of each group: a store's limit of entries."""
    return log.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= most).drop("__n")
