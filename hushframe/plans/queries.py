"""The registered queries and, where SQL can express them, the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.functions import scalars, validators
from hushframe.operators import bodies, extract, gateway, mask, restore, scan
from hushframe.sources.catalog import load_rules, session_rules
from hushframe.streaming import dialects

from . import oracles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("request_id"), F.lit(0).alias("text_idx"), "text")


def contact(text: Column) -> Column:
    return F.concat(text, F.lit(" contact user"), (F.col("turn") % 2).cast("string"), F.lit(".c"), (F.col("conv_id") % 7).cast("string"), F.lit("@mail.example.com or <EMAIL_1>"))


def turn_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns, each with a contact that its conversation shares with others; a null text stays null."""
    text = contact(F.col("text"))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("request_id"), F.col("turn").cast("int").alias("text_idx"), text.alias("text"))


def found_in(texts: DataFrame) -> DataFrame:
    """Disjoint findings of all the session's rules, in one pass over the texts."""
    return scan.findings(texts, session_rules(texts.sparkSession).rules)


def masked_documents(spark, sf_dir) -> DataFrame:
    """Each document is a request of one text, so all of its masking happens where it is."""
    return scan.mask_texts(document_texts(spark, sf_dir), session_rules(spark).rules)


DOCUMENTS_SQL = "SELECT doc_id AS k, 0 AS i, text FROM documents WHERE doc_id IS NOT NULL"
TURNS_SQL = """
SELECT conv_id AS k, turn::INT AS i, text || ' contact user' || (turn % 2) || '.c' || (conv_id % 7) || '@mail.example.com or <EMAIL_1>' AS text
FROM conversations
"""


def on_documents(select: str) -> str:
    return f"{oracles.masked(DOCUMENTS_SQL, load_rules().rules)}\n{select}"


def on_turns(select: str) -> str:
    return f"{oracles.masked(TURNS_SQL, load_rules().rules)}\n{select}"


def candidates_by_rule(spark, sf_dir):
    """How many candidates each rule has that has any."""
    return scan.scan(document_texts(spark, sf_dir), session_rules(spark).rules).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


def candidates_all_rules(spark, sf_dir):
    """How many candidates each rule of the catalogue has, also those with none."""
    catalog = session_rules(spark)
    found = scan.scan(document_texts(spark, sf_dir), catalog.rules).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    return catalog.frame(spark).select("rule_id").join(found, "rule_id", "left").select("rule_id", F.coalesce("n", F.lit(0)).alias("n"))


def coalesce_overlaps(spark, sf_dir):
    """Overlaps of made-up spans: each line item is a span of its order."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("request_id"), F.lit(0).alias("text_idx"), (F.col("l_partkey") % 40).cast("int").alias("start"),
        (F.col("l_partkey") % 40 + F.col("l_quantity").cast("int") % 9 + 1).cast("int").alias("end"), F.concat(F.lit("r"), F.col("l_linenumber").cast("string")).alias("rule_id"),
        F.lit(0).alias("data_type"), F.lit("X").alias("placeholder_type"),
    )
    texts = rows.select("request_id", "text_idx").distinct().withColumn("text", F.lit("x" * 60))
    return scan.coalesce(rows, texts).select("request_id", "start", "end", "rule_id")


COALESCE_SQL = """
WITH s AS (SELECT l_orderkey AS k, (l_partkey % 40)::INT AS s, (l_partkey % 40 + l_quantity::INT % 9 + 1)::INT AS e, 'r' || l_linenumber AS r FROM lineitem),
p AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, s - e, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM s),
g AS (SELECT *, sum(CASE WHEN pm IS NULL OR s >= pm THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, s - e, r ROWS UNBOUNDED PRECEDING) AS g FROM p)
SELECT k AS request_id, min(s) AS "start", max(e) AS "end", first(r ORDER BY s - e, s, r) AS rule_id FROM g GROUP BY k, g
"""


def mask_documents(spark, sf_dir):
    return masked_documents(spark, sf_dir).select("request_id", "text_idx", "masked_text")


def mask_conversations(spark, sf_dir):
    texts = turn_texts(spark, sf_dir)
    return mask.mask(texts, found_in(texts))[0]


def masking_state(spark, sf_dir):
    texts = turn_texts(spark, sf_dir)
    made = mask.state(texts, found_in(texts))
    said = F.transform("replacements", lambda r: F.concat_ws(":", r["ord"].cast("string"), r["rule_id"], r["data_type"].cast("string"), r["original"], r["placeholder"]))
    return made.select("request_id", F.array_join("triggered_rule_ids", ",").alias("rules"), F.array_join(F.col("triggered_data_types").cast("array<string>"), ",").alias("types"), F.array_join(said, "|").alias("replacements"))


STATE_SQL = """, said AS (SELECT k, string_agg(ord || ':' || rule_id || ':' || data_type || ':' || original || ':' || placeholder, '|' ORDER BY ord) AS replacements FROM firsts GROUP BY k)
SELECT k AS request_id, array_to_string(list_sort(list_distinct(list(rule_id))), ',') AS rules,
  coalesce(array_to_string(list_sort(list_distinct(list(data_type) FILTER (data_type BETWEEN 1 AND 6))), ','), '') AS types, any_value(replacements) AS replacements
FROM f JOIN said USING (k) WHERE kind <> '' GROUP BY k
"""
PUT_SQL = "(SELECT count(*) FROM firsts WHERE firsts.k = t.k) AS n_values"


def roundtrip_documents(spark, sf_dir):
    """The documents after masking and restoring, with the number of values that were hidden meanwhile."""
    hidden = masked_documents(spark, sf_dir).withColumn("known", F.col("replacements")).withColumn("kinds", F.array().cast("array<string>"))
    # Two rounds of Python over one row: what is counted rides along in the index.
    back = restore.restored(hidden.withColumn("text_idx", F.size("replacements")))
    return back.select("request_id", F.col("text_idx").cast("long").alias("n_values"), "text")


def roundtrip_conversations(spark, sf_dir):
    """The turns after masking by conversation and exact restoring, with the number of values of their conversation."""
    texts = turn_texts(spark, sf_dir)
    done, found = mask.mask(texts, found_in(texts))
    n = found.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_values"))
    return restore.demask(done, found).join(n, "request_id", "left").select("request_id", "text_idx", F.coalesce("n_values", F.lit(0)).alias("n_values"), "text")


def docs_with_findings(spark, sf_dir):
    found = found_in(document_texts(spark, sf_dir)).select("request_id").distinct()
    return table(spark, sf_dir, "documents").join(found, F.col("doc_id") == F.col("request_id"), "left_semi").select("doc_id", "source")


def docs_clean(spark, sf_dir):
    found = found_in(document_texts(spark, sf_dir)).select("request_id").distinct()
    return table(spark, sf_dir, "documents").join(found, F.col("doc_id") == F.col("request_id"), "left_anti").select("doc_id", "source")


def top_rules(spark, sf_dir):
    """A report: the twenty rules that mask most."""
    found = found_in(document_texts(spark, sf_dir))
    return found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rule_id").limit(20)


def validator(name: str, value: str, sql: str, **limits):
    """The scan's own check on made-up values of the orders, beside SQL that shares no code with it."""

    def query(spark, sf_dir):
        rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(value).alias("v"))
        return rows.select("o_orderkey", "v", validators.valid(F.col("v"), name, **limits).alias("valid"))

    return query, f"SELECT o_orderkey, v, {sql} AS valid FROM (SELECT o_orderkey, {value} AS v FROM orders)"


MADE = "(o_orderkey * 7919 + o_custkey * 104729) % 1000000007"


def digits(n: int, lead: str = "''") -> str:
    """SQL for n digits, two fewer in some rows, that differ by order."""
    return f"left(concat({lead}, lpad(CAST({MADE} AS VARCHAR(20)), 19, '{'73' * 10}')), {n} - CASE WHEN o_orderkey % 11 = 0 THEN 2 ELSE 0 END)"


def one_of(*values: str) -> str:
    """SQL for one of several texts by order."""
    return "CASE " + " ".join(f"WHEN o_orderkey % {len(values)} = {i} THEN {v}" for i, v in enumerate(values)) + " END"


_LEADS = one_of(*(f"'{x}'" for x in ("4", "34", "51", "2221", "2721", "6011", "644", "62", "2204", "2205", "9")))
_QUAD = f"concat(CAST(o_orderkey % 260 AS VARCHAR(9)), '.', CAST(o_custkey % 40 + 10 AS VARCHAR(9)), '.', CAST({MADE} % 256 AS VARCHAR(9)), '.', {one_of("'0'", "'7'", "'07'", "'255'")})"
_RANGES = one_of(_QUAD, "concat('10.', CAST(o_custkey % 300 AS VARCHAR(9)), '.1.1')", "concat('172.', CAST(o_custkey % 40 AS VARCHAR(9)), '.0.9/', CAST(o_orderkey % 40 AS VARCHAR(9)))", "concat('[192.168.0.', CAST(o_custkey % 300 AS VARCHAR(9)), ']')", "concat('::ffff:8.8.8.', CAST(o_custkey % 300 AS VARCHAR(9)))")
_SIX = one_of("concat('fe80::', CAST(o_custkey % 20000 AS VARCHAR(9)))", "concat('2001:db8:0:0:0:0:0:', CAST(o_custkey % 9999 AS VARCHAR(9)))", "concat('2001:db8::1:', CAST(o_custkey AS VARCHAR(9)), 'g')", "concat('1:2:3:4:5:6:', CAST(o_custkey % 999 AS VARCHAR(9)))", "concat('fd00::1/', CAST(o_orderkey % 200 AS VARCHAR(9)))", "'::1'", "concat('2001:db8::', CAST(o_custkey % 999 AS VARCHAR(9)), '::1')")
_MAIL = one_of("concat('a.', CAST(o_custkey AS VARCHAR(9)), '@x.example')", "concat('a..b', CAST(o_custkey AS VARCHAR(9)), '@x.example')", "concat(' q+', CAST(o_custkey AS VARCHAR(9)), '@a-b.co ')", "concat('x@-', CAST(o_custkey AS VARCHAR(9)), '.example')", "concat('x@y.', CAST(o_custkey AS VARCHAR(9)))", "concat(repeat('l', 60), CAST(o_custkey AS VARCHAR(9)), '@x.example')")
_IBAN = f"concat({one_of("'GB'", "'de'", "'FR'")}, lpad(CAST({MADE} % 97 + 2 AS VARCHAR(2)), 2, '0'), ' ', {one_of("'WEST'", "'3704'", "'7-70'")}, ' ', lpad(CAST(o_orderkey % 97 AS VARCHAR(9)), 4, '1'), ' 5698 ', CAST(o_custkey AS VARCHAR(9)))"
_WORD = f"concat(repeat('ab', CAST(o_orderkey % 5 AS INT)), substr('qwertyuiopasdfghjkl', CAST(o_orderkey % 7 + 1 AS INT), CAST(o_custkey % 12 AS INT)))"
VALIDATED = {
    "luhn": (digits(16, "'4'"), {}), "snils": (digits(11), {}), "inn_org": (digits(10), {}), "inn_person": (digits(12), {}), "ogrn": (digits(13), {}), "ogrnip": (digits(15, "'3'"), {}),
    "payment_card_no_luhn": (digits(16, _LEADS), {}), "payment_card": (digits(16, _LEADS), {}), "iban_mod97": (_IBAN, {}), "email_ascii": (_MAIL, {}),
    "ip_v4": (_RANGES, {}), "ip_v6": (_SIX, {}), "ip_public": (one_of(_RANGES, _SIX), {}), "ip_private": (one_of(_RANGES, _SIX), {}),
    "entropy": (_WORD, {"entropy": 2.5}), "banlist": (one_of("'Changeme'", "'x'", "concat('changeme', CAST(o_custkey % 3 AS VARCHAR(9)))"), {"banlist": ("changeme", "changeme1")}),
}


def scalar_functions(spark, sf_dir):
    email = F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))), F.lit("@example.com"))
    rows = table(spark, sf_dir, "customer").withColumn("email", email)
    return rows.select(
        "c_custkey", scalars.mask_email(F.col("email")).alias("masked"), scalars.base64url(F.col("email")).alias("b64"), F.sha2("email", 256).alias("sha"),
        F.array_join(scalars.split_csv(F.concat(F.lit(" a ,,"), "email", F.lit(" , b"))), "|").alias("parts"),
        scalars.normalize_path(F.concat(F.lit("/users/"), F.col("c_custkey").cast("string"), F.lit("/orders"))).alias("path"),
        F.round(scalars.backoff(F.col("c_custkey") % 8, 0.1, 5.0), 6).alias("backoff"),
    )


SCALAR_SQL = """
SELECT c_custkey, left(email, 1) || '***' || substr(email, instr(email, '@')) AS masked,
  rtrim(translate(base64(encode(email)), '+/', '-_'), '=') AS b64, sha256(email) AS sha, 'a|' || email || '|b' AS parts,
  '/users/:id/orders' AS path, round(least(5.0, 0.1 * pow(2.0, c_custkey % 8))::DOUBLE, 6) AS backoff
FROM (SELECT *, lower(replace(c_name, '#', '.')) || '@example.com' AS email FROM customer)
"""


def extract_chat_request(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return extract.chat_fields(extract.chat_body(turns)).select("request_id", "path", "text")


EXTRACT_SQL = """
SELECT conv_id AS request_id, 'messages.' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1) || '.content' AS path, text
FROM conversations QUALIFY text IS NOT NULL AND text <> ''
"""


def audit_page(spark, sf_dir):
    """The third page of the event log, newest first: each cursor is that of the last row of the page before."""
    log = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type").where("ts is not null")
    after = None
    for _ in range(2):
        rows = gateway.audit(log, "event_id", after).collect()  # a page: 50 rows
        after = rows[-1]["cursor"] if rows else None
    return gateway.audit(log, "event_id", after).select("event_id", "event_type")


AUDIT_SQL = """
SELECT event_id, event_type FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE ts IS NOT NULL) WHERE n BETWEEN 101 AND 150
"""


def format_bodies(spark, sf_dir, format, contacts=False):
    """A request of each conversation in the format, with the turns' texts in order; a null text is a message without one."""
    turns = table(spark, sf_dir, "conversations")
    if contacts:
        turns = turns.withColumn("text", contact(F.col("text")))
    item = {
        "chat_completions": "named_struct('role', m.role, 'content', m.text)",
        "messages": "named_struct('role', m.role, 'content', array(named_struct('type', 'text', 'text', m.text)))",
        "responses": "named_struct('type', 'message', 'role', m.role, 'content', m.text)",
    }[format]
    lists = turns.groupBy(F.col("conv_id").alias("request_id")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("ms"))
    name = "input" if format == "responses" else "messages"
    return lists.select("request_id", F.to_json(F.expr(f"named_struct('model', 'm', '{name}', transform(ms, m -> {item}))")).alias("body"))


def extract_format(format, path):
    def query(spark, sf_dir):
        return bodies.fields(format_bodies(spark, sf_dir, format), format, "request").select("request_id", "path", "text")

    sql = f"""
SELECT request_id, replace('{path}', '#', CAST(i AS VARCHAR)) AS path, text FROM (
  SELECT conv_id AS request_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text NULLS FIRST) - 1 AS i, text FROM conversations)
WHERE text <> ''
"""
    return query, sql


def roundtrip_bodies(spark, sf_dir):
    """Bodies after masking their fields in place, and restoring those of the masked bodies: the bodies themselves, with
    the number of values that were hidden meanwhile."""
    made = format_bodies(spark, sf_dir, "messages", contacts=True)
    found = bodies.fields(made, "messages", "request").where("not is_raw")
    texts = found.select("request_id", "text_idx", "text")
    masked, used = mask.mask(texts, found_in(texts))
    place = found.drop("text")
    hidden = bodies.patch(made, place.join(masked.withColumnRenamed("masked_text", "text"), ["request_id", "text_idx"]))
    again = bodies.fields(hidden, "messages", "request")
    back = restore.restore(again.select("request_id", "text_idx", F.col("text").alias("masked_text")), used)
    shown = bodies.patch(hidden, again.drop("text").join(back, ["request_id", "text_idx"]))
    n = used.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_values"))
    return bodies.fields(shown, "messages", "request").join(n, "request_id", "left").select("request_id", "path", "text", F.coalesce("n_values", F.lit(0)).alias("n_values"))


BODIES_SQL = f"SELECT * FROM (SELECT k AS request_id, 'messages.' || (row_number() OVER (PARTITION BY k ORDER BY i) - 1) || '.content.0.text' AS path, text, {PUT_SQL} FROM t) WHERE text IS NOT NULL"


def restore_drifted(spark, sf_dir):
    """Documents after masking, a rewriting of their placeholders, and tolerant restoring, with the number of values."""
    hidden = masked_documents(spark, sf_dir).withColumn("known", F.col("replacements"))
    drifted = hidden.withColumn("masked_text", F.regexp_replace("masked_text", "<([A-Z0-9_]+)_([0-9]+)>", "< $1 - 0$2 >"))
    kind = F.transform("replacements", lambda r: F.regexp_extract(r["placeholder"], "^<(.*)_[0-9]+>$", 1))
    back = restore.restored(drifted.withColumn("kinds", F.array_distinct(kind)).withColumn("text_idx", F.size("replacements")))
    return back.select("request_id", F.col("text_idx").cast("long").alias("n_values"), "text")


DRIFTED_SQL = f"SELECT k AS request_id, {PUT_SQL}, regexp_replace(text, '<([A-Z0-9_]+)_([0-9]+)>', '< \\1 - 0\\2 >', 'g') AS text FROM t"


def page_paths(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").withColumn("path", F.regexp_replace("url", r"^[a-z]+://[^/]*", ""))
    return rows.groupBy(scalars.normalize_path(F.col("path")).alias("path")).agg(F.count(F.lit(1)).alias("n"))


PATHS_SQL = """
SELECT '/' || array_to_string(list_transform(list_filter(string_split(regexp_replace(url, '^[a-z]+://[^/]*', ''), '/'), lambda x: x <> ''),
  lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') OR regexp_full_match(x, '[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}') THEN ':id' ELSE x END), '/') AS path, count(*) AS n
FROM pages WHERE url IS NOT NULL GROUP BY 1
"""


def event_latency(spark, sf_dir):
    """How many events of each type have a value, read as milliseconds, up to each bound."""
    rows = table(spark, sf_dir, "events")
    return gateway.histogram(rows, F.col("value") / 1000, ["event_type"])


LATENCY_SQL = f"""
SELECT event_type, le, count(*) FILTER (WHERE value / 1000 <= le) AS n FROM events,
  (SELECT unnest([{', '.join(f"{b}::DOUBLE" for b in gateway.BUCKETS)}, 'inf'::DOUBLE]) AS le) GROUP BY event_type, le
"""


def event_quantiles(spark, sf_dir):
    """Median and 95th percentile of each event type's values, read as milliseconds, interpolated from the buckets."""
    rows = table(spark, sf_dir, "events")
    made = gateway.quantiles(gateway.histogram(rows, F.col("value") / 1000, ["event_type"]), ["event_type"])
    return made.select("event_type", F.round("p50", 9).alias("p50"), F.round("p95", 9).alias("p95"))


def _quantile_sql(q: float) -> str:
    return f"round(max(CASE WHEN n >= {q} * total AND coalesce(before, 0) < {q} * total THEN CASE WHEN isinf(le) THEN low ELSE coalesce(low, 0) + (le - coalesce(low, 0)) * ({q} * total - coalesce(before, 0)) / (n - coalesce(before, 0)) END END), 9)"


QUANTILES_SQL = f"""
WITH b AS ({LATENCY_SQL}),
w AS (SELECT *, lag(le) OVER (PARTITION BY event_type ORDER BY le) AS low, lag(n) OVER (PARTITION BY event_type ORDER BY le) AS before, max(n) OVER (PARTITION BY event_type) AS total FROM b)
SELECT event_type, {_quantile_sql(0.5)} AS p50, {_quantile_sql(0.95)} AS p95 FROM w GROUP BY event_type
"""


def masking_summary(spark, sf_dir):
    """Totals over the masked conversations: how many by mode, the most frequent rules and types, what was passed on."""
    texts = turn_texts(spark, sf_dir)
    state = mask.state(texts, found_in(texts))
    known = texts.select("request_id").distinct().join(state, "request_id", "left")
    none = F.array().cast("array<string>")
    records = known.select(
        F.when(F.col("request_id") % 2 == 0, "enforce").otherwise("detect").alias("mode"), F.when(F.col("request_id") % 5 > 0, "messages").alias("format"), F.coalesce(F.size("replacements"), F.lit(0)).alias("replacements"),
        F.coalesce("triggered_rule_ids", none).alias("rule_ids"), F.coalesce(F.col("triggered_data_types").cast("array<string>"), none).alias("data_types"),
    )
    return gateway.summary(records)


SUMMARY_SQL = """, q AS (SELECT DISTINCT k, CASE WHEN k % 2 = 0 THEN 'enforce' ELSE 'detect' END AS mode FROM t),
rules AS (SELECT 'rule' AS kind, rule_id AS name, count(DISTINCT k) AS n FROM f WHERE kind <> '' GROUP BY rule_id ORDER BY n DESC, name LIMIT 20),
types AS (SELECT 'type' AS kind, data_type::VARCHAR AS name, count(DISTINCT k) AS n FROM f WHERE kind <> '' AND data_type BETWEEN 1 AND 6 GROUP BY data_type ORDER BY n DESC, name LIMIT 20)
SELECT 'masked' AS kind, mode AS name, count(*) AS n FROM q WHERE k IN (SELECT k FROM firsts) GROUP BY mode
UNION ALL SELECT 'passthrough', mode, count(*) FROM q WHERE k % 5 = 0 GROUP BY mode UNION ALL FROM rules UNION ALL FROM types
"""


def current_user_event(spark, sf_dir):
    """Each user's last event, as a key-value store would hold it."""
    return gateway.current_values(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


CURRENT_SQL = "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) = 1"


def events_retained(spark, sf_dir):
    log = gateway.retained(table(spark, sf_dir, "events"), "event_id", 72)
    return log.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


RETAINED_SQL = "SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 72 HOUR GROUP BY event_type"


def stream_frames(spark, sf_dir):
    """The frames of one event stream for each conversation: a frame per turn, and the end."""
    turns = table(spark, sf_dir, "conversations").where("text <> ''")
    line = gateway.frame(F.translate(F.trim("text"), "\r\n", "  "))
    joined = turns.groupBy(F.col("conv_id").alias("stream_id")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", line.alias("line")))).alias("ls"))
    streams = joined.select("stream_id", F.concat(F.array_join("ls.line", ""), F.lit("data: [DONE]\n\n")).alias("body"))
    return gateway.frames(streams).groupBy("stream_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("data")).alias("chars"))


FRAMES_SQL = """
SELECT conv_id AS stream_id, 'event' AS kind, count(*) AS n, sum(length(trim(text))) AS chars FROM conversations WHERE text <> '' GROUP BY conv_id
UNION ALL SELECT DISTINCT conv_id, 'done', 1, 6 FROM conversations WHERE text <> ''
"""


def restore_event_streams(spark, sf_dir):
    """Each conversation masked and sent as one event stream, a choice per turn, seven characters a frame; the texts that
    its restored frames say. A turn without text sends nothing."""
    texts = turn_texts(spark, sf_dir).where("text is not null")
    masked, used = mask.mask(texts, found_in(texts))
    text = F.col("masked_text")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(7)), lambda i: F.substr(text, i + 1, F.lit(7)))
    choice = F.array(F.struct(F.col("text_idx").alias("index"), F.struct(F.col("piece").alias("content")).alias("delta")))
    parts = masked.select("request_id", "text_idx", F.posexplode(cut).alias("at", "piece"))
    lines = parts.select(F.col("request_id").alias("stream_id"), "text_idx", "at", gateway.frame(F.to_json(F.struct(choice.alias("choices")))).alias("line"))
    joined = lines.groupBy("stream_id").agg(F.sort_array(F.collect_list(F.struct("text_idx", "at", "line"))).alias("ls"))
    streams = joined.select("stream_id", F.lit("chat_completions").alias("format"), F.concat(F.array_join("ls.line", ""), F.lit("data: [DONE]\n\n")).alias("body"))
    said = gateway.frames(dialects.restore_streams(streams, used)).where("kind = 'event'")
    one = F.from_json("data", "choices array<struct<index:int,delta:struct<content:string>>>")["choices"][0]
    pieces = said.select("stream_id", "seq", one["index"].alias("choice"), one["delta"]["content"].alias("content"))
    whole = pieces.groupBy("stream_id", "choice").agg(F.sort_array(F.collect_list(F.struct("seq", "content"))).alias("ps")).select("stream_id", "choice", F.array_join("ps.content", "").alias("text"))
    n = used.groupBy(F.col("request_id").alias("stream_id")).agg(F.count(F.lit(1)).alias("n_values"))
    return whole.join(n, "stream_id", "left").select("stream_id", "choice", "text", F.coalesce("n_values", F.lit(0)).alias("n_values"))


STREAMS_SQL = f"SELECT k AS stream_id, i AS choice, text, {PUT_SQL} FROM t WHERE text IS NOT NULL"


def request_parameters(spark, sf_dir):
    """Limits, paths' formats, header types and times, made of the orders' numbers."""
    k = F.col("o_orderkey")
    path = F.element_at(F.array(*map(F.lit, ("/openai/v1/messages?x=1", "/v1/responses", "/health", "/x/v1/chat/completions"))), (k % 4 + 1).cast("int"))
    page = scalars.page_params((k % 300 - 50).cast("string"), k.cast("string"))
    types = gateway.narrowed(F.array(*map(F.lit, (1, 4, 5))), F.element_at(F.array(*map(F.lit, ("none", "4,custom", "bad", "5, API_KEYS"))), (k % 4 + 1).cast("int")))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", page["limit"].alias("limit"), page["offset"].alias("offset"), gateway.format_of(path).alias("format"), F.array_join(types.cast("array<string>"), ",").alias("types"),
        scalars.epoch_to_iso8601(k * 86_461).alias("iso"), scalars.path_is_public(path, ["/health", "/v1*"]).alias("open"),
    )


REQUEST_SQL = """
SELECT o_orderkey, greatest(1, least(100, o_orderkey % 300 - 50))::INT AS "limit", least(1000000, o_orderkey)::INT AS "offset",
  CASE o_orderkey % 4 WHEN 0 THEN 'messages' WHEN 1 THEN 'responses' WHEN 3 THEN 'chat_completions' END AS format,
  CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '4' WHEN 2 THEN '1,4,5' ELSE '5' END AS types,
  strftime(make_timestamp(o_orderkey * 86461000000), '%Y-%m-%dT%H:%M:%SZ') AS iso, o_orderkey % 4 IN (1, 2) AS "open"
FROM orders
"""


def mac(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.hmac_sha256(F.col("c_name"), b"key").alias("mac"))


MAC_SQL = """
SELECT c_custkey, sha256(unhex(o) || unhex(sha256(unhex(i) || encode(c_name)))) AS mac
FROM customer, (SELECT string_agg(printf('%02x', xor(k, 92)), '' ORDER BY n) AS o, string_agg(printf('%02x', xor(k, 54)), '' ORDER BY n) AS i
  FROM (SELECT n, CASE n WHEN 0 THEN ascii('k') WHEN 1 THEN ascii('e') WHEN 2 THEN ascii('y') ELSE 0 END AS k FROM range(64) r(n)))
"""

QUERIES = {
    "candidates_by_rule": candidates_by_rule, "candidates_all_rules": candidates_all_rules, "coalesce_overlaps": coalesce_overlaps, "mask_documents": mask_documents, "mask_conversations": mask_conversations,
    "masking_state": masking_state, "roundtrip_documents": roundtrip_documents, "roundtrip_conversations": roundtrip_conversations, "docs_with_findings": docs_with_findings, "docs_clean": docs_clean, "top_rules": top_rules,
    "scalar_functions": scalar_functions, "extract_chat_request": extract_chat_request, "audit_page": audit_page,
}
SQL = {
    "candidates_by_rule": on_documents("SELECT rule_id, count(*) AS n FROM c JOIN r USING (rule) GROUP BY rule_id"),
    "candidates_all_rules": on_documents("SELECT rule_id, count(k) AS n FROM r LEFT JOIN c USING (rule) GROUP BY rule_id"),
    "mask_documents": on_documents("SELECT k AS request_id, i AS text_idx, masked AS masked_text FROM m"),
    "mask_conversations": on_turns("SELECT k AS request_id, i AS text_idx, masked AS masked_text FROM m"),
    "masking_state": on_turns(STATE_SQL), "hmac": MAC_SQL,
    "docs_with_findings": on_documents("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT k FROM f)"),
    "docs_clean": on_documents("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT k FROM f)"),
    "top_rules": on_documents("SELECT rule_id, count(*) AS n FROM f GROUP BY rule_id ORDER BY n DESC, rule_id LIMIT 20"),
    "roundtrip_conversations": on_turns(f"SELECT k AS request_id, i AS text_idx, text, {PUT_SQL} FROM t"),
    "coalesce_overlaps": COALESCE_SQL, "scalar_functions": SCALAR_SQL, "extract_chat_request": EXTRACT_SQL, "audit_page": AUDIT_SQL,
    "roundtrip_documents": on_documents(f"SELECT k AS request_id, {PUT_SQL}, text FROM t"),
}
QUERIES |= {
    "roundtrip_bodies": roundtrip_bodies, "restore_drifted": restore_drifted, "page_paths": page_paths, "event_latency": event_latency, "current_user_event": current_user_event,
    "events_retained": events_retained, "stream_frames": stream_frames, "request_parameters": request_parameters, "hmac": mac,
    "restore_event_streams": restore_event_streams, "event_quantiles": event_quantiles, "masking_summary": masking_summary,
}
SQL |= {
    "restore_drifted": on_documents(DRIFTED_SQL), "page_paths": PATHS_SQL, "event_latency": LATENCY_SQL, "current_user_event": CURRENT_SQL, "events_retained": RETAINED_SQL,
    "stream_frames": FRAMES_SQL, "request_parameters": REQUEST_SQL, "restore_event_streams": on_turns(STREAMS_SQL), "event_quantiles": QUANTILES_SQL, "masking_summary": on_turns(SUMMARY_SQL),
}
for _name, _path in {"chat_completions": "messages.#.content", "messages": "messages.#.content.0.text", "responses": "input.#.content"}.items():
    QUERIES[f"extract_{_name}"], SQL[f"extract_{_name}"] = extract_format(_name, _path)
SQL["roundtrip_bodies"] = on_turns(BODIES_SQL)
for _name, (_value, _limits) in VALIDATED.items():
    if _name == "entropy":
        _sql = oracles.entropy("v", _limits["entropy"])
    elif _name == "banlist":
        _sql = f"lower(v) NOT IN {_limits['banlist']}"
    else:
        _sql = {n: f(f"regexp_replace(v, '[^0-9]', '', 'g')") for n, f in oracles.DIGITS.items()}.get(_name) or oracles.OTHERS[_name]("v")
    QUERIES[f"validator_{_name}"], SQL[f"validator_{_name}"] = validator(_name, _value, _sql, **_limits)
