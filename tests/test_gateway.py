import base64
import datetime as dt
import hashlib
import hmac

from pyspark.sql import functions as F

from hushframe.functions import scalars as s
from hushframe.operators import gateway as g


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


def test_scalars(spark):
    ask = lambda f, v: one(spark, f(F.col("v")), v=v)
    uid = "0a1b2c3d-0000-1111-2222-333344445555"
    assert ask(s.is_uuid, uid) and not ask(s.is_uuid, uid[:-1]) and ask(s.is_email, "a@b.ru") and not ask(s.is_email, "a@b")
    clamp = lambda v: ask(lambda c: s.clamp_int(c, 20, 1, 100), v)
    assert [clamp(v) for v in ("", "7x", "-5", "999", "99999999999", "abc")] == [20, 7, 1, 100, 20, 20]
    for path, want in {"": "/", "/": "/", "/a//5/": "/a/:id", f"/u/{uid}": "/u/:id", "/api/v1/account/confirm/xyz": "/api/v1/account/confirm/:token", "/api/account/other/xyz": "/api/account/other/xyz"}.items():
        assert ask(s.normalize_path, path) == want
    assert ask(lambda c: s.path_is_public(c, ["/a", "/b*"]), "/bc") and not ask(lambda c: s.path_is_public(c, ["/a", "/b*"]), "/ab")
    assert ask(s.epoch_to_iso8601, 0) == "1970-01-01T00:00:00Z"
    assert [ask(s.pg_to_iso8601, v) for v in ("2024-01-02 03:04:05.678+00", "2024-01-02 03:04:05-03", "no")] == ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05-03", "no"]
    good = f"00-{'A' * 32}-{'1' * 16}-01"
    assert ask(s.traceparent, good).trace_id == "a" * 32 and ask(s.traceparent, good.replace("A", "0")) is None and ask(s.traceparent, "00-1") is None
    for key in (b"k", b"k" * 80):
        assert ask(lambda c: s.hmac_sha256(c, key), "méssage") == hmac.new(key, "méssage".encode(), hashlib.sha256).hexdigest()  # noqa: B023
    assert ask(s.decode_corpus, base64.urlsafe_b64encode("нет?".encode()).decode().rstrip("=")[::-1]) == "нет?"


def test_times_far_from_now(spark):
    ask = lambda v: one(spark, s.epoch_to_iso8601(F.col("v")), v=v)
    far = {253_402_300_799: "9999-12-31T23:59:59Z", 253_402_300_800: "10000-01-01T00:00:00Z", 778_148_913_539: "26628-07-23T03:58:59Z", -1: "1969-12-31T23:59:59Z", -62_135_596_801: "0000-12-31T23:59:59Z", -99_999_999_999: "-1199-02-15T14:13:21Z"}
    assert {v: ask(v) for v in far} == far and one(spark, s.epoch_to_iso8601(F.lit(None).cast("long"))) is None
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert ask(0) == "1970-01-01T00:00:00Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_gateway(spark):
    ask = lambda f, v: one(spark, f(F.col("v")), v=v)
    assert [ask(g.format_of, p) for p in ("/openai/v1/messages?x=/v1/responses", "/v1/responses", "/v2")] == ["messages", "responses", None]
    types = F.array(F.lit(1), F.lit(5))
    assert [ask(lambda h: g.narrowed(types, h), h) for h in ("personal_data, 3", "None", "what", " ", "2")] == [[5], [], [1, 5], [1, 5], []]
    rules = lambda *ids: spark.createDataFrame([(i, w) for i, w in ids], "rule_id string, w string")
    kept = g.merged_rules(rules(("a", "b"), ("b", "b")), rules(("a", "c"), ("c", "c"), ("d", "c")), rules(("b", ""), ("d", "")))
    assert sorted(map(tuple, kept.collect())) == [("a", "b"), ("c", "c")]
    key = b"0" * 32
    assert ask(lambda v: g.unsealed(g.sealed(v, key), key), "texté") == "texté"
    body = "event: x\ndata:a\ndata: b\n\n: ping\r\n\r\ndata: [DONE]\n\n"
    got = g.frames(spark.createDataFrame([(1, body)], "stream_id long, body string")).orderBy("seq").collect()
    assert [(r.kind, r.data) for r in got] == [("event", "a\nb"), ("passthrough", ""), ("done", "[DONE]")]
    assert ask(g.frame, "a\nb") == "data: a\ndata: b\n\n"


def test_audit_pages_hold_every_row_once(spark):
    at = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([(at + dt.timedelta(hours=i // 3), i, ["x"] if i % 2 else ["y", "x"]) for i in range(40)], "ts timestamp, id long, rules array<string>")
    seen, after = [], None
    while page := g.audit(log, "id", after, limit=7, rules="x").collect():
        seen += [r.id for r in page]
        after = page[-1].cursor
    assert seen == list(range(39, -1, -1))
    assert g.audit(log, "id", rules="y", since=at + dt.timedelta(hours=1)).count() == 18
    assert g.retained(log, "id", 2).count() == 7 and g.newest(log, ["ts"], [F.desc("id")], 2).count() == 27
    assert {r.id for r in g.current_values(log.withColumn("k", F.col("id") % 5), "k", ["ts", "id"]).collect()} == set(range(35, 40))
    counts = g.histogram(log, F.col("id") / 10, []).orderBy("le").collect()
    assert [r.n for r in counts][-4:] == [11, 26, 40, 40]


def test_pages_follow_each_other(spark):
    """Times whose nanoseconds no double can hold, and rows of one time."""
    rows = [(i, 1_700_000_000_000_016 - i // 2) for i in range(6)]
    log = spark.createDataFrame(rows, "id long, us long").select("id", F.timestamp_micros("us").alias("ts"))
    got, after = [], None
    while page := g.audit(log, "id", after, limit=2).collect():
        got += [r.id for r in page]
        after = page[-1].cursor
    assert got == [1, 0, 3, 2, 5, 4]


def test_toggling(spark):
    ids = lambda *names: spark.createDataFrame([(n,) for n in names], "rule_id string")
    changes = spark.createDataFrame([("a", False), ("b", True), ("x", False), ("c", True), ("c", False)], "rule_id string, enabled boolean")
    after, results = g.toggled(ids("a", "b", "c"), ids("b", "d"), changes)
    assert sorted(r.rule_id for r in after.collect()) == ["a", "c", "d"]
    assert {(r.rule_id, r.done) for r in results.collect()} == {("a", True), ("b", True), ("c", True), ("x", False)}


def test_modes(spark):
    texts = spark.createDataFrame([(1, 0, "a")], "request_id long, text_idx int, text string")
    masked = spark.createDataFrame([(1, 0, "<A_1>")], "request_id long, text_idx int, masked_text string")
    assert g.forwarded(texts, masked, "detect").first().text == "a" and g.forwarded(texts, masked, "enforce").first().text == "<A_1>"


def test_quantiles_of_buckets(spark):
    rows = spark.createDataFrame([("a", 0.001 * i) for i in range(1, 101)] + [("b", 99.0)], "k string, s double")
    got = {r.k: (r.p50, r.p95) for r in g.quantiles(g.histogram(rows, F.col("s"), ["k"]), ["k"]).collect()}
    assert abs(got["a"][0] - 0.05) < 1e-9 and abs(got["a"][1] - 0.095) < 1e-3 and got["b"] == (5.0, 5.0)


def test_summary(spark):
    rows = [("enforce", "messages", 2, ["r1", "r2"], [1]), ("enforce", None, 0, [], []), ("detect", "messages", 1, ["r1"], [1, 5])]
    got = {tuple(r) for r in g.summary(spark.createDataFrame(rows, "mode string, format string, replacements int, rule_ids array<string>, data_types array<int>")).collect()}
    assert got == {("masked", "enforce", 1), ("masked", "detect", 1), ("passthrough", "enforce", 1), ("rule", "r1", 2), ("rule", "r2", 1), ("type", "1", 2), ("type", "5", 1)}


def test_checks_of_bodies(spark):
    body = '{"n":5,"s":"äb","u":"12345678-1234-1234-1234-123456789abc","m":"a@b.co","z":null,"f":1.5,"b":"x"}'
    df = spark.createDataFrame([(body,)], "body string")
    c = lambda f: s.Check(F.col("body"), f)
    tests = [
        (c("z").required(), "missing"), (c("q").required(), "missing"), (c("n").required(), None), (c("s").length(1, 3), None), (c("s").length(4, 9), "too_short"), (c("s").length(0, 2), "too_long"),
        (c("n").length(0, 9), "not_string"), (c("q").length(5, 9), None), (c("n").between(1, 5), None), (c("n").between(6, 9), "below_min"), (c("n").between(0, 4), "above_max"), (c("f").between(0, 4), "not_integer"),
        (c("b").one_of("x", "y"), None), (c("b").one_of("y"), "not_allowed"), (c("u").uuid(), None), (c("b").uuid(), "bad_format"), (c("m").email(), None), (c("b").email(), "bad_format"), (c("b").matches("[xy]"), None),
        (c("n").string(), None), (c("b").string(), "x"),
    ]
    got = df.select(*(t.alias(f"c{i}") for i, (t, _) in enumerate(tests))).first()
    assert list(got) == [w for _, w in tests]


def test_small_scalars(spark):
    header = "00-" + "a1" * 16 + "-" + "b2" * 8 + "-01"
    df = spark.createDataFrame([(header, " \tÄbc\n")], "h string, t string")
    row = df.select(
        s.format_traceparent(s.traceparent(F.col("h"))).alias("h"), s.ascii_upper(s.ascii_trim(F.col("t"))).alias("t"), s.is_ascii(F.col("t")).alias("a"), s.is_ascii(F.col("h")).alias("b"),
        s.decode_corpus(s.encode_corpus(F.col("t"))).alias("c"), s.random_hex(40).alias("r"), s.same_bytes(F.col("h"), F.lit(header)).alias("e"), s.backoff(F.lit(3), 0.1, 0.5, jitter=True).alias("j"),
    ).first()
    assert (row.h, row.t, row.a, row.b, row.c, row.e) == (header, "ÄBC", False, True, " \tÄbc\n", True)
    assert len(row.r) == 80 and set(row.r) <= set("0123456789abcdef") and 0 <= row.j <= 0.5


def test_functions_for_sql(spark):
    from hushframe.functions.registered import register

    assert register(spark) == ["hush_mask", "hush_findings", "hush_restore", "hush_valid"]
    row = spark.sql("select hush_mask(t) m, hush_findings(t) f, hush_restore('<EMAIL_1>!', array(named_struct('placeholder', '<EMAIL_1>', 'original', 'x'))) r, hush_valid('4111111111111111', 'luhn') v, hush_mask(null) n from values ('to a@b.example') as x(t)").first()
    assert (row.m, row.f, row.r, row.v, row.n) == ("to <EMAIL_1>", ["pii.email"], "x!", True, None)
