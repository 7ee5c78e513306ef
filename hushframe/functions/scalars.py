"""Scalar functions as SQL that Spark runs; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mask_email(email: Column) -> Column:
    """The first character of the local part and the domain; *** for a local part of one character or none."""
    at = F.instr(email, "@")
    return F.when(at <= 2, F.lit("***")).otherwise(F.concat(F.substring(email, 1, 1), F.lit("***"), F.substring(email, at, F.length(email))))


def split_csv(value: Column) -> Column:
    return F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != "")


def base64url(value: Column) -> Column:
    return F.rtrim(F.translate(F.base64(value.cast("binary")), "+/", "-_"), F.lit("="))


def from_base64url(value: Column) -> Column:
    return F.unbase64(F.translate(value, "-_", "+/"))


def normalize_path(path: Column) -> Column:
    """A path for metrics: numbers and UUIDs become :id, the token of an account route :token; empty is /."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    # Fixed value: the routes whose last part is a token.
    token = r"^/+api(/+v[0-9]*)?/+account/+(confirm|reset-password|change-email|join-from-invite)/+[^/]+/*$"
    shown = F.transform(parts, lambda s, i: F.when(path.rlike(token) & (i == F.size(parts) - 1), F.lit(":token")).when(s.rlike("^[0-9]+$") | s.rlike(UUID), F.lit(":id")).otherwise(s))
    return F.concat(F.lit("/"), F.array_join(shown, "/"))


def backoff(attempt: Column, base: float, most: float, jitter: bool = False) -> Column:
    """Twice as long each time, up to `most`; with jitter anything from nothing to that."""
    delay = F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempt))
    return delay * F.rand() if jitter else delay


# The forms of ids and addresses.
UUID = "^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"
EMAIL = r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$"


def is_uuid(value: Column) -> Column:
    return value.rlike(UUID)


def is_email(value: Column) -> Column:
    return value.rlike(EMAIL)


def parse_int(value: Column, default: int) -> Column:
    """The number that the text begins with; `default` without one or beyond 32 bits."""
    return F.coalesce(F.regexp_extract(value, r"^\s*([+-]?[0-9]+)", 1).try_cast("int"), F.lit(default))


def clamp_int(value: Column, default: int, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), parse_int(value, default)))


def page_params(limit: Column, offset: Column, default: int = 20, most: int = 100) -> Column:
    return F.struct(clamp_int(limit, default, 1, most).alias("limit"), clamp_int(offset, 0, 0, 1_000_000).alias("offset"))


def path_is_public(path: Column, patterns: list[str]) -> Column:
    """Whether a pattern equals the path, or ends in * and begins it."""
    tests = [path.startswith(p[:-1]) if p.endswith("*") else path == p for p in patterns]
    return F.coalesce(F.lit(False) if not tests else F.greatest(*tests, F.lit(False)), F.lit(False))


def epoch_to_iso8601(seconds: Column) -> Column:
    """In UTC whatever the session's zone; a year has four digits at least, and no plus sign where it has more."""
    whole = F.floor(seconds)
    second = F.pmod(whole, F.lit(86_400))
    day = F.date_from_unix_date(((whole - second) / 86_400).cast("int"))
    two = lambda n: F.lpad(n.cast("int").cast("string"), 2, "0")
    year = F.year(day).cast("string")
    date = [F.when(F.year(day).between(0, 9999), F.lpad(year, 4, "0")).otherwise(year), F.lit("-"), two(F.month(day)), F.lit("-"), two(F.day(day))]
    return F.concat(*date, F.lit("T"), two(second / 3600), F.lit(":"), two(second % 3600 / 60), F.lit(":"), two(second % 60), F.lit("Z"))


def pg_to_iso8601(stamp: Column) -> Column:
    """A database's timestamp text in ISO form, without fractions; +00 becomes Z, and other text stays."""
    parts = r"^(.{10}) (.{8})(?:\.[0-9]*)?(.*)$"
    zone = F.regexp_extract(stamp, parts, 3)
    done = F.concat(F.regexp_extract(stamp, parts, 1), F.lit("T"), F.regexp_extract(stamp, parts, 2), F.when(zone.isin("", "Z", "+00", "+00:00"), F.lit("Z")).otherwise(zone))
    return F.when(stamp.rlike(parts), done).otherwise(stamp)


def traceparent(header: Column) -> Column:
    """trace_id, parent_id and flags of a version 00 header; null for any other and for all-zero ids."""
    low = F.lower(header)
    shape = "^00-(?!0{32})([0-9a-f]{32})-(?!0{16})([0-9a-f]{16})-([0-9a-f]{2})$"
    return F.when(low.rlike(shape), F.struct(*(F.regexp_extract(low, shape, i).alias(n) for i, n in enumerate(("trace_id", "parent_id", "flags"), 1))))


def format_traceparent(context: Column) -> Column:
    """The version 00 header of a struct with trace_id, parent_id and flags."""
    return F.concat_ws("-", F.lit("00"), context["trace_id"], context["parent_id"], context["flags"])


class Check:
    """What a field of a JSON body has to be; each test names the first fault as a code, or null."""

    def __init__(self, body: Column, field: str) -> None:
        self.field = field
        value = F.try_variant_get(F.try_parse_json(body), f"$.{field}", "variant")
        self.kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
        self.text = F.get_json_object(body, f"$.{field}")
        self.absent = self.kind == "VOID"

    def _of(self, string: bool, faults: list[tuple[Column, str]]) -> Column:
        fits = self.kind == "STRING" if string else self.kind == "BIGINT"
        out = F.when(self.absent, F.lit(None)).when(~fits, F.lit("not_string" if string else "not_integer"))
        for fault, code in faults:
            out = out.when(fault, F.lit(code))
        return out

    def required(self) -> Column:
        return F.when(self.absent, F.lit("missing"))

    def length(self, least: int, most: int) -> Column:
        """In bytes."""
        return self._of(True, [(F.octet_length(self.text) < least, "too_short"), (F.octet_length(self.text) > most, "too_long")])

    def matches(self, pattern: str) -> Column:
        return self._of(True, [(~self.text.rlike(f"^(?:{pattern})$"), "bad_format")])

    def between(self, least: int, most: int) -> Column:
        number = self.text.try_cast("long")
        return self._of(False, [(number < least, "below_min"), (number > most, "above_max")])

    def one_of(self, *allowed: str) -> Column:
        return self._of(True, [(~self.text.isin(*allowed), "not_allowed")])

    def email(self) -> Column:
        return self._of(True, [(~is_email(self.text), "bad_format")])

    def uuid(self) -> Column:
        return self._of(True, [(~is_uuid(self.text), "bad_format")])

    def string(self) -> Column:
        """The field's text, if it is one."""
        return F.when(self.kind == "STRING", self.text)


def hmac_sha256(message: Column, key: bytes) -> Column:
    """Lower-case hex of the HMAC, with two of Spark's own digests."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def encode_corpus(value: Column) -> Column:
    """A text as base64url that is written backwards."""
    return F.reverse(base64url(value))


def random_hex(n: int) -> Column:
    """2 * n random hex digits, others in each row."""
    digests = [F.sha2(F.concat(F.expr("uuid()"), F.expr("uuid()")), 256) for _ in range(-(-n // 32))]  # 244 random bits each
    return F.substring(F.concat(*digests), 1, 2 * n)


def same_bytes(a: Column, b: Column) -> Column:
    """Whether two texts are equal, compared by their digests, so that time says nothing of where they differ."""
    return F.sha2(a.cast("binary"), 256) == F.sha2(b.cast("binary"), 256)


def is_ascii(value: Column) -> Column:
    return F.octet_length(value) == F.length(F.regexp_replace(value, "[^\\x00-\\x7F]", ""))


def ascii_upper(value: Column) -> Column:
    """a-z in upper case; all else stays, also letters of other alphabets."""
    return F.translate(value, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def ascii_trim(value: Column) -> Column:
    return F.regexp_replace(value, "^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$", "")


def decode_corpus(value: Column) -> Column:
    """The text of base64url that was written backwards."""
    return from_base64url(F.reverse(value)).cast("string")
