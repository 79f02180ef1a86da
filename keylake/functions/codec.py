"""Key encodings, hashes and payload codecs as column expressions, evaluated in the JVM.

Encoded ranges sort as text in the order of the typed values, so range predicates on them push down to Parquet.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: days and microseconds from 0000-01-01 to 1970-01-01, and the sign bit of a 64-bit integer
EPOCH_DAYS = 719528
EPOCH_MICROS = EPOCH_DAYS * 86_400_000_000
SIGN = -(2**63)

DATE_SHAPE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
DATETIME_SHAPE = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})[Tt]([0-9]{2}:[0-9]{2}:[0-9]{2})(?:\.([0-9]{1,9}))?([Zz]|[+-][0-9]{2}:[0-9]{2})$"
INTEGER_SHAPE = r"^[+-]?[0-9]+$"


def _hex(value: Column, width: int) -> Column:
    return F.lpad(F.lower(F.hex(value)), width, "0")


def _from_hex(text: Column) -> Column:
    """Up to 15 hex digits as a long."""
    return F.conv(text, 16, 10).cast("long")


def encode_integer(value: Column) -> Column:
    """A long as 16 hex digits that sort by value."""
    return _hex(value.cast("long").bitwiseXOR(F.lit(SIGN)), 16)


def decode_integer(encoded: Column) -> Column:
    high, low = _from_hex(F.substring(encoded, 1, 8)), _from_hex(F.substring(encoded, 9, 8))
    return F.shiftleft(high, 32).bitwiseOR(low).bitwiseXOR(F.lit(SIGN))


def encode_date(value: Column) -> Column:
    """A date as 6 hex digits: days since year 0."""
    return _hex((F.datediff(value, F.lit("1970-01-01").cast("date")) + EPOCH_DAYS).cast("long"), 6)


def decode_date(encoded: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), (_from_hex(encoded) - EPOCH_DAYS).cast("int"))


def _encode_nanos(micros: Column, nanos: Column) -> Column:
    """18 hex digits of nanoseconds since year 0, from microseconds since 1970 and the nanoseconds beyond."""
    whole = (micros + F.lit(EPOCH_MICROS)).cast("decimal(21,0)") * F.lit(1000).cast("decimal(4,0)") + nanos.cast("decimal(4,0)")
    split = F.lit(2**32).cast("decimal(21,0)")
    low = (whole % split).cast("long")
    return F.concat(_hex(((whole - low) / split).cast("long"), 10), _hex(low, 8))


def encode_timestamp(value: Column) -> Column:
    """A timestamp (microseconds) as 18 hex digits of nanoseconds since year 0."""
    return _encode_nanos(F.unix_micros(value), F.lit(0))


def valid_date(text: Column) -> Column:
    """Whether a text is a calendar date in the one form allowed."""
    return F.coalesce(text.rlike(DATE_SHAPE) & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), F.lit(False))


def datetime_micros(text: Column) -> Column:
    """Microseconds since 1970 in UTC of an RFC 3339 text with an offset; null if it isn't valid."""
    part = lambda i: F.regexp_extract(text, DATETIME_SHAPE, i)
    stamp = F.try_to_timestamp(F.concat_ws(" ", part(1), part(2), F.when(F.upper(part(4)) == "Z", "+00:00").otherwise(part(4))), F.lit("yyyy-MM-dd HH:mm:ss xxx"))
    micros = F.unix_micros(stamp) + F.substring(F.rpad(part(3), 9, "0"), 1, 6).cast("long")
    first, end = F.lit(-EPOCH_MICROS), F.lit(253402300800000000)
    return F.when(text.rlike(DATETIME_SHAPE) & (micros >= first) & (micros < end), micros)


def encode_datetime(text: Column) -> Column:
    """An RFC 3339 text with up to nine fraction digits as 18 hex digits of nanoseconds since year 0; null if not valid."""
    rest = F.substring(F.rpad(F.regexp_extract(text, DATETIME_SHAPE, 3), 9, "0"), 7, 3).cast("long")
    return _encode_nanos(datetime_micros(text), rest)


def canonical_datetime(text: Column) -> Column:
    """The same instant in UTC with nine fraction digits."""
    micros = datetime_micros(text)
    fraction = F.rpad(F.regexp_extract(text, DATETIME_SHAPE, 3), 9, "0")
    return F.concat(F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), fraction, F.lit("Z"))


def encode_boolean(value: Column) -> Column:
    return F.when(value, "1").when(~value, "0")


def encode_range(value: Column, kind: str) -> Column:
    """A range key given as text, encoded for its declared kind; null if it isn't a value of that kind."""
    if kind == "String":
        return value
    if kind == "Integer":
        return F.when(value.rlike(INTEGER_SHAPE), encode_integer(value.try_cast("long")))
    if kind == "Date":
        return F.when(valid_date(value), encode_date(F.try_to_date(value, "yyyy-MM-dd")))
    if kind == "DateTime":
        return encode_datetime(value)
    if kind == "Boolean":
        return F.when(value == "true", "1").when(value == "false", "0")
    raise ValueError(f"no range of kind {kind}")


def escape_segment(text: Column) -> Column:
    """Frees a key segment of the separators 0 and 1, so that escaped segments can be joined by 0."""
    return F.replace(F.replace(text, F.lit("\x01"), F.lit("\x01\x02")), F.lit("\x00"), F.lit("\x01\x01"))


def unescape_segment(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\x01\x01"), F.lit("\x00")), F.lit("\x01\x02"), F.lit("\x01"))


def big_endian(value: Column) -> Column:
    """A long as eight bytes, most significant first."""
    return F.unhex(_hex(value.cast("long"), 16))


def revision(authored_ms: Column, stream: Column, sequence: Column, tag: str = "record-revision-v2") -> Column:
    """Revision of a record: SHA-256 of a tag and its stamp."""
    return F.sha2(F.concat(F.encode(F.lit(tag + "\0"), "utf-8"), big_endian(authored_ms), F.encode(stream, "utf-8"), big_endian(sequence)), 256)


def entry_hash(signed: Column, signature: Column) -> Column:
    """Hash of a log entry: SHA-256 of its signed bytes and signature."""
    return F.sha2(F.concat(signed, signature), 256)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 of a binary column under a key of at most 64 bytes, as hex digits."""
    block = key.ljust(64, b"\0")
    inner, outer = (bytes(b ^ x for b in block) for x in (0x36, 0x5C))
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), message), 256))), 256)


def blinded_hash(key: bytes, field_key: str, value: Column) -> Column:
    """A hash key as stored: URL-safe base64 of the first 16 bytes of its HMAC; an empty key stays empty."""
    mac = hmac_sha256(key, F.encode(F.concat(F.lit(f"hk|v1\0{field_key}\0"), value), "utf-8"))
    text = F.base64(F.unhex(F.substring(mac, 1, 32)))
    return F.when(value == "", "").otherwise(F.rtrim(F.translate(text, "+/=", "-_ ")))


def encode_payload(key: Column, value: Column) -> Column:
    """Key and value of a replicated record: two bytes of key length, key, value."""
    raw = F.encode(key, "utf-8")
    return F.concat(F.unhex(_hex(F.length(raw).cast("long"), 4)), raw, value)


def payload_key(payload: Column) -> Column:
    size = _from_hex(F.hex(F.substring(payload, 1, 2))).cast("int")
    return F.decode(F.substr(payload, F.lit(3), size), "utf-8")


def payload_value(payload: Column) -> Column:
    """The value; empty for a tombstone."""
    size = _from_hex(F.hex(F.substring(payload, 1, 2))).cast("int")
    return F.substr(payload, size + 3, F.greatest(F.length(payload) - size - 2, F.lit(0)))


def range_seconds(text: Column) -> Column:
    """Unix seconds that a range key begins with: 20 digits; null for other keys."""
    return F.when(text.rlike("^[0-9]{20}"), F.substring(text, 1, 20).try_cast("decimal(20,0)"))


def prefix_end(prefix: str) -> str | None:
    """The smallest text greater than all with this prefix, in code point order; None if there is none."""
    for at in range(len(prefix) - 1, -1, -1):
        code = ord(prefix[at]) + 1
        code = 0xE000 if code == 0xD800 else code
        if code <= 0x10FFFF:
            return prefix[:at] + chr(code)
    return None


def clip(text: Column, size: int) -> Column:
    """At most so many bytes of a text, cut between code points."""
    raw = F.encode(text, "utf-8")
    end = F.lit(size)
    for _ in range(3):  # a code point has at most three continuation bytes
        follows = F.conv(F.hex(F.substr(raw, end + 1, F.lit(1))), 16, 10).cast("int")
        end = F.when(follows.between(0x80, 0xBF), end - 1).otherwise(end)
    return F.when(F.length(raw) <= size, text).otherwise(F.decode(F.substr(raw, F.lit(1), end), "utf-8"))


def inline_file_ok(content: Column, size: Column, digest: Column) -> Column:
    """Whether base64 content agrees with the size and SHA-256 of its file marker."""
    shape = content.rlike("^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
    raw = F.when(shape, F.unbase64(content))
    return F.coalesce((F.length(raw) == size) & (F.sha2(raw, 256) == digest), F.lit(False))
