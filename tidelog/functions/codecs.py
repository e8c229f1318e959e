"""Varints, little-endian integers, record sizes, the log-record codec and seeded strings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed sizes of a log record's header (crc 4, time 8, tombstone 1, key size 8, value size 8) and a run's record header.
LOG_HEADER, RUN_HEADER, RUN_FILE_HEADER = 29, 25, 32


def record_size(key: Column, value: Column, header: int = RUN_HEADER) -> Column:
    return (F.lit(header) + F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))).cast("bigint")


def varint_len(x: Column) -> Column:
    """Bytes of a LEB128 varint."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(x)) / 7).cast("int"))


def varint_hex(x: Column) -> Column:
    """A varint's bytes: 7 bits each, lowest first, the high bit set on all but the last."""
    n = varint_len(x)
    byte = lambda i: F.lpad(F.hex(F.floor(x / F.pow(F.lit(128.0), i)).cast("bigint").bitwiseAND(127) + F.when(i < n - 1, 128).otherwise(0)), 2, "0")
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), byte), "")


def varint_value(hexed: Column) -> Column:
    """Inverse of varint_hex."""
    byte = lambda i: F.conv(F.substring(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint")
    places = F.sequence(F.lit(0), (F.length(hexed) / 2 - 1).cast("int"))
    return F.aggregate(places, F.lit(0).cast("bigint"), lambda a, i: a + byte(i).bitwiseAND(127) * F.pow(F.lit(128.0), i).cast("bigint"))


def _turned(hexed: Column) -> Column:
    """The bytes of a hexadecimal text in reverse order."""
    return F.array_join(F.reverse(F.regexp_extract_all(hexed, F.lit(".."), F.lit(0))), "")


def _le(x: Column, width: int) -> Column:
    """Little-endian bytes of a non-negative bigint."""
    return F.unhex(_turned(F.lpad(F.hex(x.cast("bigint")), 2 * width, "0")))


def _from_le(raw: Column, at: Column, width: int) -> Column:
    return F.conv(_turned(F.hex(F.substring(raw, at, F.lit(width)))), 16, 10).cast("bigint")


def _body(ts: Column, tombstone: Column, key: Column, value: Column) -> Column:
    key, value = F.encode(key, "UTF-8"), F.coalesce(F.encode(value, "UTF-8"), F.lit(b""))
    return F.concat(_le(ts, 8), F.when(tombstone, F.lit(b"\x01")).otherwise(F.lit(b"\x00")), _le(F.octet_length(key), 8), _le(F.octet_length(value), 8), key, value)


def log_crc(ts: Column, tombstone: Column, key: Column, value: Column) -> Column:
    """CRC-32 of the record with its checksum field zero."""
    return F.crc32(F.concat(F.lit(b"\x00\x00\x00\x00"), _body(ts, tombstone, key, value)))


def encode_log_record(ts: Column, tombstone: Column, key: Column, value: Column) -> Column:
    body = _body(ts, tombstone, key, value)
    return F.concat(_le(F.crc32(F.concat(F.lit(b"\x00\x00\x00\x00"), body)), 4), body)


def decode_log_record(raw: Column) -> Column:
    """struct<crc, ts, tombstone, key, value, valid>."""
    at = lambda n: F.lit(n + 1)
    key_size, value_size = _from_le(raw, at(13), 8), _from_le(raw, at(21), 8)
    key = F.decode(F.substring(raw, at(LOG_HEADER), key_size.cast("int")), "UTF-8")
    value = F.decode(F.substring(raw, (key_size + LOG_HEADER + 1).cast("int"), value_size.cast("int")), "UTF-8")
    crc = _from_le(raw, at(0), 4)
    check = F.crc32(F.concat(F.lit(b"\x00\x00\x00\x00"), F.substring(raw, at(4), F.octet_length(raw))))
    return F.struct(crc.alias("crc"), _from_le(raw, at(4), 8).alias("ts"), (F.hex(F.substring(raw, at(12), F.lit(1))) == "01").alias("tombstone"), key.alias("key"), value.alias("value"), (crc == check).alias("valid"))


def seeded_text(length: Column, seed: Column) -> Column:
    """A text of hexadecimal digits that depends on the seed alone; up to 192 characters."""
    parts = [F.sha2(F.concat_ws(":", seed.cast("string"), F.lit(str(i))), 256) for i in range(3)]
    return F.substring(F.concat(*parts), F.lit(1), length.cast("int"))


def trim_line(text: Column) -> Column:
    """text without the line break at its end."""
    return F.regexp_replace(text, "\\r?\\n$", "")


def now_seconds() -> Column:
    """The present time in whole Unix seconds, one value for a query."""
    return F.unix_timestamp(F.current_timestamp())
