"""Hash functions and bit helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of FNV-1a.
FNV32_OFFSET, FNV32_PRIME = 2166136261, 16777619
FNV64_HI, FNV64_LO, FNV64_PRIME_LOW, FNV64_PRIME_SHIFT = 3421674724, 2216829733, 435, 40
MASK32 = 4294967295


def _bytes(text: Column) -> Column:
    """array<bigint> of the UTF-8 bytes; empty for the empty string."""
    raw = F.encode(text, "UTF-8")
    byte = lambda i: F.conv(F.hex(F.substring(raw, i, 1)), 16, 10).cast("bigint")
    return F.when(F.octet_length(text) > 0, F.transform(F.sequence(F.lit(1), F.octet_length(text)), byte)).otherwise(F.expr("cast(array() as array<bigint>)"))


def fnv1a32(text: Column) -> Column:
    return F.aggregate(_bytes(text), F.lit(FNV32_OFFSET).cast("bigint"), lambda h, b: (h.bitwiseXOR(b) * FNV32_PRIME).bitwiseAND(MASK32))


def fnv1a64(text: Column) -> Column:
    """struct<hi, lo> of 32-bit halves. The prime is 2^40 + 435, so no product leaves 64 bits."""

    def step(h, b):
        low = h["lo"].bitwiseXOR(b)
        by = low * FNV64_PRIME_LOW
        high = (h["hi"] * FNV64_PRIME_LOW + F.shiftleft(low, FNV64_PRIME_SHIFT - 32) + F.shiftrightunsigned(by, 32)).bitwiseAND(MASK32)
        return F.struct(high.alias("hi"), by.bitwiseAND(MASK32).alias("lo"))

    start = F.struct(F.lit(FNV64_HI).cast("bigint").alias("hi"), F.lit(FNV64_LO).cast("bigint").alias("lo"))
    return F.aggregate(_bytes(text), start, step)


def md5_u64(text: Column, seed: Column) -> Column:
    """First 8 bytes of MD5(text, then seed as 4 big-endian bytes and 28 zero bytes), unsigned, as decimal(20,0)."""
    tail = F.unhex(F.concat(F.lpad(F.hex(seed.cast("bigint")), 8, "0"), F.lit("0" * 56)))
    return F.conv(F.substring(F.md5(F.concat(F.encode(text, "UTF-8"), tail)), 1, 16), 16, 10).cast("decimal(20,0)")


def trailing_zeros(h: Column, width: int) -> Column:
    """Trailing zero bits of a non-negative bigint; the width for 0."""
    return F.when(h == 0, width).otherwise(F.bit_count(h.bitwiseAND(-h) - 1)).cast("int")


def char_bits(text: Column) -> Column:
    """Each character's code as 8 binary digits."""
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.lpad(F.bin(F.ascii(c)), 8, "0")), "")


def codepoints_to_text(codes: Column) -> Column:
    return F.array_join(F.transform(codes, lambda c: F.char(c)), "")
