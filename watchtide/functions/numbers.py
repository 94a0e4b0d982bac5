"""Lenient numbers, 256-bit hexadecimal words, scaling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let


def lenient_long(text: Column) -> Column:
    """A decimal or ``0x`` hexadecimal integer of up to 64 bits, else null."""

    def read(plain: Column) -> Column:
        digits = F.regexp_extract(plain, "^0x([0-9a-fA-F]{1,15})$", 1)
        return F.when(plain.startswith("0x"), F.conv(F.nullif(digits, F.lit("")), 16, 10).try_cast("bigint")).otherwise(plain.try_cast("bigint"))

    return let(F.trim(text), read)


def lenient_double(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def finite(x: Column) -> Column:
    """The number, or null if it is null, NaN or infinite."""
    return let(x, lambda v: F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v))


def hex_words(data: Column) -> Column:
    """The 64-digit words after ``0x``; empty if there is no whole first word."""

    def cut(body: Column) -> Column:
        count = F.floor((F.length(body) + 63) / 64)
        words = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(body, ((i - 1) * 64 + 1).cast("int"), F.lit(64)))
        return F.when(F.length(body) >= 64, words).otherwise(F.array().cast("array<string>"))

    return let(F.regexp_extract(F.trim(data), "^0x([0-9a-fA-F]*)$", 1), cut)


def u256_to_double(word: Column) -> Column:
    """An unsigned 256-bit word as a double: eight 32-bit limbs, folded."""

    def fold(w: Column) -> Column:
        out = F.lit(0.0)
        for i in range(8):
            out = out * 4294967296.0 + F.conv(F.substring(w, 8 * i + 1, 8), 16, 10).try_cast("double")
        return out

    return let(F.lpad(F.regexp_replace(word, "^0x", ""), 64, "0"), fold)


def u256_to_long(word: Column) -> Column:
    """An unsigned 256-bit word as an exact long; null if it doesn't fit into one."""

    def read(w: Column) -> Column:
        return F.when(F.substring(w, 1, 48).rlike("^0*$"), F.conv(F.substring(w, 49, 16), 16, 10).try_cast("bigint"))

    return let(F.lpad(F.regexp_replace(word, "^0x", ""), 64, "0"), read)


def i256_to_double(word: Column) -> Column:
    """A signed 256-bit word (two's complement) as a double."""

    def signed(w: Column) -> Column:
        flipped = F.translate(F.lower(w), "0123456789abcdef", "fedcba9876543210")
        return F.when(F.substring(w, 1, 1).rlike("[89a-fA-F]"), -(u256_to_double(flipped) + 1)).otherwise(u256_to_double(w))

    return let(F.lpad(F.regexp_replace(word, "^0x", ""), 64, "0"), signed)


def scale(raw: Column, decimals: Column) -> Column:
    return finite(raw) / F.pow(F.lit(10.0), decimals)
