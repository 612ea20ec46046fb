"""Column helpers that read integers and bits out of a BINARY column.

Every helper is a composition of built-in expressions, so a decode stays inside
one code-generated stage and unused fields are pruned by the optimizer.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def octets(value: Column, offset: int | Column, size: int | Column) -> Column:
    """`size` bytes from 0-based byte `offset`."""
    return F.substring(value, offset + 1, size)


def word(raw: Column, offset: int | Column, size: int) -> Column:
    """Big-endian integer of `size` <= 8 bytes (two's complement at 8); 0 if absent."""
    return F.coalesce(
        F.conv(F.hex(octets(raw, offset, size)), 16, -10).cast("bigint"), F.lit(0).cast("bigint")
    )


def high32(value: Column) -> Column:
    """Upper four bytes of a 64-bit word, unsigned."""
    return F.shiftrightunsigned(value, 32)


def low32(value: Column) -> Column:
    """Lower four bytes of a 64-bit word, unsigned."""
    return value.bitwiseAND(0xFFFFFFFF)


def swap32(value: Column) -> Column:
    """Reverse the byte order inside each 32-bit half of a 64-bit word."""
    pairs = (
        F.shiftright(value, 8)
        .bitwiseAND(0x00FF00FF00FF00FF)
        .bitwiseOR(F.shiftleft(value.bitwiseAND(0x00FF00FF00FF00FF), 8))
    )
    return F.shiftrightunsigned(pairs, 16).bitwiseAND(0x0000FFFF0000FFFF).bitwiseOR(
        F.shiftleft(pairs.bitwiseAND(0x0000FFFF0000FFFF), 16)
    )


def int32(value: Column) -> Column:
    """Lower four bytes of a word as an int, sign and all: bit fields are then read
    from an int, without a range check for each of them."""
    return F.shiftright(F.shiftleft(value, 32), 32).cast("int")


def bits(value: Column, low: int, width: int) -> Column:
    """`width` bits of `value` starting at bit `low` (0 = least significant)."""
    shifted = F.shiftright(value, low) if low else value
    return shifted.bitwiseAND((1 << width) - 1)


def hex_text(raw: Column) -> Column:
    """Lowercase hexadecimal text of a BINARY column."""
    return F.lower(F.hex(raw))


def hex_number(number: Column) -> Column:
    """`0x..` text of a non-negative integer."""
    return F.concat(F.lit("0x"), F.lower(F.hex(number.cast("bigint"))))


def text_until_nul(raw: Column) -> Column:
    """UTF-8 text up to the first NUL; null when any byte is not valid UTF-8."""
    return F.substring_index(F.try_validate_utf8(raw.cast("string")), "\0", 1)


def latin1_text(raw: Column) -> Column:
    """One character per byte; the inverse of `latin1_bytes`."""
    return F.decode(raw, "ISO-8859-1")


def latin1_bytes(text: Column) -> Column:
    return F.encode(text, "ISO-8859-1")
