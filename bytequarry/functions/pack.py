"""The inverse of the codecs: numbers and texts to bytes, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["joined", "pack_compressed", "pack_int", "pack_text", "pack_uleb128"]


def pack_int(value: Column, size: int, big: bool = False) -> Column:
    """The low ``size`` bytes of an integer of up to 64 bits, two's complement."""
    data = F.unhex(F.substring(F.lpad(F.hex(value.cast("bigint")), 16, "0"), 17 - 2 * size, 2 * size))
    return data if big or size == 1 else F.encode(F.reverse(F.decode(data, "ISO-8859-1")), "ISO-8859-1")


def pack_text(value: Column, size: int | None = None, charset: str = "UTF-8", end: bool = False) -> Column:
    """Encoded text, cut or padded with NUL to ``size`` bytes if given; ``end`` adds a NUL."""
    data = F.encode(value, charset)
    if end:
        data = F.concat(data, F.lit(b"\x00"))
    return data if size is None else F.substring(F.concat(data, F.lit(bytes(size))), 1, size)


def joined(parts: Column) -> Column:
    """The bytes of an array one after the other."""
    return F.unhex(F.array_join(F.transform(parts, F.hex), ""))


def pack_uleb128(value: Column) -> Column:
    """A varint of a number from 0 to 2**63 - 1."""
    group = lambda i: F.shiftrightunsigned(value, 7 * i).bitwiseAND(F.lit(127).cast("bigint"))
    more = lambda i: F.shiftrightunsigned(value, 7 * (i + 1)) > 0
    parts = [F.when((F.shiftrightunsigned(value, 7 * i) > 0) | F.lit(i == 0), pack_int(group(i) + F.when(more(i), 128).otherwise(0) if i < 8 else group(i), 1)) for i in range(9)]
    return joined(F.array_compact(F.array(*parts)))


def pack_compressed(value: Column) -> Column:
    """1, 2 or 4 tagged bytes, most significant first; null from 2**29 on."""
    return F.when(value < 0x80, pack_int(value, 1)).when(value < 0x4000, pack_int(value + 0x8000, 2, True)).when(value < 0x20000000, pack_int(value + 0xC0000000, 4, True))
