"""Declared record layouts: an ordered list of fields, read as Columns, structs or exploded tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codecs import bind, bytes_, codec

__all__ = ["Layout", "either", "records"]


@dataclass(frozen=True)
class Layout:
    """Fields as text: ``name:codec`` parted by blanks; a codec may repeat as ``name:4*u16`` (an array)."""

    text: str

    @cached_property
    def fields(self) -> list[tuple[str, int, int, str]]:
        """(name, offset, repeats or 0, codec)."""
        out, at = [], 0
        for part in self.text.split():
            name, kind = part.split(":")
            times, _, kind = kind.rpartition("*")
            out.append((name, at, int(times or 0), kind))
            at += codec(kind)[0] * int(times or 1)
        return out

    @cached_property
    def size(self) -> int:
        return sum(codec(kind)[0] * (times or 1) for _, _, times, kind in self.fields)

    def read(self, data: Column, offset=0, big: Column | bool = False) -> dict[str, Column]:
        """Field name -> value of the record at the offset; names that start with ``_`` are skipped."""
        base = offset if isinstance(offset, Column) else F.lit(offset)
        out = {}
        for name, at, times, kind in self.fields:
            size, get = codec(kind)
            if not name.startswith("_"):
                out[name] = F.array(*(get(data, base + at + i * size, big) for i in range(times))) if times else get(data, base + at, big)
        return out

    def struct(self, data: Column, offset=0, big: Column | bool = False, like: Layout | None = None) -> Column:
        """The record at the offset as one struct. Its bytes are cut out and written as digits once, in both directions where
        both byte orders can occur, and every number is one run of these digits; fields that are not all there are null.

        ``like`` gives the order and the types of the fields, for a variant whose numbers are narrower.
        """
        size, base = self.size, offset if isinstance(offset, Column) else F.lit(offset)
        wanted = {n: kind for n, _, _, kind in (like or self).fields}

        def fields(p: Column) -> Column:
            out = {}
            for name, at, times, kind in self.fields:
                if not name.startswith("_"):
                    width = codec(kind)[0]
                    one = [_field(p, size, at + i * width, kind, big, wanted.get(name)) for i in range(times or 1)]
                    out[name] = F.array(*one) if times else one[0]
            return F.struct(*(out[n].alias(n) for n in wanted if n in out))

        def digits(b: Column) -> Column:
            full = F.call_function("rpad", b, F.lit(size), F.lit(b"\x00"))
            back = F.encode(F.reverse(F.decode(full, "ISO-8859-1")), "ISO-8859-1")
            return F.struct(b.alias("b"), F.length(b).alias("n"), F.hex(full).alias("f"), F.hex(back).alias("r"))

        def cut(d: Column, o: Column) -> Column:
            return F.when((o >= 0) & (o <= F.length(d)), F.substring(d, (o + 1).cast("int"), F.lit(size)))

        part = bind(data, lambda d: bind(base.cast("bigint"), lambda o: cut(d, o)))
        return _apply(part, lambda b: _apply(digits(b), fields))


def _apply(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _type(kind: str) -> str | None:
    """SQL type of a whole number's codec; none for other codecs."""
    if kind[0] not in "ui":
        return None
    size = int(kind[1:].removesuffix("be").removesuffix("le")) // 8
    return "bigint" if kind[0] == "i" and size == 8 else "int" if kind[0] == "i" or size <= 2 else "bigint" if size <= 7 else "decimal(20,0)"


def _field(p: Column, whole: int, at: int, kind: str, big: Column | bool, wanted: str | None) -> Column:
    """A field of the record whose bytes, length and digits are in ``p``."""
    size, get = codec(kind)
    if kind[0] == "b":
        return F.when(p["n"] >= at + size, F.substring(p["b"], at + 1, size))
    if kind[0] not in "ui":
        return get(p["b"], F.lit(at), big)
    order = {"be": True, "le": False}.get(kind[-2:], big)
    forth, back = F.substring(p["f"], 2 * at + 1, 2 * size), F.substring(p["r"], 2 * (whole - at - size) + 1, 2 * size)
    text = back if size == 1 or order is False else forth if order is True else F.when(order, forth).otherwise(back)
    if kind[0] == "i" and size == 8:
        value = F.conv(text, 16, -10)
    elif kind[0] == "i":
        half = 1 << (8 * size - 1)
        value = F.pmod(F.conv(text, 16, 10).cast("bigint") + half, F.lit(2 * half)) - half
    else:
        value = F.conv(text, 16, 10)
    return F.when(p["n"] >= at + size, value.cast(_type(wanted or kind)))


def either(wide: Column, layouts: dict[int, Layout], data: Column, offset, big: Column | bool = False) -> Column:
    """The record as a struct by the 64-bit layout where ``wide`` holds, else by the 32-bit one; fields and types of the first."""
    return F.when(wide, layouts[64].struct(data, offset, big)).otherwise(layouts[32].struct(data, offset, big, layouts[64]))


def records(data: Column, offset: Column, count: Column, stride, one) -> Column:
    """Array of ``one(bytes of the table, offset in it, position)`` for up to ``count`` records of ``stride`` bytes.

    The count is bounded by the bytes that are there before anything is built, and by nothing else; a null or
    impossible offset or count gives no records.
    """
    stride = stride if isinstance(stride, Column) else F.lit(stride)

    def build(d: Column, o: Column, s: Column, n: Column) -> Column:
        table = F.coalesce(bytes_(d, o, n * s), F.lit(b""))
        return bind(table, lambda t: F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: one(t, i * s, i))).otherwise(F.array()))

    def count_of(d: Column, o: Column, s: Column) -> Column:
        fits = F.when((s > 0) & (o >= 0) & (o <= F.length(d)), F.floor((F.length(d) - o) / s))
        n = count.cast("bigint")
        return F.when(n.isNotNull() & fits.isNotNull(), F.least(n, fits)).otherwise(0).cast("int")

    return bind(data, lambda d: bind(offset.cast("bigint"), lambda o: bind(stride, lambda s: bind(count_of(d, o, s), lambda n: build(d, o, s, n)))))
