"""Scalar codecs as Column expressions: bytes at an offset in, a typed value out.

Offsets are Columns or integers counted from 0. A read that leaves the bytes gives null, never a shorter
number. Unsigned 64-bit values are DECIMAL(20,0). Everything stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

__all__ = [
    "Codec", "align", "ascii_int", "bind", "bit_list", "bits", "bytes_", "codec", "compressed_int", "decimal96", "flag_names", "flags",
    "fixed_string", "float32", "float64", "guid", "hexed", "masked", "nul_string", "once", "prefixed_string", "remainder", "settled", "signed_low_bit",
    "sint", "timestamp", "uint", "uleb128_list", "version", "where_here",
]

Codec = Callable[[Column, Column, Column | bool], Column]
DEC = "decimal(20,0)"


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: expressions that name a long one several times else grow without bound."""
    if len(str(value)) <= 60:
        return use(value)
    return F.get(F.transform(F.array(value), use), F.lit(0))


def once(value: Column) -> Column:
    """The value as a column that later projections refer to instead of repeating its expression."""
    return F.get(F.transform(F.array(F.lit(0)), lambda _: value), F.lit(0))


def where_here(rows: DataFrame, condition: Column) -> DataFrame:
    """``rows.where(condition)`` that stays above the projections below it.

    A filter that the optimizer moves below a projection repeats the expressions of its columns, and those of the columns they
    are made of, so that a few decoding steps grow without bound. It does not move below a number of the row.
    """
    return rows.withColumn("_here", F.monotonically_increasing_id()).where(condition & (F.col("_here") >= 0)).drop("_here")


def settled(rows: DataFrame) -> DataFrame:
    """The same rows, with the columns so far computed before what is made of them.

    The optimizer moves the expression of a column that is named once to the place of that name, also into the body of
    a lambda, where it is then computed for every element.
    """
    return where_here(rows, F.lit(True))


def bytes_(data: Column, offset, size) -> Column:
    """``size`` bytes at ``offset``; null if they are not all there."""

    def cut(d: Column, o: Column, n: Column) -> Column:
        return F.when((o >= 0) & (n >= 0) & (o + n <= F.length(d)), F.substring(d, (o + 1).cast("int"), n.cast("int")))

    return bind(data, lambda d: bind(_col(offset).cast("long"), lambda o: bind(_col(size).cast("long"), lambda n: cut(d, o, n))))


def remainder(data: Column, offset) -> Column:
    return bind(data, lambda d: bind(_col(offset), lambda o: F.when((o >= 0) & (o <= F.length(d)), F.substring(d, (o + 1).cast("int"), F.length(d)))))


def _digits(data: Column, offset, size: int, big: Column | bool) -> Column:
    """Hexadecimal digits of a number, most significant first."""
    text = F.hex(bytes_(data, offset, size))
    if size == 1 or big is True:
        return text

    def order(t: Column) -> Column:
        little = F.concat(*(F.substring(t, 2 * i + 1, 2) for i in reversed(range(size))))
        return little if big is False else F.when(big, t).otherwise(little)

    return F.get(F.transform(F.array(text), order), F.lit(0))


def uint(data: Column, offset, size: int, big: Column | bool = False) -> Column:
    """Unsigned integer of ``size`` bytes: INT up to 2, BIGINT up to 4, else DECIMAL(20,0)."""
    kind = "int" if size <= 2 else "bigint" if size <= 7 else DEC
    return F.conv(_digits(data, offset, size, big), 16, 10).cast(kind)


def sint(data: Column, offset, size: int, big: Column | bool = False) -> Column:
    """Two's complement: INT up to 4 bytes, else BIGINT."""
    if size == 8:
        return F.conv(_digits(data, offset, 8, big), 16, -10).cast("bigint")
    half = 1 << (8 * size - 1)
    return bind(uint(data, offset, size, big).cast("bigint"), lambda v: F.when(v >= half, v - 2 * half).otherwise(v)).cast("int")


def _ieee(data: Column, offset, size: int, big: Column | bool, exponent: int, bias: int) -> Column:
    return bind(F.conv(_digits(data, offset, size, big), 16, -10).cast("bigint"), lambda raw: _of_bits(raw, size, exponent, bias))


def _of_bits(raw: Column, size: int, exponent: int, bias: int) -> Column:
    width = 8 * size - 1 - exponent
    mantissa = raw.bitwiseAND(F.lit((1 << width) - 1)).cast("double")
    power = F.shiftrightunsigned(raw, width).bitwiseAND(F.lit((1 << exponent) - 1))
    sign = F.when(F.shiftrightunsigned(raw, 8 * size - 1).bitwiseAND(F.lit(1)) == 1, F.lit(-1.0)).otherwise(F.lit(1.0))

    def scaled(x: Column, e: Column) -> Column:  # in two steps, so that neither power leaves the range of a double
        half = F.floor(e / 2)
        return x * F.pow(F.lit(2.0), half.cast("double")) * F.pow(F.lit(2.0), (e - half).cast("double"))

    normal = scaled(F.lit(float(1 << width)) + mantissa, power - bias - width)
    small = scaled(mantissa, F.lit(1 - bias - width))
    special = F.when(mantissa == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return sign * F.when(power == (1 << exponent) - 1, special).when(power == 0, small).otherwise(normal)


def float32(data: Column, offset, big: Column | bool = False) -> Column:
    return _ieee(data, offset, 4, big, 8, 127).cast("float")


def float64(data: Column, offset, big: Column | bool = False) -> Column:
    return _ieee(data, offset, 8, big, 11, 1023)


def fixed_string(data: Column, offset, size, charset: str = "UTF-8", zero_ends: bool = True) -> Column:
    """Text of a fixed number of bytes, up to its first NUL unless told otherwise."""
    text = F.decode(bytes_(data, offset, size), charset)
    return F.substring_index(text, "\x00", 1) if zero_ends else text


def nul_string(data: Column, offset, stop: str = "\x00", charset: str = "UTF-8") -> Column:
    """Text up to the next NUL (or other ASCII ``stop``) or the end; the search is by byte, not by character.

    A name is looked for in the next 128 bytes and only then in all the rest, so that the names of a heap cost time in
    proportion to their own lengths.
    """

    def cut(d: Column, o: Column) -> Column:
        def upto(most: int, otherwise: Callable[[], Column]) -> Column:
            part = F.substring(d, (o + 1).cast("int"), F.lit(most))
            return bind(part, lambda x: bind(F.instr(F.decode(x, "ISO-8859-1"), stop), lambda k: F.when(k > 0, F.substring(x, F.lit(1), k - 1)).when(o + most >= F.length(d), x).otherwise(otherwise())))

        text = upto(128, lambda: upto(2**31 - 1, lambda: F.lit(None).cast("binary")))
        return F.decode(F.when((o >= 0) & (o <= F.length(d)), text), charset)

    return bind(data, lambda d: bind(_col(offset).cast("bigint"), lambda o: cut(d, o)))


def prefixed_string(data: Column, offset, prefix: int = 1, charset: str = "UTF-8", unit: int = 1) -> Column:
    """Struct (value, size): a count of units of ``unit`` bytes, then the text; size is all bytes."""
    n = uint(data, offset, prefix).cast("bigint") * unit
    return F.struct(F.decode(bytes_(data, _col(offset) + prefix, n), charset).alias("value"), (n + prefix).alias("size"))


def ascii_int(text: Column, radix: int = 10) -> Column:
    """A number written in ASCII, blanks around it allowed; null if empty."""
    digits = F.trim(text)
    return F.when(digits != "", F.conv(digits, radix, 10)).cast("bigint")


def align(offset, size: int) -> Column:
    offset = _col(offset)
    return offset + F.pmod(-offset, F.lit(size))


def bits(value: Column, low: int, width: int) -> Column:
    """A packed field, counted from the lowest bit."""
    return F.shiftrightunsigned(value.cast("bigint"), low).bitwiseAND(F.lit((1 << width) - 1))


def masked(value: Column, mask: int) -> Column:
    """Flag as boolean for a one-bit mask, else the field that the mask selects."""
    low = (mask & -mask).bit_length() - 1
    field = F.shiftrightunsigned(value.cast("bigint").bitwiseAND(F.lit(mask)), low)
    return field == 1 if mask == mask & -mask else field


def flags(value: Column, domain: dict[str, int]) -> Column:
    """Struct with a field per flag of the domain."""
    return F.struct(*(masked(value, mask).alias(name) for name, mask in domain.items()))


def flag_names(value: Column, domain: dict[str, int]) -> Column:
    """Names of the one-bit flags that are set, in the domain's order."""
    one = [F.when(value.cast("bigint").bitwiseAND(F.lit(m)) != 0, F.lit(n)) for n, m in domain.items() if m == m & -m]
    return F.array_compact(F.array(*one))


def bit_list(value: Column) -> Column:
    """Positions of set bits of a BIGINT view of 64 bits, ascending."""
    return F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftrightunsigned", value, i).bitwiseAND(F.lit(1).cast("bigint")) == 1)


def version(value: Column) -> Column:
    """Struct (major, minor, patch) of a packed 16.8.8 version."""
    return F.struct(bits(value, 16, 16).alias("major"), bits(value, 8, 8).alias("minor"), bits(value, 0, 8).alias("patch"))


def guid(data: Column, offset=0, little: bool = False) -> Column:
    """Text of 16 bytes: in storage order, or with the first three groups little-endian as the format has them."""
    h = F.lower(F.hex(bytes_(data, offset, 16)))
    part = lambda *pairs: F.concat(*(F.substring(h, 2 * p + 1, 2) for p in pairs))
    heads = [(3, 2, 1, 0), (5, 4), (7, 6)] if little else [(0, 1, 2, 3), (4, 5), (6, 7)]
    return F.concat_ws("-", *(part(*p) for p in [*heads, (8, 9), tuple(range(10, 16))]))


def timestamp(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def hexed(value: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.conv(value.cast("string"), 10, 16)))


def _byte_list(data: Column) -> Column:
    """The bytes as an array of BIGINT."""
    pairs = F.regexp_extract_all(F.hex(data), F.lit("(..)"), 1)
    return F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("bigint"))


def uleb128_list(data: Column) -> Column:
    """All varints of the bytes, seven bits each from the lowest; an unfinished last one is left out, as are bits from the 64th on."""
    start = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("bigint").alias("value"), F.lit(0).alias("shift"))

    def step(acc: Column, byte: Column) -> Column:
        low = byte.bitwiseAND(F.lit(127).cast("bigint"))
        value = F.when(acc["shift"] < 64, acc["value"].bitwiseOR(F.call_function("shiftleft", low, F.least(acc["shift"], F.lit(63))))).otherwise(acc["value"])
        more = byte >= 128
        return F.struct(
            F.when(more, acc["out"]).otherwise(F.concat(acc["out"], F.array(value))).alias("out"),
            F.when(more, value).otherwise(F.lit(0).cast("bigint")).alias("value"),
            F.when(more, acc["shift"] + 7).otherwise(F.lit(0)).alias("shift"),
        )

    return F.aggregate(_byte_list(data), start, step, lambda acc: acc["out"])


def compressed_int(data: Column, offset=0) -> Column:
    """Struct (value, size): 1, 2 or 4 bytes, most significant first, tagged by the top bits; null for another tag."""
    first = uint(data, offset, 1)
    value = (
        F.when(first < 0x80, first.cast("bigint"))
        .when(first < 0xC0, bits(uint(data, offset, 2, True), 0, 14))
        .when(first < 0xE0, bits(uint(data, offset, 4, True), 0, 29))
    )
    size = F.when(first < 0x80, 1).when(first < 0xC0, 2).when(first < 0xE0, 4)
    return F.struct(value.alias("value"), size.alias("size"))


def signed_low_bit(value: Column) -> Column:
    """A signed number whose sign is in the lowest bit."""
    half = F.shiftright(value.cast("bigint"), 1)
    return F.when(bits(value, 0, 1) == 1, -half).otherwise(half)


def decimal96(data: Column, offset) -> Column:
    """Struct (negative, scale, unscaled, value): reserved u16, scale, sign, high 32 and low 64 bits; value is null for a scale over 9."""
    offset = _col(offset)
    scale, sign = uint(data, offset + 2, 1), uint(data, offset + 3, 1)
    size = uint(data, offset + 4, 4).cast("decimal(38,0)") * F.lit(str(2**64)).cast("decimal(20,0)") + uint(data, offset + 8, 8)
    size = F.when(sign >= 0x80, -size).otherwise(size).cast("decimal(30,0)")
    powers = F.coalesce(*(F.when(scale == s, (size.cast("decimal(38,8)") if s == 0 else size.cast("double") / F.lit(float(10**s))).cast("double")) for s in range(10)))
    return F.struct((sign >= 0x80).alias("negative"), scale.alias("scale"), size.alias("unscaled"), powers.alias("value"))


def codec(name: str) -> tuple[int, Codec]:
    """Width and reader of a codec by name: u8 u16 u32 u64, i8 i16 i32 i64, f32 f64 with the record's byte order
    (or be / le behind the name), sN text of N bytes, zN text of N bytes whole, wN UTF-16LE of N bytes, bN bytes."""
    kind, rest = name[0], name[1:]
    if kind in "uif":
        order = {"be": True, "le": False}.get(rest[-2:])
        size = int(rest[:-2] if order is not None else rest) // 8
        read = {"u": uint, "i": sint}.get(kind) or (lambda d, o, _s, b: float32(d, o, b) if size == 4 else float64(d, o, b))
        return size, lambda d, o, b: read(d, o, size, b if order is None else order)
    size = int(rest)
    if kind == "b":
        return size, lambda d, o, _b: bytes_(d, o, size)
    if kind in "szw":
        return size, lambda d, o, _b: fixed_string(d, o, size, "UTF-16LE" if kind == "w" else "UTF-8", kind == "s")
    raise ValueError(f"no codec {name!r}")
