import struct

import pytest
from pyspark.sql import functions as F

from bytequarry.functions import codecs as C
from bytequarry.functions.layouts import Layout, records

EDGES = {n: sorted({0, 1, 127, 128, 2 ** (8 * n - 1) - 1, 2 ** (8 * n - 1), 2 ** (8 * n) - 1, 0xC3A9 % 2 ** (8 * n)}) for n in (1, 2, 4, 8)}


def one(spark, data, **cols):
    return spark.createDataFrame([(data,)], "b binary").select(*(c.alias(n) for n, c in cols.items())).first()


@pytest.mark.parametrize("size", [1, 2, 4, 8])
@pytest.mark.parametrize("big", [False, True])
def test_integers(spark, size, big):
    letter, order = {1: "B", 2: "H", 4: "I", 8: "Q"}[size], ">" if big else "<"
    data = b"\xff" + b"".join(struct.pack(order + letter, v) for v in EDGES[size])
    b = F.col("b")
    got = one(spark, data, **{f"u{i}": C.uint(b, 1 + i * size, size, big) for i in range(len(EDGES[size]))}, **{f"s{i}": C.sint(b, F.lit(1 + i * size), size, F.lit(big)) for i in range(len(EDGES[size]))}, past=C.uint(b, len(data) - size + 1, size))
    signed = struct.unpack(f"{order}{len(EDGES[size])}{letter.lower()}", data[1:])
    for i, v in enumerate(EDGES[size]):
        assert int(got[f"u{i}"]) == v and got[f"s{i}"] == signed[i]
    assert got["past"] is None


def test_floats(spark):
    for order, big in (("<", False), (">", True)):
        for v in (0.0, 1.5, -2.25, 3.141592653589793, 1e300, -5e-324, 1.7976931348623157e308, float("inf"), 901.0, 1 / 3):
            got = one(spark, struct.pack(order + "d", v), d=C.float64(F.col("b"), 0, big))
            assert got["d"] == v
        for v in (0.0, -1.25, 1e-40, 3.0e38, float("-inf")):
            got = one(spark, struct.pack(order + "f", v), d=C.float32(F.col("b"), 0, big))
            assert got["d"] == struct.unpack("<f", struct.pack("<f", v))[0]


def test_text(spark):
    b, data = F.col("b"), "é\x01".encode() + b"\x00tail\x00" + "ab".encode("utf-16le") + b"\x03xyz" + b" 644  /"
    got = one(spark, data, nul=C.nul_string(b, 0), second=C.nul_string(b, 4), end=C.nul_string(b, len(data) - 1), wide=C.fixed_string(b, 9, 4, "UTF-16LE"), pre=C.prefixed_string(b, 13), octal=C.ascii_int(C.fixed_string(b, 17, 6), 8), none=C.nul_string(b, 99), slash=C.nul_string(b, 18, "/"))
    assert (got.nul, got.second, got.end, got.wide, got.pre.value, got.pre.size, got.octal, got.none, got.slash) == ("é\x01", "tail", "/", "ab", "xyz", 4, 420, None, "644  ")


def test_bits_and_more(spark):
    b = F.col("b")
    data = bytes.fromhex("00112233445566778899aabbccddeeff") + b"\x05\x80\x01\x85\x83\x00\xff" + b"\x85\x39" + b"\xc0\x00\x40\x00"
    got = one(
        spark, data, raw=C.guid(b), le=C.guid(b, 0, True), leb=C.uleb128_list(C.bytes_(b, 16, 7)), two=C.compressed_int(b, 23), four=C.compressed_int(b, 25), bad=C.compressed_int(b, 15),
        bits=C.bit_list(F.lit(-1).cast("bigint")), some=C.bit_list(F.lit(37).cast("bigint")), field=C.bits(F.lit(0xABCD), 4, 8), version=C.version(F.lit(0x000A0F0E)), up=C.align(F.lit(13), 8), same=C.align(F.lit(16), 8),
        flags=C.flags(F.lit(0x00500025), {"A": 1, "B": 2, "C": 4, "ALIGN": 0x00F00000}), names=C.flag_names(F.lit(5), {"A": 1, "B": 2, "C": 4}), neg=C.signed_low_bit(F.lit(7)), pos=C.signed_low_bit(F.lit(6)), hex=C.hexed(F.lit(255)), when=C.timestamp(F.lit(86400)),
    )
    assert got.raw == "00112233-4455-6677-8899-aabbccddeeff" and got.le == "33221100-5544-7766-8899-aabbccddeeff"
    assert got.leb == [5, 128, 389] and tuple(got.two) == (0x539, 2) and tuple(got.four) == (0x4000, 4) and tuple(got.bad) == (None, None)
    assert got.bits == list(range(64)) and got.some == [0, 2, 5] and got.field == 0xBC and tuple(got.version) == (10, 15, 14)
    assert (got.up, got.same, got.neg, got.pos, got.hex) == (16, 16, -3, 3, "0xff")
    assert got.flags.asDict() == {"A": True, "B": False, "C": True, "ALIGN": 5} and got.names == ["A", "C"]


def test_decimal96(spark):
    got = one(spark, struct.pack("<HBBIQ", 0, 2, 0x80, 1, 5), d=C.decimal96(F.col("b"), 0))
    assert got.d.negative and got.d.scale == 2 and int(got.d.unscaled) == -(2**64 + 5)


def test_layouts_and_records(spark):
    layout = Layout("a:u8 _pad:b1 b:2*u16 c:i32be name:s4")
    assert layout.size == 14
    rows = [(1, 2, 3, -4, b"ab\0\0"), (5, 6, 7, 8, b"wxyz")]
    data = b"##" + b"".join(struct.pack("<BxHH", a, x, y) + struct.pack(">i", c) + n for a, x, y, c, n in rows) + b"!"
    d = F.col("b")
    got = one(spark, data, r=records(d, F.lit(2), F.lit(1 << 40), layout.size, lambda t, o, i: F.struct(i.alias("pos"), layout.struct(t, o).alias("v"))), none=records(d, F.lit(99), F.lit(3), 14, lambda t, o, i: i), null=records(d, F.lit(None), F.lit(3), 14, lambda t, o, i: i))
    assert [(x.pos, x.v.a, x.v.b, x.v.c, x.v.name) for x in got.r] == [(0, 1, [2, 3], -4, "ab"), (1, 5, [6, 7], 8, "wxyz")]
    assert got.none == [] and got.null == []


def test_records_of_a_large_table(spark):
    n = 10_000_003
    table = spark.createDataFrame([(b"\x07" * (2 * n - 2) + b"\x2a\x01",)], "b binary").select(records(F.col("b"), F.lit(0), F.lit(1 << 40), 2, lambda t, o, i: i).alias("r"))
    assert tuple(table.select(F.size("r"), F.element_at("r", -1)).first()) == (n, n - 1)
