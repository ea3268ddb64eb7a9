"""CLR metadata packed with struct from the published format."""

import struct
import uuid

import pytest

from bytequarry.operators import clr as C
from bytequarry.operators.pe import read_directory

GUID = uuid.UUID("00112233-4455-6677-8899-aabbccddeeff")


def pe_with(body: bytes, directories: dict[int, tuple[int, int]]) -> bytes:
    """A 64-bit image of one section at RVA 0x1000, file offset 0x200."""
    opt = struct.pack("<HBBIIIII", 0x20B, 14, 0, 1, 2, 3, 0x1000, 0x1000) + struct.pack("<Q", 1 << 32) + struct.pack("<IIHHHHHHIIIIHH", 0x1000, 0x200, 6, 0, 0, 0, 6, 0, 0, 0x3000, 0x200, 0, 3, 0) + struct.pack("<QQQQII", 1, 2, 3, 4, 0, 16)
    opt += b"".join(struct.pack("<II", *directories.get(i, (0, 0))) for i in range(16))
    head = b"MZ".ljust(60, b"\0") + struct.pack("<I", 64) + b"PE\0\0" + struct.pack("<HHIIIHH", 0x8664, 1, 0, 0, 0, len(opt), 0x22) + opt
    head += struct.pack("<8sIIIIIIHHI", b".text", len(body), 0x1000, len(body), 0x200, 0, 0, 0, 0, 0x60000020)
    return head.ljust(0x200, b"\0") + body


def u7(n: int) -> bytes:
    return bytes([n & 0x7F | 0x80]) + u7(n >> 7) if n > 127 else bytes([n])


def resources(entries: list[tuple[str, bytes]]) -> bytes:
    head = struct.pack("<III", 0xBEEFCACE, 1, 0) + u7(6) + b"Reader" + u7(3) + b"Set" + struct.pack("<II", 1, len(entries)) + struct.pack("<I", 1) + u7(4) + b"type"
    head += bytes(-len(head) % 8) + bytes(8 * len(entries))
    names, at = b"", 0
    for name, value in entries:
        text = name.encode("utf-16le")
        names += u7(len(text)) + text + struct.pack("<I", at)
        at += len(value)
    return head + struct.pack("<I", len(head) + 4 + len(names)) + names + b"".join(v for _, v in entries)


def image(fields: int = 3, wide: int = 0) -> bytes:
    """Module, TypeRef, two TypeDefs, ``fields`` Fields, a MemberRef, a CustomAttribute, three ManifestResources; ``wide``: heap bits."""
    strings = b"\0mod\0A\0B\xc3\xa9\0ns\0fld\0blk\0other\0ext\0"
    at = lambda s: strings.index(b"\0" + s + b"\0") + 1
    blob = b"\0\x03abc\x80\x81" + bytes(129)
    index = lambda n, bit: struct.pack("<I" if wide & bit else "<H", n)
    s, g, b = (lambda n, bit=bit: index(n, bit) for bit in (1, 2, 4))
    row = lambda n, count, tag=0: struct.pack("<I" if count > 0xFFFF >> tag else "<H", n)
    tables = {0: struct.pack("<H", 7) + s(at(b"mod")) + g(1) + g(0) + g(0)}
    tables[1] = row(0, 2, 2) + s(at(b"A")) + s(at(b"ns"))
    tables[2] = struct.pack("<I", 1) + s(at(b"A")) + s(at(b"ns")) + row(1 << 2 | 1, 2, 2) + row(1, fields) + row(1, 0)
    tables[2] += struct.pack("<I", 2) + s(at(b"B\xc3\xa9")) + s(0) + row(1 << 2, 2, 2) + row(3, fields) + row(1, 0)
    tables[4] = b"".join(struct.pack("<H", i % 65536) + s(at(b"fld")) + b(1) for i in range(fields))
    tables[10] = row(1 << 3 | 1, 2, 3) + s(at(b"fld")) + b(5)
    tables[12] = row(2 << 5 | 1, fields, 5) + row(1 << 3 | 3, 1, 3) + b(0)
    first, second = resources([("x", b"\x01\x03one"), ("ü" * 70, b"\x20raw!"), ("z", b"\x01\x01q")]), resources([("x", b"\x01\x03two")])
    pack = lambda d: struct.pack("<I", len(d)) + d
    res = pack(first) + pack(second) + pack(b"none")
    tables[40] = b"".join(struct.pack("<II", o, 1) + s(at(n)) + row(i, 0, 2) for o, n, i in ((0, b"blk", 0), (len(pack(first)), b"other", 0), (len(pack(first) + pack(second)), b"mod", 0), (0, b"ext", 1 << 2)))
    counts = {0: 1, 1: 1, 2: 2, 4: fields, 10: 1, 12: 1, 40: 4}
    stream = struct.pack("<IBBBBQQ", 0, 2, 0, wide, 1, sum(1 << i for i in tables), 0) + b"".join(struct.pack("<I", counts[i]) for i in sorted(tables)) + b"".join(tables[i] for i in sorted(tables))
    parts = [("#~", stream), ("#Strings", strings), ("#GUID", GUID.bytes_le), ("#Blob", blob), ("#US", b"\0")]
    version = b"v4.0.30319\0\0"
    heads = b"".join(bytes(8) + n.encode().ljust(len(n) // 4 * 4 + 4, b"\0") for n, _ in parts)
    start, out, body = 16 + len(version) + 4 + len(heads), b"", b""
    for n, d in parts:
        out += struct.pack("<II", start + len(body), len(d)) + n.encode().ljust(len(n) // 4 * 4 + 4, b"\0")
        body += d + bytes(-len(d) % 4)
    root = b"BSJB" + struct.pack("<HHII", 1, 1, 0, len(version)) + version + struct.pack("<HH", 0, len(parts)) + out + body
    header = struct.pack("<IHHIIII", 72, 2, 5, 0x1048, len(root), 9, 0x06000001) + struct.pack("<II", 0x1048 + len(root), len(res)) + bytes(40)
    return pe_with(header + root + res, {14: (0x1000, 72)})


@pytest.fixture(scope="module")
def df(spark):
    good = image()
    rows = [("a", good), ("w", image(wide=7)), ("cut", good[: len(good) // 2]), ("bad", good.replace(b"BSJB", b"XXXX")), ("plain", pe_with(b"zz", {})), ("mz", b"MZ"), ("n", None)]
    return spark.createDataFrame([(k, None if b is None else bytearray(b), 1) for k, b in rows], "image_id string, content binary, row int")


def test_header_and_streams(df):
    h = {r.image_id: r for r in C.clr_header(df).collect()}
    assert set(h) >= {"a", "w", "bad"} and "plain" not in h and h["a"].cb == 72 and h["a"].flag_names == ["FLAGS_ILONLY", "FLAGS_STRONGNAMESIGNED"]
    s = sorted(C.clr_streams(df).where("image_id in ('a', 'bad')").collect(), key=lambda r: r.pos)
    assert [r["name"] for r in s] == ["#~", "#Strings", "#GUID", "#Blob", "#US"] and {r.version for r in s} == {"v4.0.30319"} and {r.image_id for r in s} == {"a"}
    assert {r.image_id for r in read_directory(df, "CLR_DESCRIPTOR").collect()} == set(h)
    t = sorted(C.clr_table_info(df).where("image_id = 'a'").collect(), key=lambda r: r.table_id)
    assert [(r.table, r.rows, r.row_size) for r in t] == [("Module", 1, 10), ("TypeRef", 1, 6), ("TypeDef", 2, 14), ("Field", 3, 6), ("MemberRef", 1, 6), ("CustomAttribute", 1, 6), ("ManifestResource", 4, 12)]
    assert [r.offset for r in t] == [52 + x for x in (0, 10, 16, 44, 62, 68, 74)]


@pytest.mark.parametrize("which", ["a", "w"])
def test_tables(df, which):
    get = lambda t: sorted(C.clr_table(df.where(f"image_id = '{which}'"), t).collect(), key=lambda r: r.row)
    m, = get("Module")
    assert (m.generation, m["name"], m.mvid, m.encid) == (7, "mod", str(GUID), None)
    t = get("TypeDef")
    assert [(r.row, r["name"], r.namespce, tuple(r.extends), r.fields, r.fields_end, r.methods, r.methods_end) for r in t] == [(1, "A", "ns", ("TypeRef", 1), 1, 3, 1, 1), (2, "Bé", "", ("TypeDef", 1), 3, 4, 1, 1)]
    assert [(r.flags, r["name"], bytes(r.signature)) for r in get("Field")] == [(i, "fld", b"abc") for i in range(3)]
    r, = get("MemberRef")
    assert tuple(r.clss) == ("TypeRef", 1) and bytes(r.signature) == bytes(129)
    c, = get("CustomAttribute")
    assert tuple(c.parent) == ("Field", 2) and tuple(c.type) == ("MemberRef", 1) and c.value is None
    assert get("GenericParam") == []


def test_wide_indexes(spark):
    """70,000 rows make the indexes to a table, and the coded ones that can mean it, four bytes wide."""
    df = spark.createDataFrame([("big", bytearray(image(70_000)))], "image_id string, content binary")
    sizes = {r.table: r.row_size for r in C.clr_table_info(df).collect()}
    assert sizes["TypeDef"] == 16 and sizes["CustomAttribute"] == 8 and sizes["MemberRef"] == 6
    assert [(r.fields, r.fields_end) for r in sorted(C.clr_table(df, "TypeDef").collect(), key=lambda r: r.row)] == [(1, 3), (3, 70_001)]
    assert C.clr_table(df, "Field").where("name = 'fld'").count() == 70_000


def test_resources(df):
    r = sorted(C.clr_resources(df.where("image_id = 'a'")).collect(), key=lambda r: (r.block_row, r.pos))
    assert [(x.block, x["name"], x.text, None if x.data is None else bytes(x.data)) for x in r] == [("blk", "x", "one", None), ("blk", "ü" * 70, None, b"\x20raw!"), ("blk", "z", "q", None), ("other", "x", "two", None)]
    a = sorted(C.clr_all_resources(df.where("image_id = 'a'")).collect(), key=lambda r: r["name"])
    assert [(x["name"], x.text) for x in a] == [("x", "two"), ("z", "q"), ("ü" * 70, None)]
    n = C.clr_named(df.where("image_id = 'a'"), "Field").collect()
    assert [(x["name"], x.flags) for x in n] == [("fld", 2)]
    with pytest.raises(ValueError):
        C.clr_named(df, "Constant")


def test_all_tables_have_a_layout(df):
    assert len(C.TABLES) == 38 and set(C.TABLES) == set(C.IDS) and len(C.CODED) == 13
