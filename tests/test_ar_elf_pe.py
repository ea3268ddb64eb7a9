import os
import struct

import pytest
from fixtures_images import ar, ar_header, elf, pe

from bytequarry.operators import elf as E
from bytequarry.operators import pe as P
from bytequarry.operators.ar import ar_members, ar_symbols
from bytequarry.sources.images import sniff


def table(spark, **images):
    return spark.createDataFrame([(k, bytearray(v) if v is not None else None, 1) for k, v in images.items()], "image_id string, content binary, pos int")


def test_ar(spark):
    syms = struct.pack(">III", 2, 100, 200) + b"foo\0b\xc3\xa9\0"
    ms = struct.pack("<III", 1, 8, 2) + struct.pack("<HH", 1, 1) + b"m1\0m2\0"
    sym64 = struct.pack(">QQ", 1, 1 << 33) + b"wide\0"
    image = ar([("/", syms), ("/", ms), ("short.o/", b"abc"), ("/0", b"LL"), ("/14", b""), ("/SYM64/", sym64), ("noslash", b"x")], b"very_long.o/\n/another/\n")
    short = b"!<arch>\n" + ar_header("cut.o/", 50) + b"only"
    df = table(spark, a=image, cut=short, bad=b"!<arch>\n" + b"x" * 60, none=None, empty=b"", one=b"!", text=b"no archive at all")
    got = sorted((r.image_id, r.pos, r.name, r.mode, r.size, bytes(r.contents)) for r in ar_members(df).collect() if r.image_id != "bad")
    assert [(g[2], g[5]) for g in got if g[0] == "a"] == [("Symbols", syms), ("Symbols2", ms), ("short.o", b"abc"), ("very_long.o", b"LL"), ("another"[:0] + "another", b""), ("/SYM64", sym64), ("noslash", b"x")]
    assert got[-1] == ("cut", 0, "cut.o", 420, 50, b"only") and got[2][3] == 420
    assert sorted(tuple(r)[1:] for r in ar_symbols(df).collect()) == [("/SYM64", 0, "wide", 1 << 33), ("Symbols", 0, "foo", 100), ("Symbols", 1, "bé", 200), ("Symbols2", 0, "m1", 1), ("Symbols2", 1, "m2", 1)]


@pytest.mark.parametrize("bits", [32, 64])
@pytest.mark.parametrize("big", [False, True])
def test_elf(spark, bits, big):
    machine = 3 if bits == 32 else 62
    df = table(spark, e=elf(bits, big, machine=machine), bare=elf(bits, big, sections=False), cut=elf(bits, big)[:70], magic=b"\x7fELF", other=b"MZ", none=None)
    h = {r.image_id: r for r in E.elf_header(df).collect()}
    assert set(h) == {"e", "bare", "cut", "magic"} and h["e"].e_machine_name == ("386" if bits == 32 else "AMD64") and h["e"].file_class == f"CLASS{bits}" and h["e"].e_type_name == "EXEC"
    assert [(r.pos, r.name, r.sh_type_name) for r in sorted(E.elf_sections(df).where("image_id = 'e'").collect())] == [(0, "", "NULL"), (1, ".text", "PROGBITS"), (2, ".symtab", "SYMTAB"), (3, ".strtab", "STRTAB"), (4, ".shstrtab", "STRTAB"), (5, ".rel", "REL"), (6, ".bss", "NOBITS")]
    data = {r.name: bytes(r.data) for r in E.elf_sections(df, True).where("image_id = 'e'").collect() if r.name}
    assert data[".text"] == bytes(range(16)) and data[".bss"] == b""
    seg = sorted(E.elf_segments(df, True).where("image_id = 'e'").collect())
    assert [(s.p_type_name, s.r, s.w, s.x) for s in seg] == [("LOAD", True, False, True), ("DYNAMIC", True, True, False)] and bytes(seg[0].data) == bytes(range(16)) and seg[0].label.startswith("LOAD @ 0x")
    sym = sorted(E.elf_symbols(df, with_data=True).collect(), key=lambda r: r.pos)
    assert [(s.name, int(s.value), int(s.size), s.type, s.binding, s.visibility, s.shndx, s.executable) for s in sym] == [("main", 0x401000, 4, "FUNC", "GLOBAL", "HIDDEN", 1, True), ("data", 0x401004, 2, "OBJECT", "GLOBAL", "HIDDEN", 1, False), ("undef", 0, 0, "NOTYPE", "GLOBAL", "HIDDEN", 0, False)]
    assert bytes(sym[0].data) == bytes(range(4)) and bytes(sym[1].data) == b"\x04\x05" and sym[2].data is None
    assert [(r.pos, r.tag_name, int(r.value)) for r in sorted(E.elf_dynamic(df).where("image_id = 'e'").collect())] == [(0, "DT_NEEDED", 7), (1, "DT_NULL", 0)]
    rel = E.elf_relocations(df, False).collect()
    assert [(int(r.offset), r.symbol, r.type, r.type_name) for r in rel] == [(0x401002, 2, 1, "R_386_32" if bits == 32 else "R_AMD64_64")]
    assert E.elf_symbols(df, dynamic=True).collect() == [] and E.elf_relocations(df, True).collect() == []


def test_real_elf(spark):
    path = next(p for p in ("/usr/bin/ls", "/bin/ls", "/usr/bin/env") if os.path.exists(p))
    data = open(path, "rb").read()
    shoff, = struct.unpack_from("<Q", data, 40)
    shnum, shstr = struct.unpack_from("<HH", data, 60)
    sh = [struct.unpack_from("<IIQQQQIIQQ", data, shoff + 64 * i) for i in range(shnum)]
    text = lambda base, at: data[base + at : data.index(b"\0", base + at)].decode()
    df = table(spark, e=data)
    assert [r["name"] for r in sorted(E.elf_sections(df).collect(), key=lambda r: r.pos)] == [text(sh[shstr][4], s[0]) for s in sh]
    dyn = next(s for s in sh if s[1] == 11)
    want = []
    for i in range(dyn[5] // 24):
        name, info, other, ndx, value, size = struct.unpack_from("<IBBHQQ", data, dyn[4] + 24 * i)
        if name:
            want.append((i, text(sh[dyn[6]][4], name), value, size, ndx))
    assert [(r.pos, r.name, int(r.value), int(r["size"]), r.shndx) for r in sorted(E.elf_symbols(df, dynamic=True).collect(), key=lambda r: r.pos)] == want
    rela = [struct.unpack_from("<QQq", data, s[4] + 24 * i) for s in sh if s[1] == 4 for i in range(s[5] // 24)]
    assert sorted((int(r.offset), r.symbol << 32 | r.type, r.addend) for r in E.elf_relocations(df, True).collect()) == sorted(rela)


@pytest.mark.parametrize("bits", [32, 64])
def test_pe(spark, bits):
    image, base, data = pe(bits)
    df = table(spark, p=image, stub=b"MZ" + bytes(100), cut=image[:300], mz=b"MZ", none=None)
    h = {r.image_id: r for r in P.pe_header(df).collect()}
    assert h["p"].is_pe and not h["stub"].is_pe and h["p"].magic_name == f"NT{bits}" and h["p"].machine_name == ("AMD64" if bits == 64 else "I386") and h["p"].dll_flag_names == ["DYNAMIC_BASE", "NX_COMPAT", "TERMINAL_SERVER_AWARE"]
    assert int(h["p"].opt.ImageBase) == (0x140000000 if bits == 64 else 0x400000) and h["p"].opt.NumberOfDirectories == 16
    s, = P.pe_sections(df, True).where("image_id = 'p'").collect()
    assert (s.Name, s.r, s.w, s.x, s.ALIGN) == (".text", True, False, True, 5) and bytes(s.data)[: len(data)] == data
    d = sorted(P.pe_directories(df).where("Size > 0 and image_id = 'p'").collect())
    assert [(r.pos, r["name"]) for r in d] == [(0, "EXPORT"), (1, "IMPORT"), (2, "RESOURCE")]
    end = s.VirtualAddress + s.SizeOfRawData
    e = sorted(P.pe_exports(df).collect(), key=lambda r: r.pos)
    assert [(r.dll, r.ordinal, r.name, r.address, r["size"]) for r in e] == [("me.dll", 10, "beta", 0x1010, end - 0x1010), ("me.dll", 11, "alpha", 0x1000, 16), ("me.dll", 12, "gamma", 0x1010, end - 0x1010)]
    assert {r.name: bytes(r.data) for r in P.pe_exports(df, with_data=True).collect()} == {"beta": data[16:].ljust(end - 0x1010, b"\0"), "alpha": data[:16], "gamma": data[16:].ljust(end - 0x1010, b"\0")}
    c = sorted(P.pe_exports(df, pair_by_position=True).collect(), key=lambda r: r.pos)
    assert [(r.ordinal, r.name, r.address) for r in c] == [(11, "alpha", 0x1010), (10, "beta", 0x1000), (12, "gamma", 0x1010)]
    i = sorted(P.pe_imports(df).collect())
    assert [(r.dll, r.pos, r.name, r.hint, r.ordinal) for r in i] == [("a.dll", 0, "f1", 3, None), ("a.dll", 1, "ordinal_7", None, 7), ("a.dll", 2, "f2", 3, None), ("b.dll", 0, "g", 3, None)]
    r, = P.pe_resources(df).collect()
    assert (r.path, r.type_id, r.type_name, r.codepage, bytes(r.data)) == (["MANIFEST", "13"], 24, "MANIFEST", 1252, b"<manifest/>")
    assert P.read_directory(df, "TLS").collect() == [] and P.read_directory(df, "IMPORT").count() == 4


def test_hostile_resources():
    """Directories that point to themselves or to each other, ever deeper, end; each is entered once."""
    from time import perf_counter

    from bytequarry.operators.walks import _leaves

    head = lambda n: struct.pack("<IIHHHH", 0, 0, 0, 0, 0, n)
    own = head(6) + b"".join(struct.pack("<II", i, 0x80000000) for i in range(6))
    chain = b"".join(head(2) + struct.pack("<IIII", 1, 0x80000000 + 32 * (i + 1), 2, 0x80000000 + 32 * (i + 1)) for i in range(2000))
    leaf = head(1) + struct.pack("<II", 7, 24) + struct.pack("<IIII", 0x1000, 5, 0, 0)
    start = perf_counter()
    assert _leaves(own) == [] and _leaves(chain) == [] and _leaves(b"") == [] and _leaves(None) == []
    assert _leaves(leaf) == [{"path": ["7"], "type_id": 7, "offset": 0x1000, "size": 5, "codepage": 0}]
    assert perf_counter() - start < 5


def test_coff(spark):
    sec = struct.pack("<8sIIIIIIHHI", b".data", 0, 0, 4, 68, 0, 0, 0, 0, 0xC0000040)
    obj = struct.pack("<HHIIIHH", 0x8664, 1, 0, 0, 0, 8, 0) + bytes(8) + sec + b"DATA"
    imp = struct.pack("<HHHHIIHH", 0, 0xFFFF, 0, 0x8664, 9, 10, 4, 1) + b"sym\0lib.dll\0"
    df = table(spark, o=obj, i=imp, n=None, t=b"\x64")
    s, = P.coff_sections(df, True).where("image_id = 'o'").collect()
    assert (s.Name, s.w, bytes(s.data)) == (".data", True, b"DATA")
    m, = P.coff_import_symbols(df).collect()
    assert (m.Symbol, m.Module, m.Value, m.architecture_name) == ("sym", "lib.dll", 4, "AMD64")


def test_sniff(spark):
    df = table(spark, ar=b"!<arch>\n", elf=b"\x7fELF", pe=b"MZ", mach=bytes.fromhex("cffaedfe"), fat_mach=bytes.fromhex("cafebabe"), cfb=bytes.fromhex("d0cf11e0a1b11ae1"), clr=b"BSJB", coff=struct.pack("<H", 0x14C) + bytes(18), coff_import=struct.pack("<HHHH", 0, 0xFFFF, 0, 0x14C), x=b"zz", y=b"", z=None)
    assert {r.image_id: r.format for r in sniff(df).collect()} == {k: k if len(k) > 1 else None for k in ("ar", "elf", "pe", "mach", "fat_mach", "cfb", "clr", "coff", "coff_import", "x", "y", "z")}
