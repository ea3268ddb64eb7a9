import struct

import pytest
from fixtures_images import mach

from bytequarry.operators import mach as M


@pytest.mark.parametrize(("bits", "big"), [(64, False), (32, True)])
def test_mach(spark, bits, big):
    image = mach(bits, big)
    df = spark.createDataFrame([("m", bytearray(image)), ("cut", bytearray(image[:120])), ("x", bytearray(b"zz")), ("n", None)], "image_id string, content binary")
    h = {r.image_id: r for r in M.mach_header(df).collect()}
    assert set(h) == {"m", "cut"} and h["m"].filetype_name == "EXECUTE" and h["m"].cputype_name == ("X86_64" if bits == 64 else "X86") and h["m"].cpusubtype_name == ("I386_ALL" if bits == 64 else "X86_ALL") and h["m"].flag_names == ["NOUNDEFS", "DYLDLINK", "TWOLEVEL", "PIE"]
    df = df.where("image_id = 'm'")
    c = sorted(M.mach_commands(df).collect())
    assert [x.cmd_name for x in c] == ["SEGMENT_64" if bits == 64 else "SEGMENT", "LOAD_DYLIB", "UUID", "RPATH", "BUILD_VERSION", None, "SYMTAB", "FUNCTION_STARTS", "DATA_IN_CODE"]
    assert c[1].text == "/usr/lib/x.dylib" and c[3].text == "@loader" and c[2].uuid == "00010203-0405-0607-0809-0a0b0c0d0e0f" and tuple(c[1].version) == (1, 2, 3) and '"nsyms":2' in c[6].fields
    s, = M.mach_segments(df, True).collect()
    assert (s.segname, s.nsects, s.r, s.w, s.x, s.flag_names, len(s.data)) == ("__TEXT", 1, True, False, True, ["HIGHVM"], 64)
    t, = M.mach_sections(df).collect()
    assert (t.sectname, t.type, t.attributes, int(t.addr) - int(s.vmaddr)) == ("__text", "REGULAR", ["SOME_INSTRUCTIONS", "PURE_INSTRUCTIONS"], 16)
    y = sorted(M.mach_symbols(df).collect(), key=lambda r: r.pos)
    assert [(r["name"], r.type, r.external, r.sect, r.ref) for r in y] == [("_main", "SECT", True, 1, "DEFINED"), ("_puts", "UNDF", True, 0, "UNDEFINED_NON_LAZY")]
    assert [int(r.address) - int(s.vmaddr) for r in sorted(M.mach_function_starts(df).collect())] == [0x10, 0x215, 0x218]
    assert [(r.offset, r.length, r.kind) for r in M.mach_data_in_code(df).collect()] == [(8, 4, "JUMP_TABLE16")]
    b, = M.mach_build_tools(df).collect()
    assert (b.platform, tuple(b.minos), b.tool, tuple(b.version)) == ("MACOS", (11, 0, 0), "LD", (512, 0, 0))
    assert [(r["name"], r.kind) for r in M.mach_dylibs(df).collect()] == [("/usr/lib/x.dylib", "LOAD_DYLIB")]


@pytest.mark.parametrize("big", [True, False])
def test_fat(spark, big):
    thin, o = mach(64), ">" if big else "<"
    fat = struct.pack(o + "II", 0xCAFEBABE, 2) + struct.pack(o + "IIIII", 0x01000007, 3, 64, len(thin), 4) + struct.pack(o + "IIIII", 0x0100000C, 2, 64, len(thin), 4)
    df = spark.createDataFrame([("f", bytearray(fat.ljust(64, b"\0") + thin)), ("n", None)], "image_id string, content binary")
    assert [(r.arch_pos, r.cputype_name, r.cpusubtype_name, r["size"]) for r in sorted(M.fat_archs(df).collect())] == [(0, "X86_64", "I386_ALL", len(thin)), (1, "ARM_64", "ARM64E", len(thin))]
    assert sorted((r.image_id, bytes(r.content) == thin) for r in M.fat_images(df).collect()) == [("f#0", True), ("f#1", True)]
