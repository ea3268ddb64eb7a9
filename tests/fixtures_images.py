"""Synthetic images, packed with struct from the published formats."""

from __future__ import annotations

import struct


def ar_header(name, size, date="0", mode="644"):
    return f"{name:<16}{date:<12}{'1':<6}{'2':<6}{mode:<8}{size:<10}`\n".encode()


def ar(members, long_names=b""):
    out = b"!<arch>\n"
    for name, body in ([("//", long_names)] if long_names else []) + members:
        out += ar_header(name, len(body)) + body + (b"\n" if len(body) & 1 else b"")
    return out


def elf(bits=64, big=False, symbols=((b"main", 0x401000, 4, 0x12, 1), (b"data", 0x401004, 2, 0x11, 1), (b"undef", 0, 0, 0x10, 0)), machine=62, sections=True):
    o = ">" if big else "<"
    code = bytes(range(16))
    names = b"\0.text\0.symtab\0.strtab\0.shstrtab\0.rel\0.bss\0"
    strtab, symtab = b"\0", struct.pack(o + ("IIIBBH" if bits == 32 else "IBBHQQ"), 0, 0, 0, 0, 0, 0)
    for n, v, s, info, shndx in symbols:
        at = len(strtab)
        strtab += n + b"\0"
        symtab += struct.pack(o + "IIIBBH", at, v, s, info, 1, shndx) if bits == 32 else struct.pack(o + "IBBHQQ", at, info, 1, shndx, v, s)
    rel = struct.pack(o + ("II" if bits == 32 else "QQ"), 0x401002, (2 << 8 | 1) if bits == 32 else (2 << 32 | 1))
    dyn = struct.pack(o + ("iIiI" if bits == 32 else "qQqQ"), 1, 7, 0, 0)
    head = 52 if bits == 32 else 64
    phsize = 32 if bits == 32 else 56
    at = head + 2 * phsize
    place = {}
    body = b""
    for k, d in (("text", code), ("sym", symtab), ("str", strtab), ("shstr", names), ("rel", rel), ("dyn", dyn)):
        place[k] = (at + len(body), len(d))
        body += d
    off = lambda n: names.index(b"\0" + n + b"\0") + 1
    table = [(0,) * 10]
    for n, t, f, addr, k, link, info in ((b".text", 1, 6, 0x401000, "text", 0, 0), (b".symtab", 2, 0, 0, "sym", 3, 0), (b".strtab", 3, 0, 0, "str", 0, 0), (b".shstrtab", 3, 0, 0, "shstr", 0, 0), (b".rel", 9, 0, 0, "rel", 2, 1), (b".bss", 8, 3, 0x500000, "text", 0, 0)):
        table.append((off(n), t, f, addr, *(place[k] if t != 8 else (place[k][0], 4096)), link, info, 1, 0))
    sh = b"".join(struct.pack(o + ("IIIIIIIIII" if bits == 32 else "IIQQQQIIQQ"), *r) for r in table)
    seg = ((1, 5, place["text"]), (2, 6, place["dyn"]))
    ph = b"".join(struct.pack(o + "IIIIIIII", t, p, 0x401000, 0x401000, n, n, f, 4096) if bits == 32 else struct.pack(o + "IIQQQQQQ", t, f, p, 0x401000, 0x401000, n, n, 4096) for t, f, (p, n) in seg)
    word = "I" if bits == 32 else "Q"
    ident = b"\x7fELF" + bytes([bits // 32, 2 if big else 1, 1, 0]) + bytes(8)
    h = struct.pack(o + f"HHI{word}{word}{word}IHHHHHH", 2, machine, 1, 0x401000, head, at + len(body) if sections else 0, 0, head, phsize, 2, 40 if bits == 32 else 64, len(table) if sections else 0, 4 if sections else 0)
    return ident + h + ph + body + (sh if sections else b"")


def pe(bits=64, exports=((b"beta", 0x1010), (b"alpha", 0x1000), (b"gamma", 0x1010)), imports=((b"a.dll", [b"f1", 7, b"f2"]), (b"b.dll", [b"g"]))):
    """One section at RVA 0x1000, file offset 0x400, that holds exports, imports and resources."""
    base, data = 0x1000, bytearray(b"\xcc" * 0x40)

    def put(b, align=4):
        while len(data) % align:
            data.append(0)
        at = base + len(data)
        data.extend(b)
        return at

    order = sorted(range(len(exports)), key=lambda i: exports[i][0])
    functions = put(b"".join(struct.pack("<I", a) for _, a in exports))
    name_at = [put(exports[i][0] + b"\0") for i in order]
    names = put(b"".join(struct.pack("<I", a) for a in name_at))
    ordinals = put(b"".join(struct.pack("<H", i) for i in order))
    dll = put(b"me.dll\0")
    exp = put(struct.pack("<IIHHIIIIIII", 0, 86400, 1, 2, dll, 10, len(exports), len(exports), functions, names, ordinals))
    width, top = (8, 1 << 63) if bits == 64 else (4, 1 << 31)
    desc = b""
    for lib, items in imports:
        thunks = b""
        for x in items:
            v = x | top if isinstance(x, int) else put(struct.pack("<H", 3) + x + b"\0", 2)
            thunks += v.to_bytes(width, "little")
        t = put(thunks + bytes(width), 8)
        desc += struct.pack("<IIIII", t, 0, 0, put(lib + b"\0"), t)
    imp = put(desc + bytes(20))
    leaf = put(b"<manifest/>")
    text = struct.pack("<H", 2) + "Né".encode("utf-16le")
    d = lambda named, ids: struct.pack("<IIHHHH", 0, 0, 0, 0, named, ids)
    res = d(0, 1) + struct.pack("<II", 24, 0x80000018) + d(1, 1) + struct.pack("<IIII", 0x80000058, 0x80000038, 13, 0x48) + bytes(0)
    res = res.ljust(0x38, b"\0") + d(0, 0)
    res = res.ljust(0x48, b"\0") + struct.pack("<IIII", leaf, 11, 1252, 0) + text
    # level 3 directory at 0x38 holds no entries of its own here; the id entry 13 is a leaf at 0x48
    rsrc = put(res, 16)
    size = len(data) + (-len(data)) % 0x200
    raw = bytes(data).ljust(size, b"\0")
    dirs = [(exp, 40), (imp, len(desc) + 20), (rsrc, len(res))] + [(0, 0)] * 13
    head = struct.pack("<HBBIIIII", 0x20B if bits == 64 else 0x10B, 14, 0, 1, 2, 3, 0x1000, 0x1000)
    middle = struct.pack("<IIHHHHHHIIIIHH", 0x1000, 0x200, 6, 0, 0, 0, 6, 0, 0, 0x3000, 0x400, 0, 3, 0x8160)
    opt = head + (struct.pack("<Q", 0x140000000) + middle + struct.pack("<QQQQII", 1, 2, 3, 4, 0, 16) if bits == 64 else struct.pack("<II", 0x2000, 0x400000) + middle + struct.pack("<IIIIII", 1, 2, 3, 4, 0, 16))
    opt += b"".join(struct.pack("<II", *x) for x in dirs)
    dos = struct.pack("<14H", 0x5A4D, *range(13)) + struct.pack("<4H", 0, 0, 0, 0) + struct.pack("<2H", 0, 0) + bytes(20) + struct.pack("<i", 0x80)
    file = struct.pack("<HHIIIHH", 0x8664 if bits == 64 else 0x14C, 1, 86400, 0, 0, len(opt), 0x22)
    sec = struct.pack("<8sIIIIIIHHI", b".text", len(data), 0x1000, size, 0x400, 0, 0, 0, 0, 0x60500020)
    return (dos.ljust(0x80, b"\0") + b"PE\0\0" + file + opt + sec).ljust(0x400, b"\0") + raw, base, bytes(data)


def mach(bits=64, big=False, starts=(0x10, 0x205, 0x3), text=0x100000000):
    o, w = ">" if big else "<", "Q" if bits == 64 else "I"
    text = text if bits == 64 else 0x1000
    pad = lambda b, n: b.ljust(n, b"\0")
    sect = struct.pack(o + f"16s16s{w}{w}IIIIIII", b"__text", b"__TEXT", text + 16, 8, 0, 4, 0, 0, 0x80000400, 0, 0) + (bytes(4) if bits == 64 else b"")
    seg = struct.pack(o + f"16s{w}{w}{w}{w}IIII", b"__TEXT", text, 0x1000, 0, 64, 7, 5, 1, 1) + sect
    dylib = struct.pack(o + "IIII", 24, 2, 0x00010203, 0x00010000) + pad(b"/usr/lib/x.dylib\0", 24)
    uuid, rpath = bytes(range(16)), struct.pack(o + "I", 12) + pad(b"@loader\0", 12)
    build = struct.pack(o + "IIIIII", 1, 0x000B0000, 0x000C0100, 1, 3, 0x02000000)
    uleb = b""
    for v in starts:
        while v > 127:
            uleb += bytes([v & 127 | 128])
            v >>= 7
        uleb += bytes([v])
    uleb = pad(uleb, 8)
    sym = struct.pack(o + f"IBBH{w}", 1, 0x0F, 1, 2, text + 16) + struct.pack(o + f"IBBH{w}", 7, 0x01, 0, 0, 0)
    names = b"\0_main\0_puts\0\0"
    dice = struct.pack(o + "IHH", 8, 4, 3)
    cmds = [(0x19 if bits == 64 else 1, seg), (0xC, dylib), (0x1B, uuid), (0x8000001C, rpath), (0x32, build), (0x99, b"\1\2\3\4")]
    size = sum(8 + len(p) for _, p in cmds) + 24 + 16 + 16
    at = (32 if bits == 64 else 28) + size
    cmds += [(2, struct.pack(o + "IIII", at, 2, at + len(sym), len(names))), (0x26, struct.pack(o + "II", at + len(sym) + len(names), len(uleb))), (0x29, struct.pack(o + "II", at + len(sym) + len(names) + len(uleb), 8))]
    head = struct.pack(o + "IIIIIII", 0xFEEDFACF if bits == 64 else 0xFEEDFACE, 0x01000007 if bits == 64 else 7, 0x80000003, 2, len(cmds), size, 0x200085) + (bytes(4) if bits == 64 else b"")
    return head + b"".join(struct.pack(o + "II", c, 8 + len(p)) + p for c, p in cmds) + sym + names + uleb + dice
