"""ELF images: header, segments, sections, symbols, dynamic entries and relocations, by native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codecs import bind, bits, bytes_, flag_names, nul_string, once, settled, uint
from ..functions.enums import codes, name_of, names
from ..functions.layouts import Layout, either, records

__all__ = ["elf_dynamic", "elf_header", "elf_relocations", "elf_sections", "elf_segments", "elf_symbols"]

HEADER = {w: Layout(f"e_type:u16 e_machine:u16 e_version:u32 e_entry:u{w} e_phoff:u{w} e_shoff:u{w} e_flags:u32 e_ehsize:u16 e_phentsize:u16 e_phnum:u16 e_shentsize:u16 e_shnum:u16 e_shstrndx:u16") for w in (32, 64)}
SEGMENT = {
    32: Layout("p_type:u32 p_offset:u32 p_vaddr:u32 p_paddr:u32 p_filesz:u32 p_memsz:u32 p_flags:u32 p_align:u32"),
    64: Layout("p_type:u32 p_flags:u32 p_offset:u64 p_vaddr:u64 p_paddr:u64 p_filesz:u64 p_memsz:u64 p_align:u64"),
}
SECTION = {w: Layout(f"sh_name:u32 sh_type:u32 sh_flags:u{w} sh_addr:u{w} sh_offset:u{w} sh_size:u{w} sh_link:u32 sh_info:u32 sh_addralign:u{w} sh_entsize:u{w}") for w in (32, 64)}
SYMBOL = {
    32: Layout("st_name:u32 st_value:u32 st_size:u32 st_info:u8 st_other:u8 st_shndx:u16"),
    64: Layout("st_name:u32 st_info:u8 st_other:u8 st_shndx:u16 st_value:u64 st_size:u64"),
}
DYNAMIC = {w: Layout(f"d_tag:i{w} d_val:u{w}") for w in (32, 64)}
RELOCATION = {w: Layout(f"r_offset:u{w} r_info:u{w} r_addend:i{w}") for w in (32, 64)}


def _both(layouts: dict[int, Layout], data: Column, offset, big: Column, wide: Column) -> Column:
    return either(wide, layouts, data, offset, big)


def _table(layouts: dict[int, Layout], data: Column, offset: Column, count: Column, big: Column, wide: Column, less: int = 0) -> Column:
    """Array of (pos, v) for a table; ``less`` bytes per 32-bit word are missing from the end of each record."""
    stride = F.when(wide, layouts[64].size - 2 * less).otherwise(layouts[32].size - less)
    return records(data, offset, count, stride, lambda t, o, i: F.struct(i.alias("pos"), _both(layouts, t, o, big, wide).alias("v")))


def _opened(images: DataFrame) -> DataFrame:
    """image_id, content, big, wide, h of the ELF images; any class but the 32-bit one is read as 64-bit."""
    elf = images.where(F.substring("content", 1, 4) == F.unhex(F.lit("7F454C46"))).select("image_id", "content")
    elf = elf.withColumn("big", once(uint(F.col("content"), 5, 1) == 2)).withColumn("wide", once(uint(F.col("content"), 4, 1) != 1))
    return elf.withColumn("h", once(_both(HEADER, F.col("content"), 16, F.col("big"), F.col("wide"))))


def elf_header(images: DataFrame) -> DataFrame:
    """image_id, identification and header fields with names; truncated fields are null, other content gives no rows."""
    c, h = F.col("content"), F.col("h")
    ident = (("file_class", 4, "ELF_CLASS"), ("encoding", 5, "ELF_DATA"), ("osabi", 7, "ELF_OSABI"))
    named = [x for n, at, d in ident for x in (uint(c, at, 1).alias(f"{n}_code"), name_of(uint(c, at, 1), d).alias(n))]
    enums = [name_of(h[f], d).alias(f"{f}_name") for f, d in (("e_type", "ELF_ET"), ("e_machine", "ELF_EM"), ("e_version", "ELF_EV"))]
    return _opened(images).select("image_id", *named, uint(c, 6, 1).alias("version"), uint(c, 8, 1).alias("abiversion"), "h.*", *enums)


def elf_segments(images: DataFrame, with_data: bool = False) -> DataFrame:
    """image_id, pos, label, fields of each program header, r, w, x and, if wanted, its bytes."""
    table = _table(SEGMENT, F.col("content"), F.col("h.e_phoff"), F.col("h.e_phnum"), F.col("big"), F.col("wide"))
    if with_data:
        table = F.transform(table, lambda r: F.struct(r["pos"].alias("pos"), r["v"].alias("v"), bytes_(F.col("content"), r["v"]["p_offset"], r["v"]["p_filesz"]).alias("data")))
    rows = _opened(images).select("image_id", F.inline(table))
    kind = name_of(F.col("v.p_type"), "ELF_PT")
    label = F.concat(F.coalesce(kind, F.col("v.p_type").cast("string")), F.lit(" @ 0x"), F.lower(F.conv(F.col("v.p_offset").cast("string"), 10, 16)))
    can = [(bits(F.col("v.p_flags"), b, 1) == 1).alias(n) for n, b in (("r", 2), ("w", 1), ("x", 0))]
    return rows.select("image_id", "pos", label.alias("label"), kind.alias("p_type_name"), "v.*", *can, *(["data"] if with_data else []))


def _with_sections(images: DataFrame) -> DataFrame:
    """Adds sh, the array of section headers, and names, the bytes of the section name table."""
    rows = settled(_opened(images)).withColumn("sh", _table(SECTION, F.col("content"), F.col("h.e_shoff"), F.col("h.e_shnum"), F.col("big"), F.col("wide")))
    own = F.get("sh", F.col("h.e_shstrndx"))["v"]
    return settled(settled(rows).withColumn("names", bytes_(F.col("content"), own["sh_offset"], own["sh_size"])))


def elf_sections(images: DataFrame, with_data: bool = False) -> DataFrame:
    """image_id, pos, name, fields of each section header, its flags' names and, if wanted, its bytes (none for NOBITS).

    Without a section name table names are null."""
    data = lambda v: F.when(v["sh_type"] == 8, F.lit(b"")).otherwise(bytes_(F.col("content"), v["sh_offset"], v["sh_size"]))
    table = F.transform("sh", lambda r: F.struct(r["pos"].alias("pos"), nul_string(F.col("names"), r["v"]["sh_name"]).alias("name"), r["v"].alias("v"), *([data(r["v"]).alias("data")] if with_data else [])))
    rows = _with_sections(images).select("image_id", F.inline(table))
    flags = flag_names(F.col("v.sh_flags"), codes("ELF_SHF"))
    return rows.select("image_id", "pos", "name", name_of(F.col("v.sh_type"), "ELF_SHT").alias("sh_type_name"), "v.*", flags.alias("flag_names"), *(["data"] if with_data else []))


def elf_symbols(images: DataFrame, dynamic: bool = False, with_data: bool = False) -> DataFrame:
    """image_id, section_idx, pos, name, fields with names and, if wanted, the bytes of each named symbol.

    All tables of the kind are read; ``section_idx`` tells them apart, and the first is the one that a single
    accessor would give. Symbols without name are left out. A symbol in a plain section has ``data`` from its
    address on; ``executable`` holds only for functions in executable sections.
    """
    c, kind = F.col("content"), 11 if dynamic else 2
    wanted = F.filter("sh", lambda r: r["v"]["sh_type"] == kind)
    tables = _with_sections(images).withColumn("tables", wanted)

    def symbols(t: Column) -> Column:
        texts = F.get("sh", t["v"]["sh_link"].cast("int"))["v"]
        return bind(bytes_(c, texts["sh_offset"], texts["sh_size"]), lambda heap: with_names(t, heap))

    def with_names(t: Column, heap: Column) -> Column:
        size = F.when(F.col("wide"), SYMBOL[64].size).otherwise(SYMBOL[32].size)
        rows = _table(SYMBOL, c, t["v"]["sh_offset"], F.floor(t["v"]["sh_size"] / size), F.col("big"), F.col("wide"))

        def one(r: Column) -> Column:
            home = F.get("sh", r["v"]["st_shndx"])["v"]
            at = r["v"]["st_value"] - home["sh_addr"]
            fits = (at >= 0) & (at + r["v"]["st_size"] <= home["sh_size"]) & (home["sh_offset"] + home["sh_size"] <= F.length(c))
            inside = F.when((r["v"]["st_shndx"] > 0) & (r["v"]["st_shndx"] < 0xFF00) & (home["sh_type"] != 8) & fits, bytes_(c, home["sh_offset"] + at, r["v"]["st_size"]))
            runs_ = (bits(r["v"]["st_info"], 0, 4) == 2) & (bits(home["sh_flags"], 2, 1) == 1)
            return F.struct(t["pos"].alias("section_idx"), r["pos"].alias("pos"), nul_string(heap, r["v"]["st_name"]).alias("name"), r["v"].alias("v"), F.coalesce(runs_, F.lit(False)).alias("executable"), *([inside.alias("data")] if with_data else []))

        return F.transform(F.filter(rows, lambda r: r["v"]["st_name"] != 0), one)

    rows = tables.select("image_id", F.inline(F.flatten(F.transform("tables", symbols))))
    info = [name_of(bits(F.col("v.st_info"), 0, 4), "ELF_STT").alias("type"), name_of(bits(F.col("v.st_info"), 4, 4), "ELF_STB").alias("binding"), name_of(bits(F.col("v.st_other"), 0, 2), "ELF_STV").alias("visibility"), name_of(F.col("v.st_shndx"), "ELF_SHN").alias("shndx_name")]
    return rows.select("image_id", "section_idx", "pos", "name", F.col("v.st_value").alias("value"), F.col("v.st_size").alias("size"), *info, F.col("v.st_shndx").alias("shndx"), "executable", *(["data"] if with_data else []))


def elf_dynamic(images: DataFrame) -> DataFrame:
    """image_id, pos, tag, tag_name, value of the entries of the first dynamic segment, to its end."""
    rows = _opened(images).withColumn("ph", _table(SEGMENT, F.col("content"), F.col("h.e_phoff"), F.col("h.e_phnum"), F.col("big"), F.col("wide")))
    first = F.get(F.filter("ph", lambda r: r["v"]["p_type"] == 2), F.lit(0))["v"]
    size = F.when(F.col("wide"), DYNAMIC[64].size).otherwise(DYNAMIC[32].size)
    table = _table(DYNAMIC, F.col("content"), first["p_offset"], F.floor(first["p_filesz"] / size), F.col("big"), F.col("wide"))
    rows = rows.select("image_id", F.inline(table))
    return rows.select("image_id", "pos", F.col("v.d_tag").alias("tag"), name_of(F.col("v.d_tag"), "ELF_DT").alias("tag_name"), F.col("v.d_val").alias("value"))


def elf_relocations(images: DataFrame, addends: bool) -> DataFrame:
    """image_id, section_idx, pos, offset, symbol, type, type_name, addend of all REL (or RELA) sections.

    Symbol index and type split at bit 8 in 32-bit images and at bit 32 in others. Names are known for 386, PPC,
    PPC64 and AMD64.
    """
    kind, less = (4, 0) if addends else (9, 4)
    wide, c = F.col("wide"), F.col("content")

    def table(t: Column) -> Column:
        size = F.when(wide, RELOCATION[64].size - 2 * less).otherwise(RELOCATION[32].size - less)
        rows = _table(RELOCATION, c, t["v"]["sh_offset"], F.floor(t["v"]["sh_size"] / size), F.col("big"), wide, less)
        return F.transform(rows, lambda r: F.struct(t["pos"].alias("section_idx"), r["pos"].alias("pos"), r["v"].alias("v")))

    found = F.flatten(F.transform(F.filter("sh", lambda r: r["v"]["sh_type"] == kind), table))
    rows = _with_sections(images).select("image_id", "wide", F.col("h.e_machine").alias("machine"), F.inline(found))
    split = F.when(wide, F.lit(1 << 32)).otherwise(F.lit(256))
    info = F.col("v.r_info")
    rows = rows.select("image_id", "section_idx", "pos", F.col("v.r_offset").alias("offset"), F.floor(info / split).cast("bigint").alias("symbol"), (info % split).cast("bigint").alias("type"), "machine", (F.col("v.r_addend") if addends else F.lit(None).cast("bigint")).alias("addend"))
    machine = names("ELF_EM")
    known = [F.when(F.col("machine") == code, name_of(F.col("type"), f"RELOC_{n}")) for code, n in machine.items() if n in ("386", "PPC", "PPC64", "AMD64")]
    return rows.select("image_id", "section_idx", "pos", "offset", "symbol", "type", F.coalesce(*known).alias("type_name"), "addend")
