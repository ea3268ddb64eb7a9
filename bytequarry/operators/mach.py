"""Mach-O images, thin and fat: header, load commands and the tables that they point to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codecs import bits, bytes_, flag_names, guid, nul_string, once, settled, uint, uleb128_list, version
from ..functions.enums import DOMAINS, codes, name_of
from ..functions.layouts import Layout, either, records
from .walks import record_offsets

__all__ = [
    "fat_archs", "fat_images", "mach_build_tools", "mach_commands", "mach_data_in_code", "mach_dylibs", "mach_function_starts", "mach_header",
    "mach_sections", "mach_segments", "mach_symbols",
]

HEADER = Layout("magic:u32 cputype:u32 cpusubtype:u32 filetype:u32 ncmds:u32 sizeofcmds:u32 flags:u32")
ARCH = Layout("cputype:u32 cpusubtype:u32 offset:u32 size:u32 align:u32")
SEGMENT = {w: Layout(f"segname:s16 vmaddr:u{w} vmsize:u{w} fileoff:u{w} filesize:u{w} maxprot:u32 initprot:u32 nsects:u32 flags:u32") for w in (32, 64)}
SECTION = {w: Layout(f"sectname:s16 segname:s16 addr:u{w} size:u{w} offset:u32 align:u32 reloff:u32 nreloc:u32 flags:u32 reserved1:u32 reserved2:u32" + (" _pad:b4" if w == 64 else "")) for w in (32, 64)}
SYMBOL = {w: Layout(f"strx:u32 type:u8 sect:u8 desc:u16 value:u{w}") for w in (32, 64)}

#: Commands whose payload is a fixed record after the 8 bytes of every command.
PAYLOADS = {
    "PREBIND_CKSUM": "cksum:u32",
    "ENCRYPTION_INFO": "cryptoff:u32 cryptsize:u32 cryptid:u32",
    "ENCRYPTION_INFO_64": "cryptoff:u32 cryptsize:u32 cryptid:u32 pad:u32",
    "MAIN": "entryoff:u64 stacksize:u64",
    "SYMTAB": "symoff:u32 nsyms:u32 stroff:u32 strsize:u32",
    "DYSYMTAB": (
        "ilocalsym:u32 nlocalsym:u32 iextdefsym:u32 nextdefsym:u32 iundefsym:u32 nundefsym:u32 tocoff:u32 ntoc:u32 modtaboff:u32 nmodtab:u32"
        " extrefsymoff:u32 nextrefsyms:u32 indirectsymoff:u32 nindirectsyms:u32 extreloff:u32 nextrel:u32 locreloff:u32 nlocrel:u32"
    ),
    "DYLD_INFO": "rebase_off:u32 rebase_size:u32 bind_off:u32 bind_size:u32 weak_bind_off:u32 weak_bind_size:u32 lazy_bind_off:u32 lazy_bind_size:u32 export_off:u32 export_size:u32",
    "THREAD": "flavor:u32 count:u32",
    "ROUTINES": "init_address:u32 init_module:u32",
    "ROUTINES_64": "init_address:u64 init_module:u64",
    "TWOLEVEL_HINTS": "offset:u32 nhints:u32",
    "LINKER_OPTION": "count:u32",
    "NOTE": "data_owner:s16 offset:u64 size:u64",
    "CODE_SIGNATURE": "dataoff:u32 datasize:u32",
}
SAME_PAYLOAD = {
    "DYLD_INFO": ("DYLD_INFO_ONLY",),
    "THREAD": ("UNIXTHREAD",),
    "CODE_SIGNATURE": ("SEGMENT_SPLIT_INFO", "FUNCTION_STARTS", "DATA_IN_CODE", "DYLIB_CODE_SIGN_DRS", "LINKER_OPTIMIZATION_HINT", "DYLD_EXPORTS_TRIE", "DYLD_CHAINED_FIXUPS", "SYMSEG"),
}
DYLIBS = ("LOAD_DYLIB", "ID_DYLIB", "LOAD_WEAK_DYLIB", "REEXPORT_DYLIB", "LAZY_LOAD_DYLIB", "LOAD_UPWARD_DYLIB")
#: Commands that hold one text, by the place of its offset.
TEXTS = ("SUB_FRAMEWORK", "SUB_UMBRELLA", "SUB_CLIENT", "SUB_LIBRARY", "LOAD_DYLINKER", "ID_DYLINKER", "DYLD_ENVIRONMENT", "RPATH", "LOADFVMLIB", "IDFVMLIB", "PREBOUND_DYLIB", "FVMFILE", *DYLIBS)
VERSIONS = ("VERSION_MIN_MACOSX", "VERSION_MIN_IPHONEOS", "VERSION_MIN_TVOS", "VERSION_MIN_WATCHOS")


def _opened(images: DataFrame) -> DataFrame:
    """image_id, content, big, wide, h of thin images."""
    magic = F.hex(F.substring("content", 1, 4))
    thin = images.where(magic.isin("FEEDFACE", "CEFAEDFE", "FEEDFACF", "CFFAEDFE")).select("image_id", "content", once(magic.isin("FEEDFACE", "FEEDFACF")).alias("big"), once(magic.isin("FEEDFACF", "CFFAEDFE")).alias("wide"))
    return thin.withColumn("h", once(HEADER.struct(F.col("content"), 0, F.col("big"))))


def cpu_subtype(cputype: Column, cpusubtype: Column) -> Column:
    """Name of a sub-type within its type, capability bits left out; null for unknown ones."""
    low = cpusubtype.bitwiseAND(F.lit(0x00FFFFFF))
    cpus = codes("MACH_CPU")
    each = [F.when(cputype == cpus[d[9:]], name_of(low, d)) for d in DOMAINS if d.startswith("MACH_SUB_")]
    return F.coalesce(*each)


def mach_header(images: DataFrame) -> DataFrame:
    """image_id, big, wide, header fields and their names; other content gives no rows."""
    h = F.col("h")
    return _opened(images).select(
        "image_id", "big", "wide", "h.*", name_of(h["cputype"], "MACH_CPU").alias("cputype_name"), cpu_subtype(h["cputype"], h["cpusubtype"]).alias("cpusubtype_name"),
        name_of(h["filetype"], "MACH_FILETYPE").alias("filetype_name"), flag_names(h["flags"], codes("MACH_FLAGS")).alias("flag_names"),
    )


def _commands(images: DataFrame) -> DataFrame:
    """image_id, content, big, wide, pos, at, cmd, cmdsize, payload (with the 8 bytes of the head) of each command."""
    rows = _opened(images)
    at = record_offsets("content", F.when(F.col("wide"), 32).otherwise(28), F.col("h.ncmds").cast("int"), F.lit(4), F.lit(4), F.lit(0), F.col("big"))
    rows = rows.withColumn("at", at)
    one = lambda o: F.struct(o.alias("at"), uint(F.col("content"), o, 4, F.col("big")).alias("cmd"), uint(F.col("content"), o + 4, 4, F.col("big")).alias("cmdsize"))
    rows = rows.withColumn("c", F.transform("at", lambda o: one(o)))
    rows = rows.withColumn("c", F.transform("c", lambda x: F.struct(x["at"].alias("at"), x["cmd"].alias("cmd"), x["cmdsize"].alias("cmdsize"), bytes_(F.col("content"), x["at"], x["cmdsize"]).alias("payload"))))
    return rows.select("image_id", "content", "big", "wide", F.posexplode("c").alias("pos", "x")).select("image_id", "content", "big", "wide", "pos", "x.*")


def mach_commands(images: DataFrame) -> DataFrame:
    """image_id, pos, cmd, cmd_name, cmdsize, text, uuid, version, fields (JSON of a fixed payload), payload of each load command.

    Unknown commands have a null name and their payload; sizes that leave the image end the list.
    """
    p, big, name = F.col("payload"), F.col("big"), F.col("cmd_name")
    rows = _commands(images).select("image_id", "big", "pos", "cmd", name_of(F.col("cmd"), "MACH_CMD").alias("cmd_name"), "cmdsize", "payload")
    text = F.when(name.isin(*TEXTS), nul_string(p, uint(p, 8, 4, big)))
    packed = F.when(name.isin(*VERSIONS), uint(p, 8, 4, big)).when(name.isin(*DYLIBS), uint(p, 16, 4, big)).when(name == "BUILD_VERSION", uint(p, 12, 4, big))
    fields = F.coalesce(*(F.when(name.isin(n, *SAME_PAYLOAD.get(n, ())), F.to_json(Layout(t).struct(p, 8, big))) for n, t in PAYLOADS.items()))
    source = F.when(name == "SOURCE_VERSION", uint(p, 8, 8, big).cast("bigint"))
    parts = F.concat_ws(".", *(bits(source, low, n).cast("string") for low, n in ((40, 24), (30, 10), (20, 10), (10, 10), (0, 10))))
    return rows.select("image_id", "pos", "cmd", "cmd_name", "cmdsize", text.alias("text"), F.when(name == "UUID", guid(p, 8)).alias("uuid"), F.when(packed.isNotNull(), version(packed)).alias("version"), F.when(source.isNotNull(), parts).alias("source_version"), fields.alias("fields"), "payload")


def _segments(images: DataFrame) -> DataFrame:
    p, big = F.col("payload"), F.col("big")
    rows = _commands(images).where(F.col("cmd").isin(1, 0x19)).withColumn("long", F.col("cmd") == 0x19)
    return rows.withColumn("v", once(either(F.col("long"), SEGMENT, p, 8, big)))


def mach_segments(images: DataFrame, with_data: bool = False) -> DataFrame:
    """image_id, pos, fields of each segment command, r, w, x by initprot and, if wanted, its bytes of the file."""
    can = [(bits(F.col("v.initprot"), b, 1) == 1).alias(n) for n, b in (("r", 0), ("w", 1), ("x", 2))]
    data = [bytes_(F.col("content"), F.col("v.fileoff"), F.col("v.filesize")).alias("data")] if with_data else []
    return _segments(images).select("image_id", "pos", "v.*", flag_names(F.col("v.flags"), codes("MACH_SEGMENT")).alias("flag_names"), *can, *data)


def mach_sections(images: DataFrame) -> DataFrame:
    """image_id, segment_pos, pos, fields of each section with type and attribute names."""
    p, big, long_ = F.col("payload"), F.col("big"), F.col("long")

    def one(t: Column, o: Column, i: Column) -> Column:
        return F.struct(i.alias("i"), either(long_, SECTION, t, o, big).alias("s"))

    table = records(p, F.when(long_, 8 + SEGMENT[64].size).otherwise(8 + SEGMENT[32].size), F.col("v.nsects"), F.when(long_, SECTION[64].size).otherwise(SECTION[32].size), one)
    rows = _segments(images).select("image_id", F.col("pos").alias("segment_pos"), F.inline(table))
    flags = F.col("s.flags")
    return rows.select("image_id", "segment_pos", F.col("i").alias("pos"), "s.*", name_of(bits(flags, 0, 8), "MACH_SECTION").alias("type"), F.concat(flag_names(bits(flags, 8, 16), codes("MACH_SECTION_SYS")), flag_names(bits(flags, 24, 8), codes("MACH_SECTION_USR"))).alias("attributes"))


def mach_dylibs(images: DataFrame) -> DataFrame:
    """image_id, pos, kind, name, timestamp, current_version, compatibility_version of the library commands."""
    p, big = F.col("payload"), F.col("big")
    rows = _commands(images).withColumn("kind", name_of(F.col("cmd"), "MACH_CMD")).where(F.col("kind").isin(*DYLIBS))
    return rows.select("image_id", "pos", "kind", nul_string(p, uint(p, 8, 4, big)).alias("name"), uint(p, 12, 4, big).alias("timestamp"), version(uint(p, 16, 4, big)).alias("current_version"), version(uint(p, 20, 4, big)).alias("compatibility_version"))


def mach_symbols(images: DataFrame) -> DataFrame:
    """image_id, pos, name, type, external, private_external, stab, sect, ref, desc, value of the first symbol table."""
    p, big, wide = F.col("payload"), F.col("big"), F.col("wide")
    first = _commands(images).where("cmd = 2").withColumn("rank", F.row_number().over(Window.partitionBy("image_id").orderBy("pos"))).where("rank = 1")
    rows = settled(first.withColumn("v", once(Layout(PAYLOADS["SYMTAB"]).struct(p, 8, big))))
    rows = settled(rows.withColumn("heap", once(bytes_(F.col("content"), F.col("v.stroff"), F.col("v.strsize")))))

    def one(t: Column, o: Column, i: Column) -> Column:
        return F.struct(i.alias("pos"), either(wide, SYMBOL, t, o, big).alias("s"))

    table = records(F.col("content"), F.col("v.symoff"), F.col("v.nsyms"), F.when(wide, SYMBOL[64].size).otherwise(SYMBOL[32].size), one)
    named = F.transform(table, lambda r: F.struct(r["pos"].alias("pos"), r["s"].alias("s"), nul_string(F.col("heap"), r["s"]["strx"]).alias("name")))
    out, t = rows.select("image_id", F.inline(named)), F.col("s.type")
    return out.select(
        "image_id", "pos", "name", name_of(bits(t, 1, 3), "MACH_NTYPE").alias("type"), (bits(t, 0, 1) == 1).alias("external"), (bits(t, 4, 1) == 1).alias("private_external"), bits(t, 5, 3).alias("stab"),
        F.col("s.sect").alias("sect"), name_of(bits(F.col("s.desc"), 0, 3), "MACH_NREF").alias("ref"), F.col("s.desc").alias("desc"), F.col("s.value").alias("value"),
    )


def _linked(images: DataFrame, cmd: str) -> DataFrame:
    """image_id, big, data of the first command of a kind that points to a blob."""
    p, big = F.col("payload"), F.col("big")
    rows = _commands(images).where(F.col("cmd") == codes("MACH_CMD")[cmd]).withColumn("rank", F.row_number().over(Window.partitionBy("image_id").orderBy("pos"))).where("rank = 1")
    return settled(rows.select("image_id", "big", once(bytes_(F.col("content"), uint(p, 8, 4, big), uint(p, 12, 4, big))).alias("data")))


def mach_function_starts(images: DataFrame) -> DataFrame:
    """image_id, pos, address: the running sum of the varint gaps from the __TEXT segment's address (0 without one).

    The padding zeros at the end of the list are no functions.
    """
    text = mach_segments(images).where("segname = '__TEXT'").groupBy("image_id").agg(F.min_by("vmaddr", "pos").alias("base"))
    gaps = _linked(images, "FUNCTION_STARTS").select("image_id", F.posexplode(uleb128_list(F.col("data"))).alias("pos", "gap")).where("gap > 0")
    total = F.sum("gap").over(Window.partitionBy("image_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return gaps.join(text, "image_id", "left").select("image_id", "pos", (total + F.coalesce("base", F.lit(0))).cast("decimal(20,0)").alias("address"))


def mach_data_in_code(images: DataFrame) -> DataFrame:
    """image_id, pos, offset, length, kind of the data ranges in code."""
    one = lambda t, o, i: F.struct(i.alias("pos"), uint(t, o, 4, F.col("big")).alias("offset"), uint(t, o + 4, 2, F.col("big")).alias("length"), name_of(uint(t, o + 6, 2, F.col("big")), "MACH_DICE").alias("kind"))
    return _linked(images, "DATA_IN_CODE").select("image_id", F.inline(records(F.col("data"), F.lit(0), F.floor(F.length("data") / 8), 8, one)))


def mach_build_tools(images: DataFrame) -> DataFrame:
    """image_id, platform, minos, sdk, pos, tool, version of the build version commands; pos and tool are null without tools."""
    p, big = F.col("payload"), F.col("big")
    rows = _commands(images).where(F.col("cmd") == codes("MACH_CMD")["BUILD_VERSION"])
    one = lambda t, o, i: F.struct(i.alias("pos"), name_of(uint(t, o, 4, big), "MACH_TOOL").alias("tool"), version(uint(t, o + 4, 4, big)).alias("version"))
    tools = records(p, F.lit(24), uint(p, 20, 4, big), 8, one)
    return rows.select("image_id", name_of(uint(p, 8, 4, big), "MACH_PLATFORM").alias("platform"), version(uint(p, 12, 4, big)).alias("minos"), version(uint(p, 16, 4, big)).alias("sdk"), F.inline_outer(tools))


def fat_archs(images: DataFrame, with_content: bool = False) -> DataFrame:
    """image_id, arch_pos, fields and names of the slices of fat images; all fields in the image's byte order."""
    magic = F.hex(F.substring("content", 1, 4))
    fat = images.where(magic.isin("CAFEBABE", "BEBAFECA")).select("image_id", "content", once(magic == "CAFEBABE").alias("big"))
    c, big = F.col("content"), F.col("big")
    one = lambda t, o, i: F.struct(i.alias("arch_pos"), ARCH.struct(t, o, big).alias("v"))
    table = records(c, F.lit(8), uint(c, 4, 4, big), ARCH.size, one)
    if with_content:
        table = F.transform(table, lambda r: F.struct(r["arch_pos"].alias("arch_pos"), r["v"].alias("v"), bytes_(c, r["v"]["offset"], r["v"]["size"]).alias("content")))
    rows = fat.select("image_id", F.inline(table))
    return rows.select("image_id", "arch_pos", "v.*", name_of(F.col("v.cputype"), "MACH_CPU").alias("cputype_name"), cpu_subtype(F.col("v.cputype"), F.col("v.cpusubtype")).alias("cpusubtype_name"), *(["content"] if with_content else []))


def fat_images(images: DataFrame) -> DataFrame:
    """The slices of fat images as images of their own: image_id with ``#`` and the slice's position, content."""
    return fat_archs(images, True).select(F.concat_ws("#", "image_id", F.col("arch_pos").cast("string")).alias("image_id"), "content")
