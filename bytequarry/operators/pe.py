"""PE and COFF images: headers, sections, directories, exports, imports, resources, import objects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codecs import bind, bytes_, flag_names, nul_string, once, settled, sint, timestamp, uint, where_here
from ..functions.enums import codes, name_of, names
from ..functions.layouts import Layout, records
from .walks import pointer_lists, resource_leaves

__all__ = [
    "bytes_at", "coff_import_symbols", "coff_sections", "directory_bytes", "opened", "pe_directories", "pe_exports", "pe_header", "pe_imports", "pe_resources",
    "pe_sections", "place_of", "read_directory", "register_directory", "text_at",
]

DOS = Layout("magic:u16 cblp:u16 cp:u16 crlc:u16 cparhdr:u16 minalloc:u16 maxalloc:u16 ss:u16 sp:u16 csum:u16 ip:u16 cs:u16 lfarlc:u16 ovno:u16 res:4*u16 oemid:u16 oeminfo:u16 res2:10*u16 lfanew:i32")
FILE = Layout("Machine:u16 NumberOfSections:u16 TimeDateStamp:u32 PointerToSymbolTable:u32 NumberOfSymbols:u32 SizeOfOptionalHeader:u16 Characteristics:u16")
_HEAD = "Magic:u16 MajorLinkerVersion:u8 MinorLinkerVersion:u8 SizeOfCode:u32 SizeOfInitializedData:u32 SizeOfUninitializedData:u32 AddressOfEntryPoint:u32 BaseOfCode:u32 "
_MIDDLE = (
    " SectionAlignment:u32 FileAlignment:u32 MajorOperatingSystemVersion:u16 MinorOperatingSystemVersion:u16 MajorImageVersion:u16 MinorImageVersion:u16 MajorSubsystemVersion:u16"
    " MinorSubsystemVersion:u16 Win32VersionValue:u32 SizeOfImage:u32 SizeOfHeaders:u32 CheckSum:u32 Subsystem:u16 DllCharacteristics:u16"
)
_TAIL = " SizeOfStackReserve:u{w} SizeOfStackCommit:u{w} SizeOfHeapReserve:u{w} SizeOfHeapCommit:u{w} LoaderFlags:u32 NumberOfDirectories:u32"
OPTIONAL = {32: Layout(_HEAD + "BaseOfData:u32 ImageBase:u32" + _MIDDLE + _TAIL.format(w=32)), 64: Layout(_HEAD + "ImageBase:u64" + _MIDDLE + _TAIL.format(w=64))}
SECTION = Layout("Name:s8 VirtualSize:u32 VirtualAddress:u32 SizeOfRawData:u32 PointerToRawData:u32 PointerToRelocations:u32 PointerToLinenumbers:u32 NumberOfRelocations:u16 NumberOfLinenumbers:u16 Characteristics:u32")
EXPORTS = Layout("ExportFlags:u32 TimeDateStamp:u32 MajorVersion:u16 MinorVersion:u16 DLLName:u32 OrdinalBase:u32 NumberEntries:u32 NumberNames:u32 FunctionTable:u32 NameTable:u32 OrdinalTable:u32")
IMPORTS = Layout("Characteristics:u32 TimeDateStamp:u32 ForwarderChain:u32 DllName:u32 FirstThunk:u32")
IMPORT_OBJECT = Layout("a:u16 b:u16 c:u16 Architecture:u16 Id:u32 Length:u32 Value:u16 Type:u16")

def content() -> Column:
    return F.col("content")


def opened(images: DataFrame) -> DataFrame:
    """image_id, content, at (of the PE mark), is_pe, n_sections, opt_size, magic, directories, sections of images that start with MZ.

    An image without the PE mark has no sections and no directories; nor has one whose optional header is
    neither 32- nor 64-bit directories.
    """
    c = content()
    rows = images.where(F.substring("content", 1, 2) == F.lit(b"MZ")).select("image_id", "content").withColumn("at", once(sint(c, 60, 4).cast("bigint")))
    at = F.col("at")
    rows = rows.withColumn("is_pe", once(F.coalesce(bytes_(c, at, 4) == F.lit(b"PE\x00\x00"), F.lit(False))))
    field = lambda o, n: once(F.when(F.col("is_pe"), uint(c, at + o, n)))
    rows = rows.withColumns({"n_sections": field(6, 2), "opt_size": field(20, 2), "magic": field(24, 2)})
    start, wide = at + 24, F.col("magic") == 0x20B
    head = F.when(wide, OPTIONAL[64].size).otherwise(F.when(F.col("magic") == 0x10B, OPTIONAL[32].size))
    rows = rows.withColumn("head", once(F.when(F.col("opt_size") >= head, head))).withColumn("n_dirs", once(uint(c, start + F.col("head") - 4, 4)))
    count = F.least("n_dirs", F.floor((F.col("opt_size") - F.col("head")) / 8))
    table = records(c, start + F.col("head"), count, 8, lambda t, o, i: F.struct(i.alias("pos"), uint(t, o, 4).alias("VirtualAddress"), uint(t, o + 4, 4).alias("Size")))
    return settled(rows.withColumns({"directories": once(table), "sections": once(_sections(c, start + F.col("opt_size"), F.col("n_sections")))}))


def _sections(data: Column, offset: Column, count: Column) -> Column:
    return records(data, offset, count, SECTION.size, lambda t, o, i: F.struct(i.alias("pos"), SECTION.struct(t, o).alias("v")))


def place_of(address: Column) -> Column:
    """Struct (at, rest): file offset of an address and the bytes from there to the end of its section's raw data.

    The first section that holds the address wins; null for one outside all sections.
    """
    home = F.filter("sections", lambda s: (address >= s["v"]["VirtualAddress"]) & (address < s["v"]["VirtualAddress"] + s["v"]["SizeOfRawData"]))
    return bind(F.get(home, F.lit(0))["v"], lambda v: F.when(v.isNotNull(), F.struct((v["PointerToRawData"] + address - v["VirtualAddress"]).alias("at"), (v["VirtualAddress"] + v["SizeOfRawData"] - address).alias("rest"))))


def bytes_at(address: Column, length: Column | None = None) -> Column:
    """Bytes at an address, to the end of the section at most; null where the file does not hold them."""
    return bind(place_of(address), lambda p: bytes_(content(), p["at"], p["rest"] if length is None else F.least(p["rest"], length)))


def text_at(address: Column, skip: int = 0) -> Column:
    """Text up to the next NUL at an address; null for one outside all sections."""
    return nul_string(content(), place_of(address)["at"] + skip)


def _section_rows(rows: DataFrame, with_data: bool) -> DataFrame:
    table = F.transform("sections", lambda s: F.struct(s["pos"].alias("pos"), s["v"].alias("v"), *([bytes_(content(), s["v"]["PointerToRawData"], s["v"]["SizeOfRawData"]).alias("data")] if with_data else [])))
    out = rows.select("image_id", F.inline(table))
    domain = codes("PE_SECTION")
    can = [(F.array_contains(flag_names(F.col("v.Characteristics"), domain), n)).alias(a) for a, n in (("r", "MEM_READ"), ("w", "MEM_WRITE"), ("x", "MEM_EXECUTE"))]
    alignment = F.shiftright(F.col("v.Characteristics"), 20).bitwiseAND(F.lit(15))
    return out.select("image_id", "pos", "v.*", flag_names(F.col("v.Characteristics"), domain).alias("flag_names"), alignment.alias("ALIGN"), *can, *(["data"] if with_data else []))


def pe_header(images: DataFrame) -> DataFrame:
    """image_id, is_pe, the DOS, file and optional header as structs, with names for machine, magic and DLL flags."""
    rows = opened(images).select("image_id", "content", "at", "is_pe", "opt_size", "magic")
    body = bytes_(content(), F.col("at") + 24, F.col("opt_size"))
    rows = rows.withColumns({"dos": once(DOS.struct(content())), "file": once(F.when(F.col("is_pe"), FILE.struct(content(), F.col("at") + 4))), "body": once(body)})
    opt = F.when(F.col("magic") == 0x20B, _optional(64)).when(F.col("magic") == 0x10B, _optional(32))
    rows = rows.select("image_id", "is_pe", "dos", "file", once(opt).alias("opt"))
    return rows.select("image_id", "is_pe", "dos", "file", "opt", name_of(F.col("file.Machine"), "COFF_MACHINE").alias("machine_name"), name_of(F.col("opt.Magic"), "PE_MAGIC").alias("magic_name"), flag_names(F.col("opt.DllCharacteristics"), codes("PE_DLL")).alias("dll_flag_names"), timestamp(F.col("file.TimeDateStamp")).alias("linked_at"))


def _optional(bits_: int) -> Column:
    """The optional header from ``body``; both widths have the same fields and types."""
    wide = ("ImageBase", "SizeOfStackReserve", "SizeOfStackCommit", "SizeOfHeapReserve", "SizeOfHeapCommit")
    names_ = [n for n, *_ in OPTIONAL[64].fields]

    def same(v: Column) -> Column:
        base = v["BaseOfData"] if bits_ == 32 else F.lit(None).cast("bigint")
        return F.struct(*((v[n].cast("decimal(20,0)") if n in wide else v[n]).alias(n) for n in names_), base.alias("BaseOfData"))

    return bind(OPTIONAL[bits_].struct(F.col("body")), same)


def pe_sections(images: DataFrame, with_data: bool = False) -> DataFrame:
    """image_id, pos, fields, flag_names, ALIGN, r, w, x and, if wanted, the raw bytes (null if out of the file)."""
    return _section_rows(opened(images), with_data)


def coff_sections(images: DataFrame, with_data: bool = False) -> DataFrame:
    """The same of COFF objects, whose file header stands at 0; an optional header is skipped."""
    h = FILE.struct(content())
    rows = images.where(F.length("content") >= FILE.size).select("image_id", "content").withColumn("file", h).where(F.col("file.Machine").isin(list(names("COFF_MACHINE"))))
    return _section_rows(rows.withColumn("sections", _sections(content(), F.lit(FILE.size) + F.col("file.SizeOfOptionalHeader"), F.col("file.NumberOfSections"))), with_data)


def coff_import_symbols(images: DataFrame) -> DataFrame:
    """image_id, fields, Symbol and Module of import objects."""
    rows = images.where(F.length("content") >= IMPORT_OBJECT.size).select("image_id", "content", IMPORT_OBJECT.struct(content()).alias("v"))
    rows = rows.where("v.a = 0 and v.b = 65535 and v.c = 0 and v.Architecture <> 0").where(F.col("v.Architecture").isin(list(names("COFF_MACHINE"))))
    rows = rows.withColumn("Symbol", nul_string(content(), F.lit(IMPORT_OBJECT.size)))
    after = F.lit(IMPORT_OBJECT.size) + F.octet_length("Symbol") + 1
    return rows.select("image_id", "v.*", name_of(F.col("v.Architecture"), "COFF_MACHINE").alias("architecture_name"), "Symbol", nul_string(content(), after).alias("Module"))


def pe_directories(images: DataFrame) -> DataFrame:
    """image_id, pos, name, VirtualAddress, Size of the data directories; those past the known ones have no name."""
    rows = opened(images).select("image_id", F.inline(once(F.col("directories"))))
    return rows.select("image_id", "pos", name_of(F.col("pos"), "PE_DIRECTORY").alias("name"), "VirtualAddress", "Size")


def directory_bytes(images: DataFrame, name: str) -> DataFrame:
    """The opened images with ``base`` and ``data`` of a directory of non-zero size; the certificate table's address is a file offset."""
    at = codes("PE_DIRECTORY")[name]
    rows = where_here(opened(images).withColumn("dir", once(F.get("directories", F.lit(at)))), F.col("dir.Size") > 0)
    rows = rows.withColumns({"base": F.col("dir.VirtualAddress"), "length": F.col("dir.Size")})
    if name == "SECURITY":
        rows = rows.withColumn("data", once(bytes_(content(), F.col("base"), F.col("length"))))
    else:
        rows = rows.withColumn("data", once(bytes_at(F.col("base"), F.col("length"))))
    return where_here(rows, F.col("data").isNotNull())


def _words(data: Column, count: Column, size: int) -> Column:
    return records(data, F.lit(0), count, size, lambda t, o, i: uint(t, o, size).cast("bigint"))


def pe_exports(images: DataFrame, pair_by_position: bool = False, with_data: bool = False) -> DataFrame:
    """image_id, dll, pos, ordinal, name, address, size and, if wanted, data of the exports that lie in a section.

    Name i belongs to function ``ordinals[i]``, the first of several; with ``pair_by_position`` it is paired with function i
    instead and takes its ordinal. Size is the distance to the next greater address; the last goes to the end of its section.
    Data are joined back from the images, so that the sizes are found on narrow rows.
    """
    rows = directory_bytes(images, "EXPORT").select("image_id", "content", "sections", once(EXPORTS.struct(F.col("data"))).alias("e"))
    table = lambda f, n, size: once(_words(bytes_at(F.col(f"e.{f}"), F.col(f"e.{n}") * size), F.col(f"e.{n}"), size))
    rows = rows.withColumns({"functions": table("FunctionTable", "NumberEntries", 4), "names": table("NameTable", "NumberNames", 4), "ordinals": table("OrdinalTable", "NumberNames", 2), "dll": once(text_at(F.col("e.DLLName")))})
    rows = settled(rows)
    rows = rows.withColumn("texts", once(F.transform("names", lambda a: text_at(a))))
    rows = rows.withColumn("places", once(F.transform("functions", lambda a: place_of(a))))
    rows = rows.select("image_id", "dll", F.col("e.OrdinalBase").alias("base"), "functions", "places", F.arrays_zip("ordinals", "texts").alias("named"))
    found = rows.select("image_id", "dll", "base", F.posexplode(F.arrays_zip("functions", "places")).alias("pos", "x"))
    found = found.select("image_id", "dll", "base", "pos", F.col("x.functions").alias("address"), F.col("x.places.at").alias("at"), F.col("x.places.rest").alias("rest")).where("at is not null")
    names_ = rows.select("image_id", F.posexplode("named").alias("i", "x")).select("image_id", "i", F.col("x.ordinals").alias("ordinal"), F.col("x.texts").alias("name"))
    if pair_by_position:
        names_ = names_.withColumnRenamed("i", "pos")
    else:
        names_ = names_.groupBy("image_id", "ordinal").agg(F.min_by("name", "i").alias("name")).withColumnRenamed("ordinal", "pos")
    following = F.min("address").over(Window.partitionBy("image_id").orderBy("address").rangeBetween(1, Window.unboundedFollowing))
    found = found.withColumn("size", F.coalesce(following - F.col("address"), F.col("rest"))).join(names_, ["image_id", "pos"], "left")
    ordinal = (F.coalesce("ordinal", "pos") if pair_by_position else F.col("pos")) + F.col("base")
    columns = ["image_id", "dll", "pos", ordinal.alias("ordinal"), F.coalesce("name", F.lit("")).alias("name"), "address", "size"]
    if not with_data:
        return found.select(*columns)
    cut = bytes_(content(), F.col("at"), F.least("size", "rest"))
    return found.join(images.select("image_id", "content"), "image_id").select(*columns, cut.alias("data"))


def pe_imports(images: DataFrame) -> DataFrame:
    """image_id, dll_pos, dll, pos, name, hint, ordinal of the imports.

    Descriptors end at one whose import lookup table is 0. Thunks are as wide as the image; the lookup table is
    read where it resolves, else the address table. An import by ordinal is named ``ordinal_N``.
    """
    rows = directory_bytes(images, "IMPORT").withColumn("width", F.when(F.col("magic") == 0x20B, 8).otherwise(4))
    rows = rows.withColumn("rest", once(bytes_at(F.col("base"))))
    table = records(F.col("rest"), F.lit(0), F.floor(F.length("rest") / IMPORTS.size), IMPORTS.size, lambda t, o, i: F.struct(i.alias("pos"), IMPORTS.struct(t, o).alias("v")))
    rows = rows.select("image_id", "content", "sections", "width", once(table).alias("all"))
    stop = F.array_min(F.transform(F.filter("all", lambda d: d["v"]["Characteristics"] == 0), lambda d: d["pos"]))
    rows = rows.withColumn("d", once(F.slice("all", F.lit(1), F.coalesce(stop, F.size("all"))))).drop("all")
    source = lambda d: F.coalesce(place_of(d["v"]["Characteristics"]), place_of(d["v"]["FirstThunk"]))
    rows = rows.withColumns({"source": once(F.transform("d", source)), "dlls": once(F.transform("d", lambda d: text_at(d["v"]["DllName"])))})
    rows = rows.withColumn("thunks", pointer_lists("content", F.transform("source", lambda p: p["at"]), F.transform("source", lambda p: p["rest"]), "width"))
    named = F.transform("thunks", lambda row: F.transform(row, lambda v: F.struct(v.alias("v"), F.when(v >= 0, text_at(v, 2)).alias("text"), F.when(v >= 0, uint(content(), place_of(v)["at"], 2)).alias("hint"))))
    rows = rows.select("image_id", "width", F.posexplode(F.arrays_zip("dlls", named.alias("named"))).alias("dll_pos", "x"))
    rows = rows.select("image_id", "width", "dll_pos", F.col("x.dlls").alias("dll"), F.posexplode("x.named").alias("pos", "y"))
    v = F.col("y.v")
    ordinal = F.when(v < 0, F.when(F.col("width") == 8, v - F.lit(-(1 << 63))).otherwise(v + F.lit(1 << 31)))
    return rows.select("image_id", "dll_pos", "dll", "pos", F.when(v < 0, F.concat(F.lit("ordinal_"), ordinal.cast("string"))).otherwise(F.col("y.text")).alias("name"), F.col("y.hint").alias("hint"), ordinal.alias("ordinal"))


def pe_resources(images: DataFrame) -> DataFrame:
    """image_id, path (a name or number per level), type_id, type_name, offset, size, codepage, data of the resource leaves.

    Levels are followed as deep as they go, each directory once, so a table that points to itself ends.
    Known top-level types have names.
    """
    rows = directory_bytes(images, "RESOURCE").withColumn("leaves", resource_leaves("data"))
    rows = rows.select("image_id", F.inline(F.transform("leaves", lambda x: F.struct(x.alias("leaf"), bytes_at(x["offset"], x["size"]).alias("data")))))
    rows = rows.select("image_id", "leaf.*", "data")
    kind = name_of(F.col("type_id"), "PE_RESOURCE")
    path = F.transform("path", lambda p, i: F.when((i == 0) & kind.isNotNull(), kind).otherwise(p))
    return rows.select("image_id", path.alias("path"), "type_id", kind.alias("type_name"), "offset", "size", "codepage", "data")


#: Readers of directories by name; a reader gets images and returns a DataFrame with image_id.
DIRECTORIES: dict[str, Callable[[DataFrame], DataFrame]] = {"EXPORT": pe_exports, "IMPORT": pe_imports, "RESOURCE": pe_resources}


def register_directory(name: str, reader: Callable[[DataFrame], DataFrame]) -> None:
    if name not in codes("PE_DIRECTORY"):
        raise KeyError(name)
    DIRECTORIES[name] = reader


def read_directory(images: DataFrame, name: str) -> DataFrame:
    """The registered reader's table, else image_id, base, data of the directory."""
    return DIRECTORIES[name](images) if name in DIRECTORIES else directory_bytes(images, name).select("image_id", "base", "data")
