"""Queries over images packed from parts: PE, COFF, CLR, Mach-O, compound documents and the further tables of ELF.

The builders are Column expressions over the parts of one image, sorted by key; positions are sums of the sizes before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codecs import settled
from ..functions.pack import joined, pack_text, pack_uleb128
from ..operators import cfb, clr, elf, mach, pe
from .base import image_of_part, number, query, read, zeros

__all__ = ["cfb_images", "clr_images", "elf_linked_images", "mach_images", "packed_parts", "pe_images"]

BASE, RAW = 0x1000, 0x200


def packed_parts(spark: SparkSession, sf_dir: str, sizes: dict[str, Column], *columns: str) -> DataFrame:
    """image_id, x (its parts by key: the columns and, for each of ``sizes``, the sum over the parts before) and the sums over all."""
    part = read(spark, sf_dir, "part", "p_partkey", "p_brand", *columns).withColumn("image_id", image_of_part())
    w = Window.partitionBy("image_id").orderBy("p_partkey")
    for name, size in sizes.items():
        part = part.withColumn(f"{name}_size", size).withColumn(name, F.sum(f"{name}_size").over(w) - F.col(f"{name}_size"))
    x = F.array_sort(F.collect_list(F.struct("p_partkey", *columns, *sizes))).alias("x")
    return part.groupBy("image_id").agg(x, *(F.sum(f"{n}_size").alias(f"{n}_all") for n in sizes))


def each(one: Callable[[Column], Column]) -> Column:
    """The bytes of ``one`` for every part of the image, one after the other."""
    return joined(F.transform("x", one))


def labelled(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix), key.cast("string"))


def label_size(prefix: str, more: int = 1) -> Column:
    return F.length(labelled(prefix, F.col("p_partkey"))) + more


def pe_wrap(body: Column, directories: dict[int, tuple[Column | int, Column | int]]) -> Column:
    """A 64-bit image with the body as its only section at RVA 0x1000, file offset 0x200."""
    opt = [number(0x20B, 2), number(14, 1), number(0, 1), *(number(v, 4) for v in (1, 2, 3, BASE, BASE)), number(1 << 32, 8), number(BASE, 4), number(RAW, 4), number(6, 2), zeros(6), number(6, 2), zeros(6), number(0x3000, 4), number(RAW, 4), zeros(4), number(3, 2), number(0x8160, 2), *(number(v, 8) for v in (1, 2, 3, 4)), zeros(4), number(16, 4)]
    opt += [number(v, 4) for i in range(16) for v in directories.get(i, (0, 0))]
    head = [F.lit(b"MZ".ljust(60, b"\0") + b"\x40\0\0\0PE\0\0"), number(0x8664, 2), number(1, 2), zeros(12), number(240, 2), number(0x22, 2), *opt]
    size = F.length(body)
    section = [F.lit(b".text\0\0\0"), number(size, 4), number(BASE, 4), number(size, 4), number(RAW, 4), zeros(12), number(0x60500020, 4)]
    used = 68 + 20 + 240 + 40
    return F.concat(*head, *section, zeros(RAW - used), body)


def pe_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image per brand and range of keys: each part is an exported function of p_size bytes and an import of hint p_size."""
    parts = packed_parts(spark, sf_dir, {"code": F.col("p_size"), "name": label_size("f"), "hint": label_size("i", 3)}, "p_size")
    n = F.size("x")
    names = 40 + 10 * n
    dll = names + F.col("name_all")
    imports = dll + 7
    hints = imports + 40 + 8 * (n + 1)
    lib = hints + F.col("hint_all")
    code = lib + 6
    export = [zeros(12), number(BASE + dll, 4), number(1, 4), number(n, 4), number(n, 4), number(F.lit(BASE + 40), 4), number(BASE + 40 + 4 * n, 4), number(BASE + 40 + 8 * n, 4)]
    tables = [each(lambda p: number(BASE + code + p["code"], 4)), each(lambda p: number(BASE + names + p["name"], 4)), joined(F.transform("x", lambda p, i: number(i, 2)))]
    heap = [each(lambda p: pack_text(labelled("f", p["p_partkey"]), end=True)), F.lit(b"me.dll\0")]
    descriptor = [number(BASE + imports + 40, 4), zeros(8), number(BASE + lib, 4), number(BASE + imports + 40, 4), zeros(20)]
    thunks = [each(lambda p: number(BASE + hints + p["hint"], 8)), zeros(8), each(lambda p: F.concat(number(p["p_size"], 2), pack_text(labelled("i", p["p_partkey"]), end=True))), F.lit(b"d.dll\0")]
    body = F.concat(*export, *tables, *heap, *descriptor, *thunks, F.unhex(F.repeat(F.lit("CC"), F.col("code_all").cast("int"))))
    made = settled(parts.select("image_id", body.alias("body"), (BASE + imports).alias("imports")))
    return made.select("image_id", pe_wrap(F.col("body"), {0: (BASE, 40), 1: (F.col("imports"), 40)}).alias("content"))


@query("SELECT IMAGE AS image_id, 'f' || p_partkey AS name, row_number() OVER (PARTITION BY IMAGE ORDER BY p_partkey) AS ordinal, p_size AS size FROM part")
def pe_exports_of_parts(spark, sf_dir):
    return pe.pe_exports(pe_images(spark, sf_dir)).select("image_id", "name", F.col("ordinal").cast("bigint").alias("ordinal"), F.col("size").cast("int").alias("size"))


@query("SELECT IMAGE AS image_id, 'd.dll' AS dll, 'i' || p_partkey AS name, row_number() OVER (PARTITION BY IMAGE ORDER BY p_partkey) - 1 AS pos, p_size AS hint FROM part")
def pe_imports_of_parts(spark, sf_dir):
    return pe.pe_imports(pe_images(spark, sf_dir)).select("image_id", "dll", "name", F.col("pos").cast("bigint").alias("pos"), F.col("hint").cast("int").alias("hint"))


@query("SELECT DISTINCT IMAGE AS image_id, '.text' AS name, 4096 AS va, 512 AS raw, true AS x, false AS w FROM part")
def pe_sections_of_parts(spark, sf_dir):
    return pe.pe_sections(pe_images(spark, sf_dir)).select("image_id", F.col("Name").alias("name"), F.col("VirtualAddress").cast("int").alias("va"), F.col("PointerToRawData").cast("int").alias("raw"), "x", "w")


@query("SELECT DISTINCT IMAGE AS image_id, pos, name FROM part, (VALUES (0, 'EXPORT'), (1, 'IMPORT')) t(pos, name)")
def pe_directories_of_parts(spark, sf_dir):
    return pe.pe_directories(pe_images(spark, sf_dir)).where("Size > 0").select("image_id", "pos", "name")


@query("SELECT DISTINCT IMAGE AS image_id, 'AMD64' AS machine, 'NT64' AS magic, 1 AS sections FROM part")
def pe_header_of_parts(spark, sf_dir):
    return pe.pe_header(pe_images(spark, sf_dir)).select("image_id", F.col("machine_name").alias("machine"), F.col("magic_name").alias("magic"), F.col("file.NumberOfSections").alias("sections"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS image_id, p_brand AS name, p_size AS size, p_type AS data FROM part")
def coff_sections_of_parts(spark, sf_dir):
    """An object per part, with one section named by its brand."""
    part = read(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size", "p_type")
    body = F.encode("p_type", "UTF-8")
    head = F.concat(number(0x8664, 2), number(1, 2), zeros(16), pack_text(F.col("p_brand"), 8), number(F.col("p_size"), 4), zeros(4), number(F.length(body), 4), number(60, 4), zeros(12), number(0x40000040, 4))
    objects = part.select(F.col("p_partkey").cast("string").alias("image_id"), F.concat(head, body).alias("content"))
    return pe.coff_sections(objects, True).select("image_id", F.substring("Name", 1, 8).alias("name"), F.col("VirtualSize").cast("int").alias("size"), F.decode("data", "UTF-8").alias("data"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS image_id, 'f' || p_partkey AS symbol, p_brand AS module, p_size AS hint FROM part")
def coff_imports_of_parts(spark, sf_dir):
    part = read(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size")
    name = labelled("f", F.col("p_partkey"))
    head = F.concat(number(0, 2), number(0xFFFF, 2), number(0, 2), number(0x14C, 2), zeros(4), number(F.length(name) + F.length("p_brand") + 2, 4), number(F.col("p_size"), 2), zeros(2))
    objects = part.select(F.col("p_partkey").cast("string").alias("image_id"), F.concat(head, pack_text(name, end=True), pack_text(F.col("p_brand"), end=True)).alias("content"))
    return pe.coff_import_symbols(objects).select("image_id", F.col("Symbol").alias("symbol"), F.col("Module").alias("module"), F.col("Value").cast("int").alias("hint"))


def clr_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A managed image per brand and range of keys: a TypeDef named by each part, a Field with its type as signature, a MemberRef to each TypeDef."""
    parts = packed_parts(spark, sf_dir, {"name": label_size("T"), "blob": F.length("p_type") + 1}, "p_size", "p_type")
    n = F.size("x")
    strings = F.concat(zeros(1), each(lambda p: pack_text(labelled("T", p["p_partkey"]), end=True)))
    blobs = F.concat(zeros(1), each(lambda p: F.concat(number(F.length(p["p_type"]), 1), F.encode(p["p_type"], "UTF-8"))))
    guid = F.unhex(F.md5(F.col("image_id").cast("binary")))
    module = F.concat(number(1, 2), number(1, 4), number(1, 2), zeros(4))
    types = joined(F.transform("x", lambda p, i: F.concat(number(p["p_size"], 4), number(p["name"] + 1, 4), zeros(4), zeros(2), number(i + 1, 2), number(1, 2))))
    fields = each(lambda p: F.concat(number(p["p_size"], 2), number(p["name"] + 1, 4), number(p["blob"] + 1, 4)))
    members = joined(F.transform("x", lambda p, i: F.concat(number((i + 1) * 8, 2), number(p["name"] + 1, 4), number(p["blob"] + 1, 4))))
    present = sum(1 << i for i in (0, 2, 4, 10))
    rows = F.concat(number(0, 4), number(2, 1), number(0, 1), number(5, 1), number(1, 1), number(present, 8), zeros(8), number(1, 4), number(n, 4), number(n, 4), number(n, 4), module, types, fields, members)
    streams = {"#~": rows, "#Strings": strings, "#GUID": guid, "#Blob": blobs}
    made = settled(parts.select("image_id", *(v.alias(k) for k, v in streams.items())))
    names = {k: k.encode().ljust(len(k) // 4 * 4 + 4, b"\0") for k in streams}
    at, heads = F.lit(16 + 12 + 4 + sum(8 + len(v) for v in names.values())), []
    for k, name in names.items():
        heads += [number(at, 4), number(F.length(F.col(f"`{k}`")), 4), F.lit(name)]
        at = at + F.length(F.col(f"`{k}`"))
    root = F.concat(F.lit(b"BSJB\1\0\1\0\0\0\0\0\x0c\0\0\0v4.0.30319\0\0\0\0"), number(len(streams), 2), *heads, *(F.col(f"`{k}`") for k in streams))
    made = settled(made.select("image_id", root.alias("root")))
    header = F.concat(number(72, 4), number(2, 2), number(5, 2), number(BASE + 72, 4), number(F.length("root"), 4), number(1, 4), zeros(52))
    made = settled(made.select("image_id", F.concat(header, "root").alias("body")))
    return made.select("image_id", pe_wrap(F.col("body"), {14: (BASE, 72)}).alias("content"))


@query("SELECT IMAGE AS image_id, 'T' || p_partkey AS name, p_size AS flags, rn AS first_field, rn + 1 AS field_end FROM (SELECT *, row_number() OVER (PARTITION BY IMAGE ORDER BY p_partkey) AS rn FROM part)")
def clr_typedefs_of_parts(spark, sf_dir):
    """Texts of the string heap, and a run of rows to the next row's start."""
    out = clr.clr_table(clr_images(spark, sf_dir), "TypeDef")
    return out.select("image_id", "name", F.col("flags").cast("int").alias("flags"), F.col("fields").alias("first_field"), F.col("fields_end").alias("field_end"))


@query("SELECT IMAGE AS image_id, 'T' || p_partkey AS name, p_type AS signature FROM part")
def clr_fields_of_parts(spark, sf_dir):
    """Blobs with their length before them."""
    return clr.clr_table(clr_images(spark, sf_dir), "Field").select("image_id", "name", F.decode("signature", "UTF-8").alias("signature"))


@query("""SELECT image_id, substr(m, 7, 2) || substr(m, 5, 2) || substr(m, 3, 2) || substr(m, 1, 2) || '-' || substr(m, 11, 2) || substr(m, 9, 2) || '-' || substr(m, 15, 2) || substr(m, 13, 2)
|| '-' || substr(m, 17, 4) || '-' || substr(m, 21) AS mvid FROM (SELECT DISTINCT IMAGE AS image_id, md5(IMAGE) AS m FROM part)""")
def clr_modules_of_parts(spark, sf_dir):
    """GUIDs, whose first three groups are little-endian."""
    return clr.clr_table(clr_images(spark, sf_dir), "Module").select("image_id", "mvid")


@query("SELECT IMAGE AS image_id, 'T' || p_partkey AS name, 'TypeDef' AS target, 'T' || p_partkey AS type_name FROM part")
def clr_memberrefs_of_parts(spark, sf_dir):
    """A coded index, joined to the table that it means."""
    images = clr_images(spark, sf_dir)
    refs = clr.clr_table(images, "MemberRef").select("image_id", "name", F.col("clss.table").alias("target"), F.col("clss.row").alias("row"))
    types = clr.clr_table(images, "TypeDef").select("image_id", "row", F.col("name").alias("type_name"))
    return refs.join(types, ["image_id", "row"]).select("image_id", "name", "target", "type_name")


@query("""SELECT image_id, t."table", CASE WHEN t."table" = 'Module' THEN 1 ELSE n END AS "rows", row_size FROM (SELECT IMAGE AS image_id, count(*) AS n FROM part GROUP BY 1),
(VALUES ('Module', 12), ('TypeDef', 18), ('Field', 10), ('MemberRef', 10)) t("table", row_size)""")
def clr_tables_of_parts(spark, sf_dir):
    return clr.clr_table_info(clr_images(spark, sf_dir)).select("image_id", "table", F.col("rows").cast("bigint").alias("rows"), F.col("row_size").cast("int").alias("row_size"))


@query("""SELECT DISTINCT IMAGE AS image_id, 'v4.0.30319' AS version, pos, name FROM part, (VALUES (0, '#~'), (1, '#Strings'), (2, '#GUID'), (3, '#Blob')) t(pos, name)""")
def clr_streams_of_parts(spark, sf_dir):
    return clr.clr_streams(clr_images(spark, sf_dir)).select("image_id", "version", "pos", "name")


def mach_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 64-bit little-endian image per brand and range of keys: a symbol per part, and function starts p_size bytes apart."""
    parts = packed_parts(spark, sf_dir, {"name": label_size("_m")}, "p_size")
    n = F.size("x")
    starts = F.concat(each(lambda p: pack_uleb128(p["p_size"].cast("bigint"))), zeros(3))
    segment = F.concat(number(0x19, 4), number(152, 4), F.lit(b"__TEXT".ljust(16, b"\0")), number(0x1000, 8), number(0x9000, 8), number(0, 8), number(64, 8), number(7, 4), number(5, 4), number(1, 4), zeros(4))
    section = F.concat(F.lit(b"__text".ljust(16, b"\0") + b"__TEXT".ljust(16, b"\0")), number(0x1010, 8), number(8, 8), number(0, 4), number(4, 4), zeros(8), number(0x80000400, 4), zeros(12))
    library = F.concat(number(0xC, 4), number(40, 4), number(24, 4), number(2, 4), number(0x00010203, 4), number(0x00010000, 4), F.lit(b"/usr/x.dylib".ljust(16, b"\0")))
    at = 32 + 152 + 40 + 24 + 16
    names = at + 16 * n
    heap_size = 1 + F.col("name_all")
    symtab = F.concat(number(2, 4), number(24, 4), number(at, 4), number(n, 4), number(names, 4), number(heap_size, 4))
    linked = F.concat(number(0x26, 4), number(16, 4), number(names + heap_size, 4), number(F.length(starts), 4))
    head = F.concat(number(0xFEEDFACF, 4), number(0x01000007, 4), number(3, 4), number(2, 4), number(4, 4), number(at - 32, 4), number(0x85, 4), zeros(4))
    symbols = each(lambda p: F.concat(number(p["name"] + 1, 4), number(0x0F, 1), number(1, 1), zeros(2), number(p["p_partkey"], 8)))
    heap = F.concat(zeros(1), each(lambda p: pack_text(labelled("_m", p["p_partkey"]), end=True)))
    return parts.select("image_id", F.concat(head, segment, section, library, symtab, linked, symbols, heap, starts).alias("content"))


@query("SELECT IMAGE AS image_id, '_m' || p_partkey AS name, p_partkey AS value, 'SECT' AS type, true AS external FROM part")
def mach_symbols_of_parts(spark, sf_dir):
    return mach.mach_symbols(mach_images(spark, sf_dir)).select("image_id", "name", F.col("value").cast("bigint").alias("value"), "type", "external")


@query("SELECT IMAGE AS image_id, 4096 + sum(p_size) OVER (PARTITION BY IMAGE ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS address FROM part")
def mach_function_starts_of_parts(spark, sf_dir):
    return mach.mach_function_starts(mach_images(spark, sf_dir)).select("image_id", F.col("address").cast("bigint").alias("address"))


@query("SELECT DISTINCT IMAGE AS image_id, pos, name FROM part, (VALUES (0, 'SEGMENT_64'), (1, 'LOAD_DYLIB'), (2, 'SYMTAB'), (3, 'FUNCTION_STARTS')) t(pos, name)")
def mach_commands_of_parts(spark, sf_dir):
    return mach.mach_commands(mach_images(spark, sf_dir)).select("image_id", "pos", F.col("cmd_name").alias("name"))


@query("SELECT DISTINCT IMAGE AS image_id, '__TEXT' AS segment, '__text' AS section, 'REGULAR' AS type, true AS x FROM part")
def mach_sections_of_parts(spark, sf_dir):
    images = mach_images(spark, sf_dir)
    segments = mach.mach_segments(images).select("image_id", F.col("pos").alias("segment_pos"), "x")
    out = mach.mach_sections(images).join(segments, ["image_id", "segment_pos"])
    return out.select("image_id", F.col("segname").alias("segment"), F.col("sectname").alias("section"), "type", "x")


@query("SELECT DISTINCT IMAGE AS image_id, '/usr/x.dylib' AS name, 1 AS major, 2 AS minor, 3 AS patch FROM part")
def mach_dylibs_of_parts(spark, sf_dir):
    v = F.col("current_version")
    return mach.mach_dylibs(mach_images(spark, sf_dir)).select("image_id", "name", *(v[x].cast("int").alias(x) for x in ("major", "minor", "patch")))


@query("SELECT IMAGE || '#' || arch AS image_id, cpu, count(*) AS symbols FROM part, (VALUES (0, 'X86_64'), (1, 'ARM_64')) t(arch, cpu) GROUP BY 1, 2")
def fat_symbols_of_parts(spark, sf_dir):
    """Two slices with the same image, named by different processors in the fat header, opened as images of their own."""
    c, size = F.col("content"), F.length("content")
    arch = lambda cpu, at: F.concat(number(cpu, 4, True), zeros(4), number(at, 4, True), number(size, 4, True), zeros(4))
    fat = mach_images(spark, sf_dir).select("image_id", F.concat(F.lit(bytes.fromhex("CAFEBABE")), number(2, 4, True), arch(0x01000007, F.lit(48)), arch(0x0100000C, 48 + size), c, c).alias("content"))
    counted = mach.mach_symbols(mach.fat_images(fat)).groupBy("image_id").agg(F.count("*").alias("symbols"))
    archs = mach.fat_archs(fat).select(F.concat_ws("#", "image_id", F.col("arch_pos").cast("string")).alias("image_id"), F.col("cputype_name").alias("cpu"))
    return counted.join(archs, "image_id").select("image_id", "cpu", "symbols")


def cfb_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compound document per brand and range of keys: a stream per part, in a sector of its own, chained as siblings."""
    parts = packed_parts(spark, sf_dir, {}, "p_type")
    n = F.size("x")
    entries = F.ceil((n + 1) / 4).cast("int")
    tables = F.ceil((entries + n) / 127).cast("int")
    first = tables + entries
    text = lambda t: F.encode(t, "UTF-16LE")

    def entry(name: Column, kind: int, right: Column | int, child: Column | int, start: Column | int, size: Column | int) -> Column:
        return F.concat(F.substring(F.concat(text(name), zeros(64)), 1, 64), number(F.length(text(name)) + 2, 2), number(kind, 1), number(1, 1), number(-1, 4), number(right, 4), number(child, 4), zeros(36), number(start, 4), number(size, 4), zeros(4))

    def stream(p: Column, i: Column) -> Column:
        return entry(labelled("p", p["p_partkey"]), 2, F.when(i + 1 < n, i + 2).otherwise(-1), -1, first + i, F.length(p["p_type"]))

    directory = F.concat(entry(F.lit("Root Entry"), 5, -1, 1, -2, 0), joined(F.transform("x", stream)), joined(F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: i < F.pmod(-(n + 1), F.lit(4))), lambda _: zeros(128))))
    link = lambda i: F.when(i < tables, -3).when(i < first - 1, i + 1).when(i < first + n, -2).otherwise(-1)
    table = joined(F.transform(F.sequence(F.lit(0), tables * 128 - 1), lambda i: number(link(i), 4)))
    listed = joined(F.transform(F.sequence(F.lit(0), F.lit(108)), lambda i: number(F.when(i < tables, i).otherwise(-1), 4)))
    head = F.concat(F.lit(bytes.fromhex("D0CF11E0A1B11AE1") + bytes(16)), number(62, 2), number(3, 2), number(0xFFFE, 2), number(9, 2), number(6, 2), zeros(10), number(tables, 4), number(tables, 4), zeros(4), number(0, 4), number(-2, 4), number(0, 4), number(-2, 4), number(0, 4))
    data = each(lambda p: F.substring(F.concat(F.encode(p["p_type"], "UTF-8"), zeros(512)), 1, 512))
    return parts.select("image_id", F.concat(head, listed, table, directory, data).alias("content"))


@query("SELECT IMAGE AS image_id, 'p' || p_partkey AS name, length(p_type) AS size, p_type AS data FROM part")
def cfb_streams_of_parts(spark, sf_dir):
    return cfb.cfb_streams(cfb_images(spark, sf_dir)).select("image_id", "name", F.col("size").cast("bigint").alias("size"), F.decode("data", "UTF-8").alias("data"))


@query("SELECT IMAGE AS image_id, 'Root Entry/p' || p_partkey AS path, 'UserStream' AS type FROM part UNION ALL SELECT DISTINCT IMAGE, 'Root Entry', 'RootStorage' FROM part")
def cfb_entries_of_parts(spark, sf_dir):
    out = cfb.cfb_entries(cfb_images(spark, sf_dir)).where("visit is not null")
    return out.select("image_id", F.array_join("path", "/").alias("path"), "type")


@query("""SELECT IMAGE AS image_id, 'p' || p_partkey AS name, CASE WHEN p_size % 3 = 0 THEN repeat(p_type || '.', p_size) WHEN p_size % 3 = 1 THEN '' ELSE p_type END AS data FROM part""")
def cfb_write_of_parts(spark, sf_dir):
    """A third of the streams grows over several sectors, a third becomes empty; all are read again from the written images."""
    part = read(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size", "p_type").where("p_size % 3 < 2")
    new = F.when(F.col("p_size") % 3 == 0, F.expr("repeat(concat(p_type, '.'), p_size)")).otherwise(F.lit(""))
    updates = part.select(image_of_part().alias("image_id"), labelled("p", F.col("p_partkey")).alias("name"), F.encode(new, "UTF-8").alias("data"))
    written = cfb.cfb_write(cfb_images(spark, sf_dir), updates)
    return cfb.cfb_streams(written).select("image_id", "name", F.decode("data", "UTF-8").alias("data"))


def elf_linked_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 64-bit big-endian image per brand and range of keys: a dynamic entry and a relocation with addend per part."""
    parts = packed_parts(spark, sf_dir, {}, "p_size")
    n = F.size("x")
    heap = b"\0.rela\0.shstrtab\0"
    be = lambda v, size: number(v, size, True)
    dynamic = each(lambda p: F.concat(be(1, 8), be(p["p_partkey"], 8)))
    rela = each(lambda p: F.concat(be(p["p_partkey"], 8), be(p["p_size"], 4), be(1, 4), be(-p["p_size"], 8)))
    at = F.lit(64 + 56)
    rel_at = at + 16 * n
    str_at = rel_at + 24 * n
    segment = F.concat(be(2, 4), be(6, 4), be(at, 8), be(0, 16 - 8), be(0, 8), be(16 * n, 8), be(16 * n, 8), be(8, 8))
    head = F.concat(F.lit(b"\x7fELF\x02\x02\x01" + bytes(9)), be(3, 2), be(62, 2), be(1, 4), be(0, 8), be(64, 8), be(str_at + len(heap), 8), be(0, 4), be(64, 2), be(56, 2), be(1, 2), be(64, 2), be(3, 2), be(2, 2))
    table = lambda name, kind, offset, size: F.concat(be(name, 4), be(kind, 4), zeros(16), be(offset, 8), be(size, 8), zeros(8), be(1, 8), be(24, 8))
    sections = F.concat(zeros(64), table(1, 4, rel_at, 24 * n), table(7, 3, str_at, F.lit(len(heap))))
    return parts.select("image_id", F.concat(head, segment, dynamic, rela, F.lit(heap), sections).alias("content"))


@query("SELECT IMAGE AS image_id, row_number() OVER (PARTITION BY IMAGE ORDER BY p_partkey) - 1 AS pos, 'DT_NEEDED' AS tag, p_partkey AS value FROM part")
def elf_dynamic_of_parts(spark, sf_dir):
    return elf.elf_dynamic(elf_linked_images(spark, sf_dir)).select("image_id", F.col("pos").cast("bigint").alias("pos"), F.col("tag_name").alias("tag"), F.col("value").cast("bigint").alias("value"))


@query("SELECT IMAGE AS image_id, p_partkey AS off, p_size AS symbol, 'R_AMD64_64' AS type, -p_size AS addend FROM part")
def elf_relocations_of_parts(spark, sf_dir):
    out = elf.elf_relocations(elf_linked_images(spark, sf_dir), True)
    return out.select("image_id", F.col("offset").cast("bigint").alias("off"), F.col("symbol").cast("int").alias("symbol"), F.col("type_name").alias("type"), F.col("addend").cast("int").alias("addend"))


@query("SELECT IMAGE AS image_id, 'DYNAMIC' AS type, 16 * count(*) AS size FROM part GROUP BY 1")
def elf_segments_of_parts(spark, sf_dir):
    return elf.elf_segments(elf_linked_images(spark, sf_dir)).select("image_id", F.col("p_type_name").alias("type"), F.col("p_filesz").cast("bigint").alias("size"))
