"""CLR metadata inside PE images: header, streams, the table directory, the rows of 38 tables, and managed resources.

Widths of heap and table indexes depend on an image's own row counts, so they are columns: ``widths`` holds one number for
each kind of index, and row sizes and offsets are sums over it. Table rows are then cut out at that stride.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codecs import bind, bit_list, bits, bytes_, compressed_int, flag_names, guid, nul_string, once, settled, sint, uint, where_here
from ..functions.enums import codes, name_of
from ..functions.layouts import Layout, records
from .pe import bytes_at, directory_bytes, register_directory
from .relational import coded_index, last_wins
from .walks import resource_items, stream_headers

__all__ = ["CODED", "TABLES", "clr_all_resources", "clr_header", "clr_named", "clr_resources", "clr_streams", "clr_table", "clr_table_info", "row_sizes"]

_DIRS = ("MetaData", "Resources", "StrongNameSignature", "CodeManagerTable", "VTableFixups", "ExportAddressTableJumps", "ManagedNativeHeader")
HEADER = Layout(
    "cb:u32 MajorRuntimeVersion:u16 MinorRuntimeVersion:u16 MetaData_at:u32 MetaData_size:u32 Flags:u32 EntryPoint:u32 "
    + " ".join(f"{d}_at:u32 {d}_size:u32" for d in _DIRS[1:])
)

# Tag bits and target tables of the coded indexes; a blank target is an unused tag.
CODED = {
    "TypeDefOrRef": (2, "TypeDef TypeRef TypeSpec"),
    "HasConstant": (2, "Field Param Property"),
    "HasCustomAttribute": (
        5,
        "MethodDef Field TypeRef TypeDef Param InterfaceImpl MemberRef Module DeclSecurity Property Event StandAloneSig ModuleRef TypeSpec"
        " Assembly AssemblyRef File ExportedType ManifestResource GenericParam GenericParamConstraint MethodSpec",
    ),
    "HasFieldMarshall": (1, "Field Param"),
    "HasDeclSecurity": (2, "TypeDef MethodDef Assembly"),
    "MemberRefParent": (3, "TypeDef TypeRef ModuleRef MethodDef TypeSpec"),
    "HasSemantics": (1, "Event Property"),
    "MethodDefOrRef": (1, "MethodDef MemberRef"),
    "MemberForwarded": (1, "Field MethodDef"),
    "Implementation": (2, "File AssemblyRef ExportedType"),
    "CustomAttributeType": (3, "- - MethodDef MemberRef"),
    "TypeOrMethodDef": (1, "TypeDef MethodDef"),
    "ResolutionScope": (2, "Module ModuleRef AssemblyRef TypeRef"),
}

# Columns of the tables. u16 and u32 are numbers, String, GUID and Blob heap indexes, @T a row of table T,
# @@T the first of a run of rows of T, other names coded indexes.
TABLES = {
    "Module": "generation:u16 name:String mvid:GUID encid:GUID encbaseid:GUID",
    "TypeRef": "scope:ResolutionScope name:String namespce:String",
    "TypeDef": "flags:u32 name:String namespce:String extends:TypeDefOrRef fields:@@Field methods:@@MethodDef",
    "Field": "flags:u16 name:String signature:Blob",
    "MethodDef": "code:u32 implflags:u16 flags:u16 name:String signature:Blob paramlist:@@Param",
    "Param": "flags:u16 sequence:u16 name:String",
    "InterfaceImpl": "clss:@TypeDef interfce:TypeDefOrRef",
    "MemberRef": "clss:MemberRefParent name:String signature:Blob",
    "Constant": "type:u16 parent:HasConstant value:Blob",
    "CustomAttribute": "parent:HasCustomAttribute type:CustomAttributeType value:Blob",
    "FieldMarshal": "parent:HasFieldMarshall native_type:Blob",
    "DeclSecurity": "action:u16 parent:HasDeclSecurity permission_set:Blob",
    "ClassLayout": "packing_size:u16 class_size:u32 parent:@TypeDef",
    "FieldLayout": "offset:u32 field:@Field",
    "StandAloneSig": "signature:Blob",
    "EventMap": "parent:@TypeDef event_list:@@Event",
    "Event": "flags:u16 name:String event_type:TypeDefOrRef",
    "PropertyMap": "parent:@TypeDef property_list:@@Property",
    "Property": "flags:u16 name:String type:Blob",
    "MethodSemantics": "flags:u16 method:@MethodDef association:HasSemantics",
    "MethodImpl": "clss:@TypeDef method_body:MethodDefOrRef method_declaration:MethodDefOrRef",
    "ModuleRef": "name:String",
    "TypeSpec": "signature:Blob",
    "ImplMap": "flags:u16 member_forwarded:MemberForwarded name:String scope:@ModuleRef",
    "FieldRVA": "rva:u32 field:@Field",
    "Assembly": "hashalg:u32 major:u16 minor:u16 build:u16 rev:u16 flags:u32 publickey:Blob name:String culture:String",
    "AssemblyProcessor": "processor:u32",
    "AssemblyOS": "platform:u32 minor:u32 major:u32",
    "AssemblyRef": "major:u16 minor:u16 build:u16 rev:u16 flags:u32 publickey:Blob name:String culture:String hashvalue:Blob",
    "AssemblyRefProcessor": "processor:u32 assembly:@AssemblyRef",
    "AssemblyRefOS": "platform:u32 major:u32 minor:u32 assembly:@AssemblyRef",
    "File": "flags:u32 name:String hash:Blob",
    "ExportedType": "flags:u32 typedef_id:u32 name:String namespce:String implementation:Implementation",
    "ManifestResource": "data:u32 flags:u32 name:String implementation:Implementation",
    "NestedClass": "nested_class:@TypeDef enclosing_class:@TypeDef",
    "GenericParam": "number:u16 flags:u16 owner:TypeOrMethodDef name:String",
    "MethodSpec": "method:MethodDefOrRef instantiation:Blob",
    "GenericParamConstraint": "owner:@GenericParam constraint:TypeDefOrRef",
}
IDS = codes("CLR_TABLE")
HEAPS = ("String", "GUID", "Blob")
_KINDS = [*HEAPS, *(f"@{t}" for t in TABLES), *CODED]


def _columns(table: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in TABLES[table].split()]


def _kind(kind: str) -> str:
    return kind.replace("@@", "@")


def index_widths(heap_sizes: Column, counts: Column) -> Column:
    """Array of the bytes of an index of each kind, from the heap bits and the row counts by table id."""
    rows = lambda t: F.get(counts, F.lit(IDS[t]))
    of = [F.when(bits(heap_sizes, i, 1) == 1, 4).otherwise(2) for i in range(3)]
    of += [F.when(rows(t) > 0xFFFF, 4).otherwise(2) for t in TABLES]
    for tag, targets in CODED.values():
        of.append(F.when(F.greatest(*(rows(t) for t in targets.split() if t != "-"), F.lit(0).cast("bigint")) > 0xFFFF >> tag, 4).otherwise(2))
    return F.array(*of)


def _width(kind: str, widths: Column) -> Column | int:
    return int(kind[1:]) // 8 if kind in ("u16", "u32") else F.get(widths, F.lit(_KINDS.index(_kind(kind))))


def _plus(a: Column | int, b: Column | int) -> Column | int:
    return a + b


def row_sizes(widths: Column) -> Column:
    """Array of the bytes of a row by table id; 0 for ids without a table."""
    of = {IDS[t]: reduce(_plus, (_width(k, widths) for _, k in _columns(t)), 0) for t in TABLES}
    return F.array(*(F.lit(0) + of.get(i, 0) for i in range(64)))


def _opened(images: DataFrame) -> DataFrame:
    """image_id, content, sections, header, root (metadata bytes) and streams of images with a CLR directory and a metadata root."""
    rows = directory_bytes(images, "CLR_DESCRIPTOR").select("image_id", "content", "sections", once(HEADER.struct(F.col("data"))).alias("header"))
    rows = rows.withColumn("root", once(bytes_at(F.col("header.MetaData_at"), F.col("header.MetaData_size"))))
    return where_here(rows, F.substring("root", 1, 4) == F.lit(b"BSJB")).withColumn("streams", stream_headers("root"))


def clr_header(images: DataFrame) -> DataFrame:
    """image_id, the header's fields and flag_names of PE images with a CLR directory, whatever its metadata."""
    rows = directory_bytes(images, "CLR_DESCRIPTOR").select("image_id", once(HEADER.struct(F.col("data"))).alias("h"))
    return rows.select("image_id", "h.*", flag_names(F.col("h.Flags"), codes("CLR_FLAGS")).alias("flag_names"))


def clr_streams(images: DataFrame) -> DataFrame:
    """image_id, version, pos, name, offset, size of the metadata streams; without the BSJB signature there are none."""
    version = F.substring_index(F.decode(bytes_(F.col("root"), 16, uint(F.col("root"), 12, 4)), "UTF-8"), "\x00", 1)
    rows = _opened(images).select("image_id", version.alias("version"), F.posexplode("streams").alias("pos", "s"))
    return rows.select("image_id", "version", "pos", "s.name", "s.offset", "s.size")


def _tables(images: DataFrame) -> DataFrame:
    """Adds the bytes of the table stream and of the heaps, counts and sizes by table id, widths, and where the rows start."""
    rows = _opened(images)

    def stream(name: str) -> Column:
        own = F.get(F.filter("streams", lambda s: s["name"] == name), F.lit(0))
        return once(bind(own, lambda s: bytes_(F.col("root"), s["offset"], s["size"])))

    rows = rows.withColumns({"data": stream("#~"), "String": stream("#Strings"), "GUID": stream("#GUID"), "Blob": stream("#Blob")})
    d = F.col("data")
    rows = where_here(rows, F.length("data") >= 24).drop("root", "streams")
    rows = settled(rows.withColumn("present", once(bit_list(sint(d, 8, 8)))))
    listed = records(d, F.lit(24), F.size("present"), 4, lambda t, o, i: uint(t, o, 4))
    rows = settled(rows.withColumn("listed", once(listed)))
    count = lambda i: F.coalesce(F.get("listed", (F.array_position("present", i) - 1).cast("int")), F.lit(0).cast("bigint"))
    rows = settled(rows.withColumn("counts", once(F.transform(F.sequence(F.lit(0), F.lit(63)), count))))
    rows = settled(rows.withColumn("widths", once(index_widths(uint(d, 6, 1), F.col("counts")))))
    return settled(rows.withColumns({"sizes": row_sizes(F.col("widths")), "first": F.lit(24) + 4 * F.size("present")}))


def _offset(table: int | Column) -> Column:
    """Offset of a table's rows in the stream: the sizes of those before it."""
    before = F.slice(F.zip_with("counts", "sizes", lambda n, s: n * s), F.lit(1), F.lit(table) if isinstance(table, int) else table)
    return F.aggregate(before, F.col("first").cast("bigint"), lambda a, x: a + x)


def clr_table_info(images: DataFrame) -> DataFrame:
    """image_id, table_id, table, rows, row_size, offset of the tables that an image has."""
    own = F.transform("present", lambda i: F.struct(i.alias("table_id"), F.get("counts", i).alias("rows"), F.get("sizes", i).cast("bigint").alias("row_size"), _offset(i).alias("offset")))
    rows = _tables(images).select("image_id", F.inline(once(own)))
    return rows.select("image_id", "table_id", name_of(F.col("table_id"), "CLR_TABLE").alias("table"), "rows", "row_size", "offset")


def _blob(heap: Column, at: Column) -> Column:
    return bind(compressed_int(heap, at), lambda n: bytes_(heap, at + n["size"], n["value"]))


def clr_table(images: DataFrame, table: str) -> DataFrame:
    """image_id, row (from 1) and the columns of one of the 38 tables.

    Heap indexes are resolved (texts, GUIDs, blobs; a zero GUID or blob index is null); a coded index is a struct of
    table and row; ``@@`` columns have the first row of their run and, as ``name_end``, the first row after it.
    """
    i, rows = IDS[table], _tables(images)
    columns = _columns(table)

    def one(t: Column, o: Column, pos: Column) -> Column:
        at, out = o, []
        for name, kind in columns:
            w = _width(kind, F.col("widths"))
            value = uint(t, at, w).cast("bigint") if isinstance(w, int) else bind(at, lambda a, w=w: F.when(w == 4, uint(t, a, 4)).otherwise(uint(t, a, 2).cast("bigint")))
            out.append(value.alias(name))
            at = at + w
        return F.struct((pos + 1).alias("row"), *out)

    raw = records(F.col("data"), _offset(i), F.get("counts", F.lit(i)), F.get("sizes", F.lit(i)), one)
    runs = [(n, k[2:]) for n, k in columns if k.startswith("@@")]
    ends = [F.get("counts", F.lit(IDS[t])).alias(f"{n}_rows") for n, t in runs]

    def resolved(r: Column) -> Column:
        out = [r["row"].alias("row")]
        for name, kind in columns:
            v = r[name]
            if kind == "String":
                v = nul_string(F.col("String"), v)
            elif kind == "GUID":
                v = F.when(v > 0, guid(F.col("GUID"), (v - 1) * 16, little=True))
            elif kind == "Blob":
                v = F.when(v > 0, _blob(F.col("Blob"), v))
            elif kind in CODED:
                tag, targets = CODED[kind]
                v = bind(v, lambda x, tag=tag, targets=targets: coded_index(x, [None if t == "-" else t for t in targets.split()], tag))
            out.append(v.alias(name))
        return F.struct(*out)

    rows = settled(rows.withColumn("raw", raw))
    found = rows.select("image_id", *ends, F.inline(F.transform("raw", resolved)))
    order = Window.partitionBy("image_id").orderBy("row")
    for n, _ in runs:
        found = found.withColumn(f"{n}_end", F.coalesce(F.lead(n).over(order), F.col(f"{n}_rows") + 1)).drop(f"{n}_rows")
    return found


def clr_named(images: DataFrame, table: str) -> DataFrame:
    """The rows of a table that has names, one for each name: the last wins."""
    if "name" not in dict(_columns(table)):
        raise ValueError(f"{table} has no name")
    return last_wins(clr_table(images, table), ["image_id", "name"], "row")


def clr_resources(images: DataFrame) -> DataFrame:
    """image_id, block, block_row, pos, name, text, data of the entries of all managed resource blocks inside the image.

    A block is a manifest resource without implementation that starts with the resource manager's magic; others have no rows. A
    value of tag 1 is a text with its length before it; any other has the bytes, tag included, up to the
    next entry's value, the last one up to the block's end.
    """
    held = _opened(images).select("image_id", once(bytes_at(F.col("header.Resources_at"), F.col("header.Resources_size"))).alias("resources"))
    rows = clr_table(images, "ManifestResource").where("implementation.row = 0").select("image_id", F.col("row").alias("block_row"), F.col("name").alias("block"), F.col("data").alias("at"))
    rows = settled(rows.join(held, "image_id")).withColumn("body", once(bind(F.col("at"), lambda a: bytes_(F.col("resources"), a + 4, uint(F.col("resources"), a, 4)))))
    rows = where_here(rows, uint(F.col("body"), 0, 4) == 0xBEEFCACE).withColumn("items", resource_items("body"))
    b, n = F.col("body"), F.size("items")

    def entry(x: Column, i: Column) -> Column:
        end = F.when(i + 1 < n, F.get("items", i + 1)["at"]).otherwise(F.length(b).cast("bigint"))
        is_text = uint(b, x["at"], 1) == 1
        text = F.decode(bytes_(b, x["at"] + 2, uint(b, x["at"] + 1, 1)), "UTF-8")
        return F.struct(i.alias("pos"), x["name"].alias("name"), F.when(is_text, text).alias("text"), F.when(~is_text, bytes_(b, x["at"], end - x["at"])).alias("data"))

    return rows.select("image_id", "block", "block_row", F.inline(F.transform("items", entry)))


def clr_all_resources(images: DataFrame) -> DataFrame:
    """image_id, name, block, text, data: the entries of all blocks together, later blocks and entries overwriting earlier ones of their name."""
    rows = clr_resources(images).withColumn("order", F.struct("block_row", "pos"))
    return last_wins(rows, ["image_id", "name"], "order").select("image_id", "name", "block", "text", "data")


register_directory("CLR_DESCRIPTOR", clr_header)
