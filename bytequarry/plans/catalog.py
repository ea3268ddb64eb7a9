"""Queries over the driver's tables: each packs rows into bytes or images, decodes them, and has a SQL equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codecs as C
from ..functions.enums import enum_table
from ..functions.layouts import Layout, records
from ..functions.pack import joined, pack_compressed, pack_int, pack_text, pack_uleb128
from ..operators import relational as R
from ..operators.ar import ar_members, ar_symbols
from ..operators.elf import elf_header, elf_sections, elf_symbols
from ..sources.images import sniff
from . import formats  # noqa: F401  (adds the queries over packed images)
from .base import BUCKET, ORACLES, QUERIES, image_of_part, query, read

__all__ = ["ORACLES", "QUERIES"]

@query("SELECT o_orderkey, o_custkey FROM orders")
def struct_u32_le_roundtrip(spark, sf_dir):
    packed = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(F.concat(pack_int(F.col("o_orderkey"), 4), pack_int(F.col("o_custkey"), 4)).alias("b"))
    return packed.select(*(c.alias(n) for n, c in Layout("o_orderkey:u32 o_custkey:u32").read(F.col("b")).items()))


@query("SELECT l_orderkey FROM lineitem")
def struct_u64_be_roundtrip(spark, sf_dir):
    packed = read(spark, sf_dir, "lineitem", "l_orderkey").select(pack_int(F.col("l_orderkey"), 8, True).alias("b"))
    return packed.select(C.uint(F.col("b"), 0, 8, True).cast("bigint").alias("l_orderkey"))


@query("SELECT l_orderkey, -l_linenumber AS negative FROM lineitem")
def struct_signed_i32(spark, sf_dir):
    packed = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber").select("l_orderkey", pack_int(-F.col("l_linenumber"), 4).alias("b"))
    return packed.select("l_orderkey", C.sint(F.col("b"), 0, 4).alias("negative"))


@query("SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) / 8 AS eighth FROM orders")
def float64_decode(spark, sf_dir):
    """An IEEE double is built from the bits of a multiple of 1/8, then decoded."""
    key = F.col("o_orderkey")
    exponent = F.floor(F.log2(key.cast("double"))).cast("bigint")
    mantissa = F.expr("shiftleft(o_orderkey, cast(52 - floor(log2(cast(o_orderkey as double))) as int))").bitwiseAND(F.lit((1 << 52) - 1))
    raw = F.when(key == 0, F.lit(0).cast("bigint")).otherwise((exponent - 3 + 1023) * F.lit(1 << 52) + mantissa)
    packed = read(spark, sf_dir, "orders", "o_orderkey").select("o_orderkey", pack_int(raw, 8).alias("b"))
    return packed.select("o_orderkey", C.float64(F.col("b"), 0).alias("eighth"))


@query("""SELECT CASE WHEN doc_id % 4 = 0 THEN 'ar' WHEN doc_id % 4 = 1 THEN 'elf' WHEN doc_id % 4 = 2 THEN 'pe' END AS format, count(*) AS n
FROM documents GROUP BY 1""")
def magic_sniff(spark, sf_dir):
    magic = F.element_at(F.array(F.lit(b"!<arch>\n"), F.lit(b"\x7fELF"), F.lit(b"MZ"), F.lit(b"")), F.pmod("doc_id", F.lit(4)).cast("int") + 1)
    images = read(spark, sf_dir, "documents", "doc_id").select("doc_id", F.concat(magic, F.lit(b"zz")).alias("content"))
    return sniff(images).groupBy("format").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_name FROM part")
def nul_string_heap(spark, sf_dir):
    """Names in one heap per brand and range of keys, found again by offset."""
    part = read(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand").withColumn("image_id", image_of_part())
    w = Window.partitionBy("image_id").orderBy("p_partkey")
    placed = part.withColumn("size", F.octet_length("p_name") + 1).withColumn("offset", F.sum("size").over(w) - F.col("size"))
    heaps = R.ordered_concat(placed.withColumn("b", pack_text(F.col("p_name"), end=True)), ["image_id"], "p_partkey", "b", "heap", binary=True)
    return placed.join(heaps, "image_id").select("p_partkey", C.nul_string(F.col("heap"), F.col("offset")).alias("p_name"))


@query("SELECT c_custkey, c_name FROM customer")
def utf16_string(spark, sf_dir):
    packed = read(spark, sf_dir, "customer", "c_custkey", "c_name").select("c_custkey", F.concat(pack_int(F.length("c_name"), 2), pack_text(F.col("c_name"), charset="UTF-16LE")).alias("b"))
    return packed.select("c_custkey", C.prefixed_string(F.col("b"), 0, 2, "UTF-16LE", 2)["value"].alias("c_name"))


def ar_images(spark: SparkSession, sf_dir: str, long_names: bool = False, index: bool = False) -> DataFrame:
    """One archive per brand and range of keys: a member per part, named by its key, with its type as body."""
    part = read(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_brand").withColumn("image_id", image_of_part())
    size = lambda b: F.octet_length(b)

    def member(name, body):
        head = F.concat(F.rpad(name, 16, " "), F.rpad(F.lit("0"), 12, " "), F.rpad(F.lit("1"), 6, " "), F.rpad(F.lit("2"), 6, " "), F.rpad(F.lit("644"), 8, " "), F.rpad(size(body).cast("string"), 10, " "), F.lit("`\n"))
        return F.concat(F.encode(head, "UTF-8"), body, F.when(size(body) % 2 == 1, F.lit(b"\n")).otherwise(F.lit(b"")))

    full = F.concat(F.col("p_name"), F.lit("_"), F.lpad(F.col("p_partkey").cast("string"), 12, "0"))
    w = Window.partitionBy("image_id").orderBy("p_partkey")
    part = part.withColumn("full", full).withColumn("at", F.sum(F.octet_length("full") + 2).over(w) - F.octet_length("full") - 2)
    name = F.concat(F.lit("/"), F.col("at").cast("string")) if long_names else F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit("/"))
    rows = part.select("image_id", "p_partkey", F.hex(member(name, F.encode("p_type", "UTF-8"))).alias("m"), "full")
    packed = rows.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "m", "full"))).alias("x"))
    body = F.unhex(F.array_join(F.col("x.m"), ""))
    heap = F.encode(F.array_join(F.transform("x.full", lambda f: F.concat(f, F.lit("/\n"))), ""), "UTF-8")
    front = member(F.lit("//"), heap) if long_names else F.lit(b"")
    if index:
        symbols = F.concat(pack_int(F.size("x"), 4, True), joined(F.transform("x.p_partkey", lambda k: pack_int(k, 4, True))), joined(F.transform("x.full", lambda f: pack_text(f, end=True))))
        front = F.concat(member(F.lit("/"), symbols), front)
    return packed.select("image_id", F.concat(F.lit(b"!<arch>\n"), front, body).alias("content"))


@query("SELECT IMAGE AS image_id, count(*) AS members, sum(length(p_type)) AS bytes FROM part GROUP BY 1")
def ar_brand_totals(spark, sf_dir):
    return ar_members(ar_images(spark, sf_dir)).groupBy("image_id").agg(F.count("*").alias("members"), F.sum("size").alias("bytes"))


@query("SELECT IMAGE AS image_id, row_number() OVER (PARTITION BY IMAGE ORDER BY p_partkey) - 1 AS pos, 'p' || p_partkey AS name, length(p_type) AS size, 420 AS mode, p_type AS body FROM part")
def ar_member_list(spark, sf_dir):
    return ar_members(ar_images(spark, sf_dir)).select("image_id", F.col("pos").cast("bigint").alias("pos"), "name", "size", F.col("mode").cast("int").alias("mode"), F.decode("contents", "UTF-8").alias("body"))


@query("SELECT IMAGE AS image_id, p_name || '_' || lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS name, p_type AS body FROM part")
def ar_long_names(spark, sf_dir):
    return ar_members(ar_images(spark, sf_dir, long_names=True)).select("image_id", "name", F.decode("contents", "UTF-8").alias("body"))


@query("SELECT IMAGE AS image_id, p_name || '_' || lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS symbol, p_partkey AS off FROM part")
def ar_symbol_index(spark, sf_dir):
    return ar_symbols(ar_images(spark, sf_dir, index=True)).where("index_kind = 'Symbols'").select("image_id", "symbol", F.col("offset").alias("off"))


@query("SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'NONE' WHEN 'N' THEN 'REL' WHEN 'R' THEN 'EXEC' END AS name FROM lineitem")
def enum_dim_join(spark, sf_dir):
    coded = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag").withColumn("code", F.array_position(F.array(F.lit("A"), F.lit("N"), F.lit("R")), F.col("l_returnflag")) - 1)
    return R.dimension(coded, enum_table(spark), "ELF_ET", "code", "name").select("l_orderkey", "l_linenumber", "name")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CASE o_orderkey % 3 WHEN 0 THEN 'ARM_ALL' END
ELSE CASE o_orderkey % 3 WHEN 0 THEN 'VAX_ALL' WHEN 1 THEN 'VAX780' ELSE 'VAX785' END END AS name FROM orders""")
def composite_domain_join(spark, sf_dir):
    coded = read(spark, sf_dir, "orders", "o_orderkey").withColumn("code", F.pmod("o_orderkey", F.lit(3)))
    which = F.when(F.col("o_orderkey") % 2 == 0, "MACH_SUB_ARM").otherwise("MACH_SUB_VAX")
    return R.dimension(coded, enum_table(spark), which, "code", "name").select("o_orderkey", "name")


@query("SELECT p_partkey, CAST(b AS INTEGER) AS bit FROM part, range(64) t(b) WHERE (p_partkey >> b) & 1 = 1")
def bitset_explode(spark, sf_dir):
    return read(spark, sf_dir, "part", "p_partkey").select("p_partkey", F.explode(C.bit_list(F.col("p_partkey"))).alias("bit"))


@query("SELECT p_partkey, (p_partkey & 1) = 1 AS x, (p_partkey & 4) = 4 AS r, (p_partkey & 240) >> 4 AS field FROM part")
def flags_struct(spark, sf_dir):
    return read(spark, sf_dir, "part", "p_partkey").select("p_partkey", C.flags(F.col("p_partkey"), {"x": 1, "r": 4, "field": 240}).alias("f")).select("p_partkey", "f.*")


@query("SELECT p_partkey, p_partkey & 15 AS low, (p_partkey >> 4) & 7 AS middle, (p_partkey >> 7) & 511 AS high FROM part")
def bitfields_unpack(spark, sf_dir):
    packed = read(spark, sf_dir, "part", "p_partkey").select("p_partkey", C.uint(pack_int(F.col("p_partkey"), 4), 0, 4).alias("v"))
    return packed.select("p_partkey", C.bits(F.col("v"), 0, 4).alias("low"), C.bits(F.col("v"), 4, 3).alias("middle"), C.bits(F.col("v"), 7, 9).alias("high"))


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1")
def first_match_lookup(spark, sf_dir):
    return R.first_match(read(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey")


@query("""WITH band AS (SELECT s_suppkey, s_suppkey * 3000 AS lo, s_suppkey * 3000 + 7000 AS hi FROM supplier),
point AS (SELECT p_partkey, CAST(floor(p_retailprice * 100) AS BIGINT) AS cents FROM part)
SELECT p_partkey, cents, min(s_suppkey) AS s_suppkey FROM point LEFT JOIN band ON cents >= lo AND cents < hi GROUP BY 1, 2""")
def range_lookup_first_wins(spark, sf_dir):
    bands = read(spark, sf_dir, "supplier", "s_suppkey").select("s_suppkey", (F.col("s_suppkey") * 3000).alias("lo"), (F.col("s_suppkey") * 3000 + 7000).alias("hi"))
    points = read(spark, sf_dir, "part", "p_partkey", "p_retailprice").select("p_partkey", F.floor(F.col("p_retailprice") * 100).cast("bigint").alias("cents"))
    return R.range_lookup(points, bands, "cents", "lo", "hi", "s_suppkey").select("p_partkey", "cents", "s_suppkey")


@query("""WITH d AS (SELECT DISTINCT p_brand, p_size FROM part), g AS (SELECT p_brand, p_size, lead(p_size) OVER (PARTITION BY p_brand ORDER BY p_size) - p_size AS gap FROM d)
SELECT p_partkey, p_brand, p_size, gap FROM part JOIN g USING (p_brand, p_size)""")
def next_distinct_gap(spark, sf_dir):
    return R.next_distinct(read(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size"), ["p_brand"], "p_size")


@query("SELECT p_partkey, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS total FROM part")
def prefix_sum_inclusive(spark, sf_dir):
    return R.prefix_sum(read(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size"), ["p_brand"], ["p_partkey"], "p_size", "total").select("p_partkey", "total")


@query("SELECT p_partkey, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) - p_size AS total FROM part")
def prefix_sum_exclusive(spark, sf_dir):
    return R.prefix_sum(read(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size"), ["p_brand"], ["p_partkey"], "p_size", "total", inclusive=False).select("p_partkey", "total")


@query("""SELECT e.event_id, e.user_id FROM events e LEFT JOIN (SELECT user_id, min(event_id) AS stop FROM events WHERE event_type = 'error' GROUP BY 1) s USING (user_id)
WHERE stop IS NULL OR event_id < stop""")
def sentinel_cutoff(spark, sf_dir):
    events = read(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    return R.until_sentinel(events, ["user_id"], "event_id", F.col("event_type") == "error").select("event_id", "user_id")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS position FROM events")
def chain_walk(spark, sf_dir):
    """Each user's events as a linked list, walked by pointer doubling."""
    events = read(spark, sf_dir, "events", "user_id", "event_id")
    return R.chain_positions(R.slice_to_next(events, ["user_id"], "event_id", "following"), ["user_id"], "event_id", "following")


@query("SELECT p_brand, string_agg(p_name, '' ORDER BY p_partkey) AS names FROM part GROUP BY 1")
def ordered_concat(spark, sf_dir):
    part = read(spark, sf_dir, "part", "p_brand", "p_partkey", "p_name").withColumn("b", F.encode("p_name", "UTF-8"))
    return R.ordered_concat(part, ["p_brand"], "p_partkey", "b", "names", binary=True).select("p_brand", F.decode("names", "UTF-8").alias("names"))


@query("SELECT p_name, max(p_partkey) AS p_partkey, arg_max(p_brand, p_partkey) AS p_brand FROM part GROUP BY 1")
def last_wins_merge(spark, sf_dir):
    return R.last_wins(read(spark, sf_dir, "part", "p_name", "p_partkey", "p_brand"), ["p_name"], "p_partkey")


@query("SELECT o_orderkey, o_custkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS following FROM orders")
def slice_to_next(spark, sf_dir):
    return R.slice_to_next(read(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), ["o_custkey"], "o_orderkey", "following")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'TypeDef' WHEN 1 THEN 'TypeRef' WHEN 2 THEN 'TypeSpec' END AS target, p_partkey // 4 AS row_no FROM part")
def coded_index_split(spark, sf_dir):
    packed = read(spark, sf_dir, "part", "p_partkey").select("p_partkey", C.uint(pack_int(F.col("p_partkey"), 4), 0, 4).alias("v"))
    return packed.select("p_partkey", R.coded_index(F.col("v"), ["TypeDef", "TypeRef", "TypeSpec"], 2).alias("x")).select("p_partkey", F.col("x.table").alias("target"), F.col("x.row").alias("row_no"))


@query("SELECT max(n) > 65535 AS plain, max(n) > 16383 AS coded FROM (SELECT count(*) AS n FROM part UNION ALL SELECT count(*) FROM orders UNION ALL SELECT count(*) FROM supplier)")
def index_width(spark, sf_dir):
    counts = None
    for name, key in (("part", "p_partkey"), ("orders", "o_orderkey"), ("supplier", "s_suppkey")):
        one = read(spark, sf_dir, name, key).agg(F.count("*").alias("n"))
        counts = one if counts is None else counts.union(one)
    top = counts.agg(F.max("n").alias("n"))
    return top.select(R.index_is_wide([F.col("n")]).alias("plain"), R.index_is_wide([F.col("n")], 2).alias("coded"))


@query("SELECT o_custkey, o_orderkey FROM orders")
def uleb128_decode(spark, sf_dir):
    """Sorted keys of each customer as varint gaps, decoded and summed again."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    gaps = read(spark, sf_dir, "orders", "o_custkey", "o_orderkey").withColumn("gap", F.col("o_orderkey") - F.coalesce(F.lag("o_orderkey").over(w), F.lit(0)))
    blobs = R.ordered_concat(gaps.withColumn("b", pack_uleb128(F.col("gap"))), ["o_custkey"], "o_orderkey", "b", "blob", binary=True)
    decoded = blobs.select("o_custkey", F.posexplode(C.uleb128_list(F.col("blob"))).alias("pos", "gap"))
    return R.prefix_sum(decoded, ["o_custkey"], ["pos"], "gap", "o_orderkey").select("o_custkey", "o_orderkey")


@query("SELECT o_orderkey, o_orderkey * 977 % 536870912 AS value FROM orders")
def cv_compressed_int(spark, sf_dir):
    packed = read(spark, sf_dir, "orders", "o_orderkey").select("o_orderkey", pack_compressed(F.col("o_orderkey") * 977 % 536870912).alias("b"))
    return packed.select("o_orderkey", C.compressed_int(F.col("b"))["value"].alias("value"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE -o_orderkey END AS value FROM orders")
def cv_signed(spark, sf_dir):
    coded = F.col("o_orderkey") * 2 + F.when(F.col("o_orderkey") % 2 == 0, 0).otherwise(1)
    return read(spark, sf_dir, "orders", "o_orderkey").select("o_orderkey", C.signed_low_bit(coded).alias("value"))


@query("""SELECT c_custkey, substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21) AS guid
FROM (SELECT c_custkey, md5(CAST(c_custkey AS VARCHAR)) AS m FROM customer)""")
def guid_format(spark, sf_dir):
    return read(spark, sf_dir, "customer", "c_custkey").select("c_custkey", C.guid(F.unhex(F.md5(F.col("c_custkey").cast("string").cast("binary")))).alias("guid"))


@query("SELECT p_brand, p_partkey, p_size FROM part")
def fixed_stride_table(spark, sf_dir):
    """A table of fixed records per brand and range of keys, sliced and exploded again."""
    part = read(spark, sf_dir, "part", "p_brand", "p_partkey", "p_size").withColumn("range", F.floor(F.col("p_partkey") / BUCKET)).withColumn("b", F.concat(pack_int(F.col("p_partkey"), 8), pack_int(F.col("p_size"), 4, True)))
    packed = R.ordered_concat(part, ["p_brand", "range"], "p_partkey", "b", "data", binary=True)
    layout = Layout("p_partkey:i64 p_size:i32be")
    return packed.select("p_brand", F.inline(records(F.col("data"), F.lit(0), F.floor(F.length("data") / layout.size), layout.size, lambda t, o, i: layout.struct(t, o))))


def elf_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 64-bit little-endian object per brand and range of keys: sections .text, .symtab, .strtab, .shstrtab and a symbol per part."""
    part = read(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size").withColumn("image_id", image_of_part())
    name = F.concat(F.lit("f"), F.col("p_partkey").cast("string"))
    w = Window.partitionBy("image_id").orderBy("p_partkey")
    part = part.withColumn("name", name).withColumn("at", F.sum(F.octet_length("name") + 1).over(w) - F.octet_length("name"))
    i = lambda v, n: pack_int(F.lit(v) if isinstance(v, int) else v, n)
    symbol = F.concat(i(F.col("at"), 4), i(0x12, 1), i(0, 1), i(1, 2), i(F.col("p_partkey"), 8), i(F.col("p_size"), 8))
    rows = part.select("image_id", "p_partkey", F.hex(symbol).alias("s"), F.hex(pack_text(F.col("name"), end=True)).alias("n"))
    tables = rows.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "s", "n"))).alias("x"))
    tables = tables.select("image_id", F.concat(F.lit(bytes(24)), F.unhex(F.array_join("x.s", ""))).alias("sym"), F.concat(F.lit(b"\x00"), F.unhex(F.array_join("x.n", ""))).alias("str"))
    heap = b"\0.text\0.symtab\0.strtab\0.shstrtab\0"
    sizes = [F.lit(16), F.length("sym"), F.length("str"), F.lit(len(heap))]
    offsets = [F.lit(64), F.lit(80), F.lit(80) + F.length("sym"), F.lit(80) + F.length("sym") + F.length("str")]
    headers = [F.lit(bytes(64))]
    for k, (label, kind) in enumerate(((b".text", 1), (b".symtab", 2), (b".strtab", 3), (b".shstrtab", 3))):
        headers.append(F.concat(i(heap.index(label + b"\0"), 4), i(kind, 4), i(6 if kind == 1 else 0, 8), i(0, 8), i(offsets[k], 8), i(sizes[k], 8), i(3 if kind == 2 else 0, 4), i(0, 4), i(1, 8), i(24 if kind == 2 else 0, 8)))
    head = F.concat(F.lit(b"\x7fELF\x02\x01\x01" + bytes(9)), i(1, 2), i(62, 2), i(1, 4), i(0, 8), i(0, 8), i(offsets[3] + len(heap), 8), i(0, 4), i(64, 2), i(56, 2), i(0, 2), i(64, 2), i(5, 2), i(4, 2))
    return tables.select("image_id", F.concat(head, F.lit(bytes(16)), "sym", "str", F.lit(heap), *headers).alias("content"))


@query("SELECT IMAGE AS image_id, 'f' || p_partkey AS name, p_partkey AS value, p_size AS size, 'FUNC' AS type, 'GLOBAL' AS binding FROM part")
def elf_symbols_of_parts(spark, sf_dir):
    out = elf_symbols(elf_images(spark, sf_dir))
    return out.select("image_id", "name", F.col("value").cast("bigint").alias("value"), F.col("size").cast("int").alias("size"), "type", "binding")


@query("""SELECT DISTINCT IMAGE AS image_id, pos, name, kind FROM part, (VALUES (0, '', 'NULL'), (1, '.text', 'PROGBITS'), (2, '.symtab', 'SYMTAB'), (3, '.strtab', 'STRTAB'),
(4, '.shstrtab', 'STRTAB')) t(pos, name, kind)""")
def elf_sections_of_parts(spark, sf_dir):
    return elf_sections(elf_images(spark, sf_dir)).select("image_id", "pos", "name", F.col("sh_type_name").alias("kind"))


@query("SELECT DISTINCT IMAGE AS image_id, 'CLASS64' AS file_class, 'AMD64' AS machine, 'REL' AS type, 5 AS sections FROM part")
def elf_header_of_parts(spark, sf_dir):
    return elf_header(elf_images(spark, sf_dir)).select("image_id", "file_class", F.col("e_machine_name").alias("machine"), F.col("e_type_name").alias("type"), F.col("e_shnum").alias("sections"))
