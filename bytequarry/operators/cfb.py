"""Compound documents: header, sector tables, directory entries with their paths, and the bytes of streams.

A sector ``i`` starts at ``(i + 1)`` times the sector size, the header filling the first. Chains end at an id
outside the table or one met before, so damaged and cyclic tables give the part that can be read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codecs import bind, once, settled, sint, uint, where_here
from ..functions.enums import codes, name_of
from ..functions.layouts import Layout, records
from .cfb_edit import rewritten
from .walks import chains, directory_order

__all__ = ["cfb_changed_sectors", "cfb_entries", "cfb_fat", "cfb_find", "cfb_header", "cfb_streams", "cfb_write"]

HEADER = Layout(
    "magic:b8 id:b16 revision:u16 version:u16 byteorder:u16 sector_shift:u16 mini_shift:u16 _unused:b6 num_directory:u32 num_fat:u32"
    " first_directory:u32 _transaction:u32 mini_cutoff:u32 first_mini:u32 num_mini:u32 first_difat:u32 num_difat:u32"
)
ENTRY = Layout("_name:b64 name_size:u16 type_code:u8 colour:u8 left:i32 right:i32 child:i32 guid:b16 flags:u32 creation:u64 modification:u64 start:i32 size:u32 _unused:u32")
STREAM = codes("CFB_TYPE")["UserStream"]
ANY = 1 << 62


def _opened(images: DataFrame) -> DataFrame:
    """image_id, content, h (header), unit and mini (bytes of a sector and of a small one) of compound documents."""
    found = images.where(F.hex(F.substring("content", 1, 8)) == "D0CF11E0A1B11AE1").select("image_id", "content")
    found = found.withColumn("h", once(HEADER.struct(F.col("content"))))
    sizes = (once(F.when(F.col(f"h.{n}_shift").between(2, 20), F.pow(F.lit(2), F.col(f"h.{n}_shift")).cast("int"))).alias(a) for n, a in (("sector", "unit"), ("mini", "mini")))
    return found.select("*", *sizes)


def _joined(data: Column, ids: Column, first: int, unit: Column, pad: str) -> Column:
    """The sectors of these ids one after the other; bytes that are not there are filled with the digit ``pad``."""

    def digits(i: Column) -> Column:
        at = (i.cast("long") + first) * unit
        there = F.when((i >= 0) & (at < F.length(data)), F.hex(F.substring(data, (at + 1).cast("int"), unit)))
        return F.rpad(F.coalesce(there, F.lit("")), 2 * unit, F.lit(pad))

    return F.unhex(F.array_join(F.transform(ids, digits), ""))


def _ids(table: Column) -> Column:
    return records(table, F.lit(0), F.floor(F.length(table) / 4), 4, lambda t, o, i: sint(t, o, 4))


def _table_lists(data: Column, unit: Column, first: Column, count: Column) -> Column:
    """The chain of sectors that list further sectors of the table: each ends in the id of the next, up to ``count`` and to an id met before."""

    def step(met: Column, _: Column) -> Column:
        following = F.when(F.size(met) == 0, first).otherwise(uint(data, (F.element_at(met, -1) + 2) * unit - 4, 4))
        more = lambda n: F.when(~F.array_contains(met, n) & ((n + 2) * unit <= F.length(data)), F.concat(met, F.array(n))).otherwise(met)
        return F.get(F.transform(F.array(following.cast("bigint")), more), F.lit(0))

    most = F.least(count, F.floor(F.length(data) / unit)).cast("int")
    return F.when(most > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), F.array().cast("array<bigint>"), step)).otherwise(F.array().cast("array<bigint>"))


def _tables(images: DataFrame) -> DataFrame:
    """``_opened`` with fat (the bytes of the sector table), the sector ids of both tables and the directory entries.

    The Arrow helpers are given plain columns only: the optimizer would otherwise leave lambdas in their arguments. They get
    the tables, of which a document has 4 bytes a sector, and never the content.
    """
    c = F.col
    df = where_here(_opened(images), c("unit").isNotNull() & c("mini").isNotNull() & c("h.num_difat").isNotNull())
    df = df.withColumn("lists", once(_table_lists(c("content"), c("unit"), c("h.first_difat"), c("h.num_difat"))))
    listed = F.filter(_ids(_joined(c("content"), c("lists"), 1, c("unit"), "F")), lambda _, i: (i + 1) % F.floor(c("unit") / 4) != 0)
    own = F.when(F.length("content") >= 512, _ids(F.substring("content", 77, 436))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("ids", once(F.concat(own, listed)))
    last = F.array_position(F.reverse(F.transform("ids", lambda i: i != -1)), True)  # ids of -1 at the end are none
    df = df.withColumn("difat", once(F.slice("ids", F.lit(1), F.when(last > 0, F.size("ids") - last + 1).otherwise(0).cast("int")))).drop("lists", "ids")
    df = settled(df.withColumn("fat", once(_joined(c("content"), c("difat"), 1, c("unit"), "F"))))
    df = df.withColumn("roots", _chains("fat", F.array(c("h.first_directory"), c("h.first_mini")), F.array(F.lit(ANY - 1), F.lit(ANY - 1)), F.lit(0), F.lit(ANY), F.lit(1)))
    df = df.withColumn("directory", _joined(c("content"), F.get("roots", F.lit(0)), 1, c("unit"), "0"))

    def entry(t: Column, o: Column, i: Column) -> Column:
        def named(v: Column) -> Column:
            length = F.least(F.greatest(v["name_size"] - 2, F.lit(0)), F.lit(64))
            name = F.decode(F.substring(t, (o + 1).cast("int"), length), "UTF-16LE")
            return F.struct(i.alias("idx"), name.alias("name"), *(v[n].alias(n) for n, *_ in ENTRY.fields if not n.startswith("_")))

        return bind(ENTRY.struct(t, o), named)

    df = df.withColumn("entries", records(c("directory"), F.lit(0), F.floor(F.length("directory") / ENTRY.size), ENTRY.size, entry)).drop("directory")
    mini = F.get("roots", F.lit(1))
    return df.withColumn("mini_table", F.slice(mini, F.lit(1), F.least(F.size(mini).cast("long"), c("h.num_mini")).cast("int")))


def _chains(table: str, starts: Column | str, sizes: Column | str, low: Column, high: Column, piece: Column) -> Column:
    starts, sizes = (F.col(x) if isinstance(x, str) else x for x in (starts, sizes))
    return chains(table, starts.cast("array<long>"), sizes.cast("array<long>"), low.cast("long"), high.cast("long"), piece.cast("long"))


def _cut(data: Column, size: Column) -> Column:
    return F.substring(data, F.lit(1), F.least(size, F.lit(2**31 - 1)).cast("int"))


def cfb_header(images: DataFrame) -> DataFrame:
    """The header of each compound document; other images and null content give no row."""
    return _opened(images).select("image_id", "h.*", F.col("unit").alias("sector_size"), F.col("mini").alias("mini_size"))


def cfb_fat(images: DataFrame) -> DataFrame:
    """image_id, mini, id, next: the links of the sector table and of the small sectors' table; negative ids end or mark."""
    c = F.col
    df = _tables(images)
    for name, ids in (("fat", "difat"), ("mini_fat", "mini_table")):
        df = df.withColumn(name, _ids(_joined(c("content"), c(ids), 1, c("unit"), "F")))

    def links(name: str, mini: bool) -> Column:
        return F.transform(name, lambda x, i: F.struct(F.lit(mini).alias("mini"), i.alias("id"), x.alias("next")))

    both = F.concat(links("fat", False), links("mini_fat", True))
    return df.select("image_id", F.inline(both))


def cfb_entries(images: DataFrame) -> DataFrame:
    """Directory entries by place; visit and path (names from the root) are null for entries that no link reaches."""
    df = _tables(images).withColumn("places", directory_order("entries.left", "entries.right", "entries.child"))
    named = lambda path: F.transform(path, lambda i: F.get("entries", i)["name"])
    df = df.withColumn("order", F.transform("places", lambda p: F.struct(p["visit"].alias("visit"), named(p["path"]).alias("path"))))
    df = df.select("image_id", F.inline(F.arrays_zip("entries", "order"))).select("image_id", "entries.*", "order.*")
    return df.withColumn("type", name_of(F.col("type_code"), "CFB_TYPE"))


def cfb_find(images: DataFrame, name: str) -> DataFrame:
    """The first entry of that exact name in each document: node, left, right, then children."""
    found = cfb_entries(images).where((F.col("name") == name) & F.col("visit").isNotNull())
    return found.groupBy("image_id").agg(F.min_by(F.struct(*found.columns[1:]), "visit").alias("e")).select("image_id", "e.*")


def cfb_streams(images: DataFrame) -> DataFrame:
    """image_id, idx, name, size, data of each stream; one below the cutoff lies in small sectors. Missing bytes are zero
    inside a chain, and absent where the chain ends early."""
    c, cutoff = F.col, F.col("h.mini_cutoff")
    df = settled(_tables(images).withColumn("mini_fat", once(_joined(c("content"), c("mini_table"), 1, c("unit"), "F"))))
    root = F.get("entries", F.lit(0))
    large = _chains("fat", "entries.start", "entries.size", cutoff, F.lit(ANY), c("unit"))
    small = _chains("mini_fat", "entries.start", "entries.size", F.lit(0), cutoff, c("mini"))
    of_root = _chains("fat", F.array(root["start"]), F.array(root["size"]), F.lit(0), F.lit(ANY), c("unit"))
    df = df.select("*", large.alias("large"), small.alias("small"), of_root.alias("of_root"))  # together, so that one worker walks them all
    df = df.withColumn("root", F.get("of_root", F.lit(0)))
    df = df.withColumn("mini_data", _cut(_joined(c("content"), c("root"), 1, c("unit"), "0"), root["size"]))

    def stream(x: Column) -> Column:
        e = x["entries"]
        data = F.when(e["size"] < cutoff, _joined(c("mini_data"), x["small"], 0, c("mini"), "0")).otherwise(_joined(c("content"), x["large"], 1, c("unit"), "0"))
        return F.struct(e["idx"].alias("idx"), e["name"].alias("name"), e["size"].alias("size"), _cut(data, e["size"]).alias("data"))

    found = F.filter(F.arrays_zip("entries", "small", "large"), lambda x: x["entries"]["type_code"] == STREAM)
    return df.select("image_id", F.inline(F.transform(found, stream)))


def cfb_write(images: DataFrame, updates: DataFrame) -> DataFrame:
    """image_id and content of all images, with the streams of ``updates`` (image_id, name, data) written.

    A name means the first stream that ``cfb_find`` would give; names that are not there, null names and images without
    updates change nothing. Null data empty a stream; of several updates of one name the greatest bytes win. Streams move
    between small and large sectors by their new size; sectors are freed and taken again, and the tables grow. Images are not changed in place:
    the result is a table, which ``write_images`` saves.
    """
    each = updates.where("name is not null").groupBy("image_id", "name").agg(F.max(F.coalesce("data", F.lit(b""))).alias("data"))
    listed = each.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("name", "data"))).alias("updates"))
    rows = images.select("image_id", "content").join(listed, "image_id", "left")
    is_document = F.hex(F.substring("content", 1, 8)) == "D0CF11E0A1B11AE1"
    rows = rows.withColumn("updates", F.when(is_document, F.col("updates")))
    return rows.groupBy("image_id").applyInArrow(rewritten, T.StructType([rows.schema["image_id"], T.StructField("content", T.BinaryType())]))


def cfb_changed_sectors(before: DataFrame, after: DataFrame) -> DataFrame:
    """image_id, sector of the sectors, the header as -1, that differ between two versions of a document, new ones included."""
    new = after.select("image_id", F.col("content").alias("new"))
    rows = _opened(before).select("image_id", "content", "unit").join(new, "image_id")
    count = F.ceil(F.length("new") / F.col("unit")).cast("int")
    part = lambda c, i: F.substring(c, i * F.col("unit") + 1, F.col("unit"))
    changed = F.filter(F.sequence(F.lit(0), count - 1), lambda i: part(F.col("content"), i) != part(F.col("new"), i))
    return rows.where(F.length("new") > 0).select("image_id", F.explode(F.transform(changed, lambda i: i - 1)).alias("sector"))
