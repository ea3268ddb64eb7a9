"""Static-link archives: members and symbol indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codecs import ascii_int, bytes_, fixed_string, nul_string, remainder, sint, uint
from ..functions.layouts import records
from .walks import member_offsets

__all__ = ["ar_members", "ar_symbols"]

MAGIC = "213C617263683E0A"


def _member(content: Column, at: Column) -> Column:
    field = lambda o, n: F.trim(fixed_string(content, at + o, n))
    size = ascii_int(field(48, 10))
    mark = field(58, 2)
    return F.struct(
        field(0, 16).alias("raw"),
        F.regexp_replace(field(0, 16), "/$", "").alias("name"),
        ascii_int(field(16, 12)).alias("date"),
        ascii_int(field(28, 6)).alias("uid"),
        ascii_int(field(34, 6)).alias("gid"),
        ascii_int(field(40, 8), 8).alias("mode"),
        size.alias("size"),
        F.when(mark == "`", "").otherwise(mark).alias("fmag"),
        F.coalesce(bytes_(content, at + 60, size), remainder(content, at + 60)).alias("contents"),
    )


def _members(images: DataFrame) -> DataFrame:
    """image_id and the array of all members, the long names' too; empty for what is no archive."""
    is_ar = F.substring("content", 1, 8) == F.unhex(F.lit(MAGIC))
    walked = images.select("image_id", "content", F.when(is_ar, member_offsets("content")).otherwise(F.array().cast("array<bigint>")).alias("at"))
    return walked.select("image_id", F.transform("at", lambda o: _member(F.col("content"), o)).alias("members"))


def ar_members(images: DataFrame) -> DataFrame:
    """image_id, pos, name, date, uid, gid, mode, size, fmag, contents of ``images`` (image_id, content).

    Long names (``/N`` into the names member, up to the next ``/`` ) are resolved; the names member is not
    returned. The first and second member of blank name are ``Symbols`` and ``Symbols2``. Numbers that are blank
    are null; a truncated last member has the bytes that are there. Null or other content gives no rows.
    """
    names = F.element_at(F.filter("members", lambda m: m["name"] == "/"), 1)["contents"]
    with_names = _members(images).select("image_id", "members", F.when(F.exists("members", lambda m: m["name"] == "/"), names).alias("names"))
    rows = with_names.select("image_id", "names", F.posexplode(F.filter("members", lambda m: m["name"] != "/")).alias("pos", "m"))
    offset = F.when(F.col("m.name").rlike("^/[0-9]+$"), F.substring("m.name", 2, 16).cast("bigint"))
    long_name = nul_string(F.col("names"), offset, "/")
    rows = rows.withColumn("name", F.coalesce(F.when(offset.isNotNull(), long_name), F.col("m.name")))
    blanks = rows.where("name = ''").groupBy("image_id").agg(F.slice(F.array_sort(F.collect_list("pos")), 1, 2).alias("blank"))
    rows = rows.join(blanks, "image_id", "left")
    index = F.coalesce(F.array_position("blank", F.col("pos")), F.lit(0))
    shown = F.when(index == 1, "Symbols").when(index == 2, "Symbols2").otherwise(F.col("name"))
    return rows.select("image_id", "pos", shown.alias("name"), "m.date", "m.uid", "m.gid", "m.mode", "m.size", "m.fmag", "m.contents")


def _texts(data: Column) -> Column:
    """NUL-terminated texts of the bytes."""
    return F.transform(F.split(F.decode(data, "ISO-8859-1"), "\\x00"), lambda x: F.decode(F.encode(x, "ISO-8859-1"), "UTF-8"))


def ar_symbols(images: DataFrame) -> DataFrame:
    """image_id, index_kind, pos, symbol, offset of the symbol indexes.

    ``Symbols``: big-endian count and offsets, then names. ``Symbols2``: little-endian, offset is the one-based
    member index as stored. ``/SYM``: names, then big-endian offsets after them. ``/SYM64``: 64-bit big-endian.
    """
    data = F.col("contents")
    indexes = ar_members(images).where(F.col("name").isin("Symbols", "Symbols2", "/SYM", "/SYM64")).select("image_id", F.col("name").alias("index_kind"), "contents")
    big = uint(data, 0, 4, True)
    members = uint(data, 0, 4)
    start2 = members * 4 + 4
    count2 = uint(data, start2, 4)
    wide = uint(data, 0, 8, True).cast("bigint")
    ints = lambda at, n, size, order: records(data, at, n, size, lambda t, o, i: sint(t, o, size, order).cast("bigint"))
    plain_names = F.slice(_texts(remainder(data, F.lit(4))), F.lit(1), F.greatest(big.cast("int"), F.lit(0)))
    names_size = F.aggregate(plain_names, F.lit(4).cast("bigint"), lambda a, x: a + F.octet_length(F.encode(x, "UTF-8")) + 1)
    kind = F.col("index_kind")
    offsets = F.when(kind == "Symbols", ints(F.lit(4), big, 4, True)).when(kind == "Symbols2", ints(start2 + 4, count2, 2, False)).when(kind == "/SYM64", records(data, F.lit(8), wide, 8, lambda t, o, i: uint(t, o, 8, True).cast("bigint"))).otherwise(ints(names_size, big, 4, True))
    names = F.when(kind == "Symbols", _texts(remainder(data, 4 + big * 4))).when(kind == "Symbols2", _texts(remainder(data, start2 + 4 + count2 * 2))).when(kind == "/SYM64", _texts(remainder(data, 8 + wide * 8))).otherwise(plain_names)
    pairs = indexes.select("image_id", "index_kind", offsets.alias("offsets"), names.alias("names"))
    pairs = pairs.withColumn("n", F.least(F.size("offsets"), F.size("names")))
    rows = pairs.where("n > 0").select("image_id", "index_kind", F.posexplode(F.arrays_zip(F.slice("names", F.lit(1), F.col("n")).alias("symbol"), F.slice("offsets", F.lit(1), F.col("n")).alias("offset"))).alias("pos", "x"))
    return rows.select("image_id", "index_kind", "pos", "x.symbol", "x.offset")
