"""Offsets of records whose place depends on the records before: small per-image helpers, bounded by the image."""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

__all__ = ["chain", "chains", "directory_order", "member_offsets", "pointer_lists", "record_offsets", "resource_items", "resource_leaves", "stream_headers"]

#: Images whose values a worker holds as Python objects at once.
SLICE = 64


def _members(content: bytes | None) -> list[int]:
    out, at = [], 8
    while content is not None and at + 60 <= len(content):
        try:
            size = int(content[at + 48 : at + 58].decode("ascii").strip() or "0")
        except ValueError:
            break
        if size < 0:
            break
        out.append(at)
        at += 60 + size
        at += at & 1
    return out


def _records(content: bytes | None, start: int | None, count: int | None, size_at: int, size_width: int, extra: int, big: bool | None) -> list[int]:
    """Starts of ``count`` records; a record holds its size, to which ``extra`` is added."""
    out, at = [], start
    while content is not None and at is not None and len(out) < (count if count is not None else len(content)):
        field = content[at + size_at : at + size_at + size_width]
        if len(field) < size_width:
            break
        size = int.from_bytes(field, "big" if big else "little") + extra
        if size < size_at + size_width or at + size > len(content):
            break
        out.append(at)
        at += size
    return out


def _chain(following: list[int] | None, start: int | None, most: int = 1 << 62) -> list[int]:
    out, seen = [], set()
    while len(out) < most and following is not None and start is not None and 0 <= start < len(following) and start not in seen:
        seen.add(start)
        out.append(start)
        start = following[start]
    return out


def _chains(table: bytes | None, starts: list[int] | None, sizes: list[int] | None, low: int, high: int, piece: int) -> list[np.ndarray]:
    following = np.frombuffer(table or b"", "<i4", len(table or b"") // 4).tolist()
    return [np.array(_chain(following, s, -(-n // piece)) if low <= n < high else [], np.int32) for s, n in zip(starts or (), sizes or (), strict=True)]


def _sector_table(content: bytes, unit: int, first: int, count: int) -> list[int]:
    """Ids of the sectors that hold the table: 109 in the header, the rest in a chain whose sectors end in the next id."""
    ids, seen = list(struct.unpack("<109i", content[76:512])) if len(content) >= 512 else [], set()
    while count > 0 and first not in seen and (first + 2) * unit <= len(content):
        seen.add(first)
        *more, first = struct.unpack_from(f"<{unit // 4 - 1}iI", content, (first + 1) * unit)
        ids += more
        count -= 1
    while ids and ids[-1] == -1:
        ids.pop()
    return ids


def _directory_order(left: list[int] | None, right: list[int], child: list[int]) -> list[dict | None]:
    out: list[dict | None] = [None] * len(left or ())
    todo, visit = [(0, [])], 0
    while todo:
        i, parents = todo.pop()
        if 0 <= i < len(out) and out[i] is None:
            path = [*parents, i]
            out[i] = {"visit": visit, "path": path}
            visit += 1
            todo += [(child[i], path), (right[i], parents), (left[i], parents)]
    return out


def _pointers(content: bytes, places: list[int | None], rests: list[int | None], width: int) -> list[list[int]]:
    out = []
    for start, rest in zip(places or (), rests or (), strict=True):
        values: list[int] = []
        if start is not None:
            for at in range(start, min(start + rest, len(content)) - width + 1, width):
                value = int.from_bytes(content[at : at + width], "little", signed=True)
                if not value:
                    break
                values.append(value)
        out.append(values)
    return out


def _leaves(data: bytes | None) -> list[dict]:
    out: list[dict] = []

    def number(at: int, n: int) -> int | None:
        return int.from_bytes(data[at : at + n], "little") if 0 <= at and at + n <= len(data) else None

    def entries(at: int, path: list[str], kind: int | None) -> list[tuple[int, list[str], int | None]]:
        counts, found = (number(at + 12, 2), number(at + 14, 2)), []
        for i in range(sum(counts) if None not in counts else 0):
            u0, u1 = number(at + 16 + 8 * i, 4), number(at + 20 + 8 * i, 4)
            if u0 is None or u1 is None:
                break
            label = str(u0)
            if u0 >> 31:
                size = number(u0 & 0x7FFFFFFF, 2) or 0
                label = data[(u0 & 0x7FFFFFFF) + 2 : (u0 & 0x7FFFFFFF) + 2 + 2 * size].decode("utf-16le", "replace")
            found.append((u1, [*path, label], kind if path else None if u0 >> 31 else u0))
        return found

    if data is None:
        return out
    todo, seen = entries(0, [], None)[::-1], {0}
    while todo:
        at, path, kind = todo.pop()
        if at >> 31:
            if (at := at & 0x7FFFFFFF) not in seen:
                seen.add(at)
                todo += entries(at, path, kind)[::-1]
        elif number(at, 4) is not None and number(at + 8, 4) is not None:
            out.append({"path": path, "type_id": kind, "offset": number(at, 4), "size": number(at + 4, 4), "codepage": number(at + 8, 4)})
    return out


def _streams(root: bytes | None) -> list[dict]:
    """Headers of metadata streams: offset, size and a name that is padded to four bytes."""
    out: list[dict] = []
    if root is None or len(root) < 20:
        return out
    at = 16 + int.from_bytes(root[12:16], "little")
    for _ in range(int.from_bytes(root[at + 2 : at + 4], "little")):
        end = root.find(b"\0", at + 12)
        if end < 0:
            break
        offset, size = struct.unpack_from("<II", root, at + 4)
        out.append({"name": root[at + 12 : end].decode("ascii", "replace"), "offset": offset, "size": size})
        at += 8 + (end - at - 12 + 4) // 4 * 4
    return out


def _items(block: bytes | None) -> list[dict]:
    """Names and places of the values of a managed resource block; ends where the block does."""
    if block is None:
        return []
    at = 12

    def number(n: int) -> int:
        nonlocal at
        at += n
        if at > len(block):
            raise EOFError
        return int.from_bytes(block[at - n : at], "little")

    def text(charset: str) -> str:
        nonlocal at
        size, shift = 0, 0
        while (byte := number(1)) & 0x80:
            size, shift = size | (byte & 0x7F) << shift, shift + 7
        size |= byte << shift
        at += size
        if at > len(block):
            raise EOFError
        return block[at - size : at].decode(charset, "replace")

    out: list[dict] = []
    try:
        text("utf-8"), text("utf-8"), number(4)
        count = number(4)
        for _ in range(number(4)):
            text("utf-8")
        at += -at % 8 + 8 * count
        start = number(4)
        for _ in range(count):
            name = text("utf-16le")
            out.append({"name": name, "at": start + number(4)})
    except EOFError:
        pass
    return out


def _each(one: Callable, kind: T.DataType):
    """A function of one image's values as a UDF. A batch holds thousands of images; only a few of them are Python objects at a time.

    It is marked so that no projection above repeats it or moves it into a lambda, where no UDF can run.
    """
    arrow = to_arrow_type(kind)

    def run(*columns: pa.Array) -> pa.Array:
        parts = [pa.array([one(*row) for row in zip(*(c.slice(at, SLICE).to_pylist() for c in columns), strict=True)], arrow) for at in range(0, len(columns[0]), SLICE)]
        return pa.concat_arrays(parts) if parts else pa.array([], arrow)

    run.__name__ = one.__name__
    return F.arrow_udf(run, kind).asNondeterministic()


_LONGS = T.ArrayType(T.LongType())
#: Pointers of a width from each file offset up to the first zero, signed: content, offsets, bytes there, width.
pointer_lists = _each(_pointers, T.ArrayType(_LONGS))
#: Leaves of a resource tree; a directory is entered once.
resource_leaves = _each(_leaves, T.ArrayType(T.StructType([T.StructField("path", T.ArrayType(T.StringType())), T.StructField("type_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("size", T.LongType()), T.StructField("codepage", T.LongType())])))
#: Header offsets of the members of a static-link archive.
member_offsets = _each(_members, T.ArrayType(T.LongType()))
#: Offsets of size-prefixed records: content, start, count or null, place and width of the size, bytes to add, big-endian.
record_offsets = _each(_records, T.ArrayType(T.LongType()))
#: Ids of a linked list: the follower of each id, and the first id. Ends at an id outside, or that was met before.
chain = _each(_chain, T.ArrayType(T.IntegerType()))
#: Sectors of several streams: bytes of the table of links, first ids, sizes, least and limit of the sizes wanted, bytes a link stands for.
chains = _each(_chains, T.ArrayType(T.ArrayType(T.IntegerType())))
#: Place in the walk (node, left, right, children) and path, as ids from the root, of each entry: left, right and child ids.
directory_order = _each(_directory_order, T.ArrayType(T.StructType([T.StructField("visit", T.IntegerType()), T.StructField("path", T.ArrayType(T.IntegerType()))])))
#: Metadata streams of a CLR root.
stream_headers = _each(_streams, T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("size", T.LongType())])))
#: Entries of a managed resource block: name and place of the value.
resource_items = _each(_items, T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("at", T.LongType())])))
