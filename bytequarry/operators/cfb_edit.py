"""Writing compound documents: sectors are allocated, freed and linked anew in one image; small per-image helpers."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa

from .walks import _chain, _directory_order, _sector_table

__all__ = ["rewritten"]

FREE, END, TABLE, TABLE_LIST = -1, -2, -3, -4


class Sectors:
    """Sectors of one size with the table of their links; free ones are taken again, the last freed first."""

    def __init__(self, links: list[int], data: bytearray, unit: int):
        self.links, self.data, self.unit = links, data, unit
        self.free = [i for i, x in enumerate(links) if x == FREE][::-1]

    def allocate(self, mark: int = END) -> int:
        i = self.free.pop() if self.free else len(self.links)
        if i == len(self.links):
            self.links.append(mark)
        self.links[i] = mark
        return i

    def release(self, i: int) -> None:
        self.links[i] = FREE
        self.free.append(i)

    def resized(self, start: int, count: int) -> list[int]:
        """The chain from ``start`` with ``count`` sectors: its tail is freed, or new ones are linked to it."""
        chain = _chain(self.links, start)
        while len(chain) > count:
            self.release(chain.pop())
        while len(chain) < count:
            chain.append(self.allocate())
        for a, b in zip(chain, [*chain[1:], END][: len(chain)], strict=True):
            self.links[a] = b
        return chain

    def put(self, i: int, piece: bytes) -> None:
        at = i * self.unit
        if len(self.data) < at + self.unit:
            self.data.extend(bytes(at + self.unit - len(self.data)))
        self.data[at : at + self.unit] = piece.ljust(self.unit, b"\0")

    def load(self, start: int, size: int | None = None) -> bytes:
        out = b"".join(bytes(self.data[i * self.unit : (i + 1) * self.unit]).ljust(self.unit, b"\0") for i in _chain(self.links, start))
        return out if size is None else out[:size]

    def store(self, start: int, data: bytes) -> int:
        """Writes a stream over the chain from ``start``; the start of the chain, END for no bytes."""
        chain = self.resized(start, -(-len(data) // self.unit))
        for k, i in enumerate(chain):
            self.put(i, data[k * self.unit : (k + 1) * self.unit])
        return chain[0] if chain else END


def _ints(data: bytes) -> list[int]:
    return list(struct.unpack(f"<{len(data) // 4}i", data[: len(data) // 4 * 4]))


def _bytes(numbers: list[int], unit: int) -> bytes:
    return struct.pack(f"<{len(numbers)}i", *numbers) + b"\xff" * (-4 * len(numbers) % unit)


def _rewritten(content: bytes | None, updates: list[dict] | None) -> bytes | None:
    """The document with new bytes for the first stream of each name; names without a stream change nothing."""
    if content is None or not updates or len(content) < 512:
        return content
    head = bytearray(content[:512])
    shift, mini_shift = struct.unpack_from("<HH", head, 30)
    if not (7 <= shift <= 20 and 2 <= mini_shift <= shift):
        return content
    unit, (first_directory, _, cutoff, first_mini, _, first_list, n_lists) = 1 << shift, struct.unpack_from("<iiIiiiI", head, 48)
    ids = _sector_table(content, unit, first_list & 0xFFFFFFFF, n_lists)
    body = bytearray(content[unit:])
    big = Sectors(_ints(b"".join(bytes(body[max(i, 0) * unit : (max(i, 0) + 1) * unit]).ljust(unit, b"\xff") for i in ids)), body, unit)
    entries = bytearray(big.load(first_directory))
    count = len(entries) // 128
    field = lambda i, at, kind: struct.unpack_from("<" + kind, entries, 128 * i + at)[0]
    names = [bytes(entries[128 * i : 128 * i + max(0, min(field(i, 64, "H") - 2, 64))]).decode("utf-16le", "replace") for i in range(count)]
    if not count:
        return content
    small = Sectors(_ints(big.load(first_mini)), bytearray(big.load(field(0, 116, "i"), field(0, 120, "I"))), 1 << mini_shift)
    order = _directory_order(*([field(i, at, "i") for i in range(count)] for at in (68, 72, 76)))
    found: dict[str, int] = {}
    for i in sorted((i for i in range(count) if order[i] is not None and field(i, 66, "B") == 2), key=lambda i: order[i]["visit"]):
        found.setdefault(names[i], i)
    for x in updates:
        i, data = found.get(x["name"]), bytes(x["data"] or b"")
        if i is None:
            continue
        start, size = field(i, 116, "i"), field(i, 120, "I")
        old, new = (small if n < cutoff else big for n in (size, len(data)))
        if old is not new:
            old.resized(start, 0)
            start = END
        struct.pack_into("<iI", entries, 128 * i + 116, new.store(start, data), len(data))
    struct.pack_into("<iI", entries, 116, big.store(field(0, 116, "i"), bytes(small.data)), len(small.data))
    links = _bytes(small.links, unit)
    first_mini = big.store(first_mini, links)
    first_directory = big.store(first_directory, bytes(entries))
    each = unit // 4
    lists = _chain_of_lists(body, unit, first_list, n_lists)
    while len(ids) * each < len(big.links) or 109 + len(lists) * (each - 1) < len(ids):
        if len(ids) * each < len(big.links):
            ids.append(big.allocate(TABLE))
        else:
            lists.append(big.allocate(TABLE_LIST))
    for k, i in enumerate(ids):
        big.put(i, _bytes((big.links + [FREE] * each * len(ids))[k * each : (k + 1) * each], unit))
    for k, i in enumerate(lists):
        own = ids[109 + k * (each - 1) : 109 + (k + 1) * (each - 1)]
        big.put(i, _bytes(own + [FREE] * (each - 1 - len(own)) + [lists[k + 1] if k + 1 < len(lists) else END], unit))
    struct.pack_into("<IiiIiIiI", head, 44, len(ids), first_directory, struct.unpack_from("<i", head, 52)[0], cutoff, first_mini, len(links) // unit, lists[0] if lists else END, len(lists))
    struct.pack_into("<109i", head, 76, *(ids + [FREE] * 109)[:109])
    return bytes(head).ljust(unit, b"\0") + bytes(body)


def _chain_of_lists(body: bytes, unit: int, first: int, count: int) -> list[int]:
    out: list[int] = []
    while len(out) < count and 0 <= first and (first + 1) * unit <= len(body) and first not in out:
        out.append(first)
        first = struct.unpack_from("<i", body, (first + 1) * unit - 4)[0]
    return out


def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (image_id, content, updates) -> image_id and the document with them, one document at a time."""
    for b in batches:
        for i in range(b.num_rows):
            row = b.slice(i, 1)
            yield pa.RecordBatch.from_arrays([row.column(0), pa.array([_rewritten(row.column(1)[0].as_py(), row.column(2)[0].as_py())], pa.binary())], ["image_id", "content"])
