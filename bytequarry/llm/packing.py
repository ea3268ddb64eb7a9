"""Operator 4: bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows. A document's ids fill whole windows first; the rest goes
to the open window with the smallest sufficient gap, else to a new window while fewer than the limit are
open, else the fullest window takes what its gap holds and is emitted full. What stays open at a partition's
end is merged with that of up to ``FAN`` other partitions, and so on until one group is left. So every
sequence but the corpus's last one is full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, slices, staged, width
from .tokens import encoder, vocabulary_file

__all__ = ["pack_documents", "op4_packing"]

#: Open windows of a partition, and partitions whose leftovers are merged at once.
OPEN, FAN = 8, 64

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_to long, part long, ids binary"
FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("padded_to", pa.int64()), ("part", pa.int64()), ("ids", pa.binary())]


class Packer:
    """Open windows; ``done`` holds (window number, pieces) of full ones. A piece is (doc_id, start, doc_tokens, ids)."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit, self.opened, self.windows, self.done = capacity, limit, 0, [], []

    def _put(self, window: list, piece: tuple) -> None:
        window[1] += len(piece[3])
        window[2].append(piece)
        if window[1] == self.capacity:
            self.done.append((window[0], window[2]))
            self.windows = [w for w in self.windows if w is not window]

    def _new(self) -> list:
        window = [self.opened, 0, []]
        self.opened += 1
        self.windows.append(window)
        return window

    def add(self, doc_id: int | None, start: int, doc_tokens: int, ids: np.ndarray) -> None:
        while len(ids):
            n, gap = len(ids), lambda w: self.capacity - w[1]
            fits = [w for w in self.windows if gap(w) >= n]
            if n >= self.capacity:
                n, window = self.capacity, self._new()
            elif fits:
                window = min(fits, key=gap)
            elif len(self.windows) < self.limit:
                window = self._new()
            else:
                window = min(self.windows, key=gap)
                n = gap(window)
            self._put(window, (doc_id, start, doc_tokens, ids[:n]))
            start, ids = start + n, ids[n:]


def _rows(windows: list[tuple[int, list]], base: int, part: int, open_: bool, capacity: int) -> pa.RecordBatch:
    out: list[list] = [[] for _ in FIELDS]
    for number, pieces in windows:
        offset = 0
        for doc_id, start, doc_tokens, ids in pieces:
            data = ids.astype("<u4").tobytes()
            for o, v in zip(out, (doc_id, start, len(ids), zlib.crc32(data), doc_tokens, base + number, offset, capacity, part, data if open_ else None), strict=True):
                o.append(v)
            offset += len(ids)
    return pa.RecordBatch.from_arrays([pa.array(o, k) for o, (_, k) in zip(out, FIELDS, strict=True)], [n for n, _ in FIELDS])


def _pack(path: str, end: int, capacity: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, packer = encoder(path), TaskContext.get().partitionId(), Packer(capacity, limit)
        base = part << 32
        for b in slices(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(enc.encode((text or "").encode("utf-8", "surrogatepass")), np.uint32(end))
                packer.add(doc_id, 0, len(ids), ids)
            yield _rows(packer.done, base, part, False, capacity)
            packer.done = []
        yield _rows([(w[0], w[2]) for w in packer.windows], base, part, True, capacity)

    return run


def _merge(level: int, capacity: int, last: bool):
    """Rows sorted by group: pieces of open windows, packed one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, now = None, None

        def close() -> Iterator[pa.RecordBatch]:
            base = (level << 57) + (now << 32)
            yield _rows(packer.done, base, now, False, capacity)
            yield _rows([(w[0], w[2]) for w in packer.windows], base, now, not last, capacity)

        for b in slices(batches):
            for group, doc_id, start, tokens, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group != now:
                    if packer:
                        yield from close()
                    packer, now = Packer(capacity, 1), group
                packer.add(doc_id, start, tokens, np.frombuffer(data, "<u4"))
        if packer:
            yield from close()

    return run


def pack_documents(docs: DataFrame, vocabulary: str | None = None, end: int = 1, capacity: int = 2048, open_windows: int = OPEN) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_to.

    A document is its text's ids without special tokens, then ``end``; a null text is empty, so it is ``end``
    alone. Every row of ``docs`` (doc_id, text) is packed, repeated rows and a null doc_id too. Pieces of a
    sequence follow each other without gap from offset 0; ``padded_to`` is the length after padding. No rows
    give no pieces. Other columns are not read.
    """
    path, spark = vocabulary or vocabulary_file(), docs.sparkSession
    if capacity < 1 or open_windows < 1:
        raise ValueError("capacity and open_windows must be positive")
    first = staged(docs.select("doc_id", "text").mapInArrow(_pack(path, end, capacity, open_windows), PIECES), "packed")
    out, rest, level = first.where("ids is null"), first.where("ids is not null"), 0
    while True:
        top = rest.agg(F.max("part")).first()[0]
        if top is None:
            break
        level, last = level + 1, top < FAN
        grouped = rest.select(F.floor(F.col("part") / FAN).alias("g"), "doc_id", "start", "doc_tokens", "ids", "sequence_id", "offset")
        n = max(1, min(width(spark), top // FAN + 1))
        dealt = grouped.repartition(n, "g").sortWithinPartitions("g", "sequence_id", "offset").select("g", "doc_id", "start", "doc_tokens", "ids")
        merged = staged(dealt.mapInArrow(_merge(level, capacity, last), PIECES), "merged")
        out, rest = out.union(merged.where("ids is null")), merged.where("ids is not null")
        if last:
            break
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_to")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of 2048 tokens."""
    return pack_documents(read(spark, sf_dir, "documents", "doc_id", "text"))
