"""Operator 10: media columns with content-addressed payloads in tar shards.

A payload is stored as an 8-bit grey PNG named by its digest, once per writing task, in tar shards of bounded
size below the shared folder; rows carry digest, shard, offset and length. Of equal payloads in several shards
the first location counts. Metadata columns come from range reads of the PNG header alone; reading a payload back
is one range read. Shards of failed attempts are never referred to, since each attempt writes its own files.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, runs, shared_folder, slices, staged, width

__all__ = ["media_metadata", "read_media", "store_texts", "op10_media"]

#: Samples of a row of the picture; payloads are padded to a positive multiple of it.
ROW = 192
#: Bytes after which a shard is closed.
SHARD_BYTES = 64_000_000
#: Bytes of a PNG up to the end of its header chunk.
HEADER = 33


def to_png(payload: bytes) -> bytes:
    """An 8-bit grey picture with ROW samples a row, lossless."""
    height = len(payload) // ROW
    lines = np.zeros((height, ROW + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, ROW)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 4)) + chunk(b"IEND", b"")


def png_header(data: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first HEADER bytes."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", data[16:25])


def from_png(data: bytes) -> bytes:
    """The samples of a picture written by ``to_png``."""
    columns, height, _ = png_header(data)
    at, packed = 8, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            packed.append(data[at + 8 : at + 8 + size])
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, columns + 1)
    return lines[:, 1:].tobytes()


class _Shards:
    """Appends members to tar files of one task."""

    def __init__(self, folder: str):
        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.out, self.name, self.at = None, "", 0

    def add(self, member: str, data: bytes) -> tuple[str, int]:
        if self.out is None or self.at > SHARD_BYTES:
            self.close()
            self.name, self.at = f"shard-{uuid.uuid4().hex}.tar", 0
            self.out = self.files.open_output_stream(f"{self.folder}/{self.name}")
        info = tarfile.TarInfo(member)
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head + data + bytes(-len(data) % 512))
        place = self.at + len(head)
        self.at = place + len(data) + -len(data) % 512
        return self.name, place

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out = None


def _store(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, seen = _Shards(folder), {}
        for b in slices(batches):
            out: list[list] = [[] for _ in range(5)]
            for text in b.column(1).to_pylist():
                data = (text or "").encode("utf-8", "surrogatepass")
                payload = data + b" " * (-len(data) % ROW if data else ROW)
                digest = hashlib.sha256(payload).digest()
                if digest not in seen:
                    png = to_png(payload)
                    seen[digest] = (*shards.add(f"{digest.hex()}.png", png), len(png))
                for o, v in zip(out, (len(data), digest, *seen[digest]), strict=True):
                    o.append(v)
            kinds = (pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(o, k) for o, k in zip(out, kinds, strict=True))], ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        shards.close()

    return run


def store_texts(docs: DataFrame) -> tuple[DataFrame, str]:
    """Rows (doc_id, n_bytes, digest, shard, offset, length) for every row of ``docs`` (doc_id, text), and the shards' folder.

    A payload is the text's UTF-8 (null: empty) and spaces up to a positive multiple of ROW. Equal payloads
    carry one location. Repeated rows and null ids are kept; other columns are not read. Shards are written at once.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/media-{uuid.uuid4().hex}"
    uri = folder if "://" in folder else "file://" + folder.removeprefix("file:")
    files, path = fs.FileSystem.from_uri(uri)
    files.create_dir(path, recursive=True)
    written = staged(docs.select("doc_id", "text").mapInArrow(_store(uri), "doc_id long, n_bytes long, digest binary, shard string, offset long, length long"), "written")
    first = written.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p")).select("digest", "p.*")
    return written.select("doc_id", "n_bytes", "digest").join(first, "digest"), uri


def _ranges(folder: str, most: int | None, decode, schema: pa.Schema):
    """Range reads of (digest, shard, offset, length), sorted by shard and offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = fs.FileSystem.from_uri(folder)
        for b in slices(batches):
            if not b.num_rows:
                continue
            digests, names, offsets, lengths = (c.to_pylist() for c in b.columns)
            rows = []
            for lo, hi in zip(*runs(np.array(names)), strict=True):
                with files.open_input_file(f"{path}/{names[lo]}") as f:
                    for i in range(lo, hi):
                        rows.append((digests[i], *decode(f.read_at(min(lengths[i], most or lengths[i]), offsets[i]))))
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _each(catalog: DataFrame) -> DataFrame:
    one = catalog.select("digest", "shard", "offset", "length").distinct()
    return one.repartition(width(catalog.sparkSession), "shard").sortWithinPartitions("shard", "offset")


def media_metadata(catalog: DataFrame, folder: str) -> DataFrame:
    """digest, width, height, depth of each stored picture, from its header bytes alone."""
    schema = pa.schema([("digest", pa.binary()), ("width", pa.int64()), ("height", pa.int64()), ("depth", pa.int64())])
    return _each(catalog).mapInArrow(_ranges(folder, HEADER, png_header, schema), "digest binary, width long, height long, depth long")


def _features(data: bytes) -> tuple[int, str, int, int, str, str]:
    payload = from_png(data)
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    share = counts[counts > 0] / len(payload)
    columns, height, depth = png_header(data)
    feature = f"grey{depth} {columns}x{height} mean={float(counts @ np.arange(256)) / len(payload):.3f} entropy={float(-(share * np.log2(share)).sum()):.4f}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature


def read_media(catalog: DataFrame, folder: str) -> DataFrame:
    """digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of each stored picture, read back."""
    schema = pa.schema([("digest", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
    return _each(catalog).mapInArrow(_ranges(folder, None, _features, schema), "digest binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` stored as pictures and read back; height comes from header-only reads."""
    catalog, folder = store_texts(read(spark, sf_dir, "documents", "doc_id", "text"))
    back = read_media(catalog, folder).join(media_metadata(catalog, folder).select("digest", "height"), "digest")
    return catalog.select("doc_id", "n_bytes", "digest").join(back, "digest").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "height")
