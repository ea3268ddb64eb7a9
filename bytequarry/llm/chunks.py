"""Operator 5: BPE encoding and decoding with content-defined chunk reuse.

1. A rolling hash cuts every text into chunks, at places that depend on the text near them only; chunk hashes
are counted over the corpus. 2. A chunk that stands twice or more is owned by one document, which encodes it
and publishes its ids; all documents that hold it take them by join and encode only the rest. A hash
only names candidates: ids are reused where the bytes they stand for are the chunk's. 3. Where chunks meet, ids
are repaired: the text between the next sure pre-token borders on both sides of the joint is encoded anew,
and the stretch grows until its ends agree with token borders of the chunks' ids. A sure border is an ASCII
space after a visible ASCII character, since no pre-token and no special token spans it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RunHashes, drop_staged, pack_text, read, slices, staged, unpack_text
from .parsing import triggers
from .tokens import Encoder, encoder, vocabulary_file

__all__ = ["decode_ids", "encode_texts", "op5_chunks"]

#: Bytes of the rolling hash, and the most bytes between two cuts.
GRAM, SPREAD = 32, 1024


def cuts(data: bytes, gram: int = 0, spread: int = 0) -> np.ndarray:
    """Chunk borders of a text, 0 and its length included; each is a character's first byte."""
    gram, spread, n = gram or GRAM, spread or SPREAD, len(data)
    if n < gram + spread:
        return np.array([0, n] if n else [0])
    b = np.frombuffer(data, np.uint8)
    chosen = np.unique(triggers(RunHashes(b.astype(np.uint64) + np.uint64(1)).rolling(gram), spread))
    whole = np.append(np.flatnonzero((b & 0xC0) != 0x80), n)
    return np.unique(np.concatenate([[0], whole[np.searchsorted(whole, chosen)], [n]]))


def chunk_hashes(data: bytes, borders: np.ndarray) -> np.ndarray:
    """A hash of each chunk's bytes. It only finds candidates: ids are reused after a comparison of the bytes."""
    at = borders.tolist()
    return np.fromiter((xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)), np.uint64, max(0, len(at) - 1)).view(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, ch, c) for each different chunk of a text."""
    for b in slices(batches):
        keys, hashes, counts = [], [], []
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            borders = cuts(data)
            if len(borders) > 1:
                u, c = np.unique(chunk_hashes(data, borders), return_counts=True)
                keys.append(np.full(len(u), key, np.int64))
                hashes.append(u)
                counts.append(c)
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, hashes, counts)], ["key", "ch", "c"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([pack_text(t) for t in b.column(2).to_pylist()], pa.binary())], ["key", "doc_id", "packed"])


def sure_before(data: bytes, at: int) -> int:
    """The last sure border at or before ``at``, else 0."""
    while (at := data.rfind(b" ", 0, at + 1)) > 0:
        if 0x21 <= data[at - 1] <= 0x7E:
            return at
        at -= 1
    return 0


def sure_after(data: bytes, at: int) -> int:
    """The first sure border at or after ``at``, else the length."""
    at = max(at, 1)
    while (at := data.find(b" ", at)) != -1:
        if 0x21 <= data[at - 1] <= 0x7E:
            return at
        at += 1
    return len(data)


def join_ids(enc: Encoder, data: bytes, borders: list[int], ids: list[np.ndarray]) -> np.ndarray:
    """The ids of the text from those of its segments, which lie between the borders."""
    if len(ids) < 2:
        return ids[0] if ids else np.zeros(0, np.uint32)
    all_ids = np.concatenate(ids)
    all_ends = np.cumsum(enc.lengths[all_ids])

    def agrees(place: int) -> bool:
        """Whether a token of the segments ends at the place."""
        return place in (0, len(data)) or all_ends[all_ends.searchsorted(place)] == place

    holes: list[list[int]] = []
    for joint in borders[1:-1]:
        lo, hi = sure_before(data, joint), sure_after(data, joint)
        while not agrees(lo):
            lo = sure_before(data, lo - 1) if lo > 0 else 0
        while not agrees(hi):
            hi = sure_after(data, hi + 1)
        if lo == hi:
            continue
        if holes and lo <= holes[-1][1]:
            holes[-1][1] = max(hi, holes[-1][1])
        else:
            holes.append([lo, hi])
    out, at = [], 0
    for lo, hi in holes:
        out += [all_ids[at : all_ends.searchsorted(lo, side="right")], enc.encode(data[lo:hi])]
        at = int(all_ends.searchsorted(hi, side="right"))
    return np.concatenate([*out, all_ids[at:]])


def _segments(hashes: list[int], borders: list[int], shared: list[bool]) -> list[tuple[int, int, int | None]]:
    """(start, end, hash of a shared chunk or None) with the other chunks put together."""
    out: list[tuple[int, int, int | None]] = []
    for h, lo, hi, same in zip(hashes, borders[:-1], borders[1:], shared, strict=True):
        if same:
            out.append((lo, hi, h))
        elif out and out[-1][2] is None:
            out[-1] = (out[-1][0], hi, None)
        else:
            out.append((lo, hi, None))
    return out


def confirmed(enc: Encoder, data: bytes, borders: np.ndarray, hashes: list[int], given: dict[int, np.ndarray]) -> list[bool]:
    """Of each chunk whether ids are given for it that stand for exactly its bytes."""
    ask = [k for k, h in enumerate(hashes) if h in given]
    out = [False] * len(hashes)
    if ask:
        sizes = [int(enc.lengths[given[hashes[k]]].sum()) for k in ask]
        told = enc.raw(np.concatenate([given[hashes[k]] for k in ask])).tobytes()
        at = 0
        for k, size in zip(ask, sizes, strict=True):
            out[k] = told[at : at + size] == data[borders[k] : borders[k + 1]]
            at += size
    return out


def _own(path: str):
    """Rows (ch, ids) for the chunks that a text owns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in slices(batches):
            hashes, ids = [], []
            for packed, own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data, left = unpack_text(packed), set(own)
                borders = cuts(data)
                for h, lo, hi in zip(chunk_hashes(data, borders).tolist(), borders[:-1].tolist(), borders[1:].tolist(), strict=True):
                    if h in left:
                        left.discard(h)
                        hashes.append(h)
                        ids.append(enc.encode(data[lo:hi]).astype(enc.dtype).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(ids, pa.binary())], ["ch", "ids"])

    return run


def _fill(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in slices(batches):
            out = []
            for packed, chunks in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                data, given = unpack_text(packed), {x["ch"]: np.frombuffer(x["ids"], enc.dtype).astype(np.uint32) for x in chunks or ()}
                borders = cuts(data)
                hashes = chunk_hashes(data, borders).tolist()
                parts = _segments(hashes, borders.tolist(), confirmed(enc, data, borders, hashes, given))
                ids = [enc.encode(data[s:e]) if h is None else given[h] for s, e, h in parts]
                out.append(join_ids(enc, data, [0, *(e for _, e, _ in parts)], ids).astype(enc.dtype).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "ids"])

    return run


def encode_texts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and ids for every row of ``docs`` (doc_id, text): the ids of the whole text without special tokens
    added, little-endian, 16 bits each where the vocabulary allows, else 32.

    Ids equal those of the ``tokenizers`` library for the whole text. Null texts are empty and have no ids.
    Repeated rows and rows without doc_id each return a row. Other columns are not read.
    """
    path = vocabulary or vocabulary_file()
    docs = docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")
    counted = docs.select("key", "text").mapInArrow(_count, "key long, ch long, c long")
    counted = staged(counted.groupBy("key", "ch").agg(F.sum("c").alias("c")), "chunks")  # rows alike share a key
    shared = counted.groupBy("ch").agg(F.sum("c").alias("c"), F.min("key").alias("owner")).where("c > 1").select("ch", "owner")
    held = staged(counted.join(shared, "ch").select("key", "ch", (F.col("key") == F.col("owner")).alias("own")), "held")
    drop_staged(counted)
    texts = docs.select("key", "doc_id", "text").mapInArrow(_pack, "key long, doc_id long, packed binary")
    owned = held.where("own").groupBy("key").agg(F.collect_list("ch").alias("own"))
    published = texts.groupBy("key").agg(F.first("packed").alias("packed")).join(owned, "key").select("packed", "own").mapInArrow(_own(path), "ch long, ids binary")
    published = staged(published, "published")
    given = staged(held.select("key", "ch").join(published, "ch").groupBy("key").agg(F.collect_list(F.struct("ch", "ids")).alias("chunks")), "given")
    drop_staged(published)
    return texts.join(given, "key", "left").select("doc_id", "packed", "chunks").mapInArrow(_fill(path), "doc_id long, ids binary")


def decode_ids(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The rows of ``encoded`` (doc_id, ids) with n_tokens, ids_text (decimal ids joined by commas) and decoded, the text
    of the ids with special tokens; bytes that are no UTF-8 become U+FFFD. Null ids are none."""
    path = vocabulary or vocabulary_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in slices(batches):
            n, text, decoded = [], [], []
            for data in b.column(1).to_pylist():
                ids = np.frombuffer(data or b"", enc.dtype)
                n.append(len(ids))
                text.append(enc.decimals(ids))
                decoded.append(enc.decode(ids))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()).cast(pa.string()) for x in (text, decoded))], ["doc_id", "n_tokens", "ids_text", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_text string, decoded string")


def op5_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all ``documents`` and what they decode to, as digests."""
    out = decode_ids(encode_texts(read(spark, sf_dir, "documents", "doc_id", "text")))
    return out.select("doc_id", "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
