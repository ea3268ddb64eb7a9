"""Helpers that every operator of this subpackage shares.

Intermediate tables are written as Parquet below the folder that the session names in
``spark.checkpoint.dir``: all executors reach it, so a lost executor never takes results
with it, and a table that is read twice is computed once.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession

__all__ = ["read", "shared_folder", "staged", "drop_staged", "lower_words", "word_hashes", "shingle_set", "mix64", "pack_text", "unpack_text", "width", "RunHashes", "digests", "lists", "minima", "runs", "slices"]

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
MIX_A = np.uint64(0x9E3779B97F4A7C15)
MIX_B = np.uint64(0xC2B2AE3D27D4EB4F)


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table of ``sf_dir``, read by Spark from wherever that folder lies."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables. Where the session names none, a local session gets a temporary one; a cluster raises."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        found = spark.sparkContext.getCheckpointDir()
        folder = found.rsplit("/", 1)[0] if found else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="bytequarry-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # nothing else reads this plan's shuffle files
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def drop_staged(df: DataFrame) -> None:
    """Removes a staged table that no later step reads."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._staged_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of text for a task that computes on it, about.
TASK_BYTES = 64 << 20


def width(spark: SparkSession, size: int = 0) -> int:
    """Partitions for a shuffle whose tasks are heavy on CPU although their rows are small; more where ``size`` bytes
    of text ask for it, so that a task's share does not grow with the data."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-size // TASK_BYTES))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def lower_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space of the text with A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def shingle_set(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; a shorter text is one shingle; no words: empty."""
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    n = min(size, len(h))
    s = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        s = mix64((s + h[j : len(h) - n + 1 + j]) * MIX_A)
    return np.unique(s)


def digests(pieces: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of a non-linear 128-bit hash of each piece: among 1e14 pieces two that differ agree with a chance below 1e-10."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, pieces)), "<i8").reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def lists(kind: pa.ListType, sizes: list[int], columns: list[list | np.ndarray]) -> pa.Array:
    """A list column of structs from the fields of all entries, one after the other."""
    fields = list(kind.value_type)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    values = [pa.array(np.concatenate(c) if len(c) else [], f.type) if not pa.types.is_binary(f.type) else pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(values, fields=fields), type=kind)


class RunHashes:
    """Hashes of any run of a sequence of unsigned 64-bit numbers in constant time each (prefix sums modulo 2**64).

    They choose places (anchors, triggers, cuts), for which equal runs must agree; different runs may collide, so
    no equality is ever concluded from them.
    """

    BASE = 0xD6E8FEB86659FD93
    powers = np.ones(1, np.uint64)
    inverse = np.ones(1, np.uint64)

    def __init__(self, values: np.ndarray):
        n = len(values)
        if len(RunHashes.powers) <= n:
            size = 2 * n + 1024
            RunHashes.powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, self.BASE, np.uint64))])
            RunHashes.inverse = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, pow(self.BASE, -1, 2**64), np.uint64))])
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * RunHashes.powers[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of values[start:end] for each pair; it also depends on the length."""
        return mix64((self.sums[end] - self.sums[start]) * RunHashes.inverse[start] + mix64((end - start).astype(np.uint64)))


    def rolling(self, window: int) -> np.ndarray:
        """The same hash of every run of ``window`` numbers, in order."""
        h = self.sums[window:] - self.sums[:-window]
        h *= RunHashes.inverse[: len(h)]
        h += mix64(np.array([window], np.uint64))[0]
        return mix64(h)


def minima(values: np.ndarray, window: int) -> np.ndarray:
    """For each window of ``values`` the position of its smallest value, the first of equal ones."""
    return np.lib.stride_tricks.sliding_window_view(values, window).argmin(axis=1) + np.arange(len(values) - window + 1)


def runs(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal neighbours."""
    cut = np.flatnonzero(labels[1:] != labels[:-1]) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(labels)]])


def pack_text(text: str | None) -> bytes:
    return zstandard.compress((text or "").encode("utf-8", "surrogatepass"), 1)


def unpack_text(data: bytes) -> bytes:
    return zstandard.decompress(data)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 400) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, so that a worker holds the Python values of few long texts at once."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)
