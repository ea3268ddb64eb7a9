"""Sources of binary images: files, streams of files, and format detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codecs import uint
from ..functions.enums import names

__all__ = ["FILES", "format_of", "read_images", "sniff", "stream_images", "write_images"]

FILES = "path string, modificationTime timestamp, length long, content binary"


def read_images(spark: SparkSession, path: str, glob: str = "*", most: int | None = None) -> DataFrame:
    """image_id, path, length, content of the files below a path; files over ``most`` bytes are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    files = files if most is None else files.where(F.col("length") <= most)
    return files.select(F.col("path").alias("image_id"), "path", "length", "content")


def stream_images(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """The same as a stream: each new file is an image."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).load(path)
    return files.select(F.col("path").alias("image_id"), "path", "length", "content")


def write_images(images: DataFrame, path: str) -> None:
    """Writes changed images (image_id, content) as a table; sources are never changed in place."""
    images.select("image_id", F.length("content").cast("long").alias("length"), "content").write.mode("errorifexists").parquet(path)


def format_of(content: Column) -> Column:
    """Format name by the first bytes, null if none fits.

    ``coff`` is weak, since any two bytes of a machine code pass; ``fat_mach`` also fits Java classes.
    """
    starts = lambda h: F.substring(content, 1, len(h) // 2) == F.unhex(F.lit(h))
    first, second = uint(content, 0, 2), uint(content, 2, 2)
    machines = [c for c in names("COFF_MACHINE")]
    return (
        F.when(starts("213C617263683E0A"), "ar")
        .when(starts("7F454C46"), "elf")
        .when(starts("4D5A"), "pe")
        .when(starts("FEEDFACE") | starts("CEFAEDFE") | starts("FEEDFACF") | starts("CFFAEDFE"), "mach")
        .when(starts("CAFEBABE") | starts("BEBAFECA"), "fat_mach")
        .when(starts("D0CF11E0A1B11AE1"), "cfb")
        .when(starts("42534A42"), "clr")
        .when((first == 0) & (second == 0xFFFF) & (uint(content, 4, 2) == 0) & (uint(content, 6, 2) != 0) & uint(content, 6, 2).isin(machines), "coff_import")
        .when((F.length(content) >= 20) & first.isin(machines), "coff")
    )


def sniff(images: DataFrame) -> DataFrame:
    """Adds ``format`` to images (…, content)."""
    return images.withColumn("format", format_of(F.col("content")))
