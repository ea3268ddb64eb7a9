"""Streams of image files: each new file is sniffed once and counted per format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.images import sniff, stream_images

__all__ = ["arriving_formats"]


def arriving_formats(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Streaming (format, images, bytes): running totals of the files that arrive below a path."""
    return sniff(stream_images(spark, path, glob)).groupBy("format").agg(F.count("*").alias("images"), F.sum("length").alias("bytes"))
