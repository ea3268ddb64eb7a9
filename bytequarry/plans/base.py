"""The catalogue of queries: each packs rows of the driver's tables into bytes or images, decodes them, and has a SQL equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pack import pack_int

__all__ = ["BUCKET", "IMAGE_SQL", "ORACLES", "QUERIES", "image_of_part", "number", "query", "read", "zeros"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Keys of parts in one image, so that no image grows with the table.
BUCKET = 1024
#: The image of a part, in SQL.
IMAGE_SQL = f"p_brand || '/' || (p_partkey // {BUCKET})"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql.replace("IMAGE", IMAGE_SQL)
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def image_of_part() -> Column:
    """The image that a part belongs to: its brand and a range of keys."""
    return F.concat_ws("/", "p_brand", F.floor(F.col("p_partkey") / BUCKET).cast("string"))


def number(value: Column | int, size: int, big: bool = False) -> Column:
    return pack_int(F.lit(value) if isinstance(value, int) else value, size, big)


def zeros(size: int) -> Column:
    return F.lit(bytes(size))
