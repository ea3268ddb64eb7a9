"""Relational operators that image decoding needs, over any DataFrame.

All take key columns; nothing depends on file order: positions are columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

__all__ = [
    "chain_positions", "coded_index", "dimension", "first_match", "index_is_wide", "last_wins", "next_distinct", "ordered_concat", "prefix_sum",
    "range_lookup", "slice_to_next", "until_sentinel",
]


def first_match(df: DataFrame, keys: Sequence[str], position: str, condition: Column | None = None) -> DataFrame:
    """Of each key the row with the smallest position among those that meet the condition (pre-aggregated)."""
    rows = df if condition is None else df.where(condition)
    others = [c for c in df.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), position).alias("_row"))
    return best.select(*keys, *(F.col("_row")[c].alias(c) for c in others)).select(*df.columns)


def range_lookup(points: DataFrame, ranges: DataFrame, value: str, start: str, end: str, position: str, keys: Sequence[str] = (), width: int = 4096) -> DataFrame:
    """Points with the columns of the first range [start, end) that holds their value; points without one are kept with nulls.

    Values are dealt to buckets of ``width``; a range posts itself in each bucket that it crosses, so the join is
    an equi-join that spills and splits skew, not a nested loop. Of several ranges the smallest position wins.
    """
    on = [*keys, "_bucket"]
    wide = ranges.where(F.col(start) < F.col(end)).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width).cast("bigint"), F.floor((F.col(end) - 1) / width).cast("bigint"))))
    tagged = points.withColumn("_point", F.struct(*points.columns)).withColumn("_bucket", F.floor(F.col(value) / width).cast("bigint"))
    extra = [c for c in ranges.columns if c not in keys]
    clash = set(extra) & set(points.columns)
    if clash:
        raise ValueError(f"columns in both tables: {sorted(clash)}")
    hit = tagged.select("_point", *on, F.col(value).alias("_value")).join(wide, on).where((F.col("_value") >= F.col(start)) & (F.col("_value") < F.col(end)))
    best = hit.groupBy("_point").agg(F.min_by(F.struct(*extra), position).alias("_range"))
    counted = points.groupBy(*points.columns).agg(F.count("*").alias("_times")).withColumn("_point", F.struct(*points.columns))
    joined = counted.join(best.withColumnRenamed("_point", "_hit"), F.col("_point").eqNullSafe(F.col("_hit")), "left")
    return joined.select(F.explode(F.array_repeat(F.struct(*points.columns, *(F.col("_range")[c].alias(c) for c in extra)), F.col("_times").cast("int"))).alias("r")).select("r.*")


def next_distinct(df: DataFrame, keys: Sequence[str], value: str, name: str = "gap") -> DataFrame:
    """Adds the distance to the next strictly greater value of the key; ties share it, the largest has null."""
    steps = df.select(*keys, value).distinct()
    gap = F.lead(value).over(Window.partitionBy(*keys).orderBy(value)) - F.col(value)
    return df.join(steps.withColumn(name, gap), [*keys, value], "left").select(*df.columns, name)


def prefix_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, inclusive: bool = True) -> DataFrame:
    """Adds the running sum of the key in the given order; exclusive sums start at 0."""
    total = F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(name, total if inclusive else total - F.col(value))


def slice_to_next(df: DataFrame, keys: Sequence[str], order: str, name: str = "end") -> DataFrame:
    """Adds the next row's ``order`` value; the last row of a key has null."""
    return df.withColumn(name, F.lead(order).over(Window.partitionBy(*keys).orderBy(order)))


def until_sentinel(df: DataFrame, keys: Sequence[str], position: str, sentinel: Column) -> DataFrame:
    """Rows of a key before the first one that meets ``sentinel``; a key without one keeps all."""
    stops = df.where(sentinel).groupBy(*keys).agg(F.min(position).alias("_stop"))
    return df.join(stops, list(keys), "left").where(F.col("_stop").isNull() | (F.col(position) < F.col("_stop"))).select(*df.columns)


def last_wins(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """Of each key the row with the largest position."""
    others = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*others), position).alias("_row"))
    return best.select(*keys, *(F.col("_row")[c].alias(c) for c in others)).select(*df.columns)


def ordered_concat(df: DataFrame, keys: Sequence[str], position: str, value: str, name: str, binary: bool = False) -> DataFrame:
    """The values of a key one after the other, by position; bytes for ``binary``, else text. Nulls add nothing."""
    piece = F.hex(value) if binary else F.col(value)
    parts = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), piece.alias("v"))))
    text = F.array_join(F.transform(parts, lambda x: F.coalesce(x["v"], F.lit(""))), "")
    return df.groupBy(*keys).agg((F.unhex(text) if binary else text).alias(name))


def chain_positions(edges: DataFrame, keys: Sequence[str], node: str, following: str) -> DataFrame:
    """(keys, node, position) of the nodes of each chain, heads at 0, by pointer doubling: a number of joins in the
    logarithm of the longest chain, on written intermediate tables. Nodes on a cycle, and those that lead from one,
    have no position and are left out. A null ``following`` ends a chain; each node has one follower and one leader at most.
    """
    from ..sources.scratch import staged

    keys = list(keys)
    own = edges.select(*keys, F.col(node).alias("n"))
    lead = edges.where(F.col(following).isNotNull()).select(*keys, F.col(following).alias("n"), F.col(node).alias("up")).join(own, [*keys, "n"], "left_semi")
    state = own.join(lead, [*keys, "n"], "left").select(*keys, "n", "up", F.when(F.col("up").isNull(), 0).otherwise(1).cast("bigint").alias("d"))
    longest = max([r["c"] for r in own.groupBy(*keys).count().agg(F.max("count").alias("c")).collect() if r["c"]] or [0])
    steps = 1
    while steps <= longest:
        state = staged(state, "chain")
        far = state.select(*keys, F.col("n").alias("up"), F.col("up").alias("up2"), F.col("d").alias("d2"))
        state = state.join(far, [*keys, "up"], "left").select(*keys, "n", F.col("up2").alias("up"), F.when(F.col("up").isNull(), F.col("d")).otherwise(F.col("d") + F.col("d2")).alias("d"))
        steps *= 2
    return state.where("up is null").select(*keys, F.col("n").alias(node), F.col("d").alias("position"))


def dimension(df: DataFrame, table: DataFrame, domain: str | Column, code: str, name: str) -> DataFrame:
    """Adds the first name of a code of a domain (a text, or a Column for a domain that differs by row); null if unknown.

    The dimension table has a bounded number of rows, those of ``enum_table``, so it is broadcast.
    """
    which = F.lit(domain) if isinstance(domain, str) else domain
    small = table.where("rank = 1").select(F.col("domain").alias("_domain"), F.col("code").alias("_code"), F.col("name").alias(name))
    joined = df.withColumn("_which", which).join(F.broadcast(small), (F.col("_which") == F.col("_domain")) & (F.col(code) == F.col("_code")), "left")
    return joined.select(*df.columns, name)


def index_is_wide(counts: Sequence[Column], tag_bits: int = 0) -> Column:
    """Whether an index into tables of these row counts takes four bytes."""
    limit = 0xFFFF >> tag_bits
    return F.greatest(*counts, F.lit(0)) > limit


def coded_index(value: Column, tables: Sequence[str | None], tag_bits: int) -> Column:
    """Struct (table, row) of a coded index; table is null for an unused tag, row counts from 1, 0 is none."""
    tag, row = F.pmod(value, F.lit(1 << tag_bits)), F.floor(value / (1 << tag_bits))
    name = F.coalesce(*(F.when(tag == i, F.lit(t)) for i, t in enumerate(tables) if t))
    return F.struct(name.alias("table"), row.cast("bigint").alias("row"))
