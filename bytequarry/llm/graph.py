"""Connected components of a link table, by contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, staged

__all__ = ["components"]


def components(edges: DataFrame, first: str, second: str) -> DataFrame:
    """(node, comp) for every node of an edge; comp is one node of its component, the same for all its nodes.

    Each round hooks every node to the smallest hash among itself and its neighbours, jumps twice along
    these hooks and contracts the edges; random hashes as order keep chains from costing a round per link.
    Rows per round fall by a constant factor; hubs are pre-aggregated by the partial minimum. An edge with
    a null end or two equal ends is ignored; no edges give an empty table.
    """
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    left = edges.select(F.col(first).alias("a"), F.col(second).alias("b")).where("a <> b")
    both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    work = staged(both, "edges")
    labels, old = None, []
    while not work.isEmpty():
        hook = work.groupBy("a").agg(F.min(order("b")).alias("m")).select(F.col("a").alias("node"), F.least(F.col("m"), order("a"))["v"].alias("to"))
        hook = staged(hook, "hooks")
        jump = hook.select(F.col("node").alias("to"), F.col("to").alias("to2"))
        jump3 = hook.select(F.col("node").alias("to2"), F.col("to").alias("to3"))
        far = hook.join(jump, "to").join(jump3, "to2").select("node", F.col("to3").alias("to"))
        far = staged(far, "jumps")
        l_a, l_b = far.select(F.col("node").alias("a"), F.col("to").alias("x")), far.select(F.col("node").alias("b"), F.col("to").alias("y"))
        rest = staged(work.join(l_a, "a").join(l_b, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
        if labels is None:
            new = far.select("node", F.col("to").alias("comp"))
        else:
            step = far.select(F.col("node").alias("comp"), F.col("to").alias("next"))
            new = staged(labels.join(step, "comp", "left").select("node", F.coalesce("next", "comp").alias("comp")), "labels")
            old.append(labels)
        drop_staged(hook)
        drop_staged(work)
        labels, work = new, rest
    for x in old[1:]:
        drop_staged(x)
    return labels if labels is not None else work.select(F.col("a").alias("node"), F.col("b").alias("comp"))
