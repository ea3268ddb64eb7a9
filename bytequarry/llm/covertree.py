"""Operator 7: embedding near-dedup by dual traversal of cover trees.

On unit vectors a cosine threshold is a distance. Vectors with equal bytes are one entry with a count. 1. The upper levels of the
tree are cells: a cell of more vectors than a block holds is divided among centres, a net of halving radius over a
bounded sample of that cell, again and again, so the number of cells grows with the data and their vectors stay
near each other. Every cell knows the true radius that covers its vectors. 2. Pairs of cells are followed from the
root down, on these radii alone: a pair whose distance exceeds both radii and the threshold is pruned before
any vector is moved. 3. Each cell gets a tree of nested levels with halving radii of its own, and each pair of cells
that is left is one unit of work, in which pairs of nodes are pruned by their radii, or taken as a whole where all their
vectors must be near enough, down to exact cosines in double precision. A unit returns its counts and a
spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import digests, drop_staged, read, runs, slices, staged, width
from .graph import components

__all__ = ["embedding_duplicates", "op7_covertree"]

#: Vectors of a cell's sample, about, that its centres come from, and most centres of one cell: as many as blocks that it fills.
SAMPLE, CENTRES = 2048, 64
#: Vectors that one task assigns to the centres of a cell.
CHUNK = 1 << 16
#: Radii of the nested levels of a cell's tree.
RADII = (1.0, 0.5, 0.25, 0.125)
#: Least and most vectors of a block, and blocks at least where there are enough vectors.
LEAST, MOST, BLOCKS = 256, 8192, 16
#: Added to distance bounds against rounding; pairs are decided on their cosine.
SLACK = 1e-7


def unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def matrix(data: list[bytes]) -> np.ndarray:
    """Unit vectors of the bytes of equally long ones."""
    return unit(np.frombuffer(b"".join(data)).reshape(len(data), -1))


def net(x: np.ndarray, radius: float, start: np.ndarray, most: int) -> np.ndarray:
    """Positions of centres that cover all unit vectors within the radius, or the first ``most``; ``start`` are centres already."""
    bound, out = 1 - radius * radius / 2, list(start)
    covered = np.zeros(len(x), bool)
    for c in start:
        covered |= x @ x[c] >= bound
    at = 0
    while len(out) < most:
        rest = np.flatnonzero(~covered[at:])
        if not len(rest):
            break
        at += int(rest[0])
        out.append(at)
        covered |= x @ x[at] >= bound
    return np.array(out, np.int64)


def top_centres(x: np.ndarray, most: int) -> np.ndarray:
    """Unit vectors of the finest net of halving radius with fewer than ``most`` centres, filled up from the next finer one."""
    centres, radius = np.array([0]), 2.0
    while radius > 1e-6 and len(centres) < most:
        radius /= 2
        centres = net(x, radius, centres, most)
    return x[centres]


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, vec_id, dim, data, d1, d2): data is null for vectors that link with nothing, else d names its bytes."""
    number = TaskContext.get().partitionId() << 33
    for b in slices(batches):
        dims, data = [], []
        for v in b.column(1).to_pylist():
            x = np.array([np.nan if e is None else e for e in v or ()], np.float64)
            good = len(x) > 0 and bool(np.isfinite(x).all()) and bool(x.any())
            dims.append(len(x))
            data.append(x.tobytes() if good else None)
        at = np.arange(number, number + b.num_rows, dtype=np.int64)
        number += b.num_rows
        d1, d2 = digests(d or b"" for d in data)
        yield pa.RecordBatch.from_arrays([pa.array(at), b.column(0).cast(pa.int64()), pa.array(dims, pa.int32()), pa.array(data, pa.binary()), pa.array(d1), pa.array(d2)], ["row", "vec_id", "dim", "data", "d1", "d2"])


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """The rows of each run of equal first ``keys`` columns."""
    rows: list[tuple] = []
    for b in slices(batches):
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if rows and r[:keys] != rows[-1][:keys]:
                yield rows
                rows = []
            rows.append(r)
    if rows:
        yield rows


def _centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Samples sorted by cell -> (cell, child, last, centre): a cell whose sample has one centre is not divided again."""
    for rows in groups(batches, 1):
        x = top_centres(matrix([r[1] for r in rows]), rows[0][2])
        n = len(x)
        yield pa.RecordBatch.from_arrays([pa.array([rows[0][0]] * n), pa.array(np.arange(n, dtype=np.int32)), pa.array([n == 1] * n), pa.array([v.tobytes() for v in x], pa.binary())], ["cell", "child", "last", "centre"])


def _assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell, its centres first -> vectors with the child of their cell and the distance to its centre."""
    now, centres, names = None, [], []
    for b in slices(batches, 4000):
        cells, kinds = b.column(0).to_pylist(), b.column(2).to_numpy()
        cut = [0, *(i for i in range(1, len(cells)) if cells[i] != cells[i - 1] or kinds[i] != kinds[i - 1]), len(cells)]
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            if lo == hi:
                continue
            part = b.slice(lo, hi - lo)
            if kinds[lo] == 0:
                if cells[lo] != now:
                    now, centres, names = cells[lo], [], []
                centres += part.column(6).to_pylist()
                names += part.column(4).to_pylist()
                continue
            y = np.frombuffer(b"".join(centres)).reshape(len(centres), -1)
            dots = matrix(part.column(6).to_pylist()) @ y.T
            best = dots.argmax(axis=1)
            far = np.sqrt(np.maximum(0, 2 - 2 * dots[np.arange(len(best)), best]))
            yield pa.RecordBatch.from_arrays([part.column(3), part.column(5), part.column(6), pa.array([names[i] for i in best]), pa.array(far)], ["row", "w", "data", "cell", "far"])


def levels_of(x: np.ndarray) -> np.ndarray:
    """Each vector's centre on each level of nested nets of halving radius; levels that hardly join any vectors are left out."""
    some = x[np.linspace(0, len(x) - 1, min(len(x), 256)).astype(np.int64)]
    levels: list[np.ndarray] = []
    for radius in RADII:
        if len(net(some, radius, np.zeros(0, np.int64), len(some))) * 2 > len(some):
            break
        centres = net(x, radius, levels[-1] if levels else np.zeros(0, np.int64), len(x) // 2 + 1)
        if len(centres) * 2 > len(x):
            break
        levels.append(centres)
    out = np.zeros((len(x), len(levels)), np.int64)
    below = np.arange(len(x))
    for k in range(len(levels) - 1, -1, -1):
        best = np.concatenate([(x[below[lo : lo + 2048]] @ x[levels[k]].T).argmax(axis=1) for lo in range(0, len(below), 2048)])
        parent = np.zeros(len(x), np.int64)
        parent[below] = levels[k][best]
        out[:, k] = parent[out[:, k + 1]] if k + 1 < len(levels) else parent
        below = levels[k]
    return out


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block: adds position and path of a vector, its centre's position on each level of the block's tree."""
    for rows in groups(batches, 2):
        line = levels_of(matrix([r[4] for r in rows]))
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.arange(len(rows), dtype=np.int32)), pa.array(line.astype(np.int32).tolist(), pa.list_(pa.int32()))], ["cell", "block", "row", "w", "data", "at", "path"])


class Tree:
    """A block's vectors and the nodes of each level: centre, true covering radius, children and members; the last level are the vectors."""

    def __init__(self, rows: list[tuple]):
        rows = sorted(rows, key=lambda r: r[3])
        self.rows, self.w = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.int64)
        self.x = matrix([r[2] for r in rows])
        self.low = self.x.astype(np.float32)
        path, at = np.array([r[4] for r in rows], np.int64).reshape(len(rows), -1), np.arange(len(rows))
        self.centre, self.radius, self.members, self.children = [], [], [], []
        of = []
        for k in range(path.shape[1]):
            nodes, which = np.unique(path[:, k], return_inverse=True)
            away = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", self.x, self.x[path[:, k]])))
            radius = np.zeros(len(nodes))
            np.maximum.at(radius, which, away)
            self.centre.append(nodes)
            self.radius.append(radius)
            self.members.append(np.split(np.argsort(which, kind="stable"), np.cumsum(np.bincount(which))[:-1]))
            of.append(which)
        self.centre.append(at)
        self.radius.append(np.zeros(len(rows)))
        of.append(at)
        for k in range(len(of) - 1):
            pairs = np.unique(np.stack([of[k], of[k + 1]], axis=1), axis=0)
            s, e = runs(pairs[:, 0])
            self.children.append([pairs[a:b, 1] for a, b in zip(s, e, strict=True)])

    @property
    def last(self) -> int:
        return len(self.centre) - 1

    def below(self, level: int, nodes: np.ndarray) -> tuple[int, np.ndarray]:
        return (level, nodes) if level == self.last else (level + 1, np.concatenate([self.children[level][i] for i in nodes]))


def traverse(a: Tree, b: Tree, cosine: float) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """(whole, i, j): with ``whole`` all of i (positions in a) reach all of j (in b), else i and j are pairs, of at least the cosine."""
    reach = np.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    sure = reach - 2 * SLACK
    loose = np.float32(cosine - 1.5e-7 * (a.x.shape[1] + 16))

    def visit(la: int, p: np.ndarray, lb: int, q: np.ndarray) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
        for lo in range(0, len(p), 1024):
            part = p[lo : lo + 1024]
            if la == a.last and lb == b.last:
                i, j = np.nonzero(a.low[part] @ b.low[q].T >= loose)
                i, j = part[i], q[j]
                for k in range(0, len(i), 1 << 16):
                    x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                    near = np.einsum("ij,ij->i", a.x[x], b.x[y]) >= cosine
                    yield False, x[near], y[near]
                continue
            away = np.sqrt(np.maximum(0, 2 - 2 * (a.x[a.centre[la][part]] @ b.x[b.centre[lb][q]].T)))
            radii = a.radius[la][part][:, None] + b.radius[lb][q][None, :]
            alive = away <= reach + radii
            if la < a.last and lb < b.last:
                for i, j in zip(*np.nonzero(away + radii <= sure), strict=True):
                    yield True, a.members[la][part[i]], b.members[lb][q[j]]
                    alive[i, j] = False
            if alive.mean() > 0.2 and alive.all():
                yield from visit(*a.below(la, part), *b.below(lb, q))
                continue
            for i in np.flatnonzero(alive.any(axis=1)):
                yield from visit(*a.below(la, part[i : i + 1]), *b.below(lb, q[alive[i]]))

    yield from visit(0, np.arange(len(a.centre[0])), 0, np.arange(len(b.centre[0])))


def _compare(cosine: float):
    """Rows sorted by unit and side -> (row, other, n): n links of a row, or a link of the forest (n is 0)."""

    def decide(left: list[tuple], right: list[tuple] | None) -> pa.RecordBatch:
        a = Tree(left)
        b = a if right is None else Tree(right)
        na, nb = np.zeros(len(a.rows), np.int64), np.zeros(len(b.rows), np.int64)
        shift = len(a.rows) if right is not None else 0
        up, first, second = np.arange(len(a.rows) + (len(b.rows) if right is not None else 0)), [], []

        def root(v: int) -> int:
            while up[v] != v:
                up[v] = v = up[up[v]]
            return v

        def join(u: int, v: int) -> None:
            ru, rv = root(u), root(v + shift)
            if ru != rv:
                up[max(ru, rv)] = min(ru, rv)
                first.append(a.rows[u])
                second.append(b.rows[v])

        for whole, i, j in traverse(a, b, cosine):
            if whole:
                na[i] += b.w[j].sum()
                if right is None:
                    na[i] -= np.where(np.isin(i, j), a.w[i], 0)  # not with itself
                else:
                    nb[j] += a.w[i].sum()
                for v in j.tolist():
                    join(int(i[0]), v)
                for u in i.tolist():
                    join(u, int(j[0]))
                continue
            if right is None:
                i, j = i[i != j], j[i != j]
            np.add.at(na, i, b.w[j])
            if right is not None:
                np.add.at(nb, j, a.w[i])
            for u, v in zip(i.tolist(), j.tolist(), strict=True):
                join(u, v)
        rows = np.concatenate([a.rows[na > 0], b.rows[nb > 0] if right is not None else np.zeros(0, np.int64), np.array(first, np.int64)])
        counts = np.concatenate([na[na > 0], nb[nb > 0], np.zeros(len(first), np.int64)])
        others = pa.array([None] * (len(rows) - len(second)) + second, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int64)), others, pa.array(counts)], ["row", "other", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, 4):
            own = rows[0][:2] == rows[0][2:4]
            left, right = ([r[5:] for r in rows if r[4] == side] for side in (0, 1))
            if left and (own or right):
                yield decide(left, None if own else right)

    return run


def divided(good: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(placed, nodes): vectors (row, w, data, cell, far) in cells of ``size`` vectors where they can be divided, and the
    nodes (cell, parent, centre, far, leaf, c) from the roots, one for each dimension, down."""
    spark = good.sparkSession
    placed = staged(good.select("row", "w", "data", F.concat(F.lit("d"), F.col("dim").cast("string")).alias("cell"), F.lit(2.0).alias("far")), "placed")
    centres = None
    done = staged(placed.where("false"), "done")
    while True:
        count = placed.groupBy("cell").agg(F.count("*").alias("c"))
        large = staged(count.where((F.col("c") > size) & ~F.endswith("cell", F.lit("!"))).select("cell", "c", F.ceil(F.col("c") / CHUNK).cast("int").alias("salts")), "large")
        if large.isEmpty():
            return staged(done.union(placed), "cells"), centres
        done = staged(done.union(placed.join(large, "cell", "left_anti").select(*placed.columns)), "done")
        rows = placed.join(large, "cell")
        share = F.least(F.lit(1.0), F.lit(float(SAMPLE)) / F.col("c"))
        some = rows.where(F.pmod(F.xxhash64(F.lit(7), "row"), F.lit(1 << 30)) <= share * float(1 << 30)).select("cell", "data", F.greatest(F.lit(2), F.least(F.lit(CENTRES), F.ceil(F.col("c") / size).cast("int"))).alias("most"))
        found = some.repartition(width(spark), "cell").sortWithinPartitions("cell", "data").mapInArrow(_centres, "cell string, child int, last boolean, centre binary")
        found = staged(found.select("cell", F.concat_ws(".", "cell", F.concat(F.col("child").cast("string"), F.when(F.col("last"), "!").otherwise(""))).alias("to"), "centre"), "centres")
        nothing = F.lit(None).cast("long")
        first = found.join(large, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), nothing.alias("row"), "to", nothing.alias("w"), F.col("centre").alias("data"))
        rest = rows.select("cell", F.pmod(F.xxhash64(F.lit(8), "row"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), "row", F.lit(None).cast("string").alias("to"), "w", "data")
        dealt = first.union(rest).repartition(width(spark), "cell", "salt").sortWithinPartitions("cell", "salt", "kind")
        placed = staged(dealt.mapInArrow(_assign, "row long, w long, data binary, cell string, far double").select(*done.columns), "placed")
        radius = placed.groupBy("cell").agg(F.max("far").alias("far"))
        new = found.join(radius, F.col("to") == radius["cell"]).select(F.col("to").alias("node"), found["cell"].alias("parent"), "centre", "far")
        centres = staged(new if centres is None else centres.union(new), "nodes")


def surviving(blocks: DataFrame, nodes: DataFrame | None, reach: float) -> DataFrame:
    """Pairs (c1, n1, c2, n2) of leaf cells, with their numbers of blocks, that the radii cannot tell apart; followed from the roots."""
    leaves = blocks.select(F.col("cell").alias("node"), "n")
    if nodes is None:
        return leaves.select(F.col("node").alias("c1"), F.col("n").alias("n1"), F.col("node").alias("c2"), F.col("n").alias("n2"))
    known = nodes.join(leaves, "node", "left")
    roots = leaves.join(nodes, "node", "left_anti").select("node").union(nodes.select(F.col("parent").alias("node")).where(~F.contains("node", F.lit(".")))).distinct()
    step = known.select(F.col("parent").alias("at"), "node", "centre", "far", F.col("n").isNotNull().alias("leaf"))
    stay = leaves.join(nodes, "node").select(F.col("node").alias("at"), "node", "centre", "far", F.lit(True).alias("leaf"))
    lone = leaves.join(nodes, "node", "left_anti").select(F.col("node").alias("at"), "node", F.lit(None).cast("binary").alias("centre"), F.lit(2.0).alias("far"), F.lit(True).alias("leaf"))
    moves = staged(step.union(stay).union(lone), "moves")
    pairs = roots.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(False).alias("end"))
    side = lambda n: moves.select(F.col("at").alias(n), *(F.col(c).alias(f"{c}_{n}") for c in ("node", "centre", "far", "leaf")))
    ended = []
    while True:
        met = pairs.join(side("a"), "a").join(side("b"), "b").where((F.col("a") != F.col("b")) | (F.col("node_a") <= F.col("node_b")))
        near = met.select("node_a", "node_b", "leaf_a", "leaf_b", "far_a", "far_b", "centre_a", "centre_b").mapInArrow(_prune(reach), "a string, b string, end boolean")
        pairs = staged(near, "pairs")
        ended.append(pairs.where("end"))
        pairs = pairs.where("not end")
        if pairs.isEmpty():
            break
    found = ended[0]
    for x in ended[1:]:
        found = found.union(x)
    left, right = (leaves.select(F.col("node").alias(n), F.col("n").alias(f"n_{n}")) for n in ("a", "b"))
    return staged(found.join(left, "a").join(right, "b").select(F.col("a").alias("c1"), F.col("n_a").alias("n1"), F.col("b").alias("c2"), F.col("n_b").alias("n2")), "meets")


def _prune(reach: float):
    """Pairs of nodes whose distance is within both radii and the reach; ``end`` where both are leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c, leaf_a, leaf_b, far_a, far_b, x, y = (col.to_pylist() for col in b.columns)
            keep = []
            for p, q, r, s in zip(x, y, far_a, far_b, strict=True):
                keep.append(p is None or q is None or float(np.linalg.norm(np.frombuffer(p) - np.frombuffer(q))) <= r + s + reach)
            end = [u and v for u, v in zip(leaf_a, leaf_b, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(c, pa.string()), pa.array(end, pa.bool_())], ["a", "b", "end"]).filter(pa.array(keep, pa.bool_()))

    return run


def embedding_duplicates(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding).

    Links join vectors with a cosine of ``cosine`` or more; n_links counts the other rows that a row links
    with. Vectors that are null, empty, zero or hold null or non-finite elements link with nothing, nor do
    vectors of different lengths. Repeated rows are vectors of their own, and so are rows without vec_id: a component_id
    is the smallest vec_id of the component, null where it has none, and such a component keeps its first row.
    Other columns are not read.
    """
    spark = vectors.sparkSession
    all_rows = staged(vectors.select("vec_id", "embedding").mapInArrow(_usable, "row long, vec_id long, dim int, data binary, d1 long, d2 long"), "vectors")
    entry = all_rows.where("data is not null").groupBy("dim", "d1", "d2")
    classes = staged(entry.agg(F.min("row").alias("rep"), F.count("*").alias("w")), "classes")
    good = all_rows.join(classes.select(F.col("rep").alias("row"), "w"), "row").select("row", "dim", "data", "w")
    total = classes.count()
    size = min(MOST, max(LEAST, -(-total // BLOCKS)))
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + SLACK
    placed, nodes = divided(good, size)
    blocks = staged(placed.groupBy("cell").agg(F.ceil(F.count("*") / size).cast("int").alias("n")), "blocks")
    pairs = surviving(blocks, nodes, reach)
    dealt = placed.join(blocks, "cell").select("cell", F.pmod(F.xxhash64("row"), F.col("n")).cast("int").alias("block"), "row", "w", "data")
    grown = staged(dealt.repartition(width(spark), "cell", "block").sortWithinPartitions("cell", "block").mapInArrow(_grow, "cell string, block int, row long, w long, data binary, at int, path array<int>"), "trees")
    vector = ["row", "w", "data", "at", "path"]
    left = grown.withColumnRenamed("cell", "c1").join(pairs, "c1").select("c1", F.col("block").alias("b1"), "c2", F.explode(F.sequence(F.lit(0), F.col("n2") - 1)).alias("b2"), F.lit(0).alias("side"), *vector)
    right = grown.withColumnRenamed("cell", "c2").join(pairs, "c2").select("c1", F.explode(F.sequence(F.lit(0), F.col("n1") - 1)).alias("b1"), "c2", F.col("block").alias("b2"), F.lit(1).alias("side"), *vector)
    once = (F.col("c1") != F.col("c2")) | (F.col("b1") < F.col("b2")) | ((F.col("b1") == F.col("b2")) & (F.col("side") == 0))
    units = left.union(right).where(once).repartition(width(spark), "c1", "b1", "c2", "b2").sortWithinPartitions("c1", "b1", "c2", "b2", "side")
    found = staged(units.mapInArrow(_compare(cosine), "row long, other long, n long"), "found")
    drop_staged(grown)
    counts = found.where("other is null").groupBy("row").agg(F.sum("n").alias("n"))
    labels = components(found.where("other is not null"), "row", "other")
    of_class = classes.join(counts, classes["rep"] == counts["row"], "left").select("dim", "d1", "d2", "rep", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n"))
    of_class = of_class.join(labels, of_class["rep"] == labels["node"], "left").select("dim", "d1", "d2", "n", F.coalesce("comp", "rep").alias("comp"))
    place = F.struct(F.col("vec_id").isNull().alias("no_id"), "vec_id", "row")
    named = staged(all_rows.drop("data").join(of_class, ["dim", "d1", "d2"], "left").select("row", "vec_id", "n", F.coalesce("comp", F.col("row")).alias("comp")), "named")
    smallest = named.groupBy("comp").agg(F.min(place).alias("lead"))
    out = named.join(smallest, "comp")
    kept = F.when(F.col("vec_id").isNull(), F.col("row") == F.col("lead.row")).otherwise(F.coalesce(F.col("vec_id") == F.col("lead.vec_id"), F.lit(False)))
    return out.select("vec_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_links"), F.col("lead.vec_id").alias("component_id"), kept.alias("kept"))


def op7_covertree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all ``embeddings``: cosine 0.95 or more."""
    return embedding_duplicates(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))
