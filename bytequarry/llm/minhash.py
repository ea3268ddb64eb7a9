"""Operator 1: MinHash near-dedup by a signature-coordinate inverted join.

Texts with equal shingle sets form one class. A class posts itself under each of its coordinate-value
pairs. Two sets of similarity s agree in a binomial number of the ``coordinates``; ``matches`` is the
largest count that a pair at the threshold misses with a chance of at most ``MISS``. So two linked classes
share one of the ``coordinates - matches + 1`` rarest pairs of either (prefix merging), and a class with
fewer shared pairs than ``matches`` has no partner (skip merging). Postings of the prefix are joined and
for every pair that meets there the collisions of its signatures are counted; pairs of ``matches`` or more are
retained and decided on the full sets.

Large postings (groups of near copies) are first contracted: each member is compared with the member of
the most shared pairs; afterwards only members outside the largest component are compared with the rest,
in blocks of bounded size. Tasks return a spanning forest of the links that they find, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MIX_B, drop_staged, lower_words, mix64, pack_text, read, shingle_set, slices, staged, unpack_text, width
from .graph import components

__all__ = ["near_duplicates", "op1_minhash"]

#: Chance that a pair right at the threshold agrees in fewer coordinates than asked for.
MISS = 2e-6
#: Members of one block of a posting; a task holds two blocks at once.
BLOCK = 256


@cache
def matches(coordinates: int, threshold: float) -> int:
    """The largest t with P(Binomial(coordinates, threshold) < t) <= MISS, at least 1."""
    below, t = 0.0, 0
    while t < coordinates:
        below += math.comb(coordinates, t) * threshold**t * (1 - threshold) ** (coordinates - t)
        if below > MISS:
            break
        t += 1
    return max(1, t)


@cache
def multipliers(coordinates: int) -> np.ndarray:
    return mix64(np.arange(1, coordinates + 1, dtype=np.uint64) * MIX_B) | np.uint64(1)


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """The smallest value of each of ``coordinates`` hash functions over the set."""
    out = np.empty(coordinates, np.uint64)
    for c, a in enumerate(multipliers(coordinates)):
        x = shingles * a
        out[c] = (x ^ (x >> np.uint64(32))).min()
    return out


SIGNED = "row long, doc_id long, carry string, packed binary, n long, cls binary, sig binary"


def _sign(size: int, coordinates: int):
    """A row for each document: packed text, number of shingles, name of the set (128 bits) and its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for b in slices(batches):
            packed, n, cls, sig = [], [], [], []
            for text in b.column(2).to_pylist():
                s = shingle_set(lower_words(text), size)
                packed.append(None if text is None else pack_text(text))
                n.append(len(s))
                cls.append(xxhash.xxh3_128_digest(s.tobytes()))
                sig.append(signature(s, coordinates).tobytes() if len(s) else b"")
            at = np.arange(number, number + b.num_rows, dtype=np.int64)
            number += b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(at), b.column(0), b.column(1), pa.array(packed, pa.binary()), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(sig, pa.binary())], ["row", "doc_id", "carry", "packed", "n", "cls", "sig"])

    return run


def _post(coordinates: int):
    """Rows (cls, key) for each coordinate; the key mixes the coordinate's number with its value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix64(np.arange(coordinates, dtype=np.uint64) + np.uint64(77))
        for b in slices(batches):
            if b.num_rows:
                values = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint64).reshape(-1, coordinates)
                keys = mix64(values + salt).astype(np.int64).ravel()
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), coordinates))), pa.array(keys)], ["cls", "key"])

    return run


def _words(packed: bytes) -> list[bytes]:
    return unpack_text(packed).lower().split()


class _Forest:
    """Union-find over positions; ``edges`` are those that joined two parts."""

    def __init__(self, n: int):
        self.up, self.edges = list(range(n)), []

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.edges.append((a, b))


def collisions(signatures: np.ndarray, left: int, inner: bool, need: int) -> list[tuple[int, np.ndarray]]:
    """(a, positions b): pairs of the first ``left`` with later ones (``inner``: also among themselves) that share ``need`` coordinates or more."""
    out = []
    for a in range(left):
        lo = a + 1 if inner else left
        b = lo + np.flatnonzero((signatures[lo:] == signatures[a]).sum(axis=1) >= need)
        if len(b):
            out.append((a, b))
    return out


def linked(pairs: list[tuple[int, np.ndarray]], shingles: Callable[[int], np.ndarray], n: int, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of those pairs whose full sets are similar enough; pairs already joined are not looked at."""
    used = sorted({a for a, _ in pairs} | {int(x) for _, b in pairs for x in b})
    if not used:
        return []
    sets = [shingles(i) for i in used]
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ids = dict(zip(used, np.split(flat, np.cumsum([len(x) for x in sets])[:-1]), strict=True))
    forest, flag = _Forest(n), np.zeros(int(flat.max()) + 1, np.int32)
    for a, b in pairs:
        b = [x for x in b.tolist() if forest.root(x) != forest.root(a)]
        if not b:
            continue
        size = np.array([len(ids[x]) for x in b])
        flag[ids[a]] = 1
        common = np.add.reduceat(flag[np.concatenate([ids[x] for x in b])], np.cumsum(size) - size)
        flag[ids[a]] = 0
        for i in np.flatnonzero(100 * common >= percent * (len(ids[a]) + size - common)):
            forest.join(a, b[i])
    return forest.edges


def _decide(size: int, percent: int, need: int):
    """Rows sorted by unit and side -> verified links of each unit: collisions are counted, those of ``need`` or more held against the full sets."""

    def unit(rows: dict[int, dict[bytes, tuple[bytes, bytes]]]) -> list[tuple[bytes, bytes]]:
        left = rows.get(0, {})
        right = {c: t for c, t in rows.get(1, {}).items() if c not in left}
        ids, members = [*left, *right], [*left.values(), *right.values()]
        if not left or len(ids) < 2:
            return []
        signatures = np.frombuffer(b"".join(sig for _, sig in members), np.uint64).reshape(len(ids), -1)
        pairs = collisions(signatures, len(left), True, need)
        return [(ids[a], ids[b]) for a, b in linked(pairs, lambda i: shingle_set(_words(members[i][0]), size), len(ids), percent)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, {}, []

        def batch() -> pa.RecordBatch:
            pairs = pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([y for _, y in out], pa.binary())], ["a", "b"])
            out.clear()
            return pairs

        for b in slices(batches):
            for u1, u2, u3, side, cls, packed, sig in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (u1, u2, u3) != now:
                    if rows:
                        out += unit(rows)
                    now, rows = (u1, u2, u3), {}
                rows.setdefault(side, {})[cls] = packed, sig
            if len(out) > 10_000:
                yield batch()
        if rows:
            out += unit(rows)
        yield batch()

    return run


@dataclass(frozen=True)
class _Rule:
    """What a pair of classes must meet."""

    texts: DataFrame
    shingle: int
    percent: int
    need: int

    def verified(self, units: DataFrame) -> DataFrame:
        """Links found in the units (u1, u2, u3, side, cls)."""
        rows = units.join(self.texts, "cls").select("u1", "u2", "u3", "side", "cls", "packed", "sig")
        dealt = rows.repartition(width(rows.sparkSession), "u1", "u2", "u3").sortWithinPartitions("u1", "u2", "u3", "side")
        return dealt.mapInArrow(_decide(self.shingle, self.percent, self.need), "a binary, b binary")


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        texts = [None if p is None else unpack_text(p) for p in b.column(b.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.binary()).cast(pa.string())], [*b.schema.names[:-1], "text"])


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, coordinates: int = 32, carry: tuple[str, ...] | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, first for every row of ``docs`` (doc_id, text).

    Links join documents whose sets of ``shingle`` words have a Jaccard similarity of ``percent`` / 100 or
    more. Null and empty texts have an empty set and link with nothing. component_id is the smallest doc_id
    reachable; ``kept`` is doc_id = component_id, so rows that share that id are all kept, and ``first`` holds for exactly
    one row of each component. Rows without doc_id take part; a component without any id has a null component_id and
    keeps its first row. Repeated rows each return a row; rows that share a doc_id but not a text are
    separate documents. Very long texts are read whole. Other columns are not read; with ``carry`` those named,
    and the text, are given back as well, and must not have the names of the result.
    """
    need = matches(coordinates, percent / 100)
    prefix = coordinates - need + 1
    carried = docs.select(*(carry or ())).schema
    extra = F.to_json(F.struct(*carry)) if carry else F.lit(None).cast("string")
    signed = staged(docs.select("doc_id", extra.alias("carry"), "text").mapInArrow(_sign(shingle, coordinates), SIGNED), "signed")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    classes = staged(signed.where("n > 0").groupBy("cls").agg(F.min(place).alias("rep"), F.first("sig").alias("sig")), "classes")
    posted = classes.select("cls", "sig").mapInArrow(_post(coordinates), "cls binary, key long")
    frequent = posted.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    of_class = posted.join(frequent, "key").groupBy("cls").agg(F.collect_list(F.struct("df", "key")).alias("p"), F.sum("df").alias("score")).where(F.size("p") >= need)
    rare = F.slice(F.array_sort("p"), F.lit(1), F.size("p") - (coordinates - prefix))
    prefixes = staged(of_class.select("cls", "score", F.explode(rare).alias("x")).select("cls", "score", F.col("x.key").alias("key")), "prefixes")
    sums = [F.sum(F.xxhash64(F.lit(i), "cls").cast("decimal(38,0)")).alias(f"same{i}") for i in (1, 2)]
    postings = prefixes.groupBy("key").agg(F.count("*").alias("n"), *sums).where("n > 1")
    postings = postings.groupBy("n", "same1", "same2").agg(F.min("key").alias("key")).select("key", "n")  # postings with equal members count once
    member = staged(prefixes.join(postings, "key"), "postings")
    wanted = member.select("cls").distinct().join(classes.select("cls", F.col("rep.row").alias("row"), "sig"), "cls")
    texts = staged(signed.select("row", "packed").join(wanted, "row").select("cls", "packed", "sig"), "texts")
    rule = _Rule(texts, shingle, percent, need)

    small = member.where(F.col("n") <= BLOCK).select(F.col("key").alias("u1"), F.lit(0).alias("u2"), F.lit(0).alias("u3"), F.lit(0).alias("side"), "cls")
    links = staged(rule.verified(small.withColumn("u1", F.col("u1").cast("string").cast("binary"))), "links")
    large = member.where(F.col("n") > BLOCK)
    if not large.isEmpty():
        links = staged(links.union(_large(large, rule)), "links")
    labels = components(links, "a", "b")
    for x in (prefixes, member, texts, links):
        drop_staged(x)
    of_node = classes.select("cls", "rep").join(labels.select(F.col("node").alias("cls"), "comp"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    smallest = of_node.groupBy("comp").agg(F.min("rep").alias("lead"))
    of_class = of_node.join(smallest, "comp").select("cls", "lead")
    held = ["row", "doc_id", "n", "cls", *(["carry", "packed"] if carry is not None else [])]
    out = signed.select(*held).join(of_class, "cls", "left").withColumn("lead", F.coalesce("lead", place))
    first, same = F.col("row") == F.col("lead.row"), F.col("doc_id") == F.col("lead.doc_id")
    kept = F.when(F.col("doc_id").isNull(), first).otherwise(F.coalesce(same, F.lit(False)))
    columns = ["doc_id", F.col("n").alias("n_shingles"), F.col("lead.doc_id").alias("component_id"), kept.alias("kept"), first.alias("first")]
    if carry is None:
        return out.select(*columns)
    rows = out.select(*columns, "carry", "packed").mapInArrow(_unpack, "doc_id long, n_shingles long, component_id long, kept boolean, first boolean, carry string, text string")
    back = F.from_json("carry", carried)
    return rows.select("doc_id", "n_shingles", "component_id", "kept", "first", "text", *(back[c].alias(c) for c in carry))


def _large(large: DataFrame, rule: _Rule) -> DataFrame:
    """Links among the members of large postings: a star round, then outsiders against all members in blocks."""
    leader = large.groupBy("key").agg(F.max(F.struct("score", "cls")).alias("lead"))
    best = large.join(leader, "key").groupBy("cls").agg(F.max("lead").alias("lead")).select("cls", F.col("lead.cls").alias("lead")).where("cls <> lead")
    best = staged(best, "leaders")
    spread = best.groupBy("lead").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("s"))
    block = lambda n: F.pmod(F.xxhash64("cls"), n).cast("int")
    ones = best.join(spread, "lead").select(F.col("lead").alias("u1"), block(F.col("s")).alias("u2"), F.lit(-1).alias("u3"), F.lit(1).alias("side"), "cls")
    lead = spread.select(F.col("lead").alias("u1"), F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("u2"), F.lit(-1).alias("u3"), F.lit(0).alias("side"), F.col("lead").alias("cls"))
    star = staged(rule.verified(ones.union(lead)), "star")
    labels = components(star, "a", "b")
    known = staged(large.join(labels.select(F.col("node").alias("cls"), "comp"), "cls", "left").select("key", "n", "cls", F.coalesce("comp", "cls").alias("comp")), "known")
    parts = known.groupBy("key", "comp").agg(F.count("*").alias("c"))
    main = parts.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("m"), F.sum("c").alias("all")).where(F.col("m.c") < F.col("all"))
    main = main.select("key", F.col("m.comp").alias("main"), F.ceil((F.col("all") - F.col("m.c")) / BLOCK).cast("int").alias("outs"), F.ceil(F.col("all") / (4 * BLOCK)).cast("int").alias("ins"))
    rows = staged(known.join(main, "key").withColumn("u1", F.col("key").cast("string").cast("binary")), "outsiders")
    out = rows.where("comp <> main").select("u1", block(F.col("outs")).alias("u2"), F.explode(F.sequence(F.lit(0), F.col("ins") - 1)).alias("u3"), F.lit(0).alias("side"), "cls")
    rest = rows.select("u1", F.explode(F.sequence(F.lit(0), F.col("outs") - 1)).alias("u2"), block(F.col("ins")).alias("u3"), F.lit(1).alias("side"), "cls")
    found = rule.verified(out.union(rest))
    return star.union(found)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of ``documents``: 3-word shingles, similarity 0.85 or more."""
    return near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"), shingle=3, percent=85).drop("first")
