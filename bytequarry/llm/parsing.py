"""Operator 2: dedup of long repeated byte strings by prefix-free parsing.

1. Rolling-hash triggers: of each run of string starts the gram with the smallest rolling hash is the trigger, so equal
strings have equal triggers at equal places. The starts that share a trigger form a block; its phrase are the
bytes up to the trigger, and what follows is parsed on. 2. Blocks that are equal as a whole are one entry with
a count; an entry that stands twice is repeated at every occurrence. Entries whose trigger has no other entry are
alone. 3. The others go to shards by the content that follows their trigger. A shard cuts what follows into phrases by a
rolling hash of its own (no phrase is the start of another, but for the ends of contexts), and puts together the
dictionary of all phrases. The dictionary's suffix array gives the class of each left phrase's ends; the suffix array of the
parse orders the contexts by the ranks of their phrases, with common lengths of neighbours; both combine
into the corpus order of all strings of the shard, in which a string is repeated if its neighbour has ``length``
bytes in common with it. 4. A trigger with more entries than one order holds is dealt by longer content: parts
of a few starts, each with the bytes that all its strings hold; parts go through the same three steps, and where even
a part has too many entries its strings are counted one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RunHashes, digests, drop_staged, lists, mix64, pack_text, read, runs, slices, staged, unpack_text, width

__all__ = ["corpus_order", "dictionary_order", "repeated_strings", "op2_parsing", "triggers"]

#: Bytes of a trigger's gram and most starts of one block, for strings of 400 bytes; shorter strings scale both down.
GRAM, SPREAD = 32, 256
#: Entries of one trigger or part in one order; beyond, longer content routes them.
GROUP = 1024
#: Contexts of one corpus order.
ORDER = 2048
#: String starts of a part, for triggers beyond GROUP.
PART = 16
#: Bytes of the rolling hash that ends a phrase after the trigger, one in how many places it does, and longest phrase.
CUT, EACH, LONGEST = 8, 32, 64

BLOCKS = pa.list_(pa.struct([("b1", pa.int64()), ("b2", pa.int64()), ("a1", pa.int64()), ("a2", pa.int64()), ("s", pa.int32()), ("n", pa.int32()), ("t", pa.int32())]))
PARSED = "row long, doc_id long, packed binary, size long, blocks array<struct<b1:long,b2:long,a1:long,a2:long,s:int,n:int,t:int>>"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
CONTEXT = "a1 long, a2 long, single boolean, row long, s int, n int, t int, context binary"


def sizes(length: int) -> tuple[int, int]:
    """Gram and spread for strings of ``length`` bytes; their sum stays below it."""
    gram = max(1, min(GRAM, length // 4))
    return gram, max(1, min(SPREAD, length - gram + 1, length * 2 // 3))


#: Low bits of a hash that give way to its position.
PLACE = np.uint64((1 << 32) - 1)


def triggers(hashes: np.ndarray, spread: int) -> np.ndarray:
    """For each run of ``spread`` positions the place of the smallest hash by its high 32 bits, the first of equal ones."""
    n = len(hashes)
    pad = -n % spread
    key = np.full(n + pad, np.iinfo(np.uint64).max, np.uint64)
    key[:n] = (hashes & ~PLACE) | np.arange(n, dtype=np.uint64)
    table = key.reshape(-1, spread)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[: n - spread + 1], ahead[spread - 1 : n]) & PLACE).astype(np.int64)


def _parse(length: int):
    """A row for each document: packed text and its blocks, named by their whole content (b) and by what follows the trigger (a)."""
    gram, spread = sizes(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for b in slices(batches):
            packed, size, counts, out = [], [], [], [[] for _ in range(7)]
            for text in b.column(1).to_pylist():
                data = (text or "").encode("utf-8", "surrogatepass")
                packed.append(pack_text(text))
                size.append(len(data))
                if len(data) < length:
                    counts.append(0)
                    continue
                hashes = RunHashes(np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)).rolling(gram)
                chosen = triggers(hashes[: len(data) - length + spread], spread)
                start, end = runs(chosen)
                t = chosen[start]
                whole = digests(data[x:y] for x, y in zip(start.tolist(), (end - 1 + length).tolist(), strict=True))
                after = digests(data[x : x + length - spread + 1] for x in t.tolist())
                counts.append(len(t))
                for o, v in zip(out, (*whole, *after, start, end - start, t - start), strict=True):
                    o.append(v)
            at = np.arange(number, number + b.num_rows, dtype=np.int64)
            number += b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(at), b.column(0), pa.array(packed, pa.binary()), pa.array(size, pa.int64()), lists(BLOCKS, counts, out)], ["row", "doc_id", "packed", "size", "blocks"])

    return run


def _contexts(length: int):
    """The bytes of each open block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = [[] for _ in range(9)]
            for row, packed, blocks in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = unpack_text(packed)
                for x in blocks:
                    for o, v in zip(out, (x["a1"], x["a2"], x["single"], row, x["s"], x["n"], x["t"], data[x["s"] : x["s"] + x["n"] - 1 + length], x["hot"]), strict=True):
                        o.append(v)
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], ["a1", "a2", "single", "row", "s", "n", "t", "context", "hot"])

    return run


def dictionary_order(phrases: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(starts, classes): the place of each phrase in the dictionary's text and, for every place of that text, the rank of
    the phrase's end that starts there among all different ends; equal ends have equal ranks.

    Prefix doubling over symbols 1 to 256, with 0 behind each phrase: NUL bytes are symbols like any other.
    """
    sizes_ = np.fromiter(map(len, phrases), np.int64, len(phrases))
    starts = np.cumsum(sizes_ + 1) - sizes_ - 1
    n = int((sizes_ + 1).sum())
    text, last = np.zeros(n, np.int64), np.repeat(starts + sizes_, sizes_ + 1)
    inside = np.ones(n, bool)
    inside[starts + sizes_] = False
    text[inside] = np.frombuffer(b"".join(phrases), np.uint8).astype(np.int64) + 1
    at = np.arange(n)

    def ranks(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        steps = np.concatenate([[1], key[order[1:]] != key[order[:-1]]]).cumsum()
        out = np.empty(n, np.int64)
        out[order] = steps
        return out

    def ahead(values: np.ndarray, k: int) -> np.ndarray:
        return np.where(at + k <= last, values[np.minimum(at + k, n - 1)], 0)

    key = text.copy()
    for k in range(1, 7):
        key = key << 9 | ahead(text, k)
    rank, k, most = ranks(key), 7, int(sizes_.max(initial=0)) + 1
    while k < most:
        rank = ranks(rank * (n + 1) + ahead(rank, k))
        k *= 2
    return starts, rank


def cut_phrases(contexts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Context of each phrase, and the phrases: a phrase ends where the rolling hash says so, LONGEST bytes after the
    last such place, again and again, and at the context's end. The bytes of a phrase tell where it ends."""
    sizes_ = np.fromiter(map(len, contexts), np.int64, len(contexts))
    ends = np.cumsum(sizes_)
    data = b"".join(contexts)
    b = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    if not len(b):
        return np.zeros(0, np.int64), []
    at, owner = np.arange(len(b)), np.repeat(np.arange(len(contexts)), sizes_)
    start = np.repeat(ends - sizes_, sizes_)
    h = np.zeros(len(b), np.uint64)
    for j in range(CUT):  # the gram that ends here
        h[j:] += b[: len(b) - j] * mix64(np.array([j + 1], np.uint64))[0]
    natural = (mix64(h) % np.uint64(EACH) == 0) & (at - start >= CUT - 1)
    since = np.maximum.accumulate(np.where(natural, at + 1, 0))
    since = np.maximum(np.concatenate([[0], since[:-1]]), start)  # first byte after the last natural end before this byte
    ends_here = natural | ((at - since + 1) % LONGEST == 0)
    ends_here[ends[sizes_ > 0] - 1] = True
    stop = np.flatnonzero(ends_here) + 1
    begin = np.concatenate([[0], stop[:-1]])
    return owner[begin], [data[x:y] for x, y in zip(begin.tolist(), stop.tolist(), strict=True)]


def parse_order(owner: np.ndarray, ids: np.ndarray, rank: np.ndarray, phrases: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each context in the order of its phrases' ranks, and the bytes that each rank has in common with the one before."""
    begin = np.searchsorted(owner, np.arange(n))
    column = np.arange(len(owner)) - begin[owner]
    wide = int(column.max(initial=-1)) + 2
    line, size = np.zeros((n, wide), np.int64), np.zeros((n, wide), np.int64)
    which = np.full((n, wide), -1, np.int64)
    lengths = np.fromiter(map(len, phrases), np.int64, len(phrases))
    line[owner, column], size[owner, column], which[owner, column] = rank[ids], lengths[ids], ids
    order = np.lexsort(line.T[::-1])
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    common = np.zeros(n, np.int64)
    if n > 1:
        a, b = order[1:], order[:-1]
        same = line[a] == line[b]
        differ = np.where(same.all(axis=1), wide - 1, same.argmin(axis=1))
        pick = np.arange(n - 1)
        before = np.cumsum(size[a], axis=1)[pick, differ] - size[a][pick, differ]
        x, y = which[a][pick, differ], which[b][pick, differ]
        both = np.flatnonzero((x >= 0) & (y >= 0))
        if len(both):
            most = max(LONGEST, 1)
            table = np.zeros((len(phrases), most), np.int16)
            flat = np.frombuffer(b"".join(p[:most] for p in phrases), np.uint8)
            kept = np.minimum(lengths, most)
            table[np.repeat(np.arange(len(phrases)), kept), np.arange(len(flat)) - np.repeat(np.cumsum(kept) - kept, kept)] = flat.astype(np.int16) + 1
            equal = (table[x[both]] == table[y[both]]) & (table[x[both]] > 0)
            before[both] += np.where(equal.all(axis=1), most, equal.argmin(axis=1))
        common[1:] = before
    return place, common


def corpus_order(contexts: list[bytes], before: np.ndarray, count: np.ndarray, length: int) -> list[np.ndarray]:
    """For each context the starts, of its ``count`` first ones, whose string of ``length`` bytes is also one of another context.

    ``before``: bytes of a context before its trigger. A start's string is an end of the left phrase and the parse
    after the trigger; all strings are sorted by (class of that end, rank of the parse), and a neighbour with the
    same end has the end's bytes and the least common length between the two parses in common.
    """
    n = len(contexts)
    owner, after = cut_phrases([c[t : t + length] for c, t in zip(contexts, before.tolist(), strict=True)])
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(p, len(known)) for p in after), np.int64, len(after))
    rights = len(known)
    left = np.fromiter((known.setdefault(c[:t], len(known)) for c, t in zip(contexts, before.tolist(), strict=True)), np.int64, n)
    phrases = list(known)
    starts, rank = dictionary_order(phrases)
    place, common = parse_order(owner, ids, rank[starts], phrases[:rights], n)

    which = np.repeat(np.arange(n), count)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    end, parse = rank[starts[left[which]] + offset], place[which]
    order = np.lexsort((parse, end))
    hit = np.zeros(len(which), bool)
    same = np.flatnonzero(end[order[1:]] == end[order[:-1]])
    one, two = order[same], order[same + 1]
    levels = [common]  # least common length of 2**k ranks
    while len(levels[-1]) > 1 << (len(levels) - 1):
        half, v = 1 << (len(levels) - 1), levels[-1]
        levels.append(np.minimum(v[: len(v) - half], v[half:]))
    lo, hi = parse[one] + 1, parse[two]
    k = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    least = np.zeros(len(lo), np.int64)
    for level, values in enumerate(levels):
        on = np.flatnonzero(k == level)
        least[on] = np.minimum(values[lo[on]], values[hi[on] - (1 << level) + 1])
    long_ = before[which[one]] - offset[one] + least >= length
    hit[one[long_]] = True
    hit[two[long_]] = True
    return [np.flatnonzero(x) for x in np.split(hit, np.cumsum(count)[:-1])] if n else []


def _order(length: int):
    """Rows sorted by what routes them -> repeated starts (row, s, n) of the blocks that stand once."""

    def decide(rows: list[tuple]) -> list[tuple[int, int, int]]:
        before, count = np.array([r[6] for r in rows], np.int64), np.array([r[5] for r in rows], np.int64)
        out = []
        for (_, _, single, row, s, *_), at in zip(rows, corpus_order([r[7] for r in rows], before, count, length), strict=True):
            if single and len(at):
                out += [(row, s + int(at[a]), int(b - a)) for a, b in zip(*runs(at - np.arange(len(at))), strict=True)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def batch(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
            x = list(zip(*found, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(x[0], pa.int64()), pa.array(x[1], pa.int32()), pa.array(x[2], pa.int32())], ["row", "s", "n"])

        for b in slices(batches):
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if len(rows) >= ORDER and r[:2] != rows[-1][:2]:
                    yield batch(decide(rows))
                    rows = []
                rows.append(r)
        if len(rows) > 1:
            yield batch(decide(rows))

    return run


def _parts(length: int):
    """Rows (b1, b2, a1, a2, row, s, n, t, single, context) for each part of a context: up to PART starts, on a grid from the trigger.

    a names the bytes that all strings of a full part hold, b all bytes of the part's strings, and the context are these.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out, pieces, cores = [[] for _ in range(5)], [], []
            for single, row, s, n, t, context in zip(*(c.to_pylist() for c in b.columns), strict=True):
                before = t - np.arange(n)
                lo, hi = runs(before // PART)
                grid = before[lo] // PART * PART
                pieces += [context[x:y] for x, y in zip(lo.tolist(), (hi - 1 + length).tolist(), strict=True)]
                cores += [context[x:y] for x, y in zip((t - grid).tolist(), (t - grid - (PART - 1) + length).tolist(), strict=True)]
                for o, v in zip(out, (np.full(len(lo), row), s + lo, hi - lo, t - lo, np.full(len(lo), single)), strict=True):
                    o.append(v)
            if pieces:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
                names = [pa.array(v) for v in (*digests(pieces), *digests(cores))]
                yield pa.RecordBatch.from_arrays([*names, *(pa.array(np.concatenate(o)).cast(k) for o, k in zip(out, kinds, strict=True)), pa.array(pieces, pa.binary())], ["b1", "b2", "a1", "a2", "row", "s", "n", "t", "single", "context"])

    return run


def _strings(length: int):
    """Rows (b1, b2, row, s, single) for each string of the parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            pieces, out = [], [[], [], []]
            for row, s, n, single, context in zip(*(c.to_pylist() for c in b.columns), strict=True):
                pieces += [context[x : x + length] for x in range(n)]
                for o, v in zip(out, (np.full(n, row), s + np.arange(n), np.full(n, single)), strict=True):
                    o.append(v)
            if pieces:
                yield pa.RecordBatch.from_arrays([*(pa.array(v) for v in digests(pieces)), pa.array(np.concatenate(out[0])), pa.array(np.concatenate(out[1]).astype(np.int32)), pa.array(np.concatenate(out[2]))], ["b1", "b2", "row", "s", "single"])

    return run


def entries(places: DataFrame, *rest: str) -> tuple[DataFrame, DataFrame]:
    """The different contents b of ``places`` with count c and one place p, and those whose a has other entries and a lone one, with their number."""
    first = staged(places.groupBy("b1", "b2").agg(F.count("*").alias("c"), F.min(F.struct("row", "s", "n", "t", "a1", "a2", *rest)).alias("p")), "entries")
    mixed = first.groupBy("p.a1", "p.a2").agg(F.count("*").alias("kinds"), F.min("c").alias("least")).where("kinds > 1 and least = 1")
    return first, first.select("p.*", "c", "b1", "b2").join(mixed, ["a1", "a2"])


def _ordered(contexts: DataFrame, length: int, tasks: int) -> DataFrame:
    rows = contexts.select("a1", "a2", "single", "row", "s", "n", "t", "context")
    return rows.repartition(tasks, "a1", "a2").sortWithinPartitions("a1", "a2").mapInArrow(_order(length), "row long, s int, n int")


def _hot(contexts: DataFrame, length: int, tasks: int) -> DataFrame:
    """Repeated starts (row, s, n) of blocks whose trigger has more entries than one order holds: longer content routes their parts."""
    kinds = "b1 long, b2 long, a1 long, a2 long, row long, s int, n int, t int, single boolean, context binary"
    parts = staged(contexts.select("single", "row", "s", "n", "t", "context").mapInArrow(_parts(length), kinds), "parts")
    first, several = entries(parts.drop("context"), "single")
    whole = parts.where("single").select("b1", "b2", "row", "s", "n").join(first.where("c > 1").select("b1", "b2"), ["b1", "b2"]).select("row", "s", "n")
    open_ = several.select("row", "s", "n", "kinds", (F.col("single") & (F.col("c") == 1)).alias("single"))
    open_ = staged(parts.drop("single").join(open_, ["row", "s", "n"]), "open")
    found = _ordered(open_.where(F.col("kinds") <= GROUP), length, tasks)
    strings = staged(open_.where(F.col("kinds") > GROUP).select("row", "s", "n", "single", "context").mapInArrow(_strings(length), "b1 long, b2 long, row long, s int, single boolean"), "strings")
    twice = strings.groupBy("b1", "b2").agg(F.count("*").alias("c")).where("c > 1").select("b1", "b2")
    return whole.union(found).union(strings.where("single").join(twice, ["b1", "b2"]).select("row", "s", F.lit(1).alias("n")))


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            total, gone, spans, kept = [], [], [], []
            for packed, ranges in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                data = unpack_text(packed)
                cuts: list[list[int]] = []
                for s, e in sorted((x["s"], x["s"] + x["n"] - 1 + length) for x in ranges or ()):
                    if cuts and s <= cuts[-1][1]:
                        cuts[-1][1] = max(cuts[-1][1], e)
                    else:
                        cuts.append([s, e])
                edges = [0, *(x for c in cuts for x in c), len(data)]
                total.append(len(data))
                gone.append(sum(e - s for s, e in cuts))
                spans.append([{"start": s, "end": e} for s, e in cuts])
                kept.append(b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, SPANS), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return run


def repeated_strings(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (start and end of each removed run) and kept (the remaining bytes) for
    every row of ``docs`` (doc_id, text).

    Removed are the bytes of every string of ``length`` bytes of a text's UTF-8 that also starts anywhere
    else, in the same document or another. Null texts are empty; texts under ``length`` bytes keep all. Repeated rows,
    and rows without doc_id, are documents of their own. Very long texts are read whole; the task that
    holds one needs memory in proportion to it. Other columns are not read.
    """
    parsed = staged(docs.select("doc_id", "text").mapInArrow(_parse(length), PARSED), "parsed")
    tasks = width(docs.sparkSession, 4 * (parsed.agg(F.sum("size")).first()[0] or 0))
    block = parsed.select("row", F.inline("blocks"))
    first, several = entries(block)
    whole = block.select("b1", "b2", "row", "s", "n").join(first.where("c > 1").select("b1", "b2"), ["b1", "b2"]).select("row", "s", "n")
    wanted = several.groupBy("row").agg(F.collect_list(F.struct("a1", "a2", (F.col("kinds") > GROUP).alias("hot"), (F.col("c") == 1).alias("single"), "s", "n", "t")).alias("open"))
    contexts = parsed.select("row", "packed").join(wanted, "row").select("row", "packed", "open").mapInArrow(_contexts(length), f"{CONTEXT}, hot boolean")
    contexts = staged(contexts, "contexts")
    cut = whole.union(_ordered(contexts.where("not hot"), length, tasks))
    hot = contexts.where("hot")
    if not hot.isEmpty():
        cut = cut.union(_hot(hot, length, tasks))
    cut = staged(cut.groupBy("row").agg(F.collect_list(F.struct("s", "n")).alias("ranges")), "cut")
    drop_staged(first)
    drop_staged(contexts)
    out = parsed.select("row", "doc_id", "packed").join(cut, "row", "left").select("doc_id", "packed", "ranges")
    return out.mapInArrow(_cut(length), "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")


def op2_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` without the bytes of 400-byte strings that start twice or more."""
    out = repeated_strings(read(spark, sf_dir, "documents", "doc_id", "text"), 400)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
