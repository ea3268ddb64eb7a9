"""Operator 9: substring dedup with sharded automata of repeated phrases.

Of each window of words the phrase (a few words) with the smallest hash is its anchor, so equal windows have equal
anchors at equal places. 1. Anchors are counted over the corpus by their words; those that stand twice or more are
the confirmed phrases. 2. Documents are dealt to shards of bounded size. A shard gets the confirmed phrases that its
documents may hold, compiles them into one Aho-Corasick automaton and streams its documents through it. The hits
are all that is known of a document from then on: of each window the located phrase with the smallest hash is the
anchor, windows without a hit repeat nothing, and the windows of one anchor stand side by side: a block. (A
phrase is located in every document where it is an anchor; where it is not, a smaller one is, so the hits of
two shards agree on equal windows.) 3. A block that also stands earlier is repeated as a whole. 4. Only of the first
occurrence of blocks whose anchor has several different blocks are single windows compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RunHashes, digests, drop_staged, lists, pack_text, read, runs, slices, staged, unpack_text, width, word_hashes
from .parsing import triggers

__all__ = ["repeated_passages", "op9_phrases"]

#: Words of a phrase.
PHRASE = 6
#: Bytes of text of one shard, about.
SHARD_BYTES = 2_000_000
#: Order of a document without id: after all others.
LAST = (1 << 63) - 1

PARSED = "row long, doc_id long, carry string, packed binary, size long, anchors array<struct<hash:long,phrase:binary,c:int>>"
ANCHORS = pa.list_(pa.struct([("hash", pa.int64()), ("phrase", pa.binary()), ("c", pa.int32())]))
LOCATED = "row long, doc_id long, carry string, packed binary, blocks array<struct<b1:long,b2:long,ah:long,s:int,n:int>>"
BLOCKS = pa.list_(pa.struct([("b1", pa.int64()), ("b2", pa.int64()), ("ah", pa.int64()), ("s", pa.int32()), ("n", pa.int32())]))
SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def joined_words(data: bytes) -> tuple[bytes, np.ndarray, list[bytes]]:
    """The words with one space before, between and after them, the places of these spaces, and the words."""
    words = data.split()
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return b" " + b" ".join(words) + b" ", np.concatenate([[0], np.cumsum(sizes + 1)]), words


def _parse(window: int, phrase: int):
    """A row for each document: its packed text and its anchors, each with its words and how often it stands here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for b in slices(batches):
            packed, size, counts, hashes, texts, times = [], [], [], [], [], []
            for text in b.column(2).to_pylist():
                data = (text or "").encode("utf-8", "surrogatepass")
                packed.append(pack_text(text))
                size.append(len(data))
                line, gaps, words = joined_words(data)
                if len(words) < window:
                    counts.append(0)
                    continue
                grams = RunHashes(word_hashes(words)).rolling(phrase) >> np.uint64(1)
                chosen = triggers(grams, window - phrase + 1)
                first, _ = runs(chosen)
                u, i, c = np.unique(grams[chosen[first]], return_index=True, return_counts=True)
                q = chosen[first][i]
                counts.append(len(u))
                hashes.append(u.astype(np.int64))
                times.append(c)
                texts += [line[x:y] for x, y in zip((gaps[q] + 1).tolist(), gaps[q + phrase].tolist(), strict=True)]
            at = np.arange(number, number + b.num_rows, dtype=np.int64)
            number += b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(at), b.column(0), b.column(1), pa.array(packed, pa.binary()), pa.array(size, pa.int64()), lists(ANCHORS, counts, [hashes, texts, times])], ["row", "doc_id", "carry", "packed", "size", "anchors"])

    return run


def locate(automaton: ahocorasick.Automaton, hashes: np.ndarray, data: bytes, window: int, phrase: int) -> tuple[list[np.ndarray], list[bytes]]:
    """(anchor, first window, windows) of the blocks that the automaton's hits make of a text, and their words."""
    line, gaps, _ = joined_words(data)
    n = len(gaps) - 1
    hits = np.fromiter(chain.from_iterable(automaton.iter(line.decode("latin-1"))) if n >= window else (), np.int64).reshape(-1, 2)
    if not len(hits):
        return [np.zeros(0, np.int64)] * 3, []
    value = np.full(n - phrase + 1, np.iinfo(np.uint64).max, np.uint64)
    value[np.searchsorted(gaps, hits[:, 0]) - phrase] = hashes[hits[:, 1]]
    chosen = triggers(value, window - phrase + 1)
    s, e = runs(chosen)
    found = value[chosen[s]] < 1 << 63
    s, e, chosen = s[found], e[found], chosen[s[found]]
    pieces = [line[x:y] for x, y in zip((gaps[s] + 1).tolist(), gaps[e + window - 1].tolist(), strict=True)]
    return [value[chosen].astype(np.int64), s, e - s], pieces


def _locate(window: int, phrase: int):
    """Rows sorted by shard, its phrases first -> a row for each document with its located blocks."""

    def shard(phrases: dict[bytes, int], docs: list[tuple[int, int, str, bytes]]) -> pa.RecordBatch:
        automaton = ahocorasick.Automaton()
        for k, text in enumerate(phrases):
            automaton.add_word(f" {text.decode('latin-1')} ", k)
        if phrases:
            automaton.make_automaton()
        hashes = np.fromiter(phrases.values(), np.uint64, len(phrases))
        counts, parts, halves = [], [[], [], []], [[], []]
        for *_, packed in docs:
            fields, pieces = locate(automaton, hashes, unpack_text(packed), window, phrase) if phrases else ([np.zeros(0, np.int64)] * 3, [])
            counts.append(len(pieces))
            for o, v in zip((*halves, *parts), (*digests(pieces), *fields), strict=True):
                o.append(v)
        cols = list(zip(*docs, strict=True))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), lists(BLOCKS, counts, [*halves, *parts])], ["row", "doc_id", "carry", "packed", "blocks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, phrases, docs = None, {}, []
        for b in slices(batches):
            if not b.num_rows:
                continue
            shards, kinds = b.column(0).to_numpy(), b.column(1).to_numpy()
            for lo, hi in zip(*runs(shards * 2 + kinds), strict=True):
                if shards[lo] != now:
                    if docs:
                        yield shard(phrases, docs)
                    now, phrases, docs = shards[lo], {}, []
                part = [b.column(i).slice(lo, hi - lo).to_pylist() for i in range(2, 7)]
                if kinds[lo] == 0:
                    phrases.update(zip(part[4], part[0], strict=True))
                else:
                    docs += zip(*part[1:], strict=True)
        if docs:
            yield shard(phrases, docs)

    return run


def _windows(window: int):
    """Rows (h1, h2, doc_id, row, s) for each window of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = [[] for _ in range(5)]
            for row, doc_id, packed, blocks in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at = np.unique(np.concatenate([np.arange(x["s"], x["s"] + x["n"]) for x in blocks]))
                line, gaps, _ = joined_words(unpack_text(packed))
                h = digests(line[x:y] for x, y in zip((gaps[at] + 1).tolist(), gaps[at + window].tolist(), strict=True))
                for o, v in zip(out, (*h, np.full(len(at), doc_id), np.full(len(at), row), at), strict=True):
                    o.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o).astype(np.int64)) for o in out], ["h1", "h2", "doc_id", "row", "s"])

    return run


def word_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the first byte of each word and of the byte after it."""
    b = np.frombuffer(data, np.uint8)
    gap = np.concatenate([[True], (b == 32) | ((b >= 9) & (b <= 13)), [True]])
    return np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])


def gone(ranges: list[dict], words: int, window: int) -> np.ndarray:
    """Of each word whether a window of the ranges covers it."""
    change = np.zeros(words + 1, np.int64)
    for x in ranges:
        change[x["s"]] += 1
        change[x["s"] + x["n"] + window - 1] -= 1
    return np.cumsum(change[:-1]) > 0


def without(data: bytes, out: np.ndarray) -> bytes:
    """The text without the words that are out; the layout between kept words stays."""
    first, _ = word_places(data)
    edge, pieces, at = np.append(first, len(data)), [], 0
    for x, y in zip(*runs(out), strict=True):
        if out[x]:
            pieces.append(data[at : edge[x]])
            at = int(edge[y])
    return b"".join([*pieces, data[at:]])


def _cut(window: int, as_words: bool):
    """Removes the words of the windows from the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            total, lost, spans, kept = [], [], [], []
            for packed, ranges in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                data = unpack_text(packed)
                words = data.split()
                out = gone(ranges, len(words), window) if ranges else None
                total.append(len(words))
                lost.append(0 if out is None else int(out.sum()))
                spans.append([] if out is None else [{"first": int(x), "last": int(y) - 1} for x, y in zip(*runs(out), strict=True) if out[x]])
                if as_words:
                    data = b" ".join(words if out is None else compress(words, ~out))
                elif out is not None:
                    data = without(data, out)
                kept.append(data)
            texts = pa.array(kept, pa.binary())
            try:
                texts = texts.cast(pa.string())
            except pa.ArrowInvalid:  # text that is no UTF-8
                texts = pa.array([x.decode("utf-8", "replace") for x in kept], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(total, pa.int64()), pa.array(lost, pa.int64()), pa.array(spans, SPANS), texts], ["doc_id", "carry", "n_words", "n_removed", "spans", "kept"])

    return run


def repeated_passages(docs: DataFrame, window: int = 20, carry: tuple[str, ...] = (), as_words: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, spans (first and last word of each removed run) and kept (the text without
    them, white space between kept words as it was, or one space ``as_words``) for every row of ``docs`` (doc_id, text).

    Removed are the words of every run of ``window`` words that also starts earlier: in a smaller doc_id, or
    before in the same document. Null texts have no words; a text under ``window`` words keeps all. Of rows
    that share a doc_id one counts as earlier, so of repeated rows one is kept. Rows without doc_id are documents
    of their own and come after all others, in one order. Very long texts are read whole; the task that
    holds one needs memory in proportion to it. Other columns are not read, but for those in ``carry``, which are given
    back beside doc_id and must not have the names of the result.
    """
    spark, phrase = docs.sparkSession, max(1, min(PHRASE, window))
    carried = docs.select(*carry).schema
    extra = F.to_json(F.struct(*carry)) if carry else F.lit(None).cast("string")
    parsed = staged(docs.select("doc_id", extra.alias("carry"), "text").mapInArrow(_parse(window, phrase), PARSED), "parsed")
    size = parsed.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    shard = F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard")
    anchors = parsed.select(shard, F.inline("anchors"))
    confirmed = anchors.groupBy("hash", "phrase").agg(F.sum("c").alias("c")).where("c > 1").select("hash", "phrase")
    confirmed = staged(confirmed, "confirmed")  # each step's shuffle is gone before the next begins
    none = F.lit(None)
    phrases = anchors.select("shard", "hash").join(confirmed, "hash").select("shard", F.lit(0).cast("tinyint").alias("kind"), "hash", none.cast("long").alias("row"), none.cast("long").alias("doc_id"), none.cast("string").alias("carry"), F.col("phrase").alias("packed"))
    phrases = staged(phrases, "phrases")
    texts = parsed.select(shard, F.lit(1).cast("tinyint").alias("kind"), none.cast("long").alias("hash"), "row", "doc_id", "carry", "packed")
    dealt = phrases.union(texts).repartition(width(spark, size), "shard").sortWithinPartitions("shard", "kind")
    located = staged(dealt.mapInArrow(_locate(window, phrase), LOCATED), "located")
    drop_staged(phrases)
    drop_staged(confirmed)
    drop_staged(parsed)

    found = located.where(F.size("blocks") > 0).select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), "row", F.inline("blocks"))
    place = F.struct("doc_id", "row", "s")
    first = staged(found.groupBy("b1", "b2").agg(F.min(place).alias("first"), F.min("ah").alias("ah"), F.min("n").alias("n")), "first")
    mixed = first.groupBy("ah").agg(F.count("*").alias("c")).where("c > 1").select("ah")
    whole = found.join(first.select("b1", "b2", "first"), ["b1", "b2"]).where(place != F.col("first")).select("row", "s", "n")
    open_blocks = first.join(mixed, "ah").groupBy("first.row").agg(F.collect_list(F.struct(F.col("first.s").alias("s"), "n")).alias("blocks"))
    single = located.select("row", F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), "packed").join(open_blocks, "row").select("row", "doc_id", "packed", "blocks")
    single = staged(single.mapInArrow(_windows(window), "h1 long, h2 long, doc_id long, row long, s long"), "windows")
    earliest = single.groupBy("h1", "h2").agg(F.min(place).alias("first"))
    later = single.join(earliest, ["h1", "h2"]).where(place != F.col("first")).select("row", F.col("s").cast("int"), F.lit(1).alias("n"))
    later = staged(later, "later")
    drop_staged(single)
    cut = staged(whole.union(later).groupBy("row").agg(F.collect_list(F.struct("s", "n")).alias("ranges")), "cut")
    drop_staged(first)
    drop_staged(later)
    out = located.select("row", "doc_id", "carry", "packed").join(cut, "row", "left").select("doc_id", "carry", "packed", "ranges")
    out = out.mapInArrow(_cut(window, as_words), "doc_id long, carry string, n_words long, n_removed long, spans array<struct<first:long,last:long>>, kept string")
    back = F.from_json("carry", carried)
    return out.select("doc_id", *(back[c].alias(c) for c in carry), "n_words", "n_removed", "spans", "kept")


def op9_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` without the words of 20-word windows that also start earlier."""
    out = repeated_passages(read(spark, sf_dir, "documents", "doc_id", "text"), 20, as_words=True)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), "spans")
