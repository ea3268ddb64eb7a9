"""Operator 8: language ID by string kernels.

The blended-spectrum presence kernel of two texts is the number of byte n-grams (n = 1 to 4, hashed) that both
hold, over the root of both texts' own numbers. A bounded sample per language is mapped to its kernel values with
landmarks (Nyström: times the inverse root of the landmarks' own kernel matrix), and one ridge regression per
language separates it from the rest. Since the kernel is a product of presence vectors, landmarks and weights
fold into one matrix, and texts are scored by products of batches of presence rows with it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .common import mix64, read, slices

__all__ = ["has_letter", "identify_languages", "train_languages", "op8_language"]

#: Documents of each language to learn from, about, and how many of all these are landmarks.
SAMPLE, LANDMARKS = 400, 256
#: Longest n-gram and hashed n-grams.
LONGEST, SPACE = 4, 1 << 15
RIDGE = 1e-2
LETTER = re.compile(r"[^\W\d_]")


def grams(text: str) -> np.ndarray:
    """Sorted different hashes of the n-grams of the lower-cased text, one space at each end and for each run of others than letters."""
    line = " " + re.sub(r"[\W\d_]+", " ", text.lower()).strip() + " "
    b = np.frombuffer(line.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint64)
    flags, code = np.zeros(SPACE, bool), b + np.uint64(1)
    for n in range(1, LONGEST + 1):
        if n > 1:
            if len(b) < n:
                break
            code = (code[:-1] << np.uint64(8)) | b[n - 1 :]
        flags[(mix64(code + np.uint64(n << 40)) >> np.uint64(49)).astype(np.int64)] = True
    return np.flatnonzero(flags)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        x = [grams(t).astype("<u2").tobytes() if LETTER.search(t) else None for t in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.binary())], ["order", "lang", "x"])


def presence(rows: list[np.ndarray]) -> np.ndarray:
    """Presence vectors of length one, a row for each text."""
    x = np.zeros((len(rows), SPACE), np.float32)
    for i, r in enumerate(rows):
        x[i, r] = 1 / np.sqrt(len(r))
    return x


def landmarks(langs: list[str]) -> np.ndarray:
    """Positions of the landmarks: as many of each language, at least one."""
    names = sorted(set(langs))
    each = max(1, LANDMARKS // len(names))
    of = np.array(langs)
    own = [np.flatnonzero(of == n) for n in names]
    return np.concatenate([x[np.unique(np.linspace(0, len(x) - 1, min(each, len(x))).astype(np.int64))] for x in own])


def fit(rows: list[np.ndarray], langs: list[str]) -> tuple[list[str], np.ndarray]:
    """Languages and the matrix (n-gram, language) of scores for presence rows of length one.

    Only the landmarks stand in memory as whole rows; the sample's kernel values are computed in blocks.
    """
    names = sorted(set(langs))
    marks = presence([rows[i] for i in landmarks(langs)])
    own, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    root = vectors / np.sqrt(np.maximum(own, 1e-6)) @ vectors.T
    phi = np.concatenate([(presence(rows[lo : lo + 256]) @ marks.T).astype(np.float64) for lo in range(0, len(rows), 256)]) @ root
    y = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    share = np.sqrt(len(langs) / (len(names) * np.maximum(1, (y > 0).sum(axis=0))))[y.argmax(axis=1)][:, None]  # languages weigh alike
    w = np.linalg.solve((phi * share).T @ (phi * share) + RIDGE * np.eye(phi.shape[1]), (phi * share).T @ (y * share))
    return names, (marks.T @ (root @ w)).astype(np.float32)


def train_languages(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Fits on about ``sample`` documents of each language of ``docs`` (doc_id, text, lang), chosen by a hash of
    doc_id; all languages count. Null texts, texts without a letter and null languages are not learnt from. At most twice
    the sample, the first by that hash, reaches the driver."""
    docs = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    if not counts:
        return [], np.zeros((SPACE, 0), np.float32)
    share = F.coalesce(*(F.when(F.col("lang") == k, F.lit(min(1.0, sample / n))) for k, n in counts.items()))
    chosen = docs.withColumn("order", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 24))).where(F.col("order") <= share * float(1 << 24)).select("order", "lang", "text")
    found = chosen.mapInArrow(_features, "order long, lang string, x binary").where("x is not null")
    rows = found.orderBy("order", "lang", "x").limit(2 * sample * len(counts)).collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    if not rows:
        return [], np.zeros((SPACE, 0), np.float32)
    return fit([np.frombuffer(r["x"], "<u2").astype(np.int64) for r in rows], [r["lang"] for r in rows])


def _score(model, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = model.value
        table = np.array([*names, "und"], object)
        for b in slices(batches):
            texts = b.column(b.num_columns - 1).to_pylist()
            best, score = np.full(len(texts), len(names)), np.zeros(len(texts))
            todo = [i for i, t in enumerate(texts) if names and t and LETTER.search(t)]
            rows = np.zeros((128, SPACE), np.float32)
            for lo in range(0, len(todo), 128):
                part = todo[lo : lo + 128]
                found = [grams(texts[i]) for i in part]
                for r, g in zip(rows, found, strict=False):
                    r[g] = 1 / np.sqrt(len(g))
                s = rows[: len(part)] @ matrix
                for r, g in zip(rows, found, strict=False):
                    r[g] = 0
                best[part] = s.argmax(axis=1)
                score[part] = np.clip((1 + s.max(axis=1)) / 2, 0, 1)
            kept = b.num_columns - (not keep_text)
            yield pa.RecordBatch.from_arrays([*b.columns[:kept], pa.array(table[best].tolist(), pa.string()), pa.array(score)], [*b.schema.names[:kept], "lang_pred", "score"])

    return run


@F.pandas_udf(BooleanType())
def has_letter(texts: pd.Series) -> pd.Series:
    """Whether the text is not null and has a letter."""
    return texts.map(lambda t: bool(t and LETTER.search(t))).astype(bool)


def identify_languages(docs: DataFrame, model: tuple[list[str], np.ndarray], keep_text: bool = False) -> DataFrame:
    """The rows of ``docs`` with lang_pred and score instead of the last column, the text, or after it; other columns
    of these two names are refused.

    lang_pred is ``und`` with score 0 if the text is null or has no letter, or nothing was learnt. Whole texts
    are scored, whatever other columns hold; repeated rows score alike. No rows give no rows.
    """
    clash = {"lang_pred", "score"} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"columns of the result: {sorted(clash)}")
    value = docs.sparkSession.sparkContext.broadcast(model)  # one column per language, SPACE rows
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[: None if keep_text else -1])
    return docs.mapInArrow(_score(value, keep_text), f"{fields}, lang_pred string, score double")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text of ``documents``, learnt from those that are not held out."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(True))
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = train_languages(docs.where(~held))
    return identify_languages(docs.select("doc_id", held.alias("held_out"), "text"), model)
