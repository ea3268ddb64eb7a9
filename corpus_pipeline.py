"""The corpus pipeline: language ID, MinHash near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet in the shared
folder and reads again as the next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytequarry.llm.common import read, staged
from bytequarry.llm.language import has_letter, identify_languages, train_languages
from bytequarry.llm.minhash import near_duplicates
from bytequarry.llm.packing import pack_documents
from bytequarry.llm.phrases import repeated_passages

__all__ = ["ORACLE_SQL", "STAGES", "run"]

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least score of a text that a language's classifier claims, and letters from which the score counts.
CLAIM, LETTERS = 0.5, 40
#: SQL expresses neither the language model nor the packing.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the corpus's languages. Rejected are texts that are null or have no letter, and texts of
    ``LETTERS`` letters or more that no language's classifier claims (score under ``CLAIM``); shorter ones say too
    little against any language. When no language can be learnt, all texts with a letter stay."""
    model = train_languages(docs)
    if not model[0]:
        return docs.select(*COLUMNS).where(has_letter("text"))
    named = identify_languages(docs.select("doc_id", "lang", "source", "n_chars", "text"), model, keep_text=True)
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]+", ""))
    return named.where((F.col("lang_pred") != "und") & ((F.col("score") >= CLAIM) | (letters < LETTERS))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, similarity 0.8; of repeated rows, and of rows that
    share an id, each is judged by its own text."""
    return near_duplicates(docs.select(*COLUMNS), carry=("lang", "source", "n_chars")).where("first").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 20-word passages that also stand earlier; documents without any word left go."""
    out = repeated_passages(docs.select(*COLUMNS), 20, carry=("lang", "source")).where("n_removed < n_words")
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, a row for each piece."""
    return pack_documents(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
