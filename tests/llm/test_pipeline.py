import re
import zlib
from collections import defaultdict

import numpy as np
from brute import near
from test_phrases import brute as passages
from tokenizers import Tokenizer

import corpus_pipeline
from bytequarry.llm.language import identify_languages, train_languages
from bytequarry.llm.tokens import vocabulary_file

DIR = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(150)
    odd = spark.createDataFrame([(90001, None, "en", "s", 0), (90002, "", "en", "s", 0), (90003, "12 %%", None, None, None), (90004, "x" * 50, None, None, None), (90004, "x" * 50, None, None, None)], docs.schema)
    docs.union(odd).write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()]
    spoken = {r.doc_id: r for r in identify_languages(spark.createDataFrame(rows, "doc_id long, text string"), train_languages(spark.read.parquet(f"{tmp_path}/documents.parquet"))).collect()}
    letters = lambda t: len(re.findall(r"[^\W\d_]", t))
    kept = {d: t for d, t in rows if t and letters(t) and (spoken[d].score >= 0.5 or letters(t) < 40)}
    assert len(rows) - 8 < len(kept) < len(rows)
    groups = near(kept.items(), 5, 80)
    kept = {d: t for d, t in kept.items() if groups[d][2]}
    cut = passages(kept.items(), 20)
    tok, want = Tokenizer.from_file(vocabulary_file()), {}
    pieces = defaultdict(list)
    for p in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[p.doc_id].append(p)
    assert set(pieces) == {d for d, (n, gone, _) in cut.items() if gone < n}
    stages = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, f in corpus_pipeline.STAGES[:-1]:
        stages = f(spark, stages, str(tmp_path))
        assert stages.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    for r in stages.collect():
        assert " ".join(r.text.split()) == cut[r.doc_id][2] and r.n_chars == len(r.text)
        want[r.doc_id] = [*tok.encode(r.text, add_special_tokens=False).ids, 1]
    for d, own in pieces.items():
        for p in own:
            ids = want[d][p.start : p.start + p.length]
            assert p.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and p.doc_tokens == len(want[d])
        assert sum(p.length for p in own) == len(want[d])


def test_language_stage_without_labels(spark):
    rows = [(1, "some text", None, "s", 9), (2, None, None, "s", 0), (3, "12 %%", None, "s", 5), (4, "é", None, None, None), (5, "", None, "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    got = corpus_pipeline.language(spark, spark.createDataFrame(rows, schema), DIR)
    assert got.columns == list(corpus_pipeline.COLUMNS) and sorted(r.doc_id for r in got.collect()) == [1, 4]
    labelled = spark.createDataFrame([(9, "34 !", "en", "s", 4), *rows], schema)  # the only label stands at a text without a letter
    assert sorted(r.doc_id for r in corpus_pipeline.language(spark, labelled, DIR).collect()) == [1, 4]


def test_language_stage_rejects_what_no_language_claims(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    noise = spark.createDataFrame([(90001, "xq zvk qqj wzx kjq vvx zqk xjw " * 9, None, None, None), (90002, "qq", None, None, None)], docs.schema)
    got = {r.doc_id for r in corpus_pipeline.language(spark, docs.union(noise), DIR).collect()}
    assert 90001 not in got and 90002 in got and len(got) > docs.count() - 4


def test_near_dedup_judges_rows_that_share_an_id(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (1, text), (1, "another text that stands alone here"), (2, text + " x"), (None, text), (None, "lone words without any id at all")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_dedup(spark, docs, DIR)
    assert got.columns == list(corpus_pipeline.COLUMNS)
    assert sorted(((r.doc_id or 0), r.text) for r in got.collect()) == sorted([(1, text), (1, rows[2][1]), (0, rows[5][1])])
