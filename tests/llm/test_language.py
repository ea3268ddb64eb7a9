import zlib

import numpy as np
import pytest

from bytequarry.llm.language import LONGEST, SPACE, fit, grams, identify_languages, landmarks, train_languages

WORDS = {"xx": ["the", "and", "of", "with", "house", "this"], "yy": ["und", "der", "nicht", "für", "haus", "ein"], "zz": ["el", "que", "casa", "niño", "para", "una"]}


def rows(n=240):
    r, out = np.random.default_rng(3), []
    for i in range(n):
        lang = ["xx", "yy", "zz"][i % 3]
        out.append((i, " ".join(r.choice(WORDS[lang], 12)), lang))
    return out


def test_held_out_accuracy_and_odd_texts(spark):
    odd = [(1000, None, "xx"), (1001, "", "yy"), (1002, "12 .. 3", "zz"), (1003, "the " * 50000, None), (None, "der und", "yy"), (5, rows()[5][1], "zz")]
    df = spark.createDataFrame([(*x, "s") for x in rows() + odd], "doc_id long, text string, lang string, score string")
    learn = df.where("doc_id < 1000 and crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1")
    got = {r.doc_id: r for r in identify_languages(df.select("doc_id", "text"), train_languages(learn)).collect()}
    held = [x for x in rows() if zlib.crc32(str(x[0]).encode()) % 3 == 1]
    assert sum(got[d].lang_pred == lang for d, _, lang in held) / len(held) > 0.97
    assert [got[d].lang_pred for d in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred == "xx" and got[None].lang_pred == "yy"
    assert all(0 <= r.score <= 1 for r in got.values())


def test_scores_are_those_of_the_kernel(spark):
    """Brute force: kernel values from sets, the Nystroem map and ridge weights written out, against the scored column."""
    r, texts = rows(60), ["der und nicht", "the house with", "el niño the und", "haus", "zzz qqq"]
    sets, langs = [set(grams(t).tolist()) for _, t, _ in r], [g for *_, g in r]
    names, m = fit([grams(t) for _, t, _ in r], langs)
    assert names == ["xx", "yy", "zz"] and m.shape == (SPACE, 3) and LONGEST == 4
    kernel = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    marks = [sets[i] for i in landmarks(langs)]
    own, v = np.linalg.eigh(np.array([[kernel(a, b) for b in marks] for a in marks]))
    root = v @ np.diag(1 / np.sqrt(np.maximum(own, 1e-6))) @ v.T
    phi = np.array([[kernel(a, b) for b in marks] for a in sets]) @ root
    y = np.array([[1.0 if g == n else -1.0 for n in names] for g in langs])  # 20 texts each, so all weigh 1
    w = np.linalg.inv(phi.T @ phi + 1e-2 * np.eye(len(marks))) @ phi.T @ y
    want = np.array([[kernel(set(grams(t).tolist()), b) for b in marks] for t in texts]) @ root @ w
    got = sorted(identify_languages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), (names, m)).collect())
    assert [x.lang_pred for x in got] == [names[i] for i in want.argmax(axis=1)]
    assert np.allclose([x.score for x in got], np.clip((1 + want.max(axis=1)) / 2, 0, 1), atol=2e-3)


def test_every_language_has_landmarks():
    langs = ["a"] * 1000 + ["b"] + ["c"] * 3
    at = landmarks(langs)
    assert {langs[i] for i in at} == {"a", "b", "c"} and len(at) <= 256 and len(set(at.tolist())) == len(at)


def test_clashing_names_are_refused(spark):
    with pytest.raises(ValueError):
        identify_languages(spark.createDataFrame([(1, "x", "y")], "doc_id long, score string, text string"), ([], np.zeros((SPACE, 0), np.float32)))


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = train_languages(empty)
    assert identify_languages(empty.select("doc_id", "text"), model).collect() == []
    assert identify_languages(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), model).first().lang_pred == "und"
