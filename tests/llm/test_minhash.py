import random

import numpy as np
import pytest
from brute import near

from bytequarry.llm import minhash
from bytequarry.llm.minhash import matches, near_duplicates


def corpus(seed=1):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    docs, n = [], 0
    for _ in range(12):
        base = [r.choice(vocab) for _ in range(r.choice([2, 5, 40, 120]))]
        for _ in range(r.choice([1, 2, 6, 25])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                w[r.randrange(len(w))] = r.choice(vocab)
            docs.append((n, " ".join(w)))
            n += 1
    return docs + [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "Alone"), (n + 4, "ALONE"), (n + 5, "é É " * 3000)]


@pytest.mark.parametrize("block", [256, 4])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    docs = corpus()
    df = spark.createDataFrame([(d, t, "x", d) for d, t in docs], "doc_id long, text string, component_id string, cls long")
    got = near_duplicates(df, 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == near(docs, 3, 85)


def test_repeated_rows_and_empty_tables(spark):
    schema = "doc_id long, text string"
    assert near_duplicates(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, "x y z"), (3, "k l m")]
    got = near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted(tuple(r)[:4] for r in got if r.doc_id) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 3, True), (3, 1, 3, True)]
    assert [tuple(r) for r in got if r.doc_id is None] == [(None, 2, 1, False, False)]
    assert sorted(r.doc_id for r in got if r.first) == [1, 3, 3]


def test_rows_without_id_and_carried_columns(spark):
    rows = [(None, "a b c d e f", 7), (None, "a b c d e f", 8), (None, None, 9), (None, "", 10), (4, None, 11)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, extra int"), carry=("extra",)).collect()
    assert all(r.component_id == r.doc_id and r.kept == r.first for r in got)
    assert sorted((r.extra, r.text) for r in got if r.first and r.text) in ([(7, "a b c d e f")], [(8, "a b c d e f")])
    assert sorted((r.extra, r.text) for r in got if not r.text) == [(9, None), (10, ""), (11, None)] and all(r.first for r in got if not r.text)


def test_collisions_are_counted():
    """Only pairs of at least ``need`` equal coordinates are kept, and each pair once."""
    g = np.random.default_rng(4)
    sig = g.integers(0, 3, (12, 8)).astype(np.uint64)
    for left, inner in ((12, True), (5, True), (5, False)):
        want = {(a, b) for a in range(left) for b in range(a + 1 if inner else left, 12) if (sig[a] == sig[b]).sum() >= 4}
        got = [(a, int(x)) for a, b in minhash.collisions(sig, left, inner, 4) for x in b]
        assert len(got) == len(set(got)) and set(got) == want


def test_recall_of_links(spark):
    """Links of planted pairs right above the threshold: measured recall against all pairs."""
    r, docs = random.Random(3), []
    for k in range(150):
        w = [f"w{k}_{i}" for i in range(100)]
        v = list(w)
        v[50] = "other"
        docs += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v[: r.choice([93, 96, 100])]))]
    got = {x.doc_id: x.component_id for x in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 3, 85).collect()}
    want = near(docs, 3, 85)
    linked = [d for d, (_, c, _) in want.items() if c != d]
    assert len(linked) > 80 and sum(got[d] == want[d][1] for d in linked) == len(linked)


def test_matches():
    assert 14 <= matches(32, 0.85) <= 17 and matches(1, 0.5) == 1
