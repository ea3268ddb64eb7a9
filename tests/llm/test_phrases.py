import hashlib
import random

import pytest

from bytequarry.llm import phrases
from bytequarry.llm.phrases import repeated_passages


def brute(docs, window):
    seen, out = {}, {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        w = [x for x in (t or "").encode().split()]
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if seen.setdefault(k, (d, i)) != (d, i):
                gone[i : i + window] = [True] * window
        out[d] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


def corpus(seed):
    r = random.Random(seed)
    vocab = ["a", "b", "É", "été", "the", "of"] + [f"v{i}" for i in range(60)]
    passages = [[r.choice(vocab) for _ in range(r.randrange(15, 60))] for _ in range(6)]
    docs = []
    for d in range(60):
        w = []
        for _ in range(r.randrange(4)):
            w += r.choice(passages)[r.randrange(5) :] + [r.choice(vocab) for _ in range(r.randrange(12))]
        docs.append((d, r.choice([" ", "\n", "\t "]).join(w)))
    docs += [(100, docs[7][1]), (101, docs[7][1]), (102, None), (103, ""), (104, "a " * 200), (105, "a b " * 100), (106, "a " * 25)]
    return docs


@pytest.mark.parametrize(("window", "shard"), [(20, 2_000_000), (8, 500)])
def test_against_brute_force(spark, monkeypatch, window, shard):
    monkeypatch.setattr(phrases, "SHARD_BYTES", shard)
    docs = corpus(window)
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, row int, packed string")
    got = {r.doc_id: (r.n_words, r.n_removed, " ".join(r.kept.split())) for r in repeated_passages(df, window).collect()}
    assert got == brute(docs, window)


def test_layout_repeated_rows_and_empty(spark):
    schema = "doc_id long, text string"
    assert repeated_passages(spark.createDataFrame([], schema)).collect() == []
    line = " ".join(f"w{i}" for i in range(20))
    got = sorted(repeated_passages(spark.createDataFrame([(1, f"x\n{line}\n  y"), (2, f"x\n{line}\n  y z"), (None, line)], schema)).collect(), key=lambda r: r.doc_id or 9)
    assert [(r.doc_id, r.n_removed, r.kept) for r in got] == [(1, 0, f"x\n{line}\n  y"), (2, 22, "z"), (None, 20, "")]
    lone = repeated_passages(spark.createDataFrame([(None, line), (None, line), (None, None)], schema)).collect()
    assert sorted((r.n_words, r.n_removed) for r in lone) == [(0, 0), (20, 0), (20, 20)]
    twice = repeated_passages(spark.createDataFrame([(1, line), (1, line)], schema)).collect()
    assert sorted((r.n_words, r.n_removed) for r in twice) == [(20, 0), (20, 20)]
    assert hashlib.sha256(b"").hexdigest()


def test_the_automaton_is_the_source(spark):
    """Blocks come from the hits alone: without phrases nothing is located, with half of them less is."""
    import ahocorasick
    import numpy as np

    text = " ".join(f"w{i}" for i in range(60)).encode()
    words = text.split()
    empty = phrases.locate(ahocorasick.Automaton(), np.zeros(0, np.uint64), text[:50], 20, 6)
    assert not empty[1]
    found = []
    for places in ([5, 30], [5]):
        automaton = ahocorasick.Automaton()
        for k, q in enumerate(places):
            automaton.add_word((b" " + b" ".join(words[q : q + 6]) + b" ").decode(), k)
        automaton.make_automaton()
        (_, s, n), pieces = phrases.locate(automaton, np.array([9, 4][: len(places)], np.uint64), text, 20, 6)
        found.append((s.tolist(), n.tolist()))
        assert pieces == [b" ".join(words[a : a + b + 19]) for a, b in zip(s, n)]
    assert found == [([0, 16], [6, 15]), ([0], [6])]
