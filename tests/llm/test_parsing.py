import random
from collections import Counter

import numpy as np
import pytest

from bytequarry.llm import parsing
from bytequarry.llm.parsing import repeated_strings, triggers


def brute(docs, length):
    data = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(b[i : i + length] for _, b in data for i in range(len(b) - length + 1))
    out = []
    for d, b in data:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), kept))
    return sorted(out)


def corpus(seed, length):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé ") for _ in range(r.randrange(1, 8)))
    passages = ["".join(word() for _ in range(length // 2)) for _ in range(5)]
    docs = []
    for d in range(50):
        t = ""
        for _ in range(r.randrange(4)):
            p = r.choice(passages)
            a = r.randrange(len(p) // 2)
            p = list(p[a : a + r.randrange(length // 2, 2 * length)])
            if p and r.random() < 0.5:
                p[r.randrange(len(p))] = "#"
            t += "".join(p) + word()
        docs.append((d, t))
    return [*docs, (60, None), (61, ""), (62, "x" * (3 * length)), (63, "ab" * length), (64, "x" * length), (7, docs[7][1]), (90, "\x00" * (length + 1)), (91, "end" + "\x00" * (length - 3))]


@pytest.mark.parametrize(("length", "group"), [(400, 200), (60, 200), (60, 2), (60, 1)])
def test_against_brute_force(spark, monkeypatch, length, group):
    monkeypatch.setattr(parsing, "GROUP", group)
    monkeypatch.setattr(parsing, "ORDER", 16)
    monkeypatch.setattr(parsing, "PART", 16 if length > 100 else 5)
    docs = corpus(length, length)
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, row int, packed string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in repeated_strings(df, length).collect())
    assert got == brute(docs, length)


def test_empty(spark):
    assert repeated_strings(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    lone = repeated_strings(spark.createDataFrame([(None, "a" * 900), (None, None)], "doc_id long, text string")).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in lone) == [(0, 0), (900, 900)]


def test_triggers_are_first_minima():
    h = np.random.default_rng(3).integers(0, 2**63, 500, dtype=np.uint64) << np.uint64(40)
    want = [i + int(np.argmin((h[i : i + 37] >> np.uint64(32)))) for i in range(500 - 37 + 1)]
    assert triggers(h, 37).tolist() == want


@pytest.mark.parametrize("alphabet", ["a\x00", "ab", "\x00\x01", "aé"])
def test_order_against_brute_force(alphabet):
    """All strings of a shard, with alphabets in which padding by NUL or bytes of long characters would show."""
    r, length = random.Random(alphabet), 12
    for _ in range(60):
        contexts, before, count = [], [], []
        for _ in range(r.randrange(1, 30)):
            t = r.randrange(6)
            n = r.randrange(1, t + 2)
            size = n - 1 + length
            contexts.append("".join(r.choice(alphabet) for _ in range(size)).encode()[:size])
            before.append(t)
            count.append(n)
        groups = {}
        for k, (c, t, n) in enumerate(zip(contexts, before, count)):
            for i in range(n):
                groups.setdefault((t - i, c[i : i + length]), set()).add(k)
        want = [[i for i in range(n) if len(groups[t - i, c[i : i + length]]) > 1] for c, t, n in zip(contexts, before, count)]
        got = parsing.corpus_order(contexts, np.array(before), np.array(count), length)
        assert [x.tolist() for x in got] == want


@pytest.mark.parametrize("alphabet", ["a\x00", "ab"])
def test_short_strings_of_two_letters(spark, alphabet):
    r = random.Random(8)
    docs = [(d, "".join(r.choice(alphabet) for _ in range(r.randrange(40)))) for d in range(60)]
    got = sorted((x.doc_id, x.n_bytes, x.n_removed, len(x.spans), bytes(x.kept)) for x in repeated_strings(spark.createDataFrame(docs, "doc_id long, text string"), 12).collect())
    assert got == brute(docs, 12)


def test_dictionary_order_is_the_order_of_all_ends():
    r = random.Random(2)
    phrases = list({bytes(r.choice(b"\x00\x01\xff") for _ in range(r.randrange(40))) for _ in range(50)} | {b""})
    starts, rank = parsing.dictionary_order(phrases)
    ends = {p[i:]: rank[s + i] for p, s in zip(phrases, starts) for i in range(len(p) + 1)}
    assert all(rank[s + i] == ends[p[i:]] for p, s in zip(phrases, starts) for i in range(len(p) + 1))
    assert [ends[e] for e in sorted(ends)] == list(range(1, len(ends) + 1))
