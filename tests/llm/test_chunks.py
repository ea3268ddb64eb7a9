import random
import time

import numpy as np
from test_packing import TEXTS
from tokenizers import Tokenizer

from bytequarry.llm import chunks
from bytequarry.llm.chunks import cuts, decode_ids, encode_texts, join_ids
from bytequarry.llm.tokens import encoder, vocabulary_file


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeñé19'") for _ in range(r.randrange(1, 9)))
    passages = [r.choice(["", " ", "\n"]).join(word() for _ in range(200)) for _ in range(4)]
    texts = ["".join(r.choice([*passages, word(), " ", *TEXTS]) + r.choice([" ", ""]) for _ in range(r.randrange(6))) for _ in range(80)]
    return [*texts, *texts[:9], None, "", "a" * 5000, " " * 3000, "<|endoftext|>" * 300, "x y " * 900]


def test_ids_equal_those_of_the_library(spark, monkeypatch):
    monkeypatch.setattr(chunks, "GRAM", 8)
    monkeypatch.setattr(chunks, "SPREAD", 48)
    tok, texts = Tokenizer.from_file(vocabulary_file()), corpus(4)
    rows = [(i, t, b"") for i, t in enumerate(texts)] + [(3, texts[3], b""), (None, texts[5], b"")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids binary")
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_tokens, r.ids_text, r.decoded) for r in decode_ids(encode_texts(df)).collect())
    want = []
    for d, t, _ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((-1 if d is None else d, len(ids), ",".join(map(str, ids)), tok.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)


def test_joints_at_any_place():
    enc, tok, r = encoder(vocabulary_file()), Tokenizer.from_file(vocabulary_file()), random.Random(9)
    for t in corpus(6):
        data = (t or "").encode()
        at = sorted({0, len(data), *(r.randrange(len(data) + 1) for _ in range(5))})
        whole = {i for i in at if i == len(data) or (data[i] & 0xC0) != 0x80}
        borders = sorted(whole | {0, len(data)})
        if len(borders) > 1:
            ids = [enc.encode(data[a:b]) for a, b in zip(borders, borders[1:])]
            assert join_ids(enc, data, borders, ids).tolist() == tok.encode(t, add_special_tokens=False).ids


def test_many_joints_take_linear_time():
    """Each joint is looked up in sorted arrays; nothing as long as the text is built for one joint."""
    enc, word = encoder(vocabulary_file()), b"joints of many"
    data = word * 20_000
    began = time.process_time()
    got = join_ids(enc, data, list(range(0, len(data) + 1, len(word))), [enc.encode(word)] * 20_000)
    assert time.process_time() - began < 10
    assert got.tolist() == enc.encode(data).tolist()


def test_cuts_follow_the_content():
    r = random.Random(1)
    middle = "".join(r.choice("abcdefgh é") for _ in range(9000)).encode()
    a, b = cuts(b"x" * 700 + middle + b"y" * 900), cuts(b"zz" * 123 + middle)
    assert len(np.intersect1d(a - 700, b - 246)) > 5 and np.diff(a).max() <= 2 * chunks.SPREAD


def test_empty(spark):
    assert decode_ids(encode_texts(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


def test_repeated_rows_publish_once(spark, monkeypatch):
    rows, plain = {}, chunks.staged

    def counted(df, label):
        out = plain(df, label)
        rows[label] = out.count()
        if label == "given":
            rows["entries"] = sum(len(r.chunks) for r in out.select("chunks").collect())
        return out

    monkeypatch.setattr(chunks, "staged", counted)
    r = random.Random(2)
    text = " ".join("".join(r.choice("abcdeñ") for _ in range(r.randrange(1, 9))) for _ in range(3000))
    df = spark.createDataFrame([(None, text)] * 40 + [(7, text)] * 30, "doc_id long, text string").repartition(5)
    got = decode_ids(encode_texts(df)).groupBy("doc_id", "ids_text").count().collect()
    want = ",".join(map(str, Tokenizer.from_file(vocabulary_file()).encode(text, add_special_tokens=False).ids))
    assert sorted((x.doc_id or 0, x.ids_text, x["count"]) for x in got) == [(0, want, 40), (7, want, 30)]
    data = text.encode()
    n = len(set(chunks.chunk_hashes(data, cuts(data)).tolist()))
    assert n > 9 and rows == {"chunks": 2 * n, "held": 2 * n, "published": n, "given": 2, "entries": 2 * n}


def thue_morse(size, a, b):
    return "".join(a if i.bit_count() % 2 == 0 else b for i in range(size))


def test_texts_that_collide_under_polynomials(spark):
    """A polynomial hash modulo a power of two is equal on these two texts for every odd base."""
    tok = Tokenizer.from_file(vocabulary_file())
    texts = [thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a"), thue_morse(4096, "a", "b"), thue_morse(4096, "b", "a")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.ids_text, r.decoded) for r in decode_ids(encode_texts(df)).collect()}
    assert got == {i: (",".join(map(str, tok.encode(t, add_special_tokens=False).ids)), t) for i, t in enumerate(texts)}


def test_ids_of_other_bytes_are_not_reused(spark, monkeypatch):
    """With all chunks under one hash every reuse but that of equal bytes is refused."""
    monkeypatch.setattr(chunks, "chunk_hashes", lambda data, borders: np.zeros(max(0, len(borders) - 1), np.int64))
    enc = encoder(vocabulary_file())
    data, given = b"one two three", {0: enc.encode(b"one two")}
    assert chunks.confirmed(enc, data, np.array([0, 7, 13]), [0, 0], given) == [True, False]
    assert chunks.confirmed(enc, data, np.array([0, 3, 13]), [0, 5], given) == [False, False]
