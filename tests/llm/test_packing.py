import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from bytequarry.llm import packing
from bytequarry.llm.packing import pack_documents
from bytequarry.llm.tokens import encoder, vocabulary_file

TEXTS = ["", "Hello  world\n\n it's 12345 été x", "<|endoftext|> a<|endoftext|>", "日本語 text ​　 mixed", "\t \r\n x\x0b\x0c y \x1c\x85 z", "aaaaaaaa" * 50, "  lead", "trail  ", "éİ ß Ω", "don't WE'LL I'M", "😀👍🏽 ok", "a b c", "ǅul ʰ ª º ²"]


def test_encoder_equals_the_library():
    enc, tok, r = encoder(vocabulary_file()), Tokenizer.from_file(vocabulary_file()), random.Random(5)
    alphabet = "abcXYZ019 \n\t.,'-éñüßç ŁȿɐΩж日😀<|>_"
    texts = TEXTS + ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(3000)] + ["".join(chr(r.randrange(1, 0x2FF)) for _ in range(40)) for _ in range(2000)]
    for t in texts:
        want = tok.encode(t, add_special_tokens=False).ids
        assert enc.encode(t.encode()).tolist() == want, t
        assert enc.decode(np.array(want, np.uint32)).decode() == tok.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("fan", [64, 2])
def test_every_id_lies_in_one_piece(spark, monkeypatch, fan):
    monkeypatch.setattr(packing, "FAN", fan)
    r = random.Random(2)
    docs = [(i, r.choice([None, "", *TEXTS, "long words here " * r.randrange(900)])) for i in range(300)] + [(None, "no id"), (5, "same id"), (5, "same id")]
    rows = pack_documents(spark.createDataFrame([(d, t, 7) for d, t in docs], "doc_id long, text string, part int").repartition(7)).collect()
    tok, want = Tokenizer.from_file(vocabulary_file()), defaultdict(list)
    for d, t in docs:
        want[d].append([*tok.encode(t or "", add_special_tokens=False).ids, 1])
    sequences, pieces = defaultdict(list), defaultdict(list)
    for p in rows:
        sequences[p.sequence_id].append(p)
        pieces[p.doc_id].append(p)
    fill = []
    for s in sequences.values():
        s.sort(key=lambda p: p.offset)
        assert [p.offset for p in s] == [sum(q.length for q in s[:i]) for i in range(len(s))]
        fill.append(sum(p.length for p in s))
    assert max(fill) <= 2048 and sum(f < 2048 for f in fill) <= 1
    for d, lists in want.items():
        assert sum(p.length for p in pieces[d]) == sum(map(len, lists))
        if len(lists) == 1:
            at = 0
            for p in sorted(pieces[d], key=lambda p: p.start):
                ids = lists[0][p.start : p.start + p.length]
                assert p.start == at and p.doc_tokens == len(lists[0]) and p.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
                at += p.length


def test_no_documents(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
