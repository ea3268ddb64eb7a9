"""Byte-level BPE in the workers: ids exactly as the ``tokenizers`` library gives them.

Texts of ordinary characters go through ``tiktoken`` with the same vocabulary and pattern, which is several
times faster; any other text (characters from U+0240, control characters, a special token's text) goes
through ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import re
from functools import cache

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

__all__ = ["Encoder", "encoder", "vocabulary_file"]

ODD = re.compile(rb"[\x00-\x08\x0b-\x1f\x7f\xc9-\xff]|\xc2[\x80-\xa0]|<\|")


def vocabulary_file(name: str = "byte_bpe_50k.json") -> str:
    return public_tokenizers.path(name)


def _bytes_of_characters() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Encoder:
    """Encodes and decodes with one vocabulary file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        of = _bytes_of_characters()
        ranks = {bytes(of[c] for c in token): i for token, i in model["model"]["vocab"].items() if all(c in of for c in token)}
        special = {x["content"]: x["id"] for x in model["added_tokens"]}
        ranks = {k: v for k, v in ranks.items() if v not in special.values()}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.size = 1 + max(max(ranks.values()), max(special.values(), default=0))
        table = {v: k for k, v in ranks.items()} | {v: k.encode() for k, v in special.items()}
        self.lengths = np.array([len(table.get(i, b"")) for i in range(self.size)], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(table.get(i, b"") for i in range(self.size)), np.uint8)
        width = len(str(self.size)) + 1
        written = [f"{i},".encode() for i in range(self.size)]
        self.digits = np.frombuffer(b"".join(x.ljust(width) for x in written), np.uint8).reshape(self.size, width)
        self.dtype = np.dtype("<u2" if self.size <= 65536 else "<u4")

    def encode(self, data: bytes) -> np.ndarray:
        """ids of UTF-8 text."""
        if not data:
            return np.zeros(0, np.uint32)
        if ODD.search(data):
            return np.array(self.exact.encode(data.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(data.decode("utf-8"), disallowed_special=())

    def raw(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that the ids stand for, one after the other."""
        ids = ids.astype(np.int64)
        size = self.lengths[ids]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.starts[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ids) else 0)]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text, specials included; broken sequences become U+FFFD."""
        data = self.raw(ids).tobytes()
        return data if data.isascii() else data.decode("utf-8", "replace").encode()

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        text = self.digits[ids.astype(np.int64)].ravel()
        return text[text != 32].tobytes()[:-1]


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)
