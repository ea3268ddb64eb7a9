"""Operator 3: license scans by ordered signature rules.

Texts become words (A-Z lower-cased; everything else of ASCII but digits parts words). Rules are regular
expressions over the words joined by single spaces. A rule is tried only on texts that hold one of its
keywords. Detections are ordered by priority, then by the order of the rules; one that lies within the
interval of an earlier detection is suppressed. Base phrases are counted on all texts and always stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, slices

__all__ = ["BASE", "Rule", "license_rules", "scan_licenses", "op3_licenses"]

#: Base phrases and their labels; fixed values.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Label, keywords of which a text needs one, and the name as people write it (over lower-cased words).
LICENSES = (
    ("mit", "mit", r"mit"),
    ("x11", "x11 consortium", r"x11|mit x11|x consortium"),
    ("isc", "isc", r"isc"),
    ("apache-1.0", "apache", r"apache(?: software)?(?: license)?(?: version| v)? 1 0"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: license)?(?: version| v)? 1 1"),
    ("apache-2.0", "apache apache2", r"apache(?: software)?(?: license)?(?: version| v)? ?2(?: 0)?"),
    ("bsd-2-clause", "bsd freebsd", r"(?:simplified|2 clause|two clause) bsd|bsd (?:2|two) clause|freebsd"),
    ("bsd-3-clause", "bsd", r"(?:new|revised|modified|3 clause|three clause) bsd|bsd (?:3|three) clause"),
    ("bsd-4-clause", "bsd", r"(?:original|4 clause|four clause) bsd|bsd (?:4|four) clause"),
    ("0bsd", "0bsd bsd", r"0bsd|(?:zero clause|0 clause) bsd|bsd zero clause"),
    ("gpl-1.0", "gpl general gpl1", r"(?:gnu )?(?:gpl|general public license)(?: version| v)? ?1(?: 0)?"),
    ("gpl-2.0", "gpl general gplv2 gpl2", r"gplv?2|(?:gnu )?(?:gpl|general public license)(?: version| v)? ?2(?: 0)?"),
    ("gpl-3.0", "gpl general gplv3 gpl3", r"gplv?3|(?:gnu )?(?:gpl|general public license)(?: version| v)? ?3(?: 0)?"),
    ("lgpl-2.0", "lgpl library lgpl2", r"(?:gnu )?(?:lgpl|library general public license)(?: version| v)? ?2(?: 0)?"),
    ("lgpl-2.1", "lgpl lesser lgpl2", r"(?:gnu )?(?:lgpl|lesser general public license)(?: version| v)? ?2 1"),
    ("lgpl-3.0", "lgpl lesser lgplv3 lgpl3", r"lgplv3|(?:gnu )?(?:lgpl|lesser general public license)(?: version| v)? ?3(?: 0)?"),
    ("agpl-1.0", "agpl affero agpl1 affero1", r"(?:affero|agpl)(?: general public license)?(?: version| v)? ?1(?: 0)?"),
    ("agpl-3.0", "agpl affero agplv3 agpl3 affero3", r"agplv3|(?:gnu )?(?:affero|agpl)(?: general public license)?(?: version| v)? ?3(?: 0)?"),
    ("gfdl-1.2", "gfdl documentation gfdl1", r"(?:gnu )?(?:gfdl|free documentation license)(?: version| v)? ?1 2"),
    ("gfdl-1.3", "gfdl documentation gfdl1", r"(?:gnu )?(?:gfdl|free documentation license)(?: version| v)? ?1 3"),
    ("mpl-1.0", "mpl mozilla mpl1", r"(?:mozilla public license|mpl)(?: version| v)? ?1 0"),
    ("mpl-1.1", "mpl mozilla mpl1", r"(?:mozilla public license|mpl)(?: version| v)? ?1 1"),
    ("mpl-2.0", "mpl mozilla mpl2", r"(?:mozilla public license|mpl)(?: version| v)? ?2(?: 0)?"),
    ("epl-1.0", "epl eclipse epl1", r"(?:eclipse public license|epl)(?: version| v)? ?1(?: 0)?"),
    ("epl-2.0", "epl eclipse epl2", r"(?:eclipse public license|epl)(?: version| v)? ?2(?: 0)?"),
    ("cddl-1.0", "cddl cddl1 distribution", r"(?:common development and distribution license|cddl)(?: version| v)?(?: ?1(?: 0)?)?"),
    ("cpl-1.0", "cpl common cpl1", r"(?:common public license|cpl)(?: version| v)?(?: ?1(?: 0)?)?"),
    ("ipl-1.0", "ibm", r"ibm public license(?: version| v)?(?: ?1(?: 0)?)?"),
    ("eupl-1.1", "eupl european eupl1", r"(?:european union public licen[cs]e|eupl)(?: version| v)? ?1 1"),
    ("eupl-1.2", "eupl european eupl1", r"(?:european union public licen[cs]e|eupl)(?: version| v)? ?1 2"),
    ("artistic-1.0", "artistic artistic1", r"artistic(?: license)?(?: version| v)? ?1(?: 0)?"),
    ("artistic-2.0", "artistic artistic2", r"artistic(?: license)?(?: version| v)? ?2(?: 0)?"),
    ("bsl-1.0", "boost", r"boost software(?: license)?(?: version| v)?(?: ?1(?: 0)?)?"),
    ("busl-1.1", "busl business busl1", r"(?:business source(?: license)?|busl)(?: version| v)?(?: ?1 1)?"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("libpng", "libpng libpng2", r"libpng(?: version| v)?(?: ?2(?: 0)?)?"),
    ("unlicense", "unlicense", r"unlicense"),
    ("wtfpl", "wtfpl fuck", r"wtfpl|do what the fuck you want to public license"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-1.0", "cc commons", r"(?:cc by|creative commons attribution) 1 0"),
    ("cc-by-2.0", "cc commons", r"(?:cc by|creative commons attribution) 2 0"),
    ("cc-by-2.5", "cc commons", r"(?:cc by|creative commons attribution) 2 5"),
    ("cc-by-3.0", "cc commons", r"(?:cc by|creative commons attribution) 3 0"),
    ("cc-by-4.0", "cc commons", r"(?:cc by|creative commons attribution)(?: international)? 4 0"),
    ("cc-by-sa-3.0", "cc commons", r"(?:cc by sa|creative commons attribution share ?alike) 3 0"),
    ("cc-by-sa-4.0", "cc commons", r"(?:cc by sa|creative commons attribution share ?alike) 4 0"),
    ("cc-by-nd-4.0", "cc commons", r"(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s) 4 0"),
    ("cc-by-nc-3.0", "cc commons", r"(?:cc by nc|creative commons attribution non ?commercial) 3 0"),
    ("cc-by-nc-4.0", "cc commons", r"(?:cc by nc|creative commons attribution non ?commercial) 4 0"),
    ("cc-by-nc-sa-3.0", "cc commons", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike) 3 0"),
    ("cc-by-nc-sa-4.0", "cc commons", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike) 4 0"),
    ("cc-by-nc-nd-4.0", "cc commons", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s) 4 0"),
    ("ofl-1.1", "ofl sil ofl1 font", r"(?:sil )?(?:open font license|ofl)(?: version| v)?(?: ?1 1)?"),
    ("odbl-1.0", "odbl odbl1 database", r"(?:open database license|odbl)(?: version| v)?(?: ?1 0)?"),
    ("pddl-1.0", "pddl pddl1 dedication", r"(?:public domain dedication and license|pddl)(?: version| v)?(?: ?1 0)?"),
    ("ms-pl", "microsoft ms", r"(?:microsoft public license|ms pl)"),
    ("ms-rl", "microsoft ms", r"(?:microsoft reciprocal license|ms rl)"),
    ("python-2.0", "python psf psfl psfl2", r"(?:python software foundation license|psf license|psfl|python license)(?: version| v)?(?: ?2(?: 0)?)?"),
    ("php-3.01", "php php3", r"php(?: license)?(?: version| v)?(?: ?3(?: 01)?)?"),
    ("ruby", "ruby", r"ruby"),
    ("vim", "vim", r"vim"),
    ("postgresql", "postgresql", r"postgresql"),
    ("openssl", "openssl", r"openssl(?: ssleay)?"),
    ("ncsa", "ncsa illinois", r"(?:university of illinois )?ncsa(?: open source)?"),
    ("afl-3.0", "afl academic afl3", r"(?:academic free license|afl)(?: version| v)?(?: ?3(?: 0)?)?"),
    ("osl-3.0", "osl osl3 software", r"(?:open software license|osl)(?: version| v)?(?: ?3(?: 0)?)?"),
    ("sspl-1.0", "sspl server sspl1", r"(?:server side public license|sspl)(?: version| v)?(?: ?1(?: 0)?)?"),
    ("elastic-2.0", "elastic elastic2", r"elastic(?: license)?(?: version| v)?(?: ?2(?: 0)?)?"),
    ("json", "json", r"json"),
    ("mulanpsl-2.0", "mulan", r"mulan(?: psl| permissive software license)(?: version| v)?(?: ?2(?: 0)?)?"),
)

#: Ways to point to a license by name: priority, keywords and pattern. N stands for the name.
NOTICES = (
    (90, "spdx", r"spdx license identifier (?:N)"),
    (80, "licensed released distributed published available provided covered dual", r"(?:dual )?(?:licensed|released|distributed|published|(?:made )?available|provided|covered) (?:under|by|subject to|according to) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:N)(?: licen[sc]e)?"),
    (70, "license licence licenses licences", r"licen[sc]es?(?: is| type| name| url)? (?:the )?(?:N)(?: licen[sc]e)?"),
    (60, "license licence", r"(?:the )?(?:N) licen[sc]e"),
)

#: Label, priority, keywords and pattern of sentences from notices and license texts.
SENTENCES = (
    ("mit", 85, "permission", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", 85, "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("bsd", 84, "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("apache-2.0", 85, "compliance", r"you may not use this file except in compliance with the license .{0,80}apache org licenses license 2 0"),
    ("gpl", 75, "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", 76, "redistribute", r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl", 76, "redistribute affero", r"you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl", 50, "gpl general", r"(?:gnu )?general public licen[sc]e|gnu gpl"),
    ("lgpl", 51, "lesser lgpl library", r"(?:gnu )?(?:lesser|library) general public licen[sc]e|gnu lgpl"),
    ("agpl", 51, "affero agpl", r"(?:gnu )?affero general public licen[sc]e|gnu agpl"),
    ("mpl-2.0", 85, "mozilla", r"subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", 85, "unencumbered", r"free and unencumbered software released into the public domain"),
    ("public-domain", 55, "domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain"),
    ("zlib", 85, "warranty", r"provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("wtfpl", 85, "wtfpl fuck", r"you just do what the fuck you want to"),
    ("bsl-1.0", 85, "permission", r"permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("cc-by-sa", 58, "cc commons", r"cc by sa|creative commons attribution share ?alike"),
    ("cc-by-nc", 58, "cc commons", r"cc by nc|creative commons attribution non ?commercial"),
    ("cc-by-nc-sa", 59, "cc commons", r"cc by nc sa|creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", 59, "cc commons", r"cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s"),
    ("cc-by-nd", 58, "cc commons", r"cc by nd|creative commons attribution no ?deriv(?:ative)?s"),
    ("cc-by", 57, "cc commons", r"cc by|creative commons attribution"),
    ("cc0-1.0", 85, "cc0 commons", r"cc0 1 0 universal|creative commons zero"),
    ("reserved", 40, "reserved", r"all rights reserved"),
    ("reserved", 39, "derechos", r"todos los derechos reservados"),
    ("reserved", 39, "droits", r"tous droits réservés"),
    ("reserved", 39, "rechte", r"alle rechte vorbehalten"),
    ("copyright", 30, "copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)?[0-9]{2})?"),
    ("proprietary", 45, "proprietary confidential", r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", 45, "commercial", r"commercial licen[sc]e"),
    ("non-commercial", 45, "commercial noncommercial", r"(?:for )?non ?commercial (?:use|purposes) only"),
    ("source-available", 35, "source", r"source available licen[sc]e"),
    ("permissive", 20, "permission", r"permission (?:is|to) .{0,40}(?:granted|copy)"),
)


class Rule(NamedTuple):
    label: str
    priority: int
    keywords: frozenset[str]
    needs: frozenset[str]
    pattern: re.Pattern


@cache
def license_rules() -> tuple[Rule, ...]:
    """All rules, the first ones winning; each needs one of ``keywords`` and, if there are any, one of ``needs``."""
    whole = lambda p: re.compile(rf"(?<!\S)(?:{p})(?!\S)")
    named = [Rule(label, priority, frozenset(keys.split()), frozenset(words.split()), whole(shape.replace("N", name))) for priority, words, shape in NOTICES for label, keys, name in LICENSES]
    said = [Rule(label, priority, frozenset(keys.split()), frozenset(), whole(p)) for label, priority, keys, p in SENTENCES]
    return tuple(sorted(named + said, key=lambda r: -r.priority))


_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def gaps_of(line: bytes | str) -> np.ndarray:
    """Places of the single spaces of a line, so that a place's word number is a search and not a count."""
    data = line if isinstance(line, bytes) else line.encode("utf-32-le", "surrogatepass")
    return np.flatnonzero(np.frombuffer(data, np.uint8 if isinstance(line, bytes) else "<u4") == 32)


def base_places(line: bytes) -> list[tuple[int, int, str]]:
    """(first word, words, label) of each base phrase in words joined and surrounded by single spaces."""
    out, gaps = [], gaps_of(line)
    for phrase, label in BASE:
        needle, at, found = b" " + phrase.encode() + b" ", -1, []
        while (at := line.find(needle, at + 1)) >= 0:
            found.append(at)
        out += [(first, phrase.count(" ") + 1, label) for first in np.searchsorted(gaps, found).tolist()]
    return out


class Cover:
    """Intervals that no other one contains, sorted; starts and ends both ascend."""

    def __init__(self):
        self.starts, self.ends = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def contains(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        i = np.searchsorted(self.starts, starts, side="right") - 1
        return (i >= 0) & (self.ends[i] >= ends) if len(self.starts) else np.zeros(len(starts), bool)

    def add(self, starts: np.ndarray, ends: np.ndarray) -> None:
        starts, ends = np.concatenate([self.starts, starts]), np.concatenate([self.ends, ends])
        order = np.lexsort((-ends, starts))
        starts, ends = starts[order], ends[order]
        before = np.concatenate([[-1], np.maximum.accumulate(ends)[:-1]])
        self.starts, self.ends = starts[ends > before], ends[ends > before]


def detections(line: str, words: set[str], rules: tuple[Rule, ...]) -> list[tuple[int, int, str, int]]:
    """(start, end, label, priority) in characters of the joined words, without those that an earlier detection contains.

    The places of one rule never overlap, so they are held against those of the earlier rules together.
    """
    kept: list[tuple[int, int, str, int]] = []
    cover = Cover()
    for r in rules:
        if words.isdisjoint(r.keywords) or r.needs and words.isdisjoint(r.needs):
            continue
        found = np.array([m.span() for m in r.pattern.finditer(line)], np.int64).reshape(-1, 2)
        found = found[~cover.contains(found[:, 0], found[:, 1])]
        if len(found):
            cover.add(found[:, 0], found[:, 1])
            kept += [(s, e, r.label, r.priority) for s, e in found.tolist()]
    return kept


DETECTIONS = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("label", pa.string()), ("priority", pa.int32())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rules = license_rules()
    gate = frozenset().union(*(r.keywords for r in rules))
    raw_gate = frozenset(k.encode() for k in gate)
    for b in slices(batches):
        out: list[list] = [[] for _ in range(7)]
        for text in b.column(1).to_pylist():
            words = words_of(text)
            have = raw_gate.intersection(words)
            places, found = [], []
            if have:
                joined = b" ".join(words)
                places = base_places(b" " + joined + b" ")
                line = joined.decode("utf-8", "replace")
                spans = detections(line, set(line.split(" ")), rules)
                if spans:
                    gaps = gaps_of(line)
                    first, last = (np.searchsorted(gaps, [x[i] for x in spans]).tolist() for i in (0, 1))
                    found = [(f, e - f + 1, label, p) for f, e, (_, _, label, p) in zip(first, last, spans, strict=True)]
            starts = [p[0] for p in places]
            base = {p[2] for p in places}
            for o, v in zip(out, (len(words), len(places), min(starts, default=None), max(starts, default=None), sorted(base), sorted(base | {d[2] for d in found}), [dict(zip(("first", "words", "label", "priority"), d, strict=True)) for d in sorted(found)]), strict=True):
                o.append(v)
        kinds = (*(pa.int64(),) * 4, pa.list_(pa.string()), pa.list_(pa.string()), DETECTIONS)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(o, k) for o, k in zip(out, kinds, strict=True))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "detections"])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, detections for every row of ``docs`` (doc_id, text).

    detections are (first word, words, label, priority) of what no earlier detection contains; labels are those
    and the base phrases', distinct and sorted. Null and empty texts have no words and no labels. Repeated rows
    and rows without doc_id each return a row. Of rules with one priority the first of the list wins a tie. Very long
    texts are scanned whole, in time near to linear in their length. Other columns are not read.
    """
    kinds = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, detections array<struct<first:long,words:long,label:string,priority:int>>"
    return docs.select("doc_id", "text").mapInArrow(_scan, kinds)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses that all ``documents`` name; score is the highest priority found, over 100."""
    out = scan_licenses(read(spark, sf_dir, "documents", "doc_id", "text"))
    top = F.greatest(F.coalesce(F.array_max("detections.priority"), F.lit(0)), F.when(F.col("n_base") > 0, 40).otherwise(0))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), (top / 100.0).alias("score"))
