import random
import re
from itertools import product
from re import _parser

from bytequarry.llm.licenses import BASE, LICENSES, NOTICES, SENTENCES, base_places, detections, license_rules, scan_licenses


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for phrase, label in BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    s = [i for i, _ in at]
    return len(w), len(at), min(s, default=None), max(s, default=None), sorted({x for _, x in at})


def texts():
    r = random.Random(1)
    bits = ["CC BY", "cc-by", "General Public License", "All Rights\nReserved", "rights", "all", "été", "x_y", "cc", "by", "cc by cc by", "É", "\x7f", "1.0", "{license}", "general", "public"]
    return [r.choice([" ", ", ", "\t", "-"]).join(r.choice(bits) for _ in range(r.randrange(12))) for _ in range(300)] + [None, "", "cc by", "word " * 20000 + "all rights reserved"]


def test_base_against_brute_force(spark):
    rows = [(i, t, 1) for i, t in enumerate(texts())] + [(None, "cc by", 2), (1, texts()[1], 1)]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, labels int")).collect()
    assert len(got) == len(rows)
    of = dict(enumerate(texts())) | {None: "cc by"}
    for x in got:
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == brute(of[x.doc_id])
        assert set(x.base_labels) <= set(x.labels)


def test_rules(spark):
    cases = {"Released under the MIT License.": ["mit"], "Licensed under the Apache License, Version 2.0.": ["apache-2.0"], "Licensed under CC BY-NC 4.0.": ["cc-by", "cc-by-nc-4.0"], "This work is licensed under the GNU General Public License, version 3.": ["gpl", "gpl-3.0"], "SPDX-License-Identifier: BSD-3-Clause": ["bsd-3-clause"], "admit licenses": [], "Permission is hereby granted, free of charge, to any person obtaining a copy": ["mit"]}
    got = {r.text: r.labels for r in scan_licenses(spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")).join(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string"), "doc_id").collect()}
    assert got == cases
    assert len(license_rules()) > 200
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def spelled(parts):
    """Every text that a parsed pattern matches; of ``.`` the letter x, none, one or three times."""
    each = []
    for op, v in parts:
        if str(op) == "LITERAL":
            each.append([chr(v)])
        elif str(op) == "ANY":
            each.append(["x"])
        elif str(op) == "IN":
            each.append([chr(c) for k, x in v for c in ([x] if str(k) == "LITERAL" else x)])
        elif str(op) == "BRANCH":
            each.append([t for b in v[1] for t in spelled(b)])
        elif str(op) == "SUBPATTERN":
            each.append(spelled(v[-1]))
        else:
            assert str(op) == "MAX_REPEAT"
            each.append([u for n in sorted({v[0], min(v[1], 3), min(v[1], 1)}) if n >= v[0] for u in ("".join(t) for t in product(spelled(v[2]), repeat=n))])
    return ["".join(t) for t in product(*each)]


def test_keywords_cover_the_patterns(spark):
    names = [(label, keys, t) for label, keys, name in LICENSES for t in spelled(_parser.parse(name))]
    said = [(label, keys, t) for label, _, keys, p in SENTENCES for t in spelled(_parser.parse(p))]
    ways = [(str(p), words, t) for p, words, shape in NOTICES for t in spelled(_parser.parse(shape)) if p != 90]
    assert len(names) > 500 and [x for x in names + said + ways if set(x[1].split()).isdisjoint(x[2].split(" "))] == []
    # a scan without gates finds the same
    lines = [x[2] for x in said] + [f"{way} {t}" for way in ("licensed under the", "spdx license identifier", "licences") for _, _, t in names] + [f"{t} license" for _, _, t in names]
    free = tuple(r._replace(keywords=frozenset(["any"]), needs=frozenset()) for r in license_rules())
    r = random.Random(3)
    for line in r.sample(lines, 600):
        assert detections(line, set(line.split(" ")), license_rules()) == detections(line, {"any"}, free)
    cases = {"Licensed under the Common Development and Distribution License, Version 1.0": "cddl-1.0", "licensed under the Open Software License": "osl-3.0", "licensed under the Open Database License": "odbl-1.0", "the Open Font License": None, "licensed under the Open Font License": "ofl-1.1", "under the Public Domain Dedication and License": None, "licensed under the Public Domain Dedication and License": "pddl-1.0", "Do What the Fuck You Want to Public License": None, "released under the Do What the Fuck You Want to Public License": "wtfpl", "licensed under PSFL": "python-2.0", **{f"licensed under {n}": w for n, w in (("Apache2", "apache-2.0"), ("MPL2", "mpl-2.0"), ("EPL2", "epl-2.0"), ("LGPL3", "lgpl-3.0"), ("AGPL3", "agpl-3.0"))}}
    got = scan_licenses(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()
    assert {x.doc_id: x.labels for x in got} == {i: [w] if w else [] for i, w in enumerate(cases.values())}


def test_suppression_against_brute_force():
    """Every match of every rule, in order; one that lies within a kept one goes."""
    r, rules = random.Random(5), license_rules()
    parts = [x for v in (spelled(_parser.parse(p)) for _, _, _, p in SENTENCES) for x in v][:60] + ["mit license", "licensed under the apache license version 2 0", "gpl 3", "cc by", "the", "of"]
    seen = 0
    for _ in range(60):
        line = " ".join(r.choice(parts) for _ in range(r.randrange(1, 25)))
        words, kept = set(line.split(" ")), []
        for rule in rules:
            if words.isdisjoint(rule.keywords) or rule.needs and words.isdisjoint(rule.needs):
                continue
            for m in rule.pattern.finditer(line):
                if not any(s <= m.start() and m.end() <= e for s, e, _, _ in kept):
                    kept.append((m.start(), m.end(), rule.label, rule.priority))
        assert detections(line, words, rules) == kept
        seen += len(kept)
    assert seen > 200


def test_time_is_linear_in_the_text(spark):
    """Four times the hits take less than ten times the time; quadratic scans would take sixteen."""
    from time import perf_counter

    took = []
    for n in (20_000, 80_000):
        line = " ".join(["all rights reserved"] * n)
        start = perf_counter()
        found = detections(line, set(line.split(" ")), license_rules())
        places = base_places((" " + line + " ").encode())
        took.append(perf_counter() - start)
        assert len(found) == len(places) == n and places[-1] == (3 * n - 3, 3, "reserved")
    assert took[1] < 10 * took[0]
