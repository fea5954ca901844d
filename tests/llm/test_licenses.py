"""License rules against plain Python over words."""

import random
import re

import brute

from tidewave.llm import licenses
from tidewave.llm.license_rules import PHRASES, RULES


def plain_scan(text):
    """(number of words, places of phrases, detections) of one text, detection against detection."""
    words = brute.LETTERED.findall((text or "").translate(brute.LOWER))
    places = sorted((i, label) for label, phrase in PHRASES for v in [phrase.split()]
                    for i in range(len(words) - len(v) + 1) if words[i:i + len(v)] == v)
    line = "".join(f" {w}#{i} " for i, w in enumerate(words))
    found = []
    for r in RULES:
        if set(r.keywords) & set(words):
            for m in re.finditer(licenses.numbered(r.pattern), line):
                numbers = [int(x) for x in re.findall("#([0-9]+)", m[0])]
                found.append((numbers[0], numbers[-1], r.level, r.number, r.label))
    kept = [d for d in found if not any(
        e is not d and e[0] <= d[0] and e[1] >= d[1] and e[2] >= d[2]
        and (e[:2] != d[:2] or (e[2], -e[3]) > (d[2], -d[3])) for e in found)]
    return len(words), places, sorted((d[0], d[1], d[3], d[4]) for d in kept)


PARTS = ["MIT License", "Released under the MIT License.", "apache", "License", "Apache License, Version 2.0", "GNU", "General Public License",
         "v3", "or any later version", "SPDX-License-Identifier:", "GPL-2.0-only", "BSD-3-Clause", "cc by nc 4.0", "Creative Commons", "é",
         "licensed under the terms of the", "LESSER", "2.1", "www.gnu.org/licenses/gpl-3.0.html", "All rights reserved", "mit", "x", "\n", "lİcense", "mIT LIcense"]


def check(spark, texts):
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string, other string")
    out = {r.doc_id: r for r in licenses.scan(df).collect()}
    report = {r.doc_id: r for r in licenses.report(licenses.scan(df)).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        n, places, found = plain_scan(t)
        r, s = out[i], report[i]
        assert (r.n_words, [tuple(p) for p in r.places]) == (n, places)
        assert [(d.first, d.last, d.rule, d.label) for d in r.detections] == found
        assert s.labels == ",".join(sorted({p[1] for p in places} | {d[3] for d in found}))
        assert (s.n_base, s.first_word, s.last_word) == (len(places), *((places[0][0], places[-1][0]) if places else (None, None)))
        assert 0 <= s.score <= 1 and (s.score > 0) == bool(found) and s.other == "clash"
    return report


def test_random_texts(spark):
    rng = random.Random(11)
    check(spark, [" ".join(rng.choice(PARTS) for _ in range(rng.randint(1, 12))) for _ in range(400)])


def test_edges(spark):
    long = "word " * 100_000 + "MIT license " * 3000 + "GPL v2"
    got = check(spark, [None, "", " .,;", "mit", "MIT license", "MIT license", "mit license mit license", "mit-licenses"])
    assert got[4].labels == got[5].labels == "mit" and got[7].n_base == 0
    df = spark.createDataFrame([(1, long)], "doc_id long, text string")
    r = licenses.report(licenses.scan(df)).first()
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.n_detections) == (106_002, 3000, 100_000, 105_998, 3001)
    assert r.labels == "gpl-2.0,mit"
    assert licenses.scan(df.limit(0)).count() == 0


def test_rules_are_many_and_whole():
    assert len(RULES) >= 300 and [r.number for r in RULES] == list(range(len(RULES)))
    assert [r.level for r in RULES] == sorted((r.level for r in RULES), reverse=True)
    for r in RULES:
        re.compile(licenses.numbered(r.pattern))
        assert r.keywords and all(k in r.pattern.replace(" ?", "").replace("[cs]", "s" if "license" in k else "c") for k in r.keywords), r
