import re
from re import _parser

from plumbline.llm.licenses import BASE, GATE, ruled, scanned


def brute(text: str | None) -> tuple[list[tuple[int, int, str, int, float, int]], list[tuple[int, str]], int]:
    """The same by plain Python: detections, base places, number of words."""
    lowered = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered) if w]
    joined = " " + " ".join(words) + " "
    hits = [(joined[: m.start()].count(" "), joined[: m.end()].count(" ") - 1, r.label, r.priority, r.confidence, r.number) for r in ruled() if r.keyword in joined for m in re.finditer(f" ({r.pattern})(?= )", joined)]
    wins = lambda e, d: (e[3], -(e[1] - e[0]), e[5]) < (d[3], -(d[1] - d[0]), d[5])
    left = [d for d in hits if not any(e[0] <= d[0] and e[1] >= d[1] and wins(e, d) for e in hits)]
    base = [(i, label) for phrase, label in BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return left, base, len(words)


TEXTS = [
    "Released under the MIT License.\nLicensed under the Apache License, Version 2.0. under the mit license",
    "This work is licensed under the GNU General Public License, version 3. mit der lizenz",
    "SPDX-License-Identifier: BSD-3-Clause; licensed under CC BY-NC 4.0 or CC-BY-NC-SA; cc by nc",
    "cc by ncx under the mit licensed apache license version 20",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software; all rights reserved",
    "Éunder the mit license ünder the MIT license",
    "under the mit license " * 50 + "x",
    "subject to the terms of the Mozilla Public License 2.0 in the public domain is in the public domain",
    "", None, "   ", "...", "plain words only", "MIT", "license: MIT license",
]


def test_equals_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(None, TEXTS[0], "", ""), (0, TEXTS[0], "", "")], "doc_id long, text string, base string, words string")
    rows = scanned(docs).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = TEXTS[r["doc_id"] or 0]
        left, base, n = brute(text)
        starts = [i for i, _ in base]
        base_labels = sorted({label for _, label in base})
        assert (r["n_words"], r["n_base"]) == (n, len(base))
        assert (r["first_word"], r["last_word"]) == ((min(starts), max(starts)) if starts else (None, None))
        assert r["base_labels"] == ",".join(base_labels)
        assert r["labels"] == ",".join(sorted({*base_labels, *(d[2] for d in left)}))
        assert sorted((d["first"], d["last"], d["label"], d["number"]) for d in r["detections"] or []) == sorted((d[0], d[1], d[2], d[5]) for d in left)
        assert r["score"] == max([0.0, *(d[4] for d in left), *([0.9] if base else [])])


def matches(pattern, whole):
    """Strings that a pattern matches: each branch, each letter of a class, with or without all that may be missing."""

    def grown(heads, parts):
        for kind, value in parts:
            if kind is _parser.LITERAL:
                heads = [h + chr(value) for h in heads]
            elif kind is _parser.IN:
                heads = [h + chr(v) for h in heads for k, v in value if k is _parser.LITERAL]
            elif kind is _parser.BRANCH:
                heads = [x for branch in value[1] for x in grown(heads, branch)]
            elif kind is _parser.SUBPATTERN:
                heads = grown(heads, value[3])
            elif kind is not _parser.ANY:
                assert kind in (_parser.MAX_REPEAT, _parser.MIN_REPEAT), kind
                if value[0] or whole:
                    heads = grown(heads, value[2])
        return heads

    return grown([""], _parser.parse(pattern))


def test_rules_are_many_and_hold_their_keywords():
    rules = ruled()
    assert len(rules) > 500 and len(BASE) == 3 and len({(r.pattern, r.label) for r in rules}) == len(rules)
    for r in rules:
        for text in {*matches(r.pattern, False), *matches(r.pattern, True)}:
            assert r.keyword in text and set(GATE) & set(text.split()), (r, text)
    assert all(set(GATE) & set(phrase.split()) for phrase in BASE)


def test_written_notices(spark):
    notices = {
        "gpl-2": "you can redistribute it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2",
        "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "bsd-4-clause": "All advertising materials mentioning features or use of this software must display the following",
        "sspl-1": "Server Side Public License, version 1", "proprietary": "Unauthorized copying of this file, via any medium, is prohibited",
        "cc-by-sa": "see http://creativecommons.org/licenses/by-sa/4.0/ for it", "json": "The Software shall be used for Good, not Evil.",
        "openrail": "released under a BigScience OpenRAIL-M license", "public-domain": "This software is a work of the United States Government",
    }
    rows = spark.createDataFrame(list(enumerate(notices.values())), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"].split(",") for r in scanned(rows).collect()}
    for i, label in enumerate(notices):
        assert label in got[i], (label, got[i])


def test_containment_keeps_the_specific_licence(spark):
    docs = spark.createDataFrame([(1, "Shared under CC BY-NC-SA 4.0"), (2, "GNU General Public License v3")], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in scanned(docs).collect()}
    assert got == {1: "cc-by-nc,cc-by-nc-sa", 2: "gpl-3"}  # the first is a place of the base phrase "cc by nc" too


def test_empty_table(spark):
    assert scanned(spark.createDataFrame([], "doc_id long, text string")).collect() == []
