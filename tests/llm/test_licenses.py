import re

import pytest

from tableprofile.llm import license_rules, licenses

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = [
    "Licensed under CC BY-NC 4.0.",
    "This work is licensed under the GNU General Public License, version 3. All rights reserved.",
    "Released under the MIT License. cc  by\ncc-by 2 all-rights.reserved",
    "Copyright (c) 2019 Foo. SPDX-License-Identifier: Apache-2.0 or GPL-2.0-or-later",
    "The Apache License, Version 2.0; see http://www.apache.org/licenses/LICENSE-2.0",
    "mit dem Hund. accbya General-Public-Licenses eall rights reserved",
    "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "for non-commercial use only, noncommercial purposes; no rights reserved", "ALL RIGHTS RESERVEDé all rights reserved",
]


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places = [
        (label, k, k + len(p.split()) - 1)
        for label, _, p in license_rules.BASE
        for k in range(len(words))
        if words[k : k + len(p.split())] == p.split()
    ]
    canon, found = f" {' '.join(words)} ", []
    for n, r in enumerate(license_rules.rules()):
        for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", canon, re.A):
            first = canon[: m.start()].count(" ") - 1
            found.append((first, first + m.group().count(" "), r.priority, n, r))

    def beats(b, a):
        if b is a or b[0] > a[0] or b[1] < a[1] or b[2] > a[2]:
            return False
        return b[:2] != a[:2] or b[2:4] < a[2:4]

    kept = [a for a in found if not any(beats(b, a) for b in found)]
    return len(words), sorted(places), sorted((r.name, r.label, a, b, p, r.score) for a, b, p, _, r in kept)


def test_against_brute_force(documents, odd_rows):
    long = "word " * 20_000 + TEXTS[1] + " tail" * 50
    rows = [*enumerate(TEXTS, 100), (200, long), (201, " ".join(TEXTS) * 3), *odd_rows]
    out = licenses.scan_licenses(documents(rows)).collect()
    got = sorted(((r["doc_id"], r["n_words"], sorted(map(tuple, r["base"])), sorted(map(tuple, r["detections"]))) for r in out), key=repr)
    assert got == sorted(((i, *brute(t)) for i, t in rows), key=repr)
    assert licenses.license_digest(documents(rows).limit(0)).collect() == []


def test_detections_without_number(documents):
    """Copies of a text have the detections of one, moved; their number is beyond many blocks."""
    one = " ".join(TEXTS) + " zzz "
    n, base, found = brute(one)
    copies = 4000
    r = licenses.scan_licenses(documents([(1, one * copies)])).first()
    assert r["n_words"] == n * copies and len(r["base"]) == len(base) * copies
    moved = {(name, label, a + n * c, b + n * c, p, s) for c in range(copies) for name, label, a, b, p, s in found}
    assert len(r["detections"]) == len(moved) > 50_000 and set(map(tuple, r["detections"])) == moved
    ends = [(d["first"], -d["last"]) for d in r["detections"]]
    assert ends == sorted(ends)


def test_a_span_of_blocks_hides_what_it_holds(documents):
    """A strong detection in the first block reaches into all later ones."""
    rules = [
        license_rules.Rule("wide", "w", 1, ("start",), "", "start(?: a)+ stop", 1.0),
        license_rules.Rule("narrow", "n", 2, ("a",), "", "a", 0.5),
    ]
    text = "a start" + " a" * 2000 + " stop a"
    r = licenses.scan_licenses(documents([(1, text)]), signatures=rules).first()
    assert [(d["rule"], d["first"], d["last"]) for d in r["detections"]] == [("narrow", 0, 0), ("wide", 1, 2002), ("narrow", 2003, 2003)]


def test_digest(documents):
    r = licenses.license_digest(documents([(1, TEXTS[1])])).first()
    assert (r["n_base"], r["first_word"], r["last_word"]) == (2, 7, 12)
    assert (r["base_labels"], r["labels"]) == ("gpl,reserved", "gpl,gpl-3.0,reserved")
    none = licenses.license_digest(documents([(1, "nothing")])).first()
    assert (none["first_word"], none["labels"], none["score"]) == (None, "", 0.0)


@pytest.mark.parametrize("name", [r.name for r in license_rules.rules() if r.name.endswith("/name")][::7])
def test_keywords_open_the_gate(name):
    """A text made of a licence's own label is found whatever stands between its words."""
    rule = next(r for r in license_rules.rules() if r.name == name)
    assert rule.keywords and rule.also == "licen" and re.compile(rule.pattern)


def test_rules_are_hundreds_with_names_of_their_own():
    names = [r.name for r in license_rules.rules()]
    assert len(names) >= 300 and len(set(names)) == len(names)
