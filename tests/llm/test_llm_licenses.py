"""Patience alignment and license scans against dynamic programming and planted texts."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from llm_tables import none_of, odd_documents, table

from kinfold.llm import licenses
from kinfold.llm.common import words
from kinfold.llm.queries import QUERIES


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y and x else max(row[j + 1], row[j])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=60), st.lists(st.integers(1, 60), max_size=40))
def test_alignment_is_a_common_subsequence(text, template):
    pairs = licenses.align(text, template)
    assert all(text[i] == template[j] for i, j in pairs)
    assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:]))
    assert len(pairs) <= lcs(text, template)
    if len(set(text)) == len(text) and len(set(template)) == len(template):
        assert len(pairs) == lcs(text, template)  # all words are anchors


@given(st.lists(st.integers(-50, 50), max_size=40))
def test_longest_increasing(values):
    at = licenses.increasing(values)
    assert all(values[a] < values[b] and a < b for a, b in zip(at, at[1:]))
    best = [1] * len(values)
    for i in range(len(values)):
        best[i] = 1 + max((best[j] for j in range(i) if values[j] < values[i]), default=0)
    assert len(at) == max(best, default=0)


def test_planted_licenses_are_found():
    scanner, rng = licenses.Scanner(licenses.TEMPLATES), random.Random(3)
    noise = lambda n: " ".join(f"q{rng.randrange(999)}" for _ in range(n))
    for name, text in licenses.TEMPLATES.items():
        ws = text.split()
        changed = [w if i % 12 != 7 else "changed" for i, w in enumerate(ws)]
        for planted in (text, text.upper(), " \n".join(changed)):
            got = scanner.scan(f"{noise(30)} {planted} {noise(30)}".encode())
            assert len(got) == 1 and got[0][0] == name and got[0][1] >= licenses.COVERAGE, (name, got)
            assert got[0][1] == 1.0 or planted == " \n".join(changed)
        assert [x[:2] for x in scanner.scan((text + " " + text + " " + noise(3) + " " + text).encode())] == [(name, 1.0)] * 3
    assert scanner.scan(noise(500).encode()) == [] and scanner.scan(None) == [] and scanner.scan(b"") == []
    assert scanner.scan("the software is licensed under the terms of this work, version 3".encode()) == []


def test_interrupted_licenses_are_found_whole():
    scanner, rng = licenses.Scanner(licenses.TEMPLATES), random.Random(5)
    noise = lambda n: [f"q{rng.randrange(999)}" for _ in range(n)]
    for name, text in licenses.TEMPLATES.items():
        ws = text.split()
        n = len(words(text.encode()))
        for many in (6, 7, 20, 50):
            for at in range(1, len(ws)):
                planted = [*noise(30), *ws[:at], *noise(many), *ws[at:], *noise(30)]
                got = scanner.scan(" ".join(planted).encode())
                assert got == [(name, 1.0, 30, 30 + n + many)], (name, many, at, got)


def test_query_agrees_with_dynamic_programming(spark):
    """A statement that a plain search of all windows finds is found, and no other."""
    scanner = licenses.Scanner(licenses.TEMPLATES)
    texts = {r.doc_id: r.text for r in table(spark, "documents").collect()}
    got = {r.doc_id: r for r in QUERIES["op7_license_scan"](spark, "/root/testdata/sf0.001").collect()}
    assert got.keys() == texts.keys()
    for d, text in texts.items():
        ids = [scanner.number.get(w, 0) for w in words(text.encode())]
        assert got[d].n_words == len(ids)
        best = 0.0
        for template in scanner.templates.values():
            n = len(template)
            if len({x for x in ids if x} & set(template)) < licenses.COVERAGE * len(set(template)):
                continue
            best = max([best, *(lcs(ids[i:i + n + 3], template) / n for i in range(max(1, len(ids) - n + 1)))])
        assert (best >= licenses.COVERAGE) == (got[d].license is not None), (d, best, got[d])
        assert got[d].coverage <= best + 1e-9


def test_odd_rows_and_empty(spark):
    rows = licenses.scan(odd_documents(spark)).collect()
    assert len(rows) == 15 and all(r.license is None and r.findings == "" and r.coverage == 0.0 for r in rows)
    assert licenses.scan(none_of(odd_documents(spark))).collect() == []


def found(text, **kw):
    return [x[0] for x in licenses.Scanner(licenses.TEMPLATES, **kw).scan(text.encode())]


def test_scattered_words_are_no_notice():
    for text in ("The album was released under the label in the spring and later the station got a broadcasting license",
                 "He was licensed under the old rules. By 4 in the morning the cc list had 0 names",
                 "This work is what the public knows; licensed in general, under the version of the license for gnu herds, 3 in all",
                 "licensed by the state under a rule of 4 parts, cc by hand, 0 errors",
                 " ".join("the software is provided as is without warranty of any kind and in no event liable for the use or other dealings".split() * 40)):
        assert found(text) == [], text


def test_relatives_are_told_apart():
    for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        for version in ("4.0", "3.0"):
            assert found(f"Text. Licensed under CC {kind} {version}. More text.") == [f"CC-{kind}-{version} notice"]
    assert found("Licensed under CC BY 2.5") == []
    for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause"):
        assert found("See below. " + licenses.TEMPLATES[name]) == [name]
        if f"{name} notice" in licenses.TEMPLATES:
            assert found(licenses.TEMPLATES[f"{name} notice"]) == [f"{name} notice"]
    assert found("This work is licensed under the GNU Library General Public License, version 3.") == []


def test_a_statement_may_be_interrupted_at_any_length():
    rng = random.Random(7)
    for name in ("MIT", "BSD-3-Clause", "GPL-3.0 notice", "CC-BY-4.0 notice"):
        ws = licenses.TEMPLATES[name].split()
        for many in (400, 5000):
            at = rng.randrange(1, len(ws))
            got = licenses.Scanner(licenses.TEMPLATES).scan(" ".join([*ws[:at], *(f"q{rng.randrange(99)}" for _ in range(many)), *ws[at:]]).encode())
            assert [x[:2] for x in got] == [(name, 1.0)], (name, many, at, got)


def test_templates_from_files(spark, tmp_path):
    (tmp_path / "Own-1.0").write_text("You may read this text aloud to any person who asks for it on a rainy day.\nNothing else.")
    own = licenses.templates_from(spark, str(tmp_path))
    docs = spark.createDataFrame([(1, "Note: you may read this text aloud to any person who asks for it on a rainy day. Nothing else. Bye."), (2, "no")], "doc_id long, text string")
    assert {r.doc_id: r.license for r in licenses.scan(docs, own).collect()} == {1: "Own-1.0", 2: None}
    try:
        licenses.templates_from(spark, str(tmp_path), most_bytes=10)
        raise AssertionError("no bound")
    except ValueError as e:
        assert "more than 10" in str(e)
