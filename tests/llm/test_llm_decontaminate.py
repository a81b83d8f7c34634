"""FM-index and decontamination against plain search."""

import hashlib
import re

import numpy as np
from llm_tables import none_of, odd_documents, table

from kinfold.llm import decontaminate, fmindex

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(docs, items, window=10):
    grams = {}
    for item, text in items:
        ws = words(text)
        for i in range(max(1, len(ws) - window + 1) if ws else 0):
            grams.setdefault(tuple(ws[i:i + window]), set()).add("" if item is None else str(item))
    sizes = {len(g) for g in grams}
    out = []
    for d, text in docs:
        ws, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(ws) - n + 1):
                if (g := tuple(ws[i:i + n])) in grams:
                    hit.update(range(i, i + n))
                    found |= grams[g]
        out.append((d, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r)[:6] for r in df.collect()), key=str)


def test_suffix_array_search_and_locate():
    rng = np.random.default_rng(1)
    for _ in range(60):
        sigma = int(rng.integers(2, 6))
        s = np.concatenate((np.tile(rng.integers(0, sigma, int(rng.integers(1, 80))), int(rng.integers(1, 4))), [0]))
        ends = np.cumsum(s == 0)
        key = [(int(x), int(e) if x == 0 else 0) for x, e in zip(s, ends)]
        assert fmindex.suffix_array(s, sigma).tolist() == sorted(range(len(s)), key=lambda i: key[i:])
        index = fmindex.FMIndex(s, sigma, sample=3)
        patterns, lengths = rng.integers(1, sigma, (15, 3)), rng.integers(1, 4, 15)
        lo, hi = index.search(patterns, lengths)
        for p, n, a, b in zip(patterns, lengths, lo, hi):
            q = p[3 - n:].tolist()
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(len(s) - n + 1) if s[i:i + n].tolist() == q]


def test_report_equals_plain_search(spark, monkeypatch):
    docs, items = table(spark, "documents"), table(spark, "benchmark")
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.collect()])
    assert got(decontaminate.report(docs, items)) == want
    assert sum(r[5] for r in want) > 0
    # Many shards, pieces and blocks give the same.
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 25)
    assert got(decontaminate.report(docs, items)) == want


def test_odd_rows(spark):
    docs = odd_documents(spark).select("doc_id", "text")
    items = spark.createDataFrame([(1, "Quick BROWN fox"), (2, None), (3, ""), (4, "..."), (None, "jumps over"), (5, "word " * 12), (5, "one"),
                                   (6, "lazy dog and runs away from the big bad wolf again"), (7, "après noël")], "item_id long, text string")
    want = brute([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()])
    assert got(decontaminate.report(odd_documents(spark), items)) == want
    spans = {r.doc_id: r.removal_spans for r in decontaminate.report(odd_documents(spark), items).collect()}
    assert spans[1] == "1:6,7:18" and spans[3] == "" and spans[7] == "1:3"


def test_removal_and_cleaning(spark):
    items = spark.createDataFrame([(1, "Quick BROWN fox"), (2, "noël")], "item_id long, text string")
    docs = odd_documents(spark)
    cut = decontaminate.without_spans(docs, items)
    assert cut.schema.names == docs.schema.names and cut.count() == docs.count()
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts[1].startswith("the  jumps") and texts[7] == "été après  garçon" and texts[3] is None and texts[4] == ""
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["3", "4", "5", "6", "None", "8", "9", "10", "11", "12"])


def test_empty_tables(spark):
    docs = odd_documents(spark)
    items = table(spark, "benchmark")
    assert decontaminate.report(none_of(docs), items).collect() == []
    assert all(r.n_hit == 0 and not r.contaminated for r in decontaminate.report(docs, none_of(items)).collect())


def test_a_repeated_item_is_sent_once(spark, monkeypatch):
    sent = []
    search = decontaminate._search
    monkeypatch.setattr(decontaminate, "_search", lambda rows, *a: sent.append(rows) or search(rows, *a))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 400)
    texts = [" ".join(f"w{i}x{j}" for j in range(12)) for i in range(20)]
    items = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])] * 300
    docs = [(i, f"before {t} after") for i, t in enumerate(texts)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    report = decontaminate.report(spark.createDataFrame(docs, "doc_id long, text string"), benchmark)
    assert got(report) == brute(docs, items)
    assert sorted(r for rows in sent for r in rows) == sorted((str(i), t) for i, t in enumerate(texts))
    assert len(sent) <= 1 + sum(len(t) + 2 for t in texts) // 400
