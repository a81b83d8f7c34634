"""Language identification: held-out accuracy and a plain version of the method."""

import unicodedata
import zlib
from collections import Counter

from llm_tables import none_of, odd_documents, table

from kinfold.llm import language
from kinfold.llm.queries import QUERIES


def grams(text):
    """n-grams of 1 to 3 letters, _ for the edge of a word, by plain loops."""
    out, word = Counter(), ""
    for c in (text or "") + " ":
        if unicodedata.category(c)[0] == "L":
            low = c.lower()
            word += low if len(low) == 1 else c
        elif word:
            out.update(word)
            out.update(("_" + word + "_")[i:i + 2] for i in range(len(word) + 1))
            out.update(("_" + word + "_")[i:i + 3] for i in range(len(word)))
            word = ""
    return out


def code(g):
    v = 0
    for c in g:
        v = (v << 21) | (0 if c == "_" else ord(c))
    return v + {1: 0, 2: 1 << 42, 3: -1 << 63}[len(g)]


def top(counts):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))][:language.PROFILE]


def brute(rows):
    learn = {}
    for d, text, lang in rows:
        if lang is not None and text is not None and not (d is not None and zlib.crc32(str(d).encode()) % 4 == 2):
            learn.setdefault(lang, Counter()).update(grams(text))
    profiles = {k: {g: i for i, g in enumerate(top(learn[k]))} for k in sorted(learn) if learn[k]}
    out = []
    for d, text, _ in rows:
        own = top(grams(text))
        held = d is not None and zlib.crc32(str(d).encode()) % 4 == 2
        if not own or not profiles:
            out.append((d, held, "und", 0.0))
            continue
        n = language.PROFILE
        away = {k: sum(abs(p[g] - i) if g in p else n for i, g in enumerate(own)) for k, p in profiles.items()}
        best = min(away, key=lambda k: (away[k], k))
        out.append((d, held, best, round(1 - away[best] / (n * len(own)), 9)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in df.collect()), key=str)


def test_query_equals_plain_method(spark):
    rows = [tuple(r) for r in table(spark, "documents").select("doc_id", "text", "lang").collect()]
    assert got(QUERIES["op10_language"](spark, "/root/testdata/sf0.001")) == brute(rows)


def test_held_out_accuracy(spark):
    pred = QUERIES["op10_language"](spark, "/root/testdata/sf0.01").where("held_out").join(table(spark, "documents", "sf0.01").select("doc_id", "lang"), "doc_id").collect()
    assert len(pred) > 200 and sum(r.lang == r.lang_pred for r in pred) / len(pred) > 0.97


def test_odd_rows(spark):
    docs = odd_documents(spark)
    want = brute([tuple(r) for r in docs.select("doc_id", "text", "lang").collect()])
    assert got(language.identify(docs)) == want
    assert {r[2] for r in want if r[0] in (3, 4, 6, 8)} == {"und"}
    kept = language.accepted(docs)
    assert kept.schema == docs.schema
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "2", "5", "7", "None", "9", "10", "11", "12"])


def test_small_flushes_give_the_same(spark, monkeypatch):
    docs = table(spark, "documents")
    want = language.train(docs)
    monkeypatch.setattr(language, "HELD", 500)
    have = language.train(docs)
    assert list(want) == list(have) and all((want[k] == have[k]).all() for k in want)


def test_empty_and_untaught(spark):
    docs = odd_documents(spark)
    assert language.identify(none_of(docs)).collect() == [] and language.accepted(none_of(docs)).collect() == []
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", docs["host"]).where("false").unionByName(docs.withColumn("lang", docs["class"]))).collect()} == {"und"}
