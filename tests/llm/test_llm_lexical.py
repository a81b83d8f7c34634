"""Ranked search: a plain ranking, tiles, blocks, ties and odd rows."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from llm_tables import none_of, odd_documents
from oracle_check import compare, duck

from kinfold.llm import lexical
from kinfold.llm.queries import ORACLES, QUERIES

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return _TERM.findall((text or "").translate(_LOWER))


def plain(docs, items, top=20):
    """(doc_id, text) and (item_id, text) -> rows of the ranking, by the contract's words."""
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    held = [h for h in held if h[2]]
    n_docs, n_terms = len(held), sum(h[2] for h in held)
    df = Counter(t for _, c, _ in held for t in c)
    bags = {}
    for item, text in set(items):
        bags.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, bag in bags.items():
        scored = []
        for i, c, n in held:
            m = 75 + 25 * n * n_docs // n_terms
            s = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                    for t, r in bag.items() if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, k, r[3], -r[0]) for k, r in enumerate(sorted(scored)[:top], 1)]
    return out


def check(got, docs, items, top=20):
    key = lambda r: (str(r[0]), r[1])
    assert sorted(map(tuple, got), key=key) == sorted(plain(docs, items, top), key=key)


ITEMS = [(1, "the quick brown FOX fox fox"), (2, "été après"), (3, None), (4, "..."), (5, "nowhere else"), (1, "the quick brown FOX fox fox"),
         (1, "lazy dog"), (None, "word end"), (6, "one " * 3000)]


def test_query_equals_sql(spark):
    r = compare(spark, duck("/root/testdata/sf0.01"), "op11", QUERIES["op11_lexical_search"], ORACLES["op11_lexical_search"], "/root/testdata/sf0.01")
    assert r["status"] == "ok", r


@pytest.mark.parametrize("block,tile,width", [(8 << 20, 64, 2048), (60, 2, 3)])
def test_odd_rows_blocks_and_tiles(spark, monkeypatch, block, tile, width):
    monkeypatch.setattr(lexical, "ITEM_TILE", tile)
    monkeypatch.setattr(lexical, "DOC_TILE", width)
    docs = odd_documents(spark)
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, `doc_id.score` string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check(lexical.search(docs, items, top=3, block_bytes=block).collect(), rows, ITEMS, 3)


def test_empty_tables(spark):
    docs = odd_documents(spark)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(none_of(docs), items).collect() == []
    assert lexical.search(docs, none_of(items)).collect() == []
    assert lexical.search(docs, none_of(items)).columns == ["item_id", "rank", "doc_id", "score"]


def test_ties_go_by_doc_id_across_tasks(spark):
    rows = [(i * 37 % 1000, "same words here") for i in range(1000)] + [(2000 + i, "other text") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(13)
    got = lexical.search(docs, spark.createDataFrame([("a", "words")], "item_id string, text string")).orderBy("rank").collect()
    assert [r.doc_id for r in got] == list(range(20)) and [r["rank"] for r in got] == list(range(1, 21))


@pytest.mark.parametrize("exact", [1 << 53, 20_000_000, 4_000_000])
def test_tiles_hold_every_repetition_below_the_exact_bound(exact):
    weight = np.array([3, 0, 1, 2, 3])
    counts = [{0: 5, 1: 2, 2: 9}, {3: 4, 0: 1}, {}]
    tiles = lexical.vocabulary_tiles(counts, weight, width=2, exact=exact)
    seen = [Counter(), Counter(), Counter()]
    for ids, a in tiles:
        assert len(ids) <= 2 and len(set(ids)) == len(ids)
        assert (a @ weight[ids] * lexical.IMPACT_BOUND < exact).all()
        for i, row in enumerate(a):
            seen[i].update({int(v): int(n) for v, n in zip(ids, row, strict=True) if n})
    assert seen == [Counter({v: n for v, n in c.items() if weight[v]}) for c in counts]
