"""BagMinHash near-dedup against all pairs."""

from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from llm_tables import none_of, odd_documents, table, with_text

from kinfold.llm import bagminhash, neardup
from kinfold.llm.common import mix
from kinfold.llm.components import components
from kinfold.llm.queries import QUERIES


def brute(rows, similar=0.8):
    """Groups by all pairs that share a shingle: doc_id -> least doc_id."""
    bags = {i: bagminhash.shingles((t or "").encode()) for i, t in rows}
    texts = dict(rows)
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    holders = defaultdict(list)
    for i, (h, _) in bags.items():
        for x in h.tolist():
            holders[x].append(i)
    pairs = {p for v in holders.values() for p in combinations(sorted(v), 2)} | \
        {p for p in combinations(sorted(texts), 2) if texts[p[0]] == texts[p[1]] and texts[p[0]] is not None and not len(bags[p[0]][0])}
    for a, b in pairs:
        if texts[a] == texts[b] or bagminhash.weighted_jaccard(bags[a], bags[b]) >= similar:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


def test_signature_is_unbiased():
    rng = np.random.default_rng(5)
    for spread in (1, 4, 300):
        off = []
        for _ in range(30):
            a = {i: int(rng.integers(1, spread + 1)) for i in range(50)}
            b = {i: v if rng.random() < 0.7 else int(rng.integers(1, spread + 1)) for i, v in a.items()} | {100: spread}
            bags, salt = [], rng.integers(1 << 60, dtype=np.uint64)
            for d in (a, b):
                h = mix(np.array(list(d), np.uint64) + salt)
                by = np.argsort(h)
                bags.append((h[by], np.array(list(d.values()), np.int64)[by]))
            j = bagminhash.weighted_jaccard(*bags)
            s = bagminhash.signatures(bags, 512)
            off.append(((s[0] == s[1]).mean() - j) / np.sqrt(j * (1 - j) / 512))
        assert abs(np.mean(off)) < 4 / np.sqrt(30) and np.std(off) < 1.6


def test_signature_does_not_depend_on_its_batch():
    bags = [bagminhash.shingles(t) for t in (b"a", b"a b c d e f g", b"x y z " * 500)]
    alone = np.concatenate([bagminhash.signatures([b]) for b in bags])
    assert (alone == bagminhash.signatures(bags)).all()


def test_shingles():
    assert [len(bagminhash.shingles(t)[0]) for t in (None, b"", b"...", b"one", b"a b c d e", b"a b c d e f")] == [0, 0, 0, 1, 1, 2]
    assert bagminhash.shingles(b"A b, C!")[0] == bagminhash.shingles(b"a B c")[0]
    h, n = bagminhash.shingles(b"a b c d e " * 3)
    assert n.sum() == 11 and len(h) == 5


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 120)] + [(7, 7), (200, 201), (201, 200), (119, 300)]
    got = dict(components(spark.createDataFrame(links, "a long, b long"))[0].collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in [*range(100, 120), 300]}, 200: 200, 201: 200}


def test_query_equals_all_pairs(spark):
    docs = table(spark, "documents", "sf0.01").select("doc_id", "text").collect()
    got = {r.doc_id: r.group_id for r in QUERIES["op3_minhash_neardup"](spark, "/root/testdata/sf0.01").collect()}
    assert got == brute([tuple(r) for r in docs])


@pytest.mark.parametrize("block", [512, 5])
def test_chains_and_many_near_copies(spark, monkeypatch, block):
    """Groups of near copies that are not all alike, and a chain in which only neighbours are."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = np.random.default_rng(2)
    base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
    rows = []
    for i in range(80):  # near copies of one text, often under 0.8 to each other
        own = list(base)
        for k in rng.integers(0, 120, 2):
            own[k] = f"n{i}x{k}"
        rows.append((i, " ".join(own)))
    for i in range(30):  # each differs from the one before by a word
        base = list(base) if i else [f"c{x}" for x in rng.integers(0, 5000, 100)]
        base[3 * i] = f"z{i}"
        rows.append((1000 + i, " ".join(base)))
    got = {r.doc_id: r.group_id for r in neardup.groups(with_text(spark, rows)).collect()}
    assert got == brute(rows)


def test_odd_rows(spark):
    got = neardup.groups(odd_documents(spark)).collect()
    assert len(got) == 15
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.group_id, r.class_id))
    assert by[1] == by[2] == {(1, 1)} and by[3] == {(3, 3)} and by[9] == {(9, 9)} and by[10] == {(9, 10)}
    assert by[None] == {(None, None), (1, None)}  # the null text, and a near copy of document 1
    kept = neardup.deduplicated(odd_documents(spark))
    assert kept.columns == odd_documents(spark).columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 8, 9, 11, 12]


def test_empty_table(spark):
    assert neardup.groups(none_of(odd_documents(spark))).collect() == []
    assert neardup.deduplicated(none_of(odd_documents(spark))).collect() == []
