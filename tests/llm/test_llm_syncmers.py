"""Closed syncmers and the fingerprint report against plain code."""

import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_tables import none_of, odd_documents, table

from kinfold.llm import syncmers
from kinfold.llm.queries import QUERIES


def plain_positions(text):
    cp = syncmers.code_points(text)
    inner = [int(syncmers._rolled(cp[i:i + syncmers.S], None, syncmers.S)[0]) for i in range(len(cp) - syncmers.S + 1)]
    w = syncmers.K - syncmers.S + 1
    return [i for i in range(len(cp) - syncmers.K + 1) if min(inner[i:i + w]) in (inner[i], inner[i + w - 1])]


def sketch(text):
    cp = syncmers.code_points(text)
    return syncmers.sketch(syncmers.syncmers(cp)[1], cp)


def brute(docs):
    key = lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, hashlib.md5((r[1] or "").encode()).hexdigest())
    rows = sorted(docs, key=key)
    out = []
    for i, (d, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        n = len(text) // 3
        edited = text[:len(text) - n] + after[:n]
        f, e, a = sketch(text), sketch(edited), sketch(after)
        out.append((d, len(text), hashlib.sha256(edited.encode()).hexdigest(), syncmers.as_text(f), syncmers.as_text(e),
                    syncmers.likeness(f, e), syncmers.likeness(f, a)))
    return sorted(out, key=str)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc é😀", max_size=80))
def test_positions(text):
    at, h = syncmers.syncmers(syncmers.code_points(text))
    assert at.tolist() == plain_positions(text) and len(h) == len(at)


def test_anchors_are_context_free(spark):
    rng = np.random.default_rng(0)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage = word(300)
    rows = [(1, word(50) + passage + word(20)), (2, word(7) + passage)]
    got = {}
    for r in syncmers.anchors(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).add((r.position, r.hash))
    inside = lambda d, at: {(p - at, h) for p, h in got[d] if at <= p <= at + 300 - syncmers.K}
    assert inside(1, 50) == inside(2, 7) and len(inside(1, 50)) > 30


def test_query_equals_plain_code(spark):
    docs = [tuple(r) for r in table(spark, "documents").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op9_syncmer_fingerprints"](spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == brute(docs)
    assert np.mean([r[5] for r in got]) > 0.3 > 0.1 > np.mean([r[6] for r in got])


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = sorted((tuple(r) for r in syncmers.report(docs).collect()), key=str)
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert got == want


def test_likeness():
    a = np.arange(200, dtype=np.uint32)
    assert syncmers.likeness(a[:0], a[:0]) == 1.0 and syncmers.likeness(a[:0], a[:3]) == 0.0
    assert syncmers.likeness(a[:10], a[:10]) == 1.0 and syncmers.likeness(a[:10], a[5:15]) == 5 / 15
    rng = np.random.default_rng(4)
    x = rng.integers(0, 1 << 32, 3000, dtype=np.uint64).astype(np.uint32)
    one, two = (np.unique(s)[:syncmers.SKETCH] for s in (x[:2000], x[1000:]))
    assert abs(syncmers.likeness(one, two) - 1 / 3) < 0.2


def test_a_passage_of_a_long_text_is_seen(spark):
    """60 words shared by two texts of 120 000 characters at different places, against pairs of anchors by plain loops."""
    rng = np.random.default_rng(8)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage = " ".join(word(6) for _ in range(60))
    texts = [word(70_000) + passage + word(50_000), word(20_000) + passage + word(100_000)]
    got = {r.doc_id: r for r in syncmers.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    links = []
    for text in texts:
        at, h = syncmers.syncmers(syncmers.code_points(text))
        links.append({(x, b - a) for x, a, b in zip(h.tolist(), at.tolist(), [*at[1:].tolist(), int(at[-1])])})
    want = len(links[0] & links[1]) / len(links[0] | links[1])
    assert len(links[0] & links[1]) > 60
    assert abs(got[0].near_next - want) < 1e-5 and abs(got[1].near_next - want) < 1e-5
    assert len(got[0].fingerprint) > 8 * 1000


def test_positions_matter():
    """The same anchors at other distances are not alike; a shift of the whole text is."""
    rng = np.random.default_rng(9)
    part = lambda n: rng.integers(97, 123, n).astype(np.uint64)
    pieces = [part(40) for _ in range(200)]
    whole = np.concatenate(pieces)
    spread = np.concatenate([np.concatenate((p, part(5))) for p in pieces])
    shifted = np.concatenate((part(500), whole))
    near = lambda a, b: syncmers.likeness(*(syncmers.sketch(syncmers.syncmers(c)[1], c) for c in (a, b)))
    hashes = [set(syncmers.syncmers(c)[1].tolist()) for c in (whole, spread)]
    assert near(whole, spread) < len(hashes[0] & hashes[1]) / len(hashes[0] | hashes[1])
    assert near(whole, shifted) > 0.9
    again = np.tile(part(5), 20_000)  # a text of few anchors, repeated
    assert near(again, again) == 1.0 and abs(near(again, again[:50_000]) - 0.5) < 0.01


def test_one_row_and_none(spark):
    docs = odd_documents(spark)
    assert [r.near_next for r in syncmers.report(docs.where("doc_id = 1")).collect()] == [1.0]
    assert syncmers.report(none_of(docs)).collect() == []
