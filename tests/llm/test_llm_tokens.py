"""Token blocks: exact round trip against the tokenizer on whole texts."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_tables import none_of, odd_documents, table

from kinfold.llm import tokens
from kinfold.llm.queries import QUERIES, word_bpe


def brute(docs):
    """Ids of whole texts by the library itself, in ascending order of doc_id and text."""
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(word_bpe())
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start, out = 0, []
    for d, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: r[1])


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 20])
def test_pack_and_unpack(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << bits, 10_007).astype(np.uint32)
    data = tokens.pack(ids, bits)
    assert len(data) == (len(ids) * bits + 7) // 8
    for start, n in ((0, len(ids)), (1, 5), (4095, 4), (10_000, 7), (5, 0)):
        assert (tokens.unpack(data, bits, start, n) == ids[start:start + n]).all()


def test_width_is_the_least():
    assert [tokens.width_for(v) for v in (1, 2, 3, 256, 257, 49408, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("ab'<|>–²·endoftextstart \n\t,.!1é́ß İΣς")), max_size=60))
def test_chunks_give_the_ids_of_the_text(text):
    ids = tokens.TextIds.of(word_bpe())
    assert np.frombuffer(ids.encode(text), "<u4").tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids


def test_special_tokens_and_contractions():
    ids = tokens.TextIds.of(word_bpe())
    for text in ("a<|endoftext|>b", "x<|startoftext|><|endoftext|>.", "it's !'s 's'S we'll l'l", "<|endoftext", "a|>b", "A,b;c1d2", "<|ENDOFTEXT|>", "A <|StartOfText|>b<|endoftext|>C", "ΑΣ A\u0301 K\u212a"):
        assert np.frombuffer(ids.encode(text), "<u4").tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids


def test_query_equals_the_library(spark):
    docs = table(spark, "documents")
    assert order(QUERIES["op2_token_blocks"](spark, "/root/testdata/sf0.001").collect()) == brute(docs)


def test_odd_rows_and_small_blocks(spark, tmp_path):
    docs = odd_documents(spark)
    path = str(tmp_path / "blocks")
    tokens.write_blocks(docs, word_bpe(), path, block_ids=8)
    want = brute(docs)
    assert order(tokens.digests(spark, path).collect()) == want
    total = sum(n for _, _, n, _ in want)
    every = [r[1] for r in sorted(tokens.read_range(spark, path, 0, total).collect())]
    assert len(every) == total
    for _ in range(5):
        a = random.randrange(total)
        n = random.randrange(1, 50)
        got = sorted(tuple(r) for r in tokens.read_range(spark, path, a, n).collect())
        assert [x[0] for x in got] == list(range(a, min(total, a + n))) and [x[1] for x in got] == every[a:a + n]


def test_empty_table(spark):
    assert tokens.tokenize(none_of(odd_documents(spark)), word_bpe()).collect() == []


def test_ids_do_not_depend_on_what_is_remembered(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_BYTES", 1500)
    monkeypatch.setattr(tokens, "LONG_WORD", 6)
    ids = tokens.TextIds(word_bpe())
    texts = [" ".join(f"word{i % 7} other{i % 5}, more{i % n} longerthanthat" for i in range(60)) for n in (1, 3, 9, 2)]
    for some in (texts[:1], texts, texts[::-1]):
        for text, got in zip(some, ids.encode_all([t.encode() for t in some]), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids
        for held in (ids.words, ids.parts):
            assert held.spent < 1500 and len(held.old) * 200 < 20000
            assert not [w for w in (*held.new, *held.old) if len(w) > 6]


def test_every_code_point_at_a_cut():
    ids = tokens.TextIds.of(word_bpe())
    points = [chr(c) for c in range(0x3000)]
    texts = [t for c in points for t in (f"a{c}.", f"a{c}!b", f".{c}a", f"{c}1", f"a{c}", f"{c}a 1{c}", f"{c}'s", f"é{c}{c},", f"A{c}B", f"E\u0301{c}Z")]
    want = [e.ids for e in ids.tokenizer.encode_batch(texts, add_special_tokens=False)]
    got = [np.frombuffer(g, "<u4").tolist() for g in ids.encode_all([t.encode() for t in texts])]
    assert [t for t, a, b in zip(texts, got, want, strict=True) if a != b] == []


def test_one_doc_id_is_split_over_ranges(spark, tmp_path):
    rows = [(7 if i % 3 else None, f"text {i % 400}") for i in range(3000)] + [(7, "same")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    path = str(tmp_path / "blocks")
    tokens.write_blocks(docs, word_bpe(), path)
    per_shard = [sum(len(r.doc_ids) for r in g) for g in _by_shard(tokens.read_blocks(spark, path).collect())]
    assert sum(per_shard) == 6000 and max(per_shard) < 3000
    assert order(tokens.digests(spark, path).collect()) == brute(docs)


def _by_shard(rows):
    out = {}
    for r in rows:
        out.setdefault(r.shard, []).append(r)
    return out.values()


def test_ids_do_not_depend_on_what_is_remembered():
    texts = [f"w{i % 700}x un{i}known İ.{i} Ünder-{i % 9}".encode() for i in range(3000)]
    want = tokens.TextIds(word_bpe()).encode_all(texts)
    for bound in (0, 2000, 1 << 20):
        ids = tokens.TextIds(word_bpe(), bound)
        assert [got for i in range(0, 3000, 100) for got in ids.encode_all(texts[i:i + 100])] == want


def test_a_worker_keeps_one_operator_at_a_time():
    """What the tokenizer remembered is gone once another operator runs in the worker."""
    from weakref import ref

    from kinfold.llm import bagminhash, common, language
    first = tokens.TextIds.of(word_bpe())
    assert tokens.TextIds.of(word_bpe()) is first
    gone = ref(first)
    del first
    language.ngrams("some text")
    assert gone() is None and list(common._kept) == [("language",)]
    assert common.kept(("bagminhash",), common.WordHashes) is common.kept(("bagminhash",), common.WordHashes)
    assert list(common._kept) == [("bagminhash",)] and bagminhash.SHINGLE == 5
