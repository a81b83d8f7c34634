"""The pipeline against its stages done by plain code, on the documents that planted cases were added to."""

import hashlib
import zlib

import corpus_pipeline
import numpy as np
import test_llm_decontaminate as plain_decontaminate
import test_llm_language as plain_language
import test_llm_neardup as plain_neardup
from llm_tables import none_of, odd_documents, table
from test_llm_mixing import stepwise

from kinfold.llm import mixing
from kinfold.llm.queries import word_bpe


def plain_mix(rows):
    """doc_id, text and source of the drawn rows, one after another by finish time."""
    size = lambda t: len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")])
    units, copies = {}, {}
    for d, t, s in rows:
        unit = (d, s, None if t is None else hashlib.md5(t.encode()).hexdigest())
        copies[unit] = copies.get(unit, 0) + 1
        units[*unit, copies[unit]] = [t]
    key = lambda u: hashlib.md5(f"{mixing.SEED}|{'' if u[0] is None else u[0]}|{u[2] or ''}|{u[3]}".encode()).hexdigest()
    sizes = {}
    for u, ts in units.items():
        sizes[u[1]] = sizes.get(u[1], 0) + sum(map(size, ts))
    target = stepwise(sizes)
    rank = {s: i for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    queue = []
    for s in sizes:
        for epoch in range(3):
            sent = epoch * sizes[s]
            for u in sorted((u for u in units if u[1] == s), key=key):
                n = sum(map(size, units[u]))
                sent += n
                if n and target[s]:
                    queue.append((sent / target[s], rank[s], epoch, key(u), n, u))
    out, used = [], 0
    for f, _, _, _, n, u in sorted(queue, key=lambda q: q[:4]):
        used += n
        if used > sum(sizes.values()):
            break
        out += [(u[0], t) for t in units[u]]
    return out


def plain_run(rows, items):
    from tokenizers import Tokenizer
    pred = {}
    for r in plain_language.brute([(i, t, l) for i, t, l, _ in rows]):
        pred[r[0]] = r[2]
    rows = [r for r in rows if pred[r[0]] != "und"]
    group = plain_neardup.brute([(i, t) for i, t, _, _ in rows])
    rows = [r for r in rows if group[r[0]] == r[0]]
    bad = {r[0] for r in plain_decontaminate.brute([(i, t) for i, t, _, _ in rows], items) if r[5]}
    drawn = plain_mix([(i, t, s) for i, t, _, s in rows if i not in bad])
    tok, start, out = Tokenizer.from_file(word_bpe()), 0, []
    for d, t in sorted(drawn):
        ids = tok.encode(t, add_special_tokens=False).ids + [1]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_run_equals_plain_code(spark):
    docs = table(spark, "documents").select("doc_id", "text", "lang", "source").collect()
    items = [tuple(r) for r in table(spark, "benchmark").collect()]
    got = sorted((tuple(r) for r in corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()), key=lambda r: r[1])
    assert got == plain_run([tuple(r) for r in docs], items)


def test_stages_drop_what_was_planted_and_keep_the_rest(spark, tmp_path):
    docs = table(spark, "documents").limit(40).cache()
    item = table(spark, "benchmark").first()
    base = docs.orderBy("doc_id").first()
    more = [(9001, None, "en", "a", 0), (9002, "123 ...", "en", "a", 7), (9003, base.text, "en", "a", 1), (9004, base.text + " tail", "en", "a", 1),
            (9005, "before it " + item.text + " and after", "en", "a", 1), (9006, "a clean document of its own kind with words", "en", "a", 1)]
    planted = docs.unionByName(spark.createDataFrame(more, docs.schema))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "minhash_neardup", "decontaminate", "mixing", "token_output"]
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    now, was = planted, ids(planted)
    gone = []
    for name, stage in corpus_pipeline.STAGES[:4]:
        now, _ = corpus_pipeline.write_table(stage(spark, now, "/root/testdata/sf0.001"), "test-stage")
        assert now.columns == docs.columns
        gone.append(was - ids(now))
        was = ids(now)
    assert gone[0] == {9001, 9002} and {9003, 9004} <= gone[1] and 9005 in gone[2] and 9006 not in gone[0] | gone[1] | gone[2]
    docs.unpersist()


def test_odd_rows_and_empty_table_pass(spark):
    for docs in (odd_documents(spark), none_of(odd_documents(spark))):
        for _, stage in corpus_pipeline.STAGES:
            docs, _ = corpus_pipeline.write_table(stage(spark, docs, "/root/testdata/sf0.001"), "test-stage")
        assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
