"""Mixing: targets against the stepwise rule, shares, repeats and odd rows."""

import pytest
from llm_tables import none_of, odd_documents, table
from oracle_check import compare, duck
from pyspark.sql import functions as F

from kinfold.llm import mixing
from kinfold.llm.queries import ORACLES, QUERIES


def stepwise(sizes, weights=(1, 2, 3)):
    """Targets by sharing again and again what the stopped sources leave."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, done = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in done]
        left, ws = total - sum(done.values()), sum(w[s] for s in free)
        share = {s: left * w[s] / ws for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return done | share
        done |= {s: 3.0 * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1000, "c": 1, None: 3}, {"a": 5}, {"b": 0, "a": 7, "c": 0},
                                   {"a": 100, "b": 1, "c": 2, "d": 50, "e": 1, "f": 900, "é": 4, None: 1}, {"x": 0}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(stepwise(sizes))


def test_query_equals_sql(spark):
    r = compare(spark, duck("/root/testdata/sf0.01"), "op6", QUERIES["op6_mixing"], ORACLES["op6_mixing"], "/root/testdata/sf0.01")
    assert r["status"] == "ok", r


def test_sources_come_near_their_targets_and_reruns_agree(spark):
    docs = table(spark, "documents", "sf0.01")
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    by, most = {}, {}
    for r in rows:
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
        by.setdefault((r.source, r.target), []).append(r.taken)
        most[r.source] = max(most.get(r.source, 0), r["size"])
    for (source, target), taken in by.items():
        assert abs(sum(taken) - target) <= 2 * most[source]
    assert sum(r.taken for r in rows) <= sum(r["size"] for r in rows)
    again = mixing.mix(docs.repartition(7, "text")).collect()
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    size = {(r.doc_id, r.text_md5): r["size"] for r in rows}
    assert [size[k] for k in size if k[0] == 3] == [0] and [size[k] for k in size if k[0] == 5] == [40_001]
    twins = [r.taken for r in rows if r.doc_id == 2]
    assert len(twins) == 2 and twins[0] == twins[1]
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    drawn = sum(r.copies for r in rows)
    assert out.count() == drawn
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in rows if r.copies}


def test_empty_table(spark):
    docs = none_of(odd_documents(spark))
    assert mixing.mix(docs).collect() == [] and mixing.mixed_documents(docs).collect() == []


def test_a_row_that_is_a_third_of_all(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 16)
    rows = [(1, "same words " * 20, "a")] * 60 + [(10 + i, "one two three " * (1 + i % 7), "bc"[i % 2]) for i in range(120)]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, source string, n int") \
        .withColumn("lang", F.lit("en")).withColumn("a.b", F.create_map(F.lit("k"), F.col("n"))).repartition(5)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault((r.source, r.target), []).append(r.taken)
    for (_, target), taken in by.items():
        assert abs(sum(taken) - target) <= 2 * 40
    drawn = mixing.mixed_documents(docs)
    assert drawn.columns == docs.columns
    kept = [r for r in drawn.collect() if r.doc_id == 1]
    assert len(kept) == sum(r.copies for r in got if r.doc_id == 1)
    times = [sum(k.n == i for k in kept) for i in range(60)]
    assert max(times) - min(times) <= 1
    check = compare(spark, _Tables(docs.drop("a.b")), "op6", lambda s, d: mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken"), ORACLES["op6_mixing"], "")
    assert check["status"] == "ok", check


class _Tables:
    """A DuckDB with one table ``documents``."""

    def __init__(self, docs):
        import duckdb
        self.con = duckdb.connect()
        self.con.register("documents", docs.toPandas())

    def sql(self, query):
        return self.con.sql(query)
