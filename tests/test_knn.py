"""Two-phase k nearest neighbours against all pairs."""

import numpy as np
import pytest

from kinfold.operators import knn

RNG = np.random.default_rng(4)
SCHEMA = "id long, vec array<double>, label int"


def rows(n, centres=0, size=4, start=0):
    x = RNG.normal(size=(n, size))
    if centres:
        x = x * 0.02 + RNG.normal(size=(centres, size))[np.arange(n) % centres] * 5
    return [(start + i, v.tolist(), int(RNG.random() < .4)) for i, v in enumerate(x)]


def plain(query, ref, k):
    out = {}
    for q, v, _ in query:
        near = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), r, y) for r, w, y in ref)[:k]
        out[q] = (sum(y for _, _, y in near) / len(near), len(near))
    return out


def check(spark, query, ref, k=3, **kw):
    got = knn.knn_fraction(spark.createDataFrame(query, SCHEMA), spark.createDataFrame(ref, SCHEMA), "id", "id", "vec", "label", k=k, **kw).collect()
    assert {r.id: (pytest.approx(r.knn_fraction), r.k) for r in got} == plain(query, ref, k)


@pytest.mark.parametrize("block,pivots,centres", [(512, None, 0), (5, None, 7), (3, 1, 3), (4, 40, 0)])
def test_all_pairs(spark, monkeypatch, block, pivots, centres):
    monkeypatch.setattr(knn, "BLOCK", block)
    monkeypatch.setattr(knn, "SLICE", 2)
    check(spark, rows(60, centres, start=1000), rows(200, centres), pivots=pivots)


def test_ties_copies_and_few_rows(spark):
    same = [(i, [1.0, 2.0], i % 2) for i in range(40)]
    check(spark, [(100, [1.0, 2.0], 0), (101, [50.0, 2.0], 0)], same, k=5)
    check(spark, [(100, [1.0, 2.0], 0)], same[:2], k=5)


def test_empty_tables_and_null_vectors(spark):
    q, r = spark.createDataFrame([(1, [1.0], 0), (2, None, 1)], SCHEMA), spark.createDataFrame([(7, None, 1)], SCHEMA)
    assert knn.knn_fraction(q, r, "id", "id", "vec", "label").collect() == []
    assert knn.knn_fraction(q.where("id > 5"), q, "id", "id", "vec", "label").collect() == []
    got = knn.knn_fraction(q, r.unionByName(q), "id", "id", "vec", "label").collect()
    assert [(x.id, x.knn_fraction, x.k) for x in got] == [(1, 0.0, 1)]


def test_compared_pairs_grow_slower_than_the_product(spark):
    compared = []
    for n in (400, 1600):
        r = rows(n + n // 4, 40)
        q, r = r[n:], r[:n]
        made: list[int] = []
        knn.knn_fraction(spark.createDataFrame(q, SCHEMA), spark.createDataFrame(r, SCHEMA), "id", "id", "vec", "label", pairs=made).collect()
        compared += made
        assert made[0] < 0.3 * len(q) * len(r)
    assert compared[1] / compared[0] < 16


@pytest.mark.parametrize("group_bytes,cells", [(32 << 20, 64), (1000, 3)])
def test_grid_of_unclustered_rows(spark, monkeypatch, group_bytes, cells):
    """Every query must see nearly every partition; no written table holds it more than once."""
    monkeypatch.setattr(knn, "GROUP_BYTES", group_bytes, raising=False)
    monkeypatch.setattr(knn, "CELLS", cells, raising=False)
    held, written = [], knn.written

    def counted(df):
        out, path = written(df)
        if "vec" in out.columns:
            blocks = out.schema["vec"].dataType.elementType.typeName() == "array"
            held.append(out.selectExpr("sum(size(vec))" if blocks else "count(*)").first()[0])
        return out, path
    monkeypatch.setattr(knn, "written", counted)
    query, ref = rows(40, size=16, start=1000), rows(300, size=16)
    ref += [(1000 + i, v, 1 - y) for i, v, y in ref[:5]]  # equal vectors: ties go to the smaller id
    check(spark, query + [(2000, ref[0][1], 0)], ref, k=3)
    assert max(held) <= len(ref)


def test_queries_that_share_an_id_or_have_none(spark):
    ref = rows(200, size=8)
    [a, b] = rows(2, size=8)
    q = spark.createDataFrame([(1, a[1], 0), (1, a[1], 0), (None, b[1], 0)], SCHEMA)
    got = {r.id: (r.knn_fraction, r.k) for r in knn.knn_fraction(q, spark.createDataFrame(ref, SCHEMA), "id", "id", "vec", "label").collect()}
    alone = plain([(None, b[1], 0)], ref, 3)
    # The rows of an id are ranked together: the nearest twice, and the second.
    first, second = [sorted((sum((x - y) ** 2 for x, y in zip(a[1], w)), r, y) for r, w, y in ref)[i][2] for i in (0, 1)]
    assert got == {1: (pytest.approx((2 * first + second) / 3), 3), None: (pytest.approx(alone[None][0]), 3)}
