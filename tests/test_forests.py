"""Forests over binned tables."""

import numpy as np

from kinfold.operators import boosting as B
from kinfold.operators import forests as T
from kinfold.operators import models as M


def _rows(spark, n=600):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 8, (n, 3))
    y = ((x[:, 0] > 3) ^ (x[:, 1] > 5)).astype(int)
    return spark.createDataFrame([(i, int(y[i]), i % 3, [int(v) for v in x[i]]) for i in range(n)], "PassengerId long, Survived int, fold int, bins array<tinyint>")


def test_forest_learns_in_one_job_however_many_trees(spark):
    d = _rows(spark)
    trees = T.fit(B.counted(d), {"a": T.Forest(40, 6, 1), "b": T.Forest(25, 3, 1)})
    assert len(trees["a"].feature) == 40 and len(trees["b"].feature) == 25
    got = T.score(d, trees["a"]).collect()
    assert sum((r.p > 0.5) == (r.Survived == 1) for r in got) > 0.95 * len(got)
    shares = T.importance(trees["a"], 3)
    assert abs(sum(shares) - 1) < 1e-9 and shares[2] < min(shares[:2])


def test_split_is_the_best_gini_cut():
    bins = np.array([[b] for b in range(10)], np.uint8)
    n0, n1 = np.where(np.arange(10) < 4, 50, 0), np.where(np.arange(10) < 4, 0, 50)
    t = T._grow(T.Forest(1, 1, 1), 0, bins, n0, n1)
    assert t.feature[0, 0] == 0 and t.cut[0, 0] == 3 and t.value[0, 1] == 0 and t.value[0, 2] == 1


def test_leaf_size_folds_and_empty_table(spark):
    d = _rows(spark)
    table = B.counted(d, fold="fold")
    trees = T.fit(table, {"big": T.Forest(5, 6, 10_000), "none": T.Forest(5, 2, 1, without=(0, 1, 2))})
    assert (trees["big"].feature < 0).all()
    assert {r.p for r in T.score(d, trees["none"]).collect()} == {0.5}
    assert T.fit(table, {"a": T.Forest(2, 2, 1)}, local_rows=3) is None


def test_larger_tables_go_to_mllib_with_the_same_columns(spark, monkeypatch):
    from pyspark.ml.feature import VectorAssembler
    d = _rows(spark, 120).selectExpr("*", "double(bins[0]) a", "double(bins[1]) b", "double(bins[2]) c")
    d = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(d).drop("a", "b", "c")
    forms = {0: T.Forest(5, 3, 1, without=(0,)), "all": T.Forest(5, 3, 1)}
    near = M.forest_fits(d, forms, fold="fold")["all"](d)
    monkeypatch.setattr(T, "LOCAL_ROWS", 3)
    far = M.forest_fits(d, forms, fold="fold")
    assert near.columns == far["all"](d).columns and far[0](d).count() == near.count() == 120
