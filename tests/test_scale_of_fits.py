"""Bins by search, forests over blocks, machines from passes, merged rows of folds, scores of scoring rows alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.operators import boosting as B
from kinfold.operators import forests as T
from kinfold.operators import machines
from kinfold.operators import models as M

RNG = np.random.default_rng(5)


def test_bins_by_search_equal_counted_cuts(spark):
    inf, nan = float("inf"), float("nan")
    values = [None, nan, inf, -inf, 0.0, -0.0, 1.0, 1.0000000000000002, 2.5, 7.0, -3.0]
    df = spark.createDataFrame([(i, v, None) for i, v in enumerate(values)], "id int, a double, b double")
    cuts = [[-inf, -3.0, 0.0, 1.0, 7.0, inf], []]
    features = [F.col("a"), F.col("b")]
    got = B.with_bins(df.withColumn("want", B.bins_of(features, cuts)), features, cuts)
    assert got.columns == ["id", "a", "b", "want", "bins"] and dict(got.dtypes)["bins"] == "array<tinyint>"
    assert all(r.bins == r.want for r in got.collect())


def test_equal_rows_of_folds_count_as_one_and_draw_as_before():
    x = RNG.integers(0, 5, (40, 3)).astype(np.uint8)
    rows, fold = np.tile(x, (4, 1)), np.repeat(np.arange(4), 40)
    n0, n1 = RNG.integers(0, 4, 160), RNG.integers(0, 4, 160)
    merged, back = B.distinct(rows)
    assert len(merged) <= 40 and (merged[back] == rows).all()
    for t in range(5):
        a, b = T._grow(T.Forest(1, 4, 1), t, rows, n0, n1), T._grow(T.Forest(1, 4, 1), t, merged, n0, n1, back)
        assert all((getattr(a, c) == getattr(b, c)).all() for c in ("feature", "cut", "value"))
    p = B.Params(rounds=15, depth=3, rows=0.8)
    seen = []
    distinct = B.distinct
    try:
        B.distinct = lambda b: seen.append(len(b)) or distinct(b)
        a = B.grow(B.Cell("a", p), np.array([""] * 160, object), fold, rows, n0, n1)
    finally:
        B.distinct = distinct
    b = B.grow(B.Cell("a", p), np.array([""] * 160, object), np.zeros(160, int), rows, n0, n1)
    assert seen == [160]
    assert np.allclose(a.at(x, [15]), b.at(x, [15]))


def _table(spark, n=3000):
    x = RNG.integers(0, 12, (n, 4))
    y = (RNG.random(n) < 0.1 + 0.5 * (x[:, 0] > 5) + 0.3 * (x[:, 1] > 7)).astype(int)
    return spark.createDataFrame([(i, int(y[i]), i % 3, [int(v) for v in x[i]]) for i in range(n)], "PassengerId long, Survived int, fold int, bins array<tinyint>")


def test_forest_over_blocks_learns_as_one_in_tasks(spark, monkeypatch):
    d = _table(spark)
    forms = {"a": T.Forest(80, 5, 5), 0: T.Forest(40, 3, 5, without=(0,)), "none": T.Forest(2, 2, 1, without=(0, 1, 2))}
    near = T.grown(B.counted(d, fold="fold"), forms)
    monkeypatch.setattr(T, "LOCAL_ROWS", 3)
    monkeypatch.setattr(T, "SPREAD_ROWS", 700)
    monkeypatch.setattr(T, "HELD_BYTES", 1 << 20)
    monkeypatch.setattr(M, "fit_packed", None)   # nothing of MLlib
    far = T.grown(B.counted(d, fold="fold"), forms)
    for key in ("a", 0):
        assert far[key].feature.shape == near[key].feature.shape
        a, b = ({r.PassengerId: r.p for r in T.score(d, trees[key]).collect()} for trees in (near, far))
        assert np.mean([abs(a[i] - b[i]) for i in a]) < 0.05
        hits = [np.mean([(p[r.PassengerId] > 0.5) == (r.Survived == 1) for r in d.collect()]) for p in (a, b)]
        assert abs(hits[0] - hits[1]) < 0.02 and hits[1] > 0.7
    assert {r.p for r in T.score(d, far["none"]).collect()} == {0.5}
    again = T.grown(B.counted(d, fold="fold").repartition(3), {"a": T.Forest(2, 9, 1)})["a"]
    assert again.feature.shape == (2, 2**10 - 1) and (again.value[again.value > 0] <= 1).all()


def test_machines_from_passes_are_those_of_the_library(spark, monkeypatch):
    n = 2000
    x = RNG.normal(size=(n, 3))
    y = (x[:, 0] * x[:, 1] + x[:, 2] + RNG.normal(size=n) * 0.5 > 0).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), *map(float, x[i])) for i in range(n)], "PassengerId long, Survived int, a double, b double, c double").cache()
    tr, te = df.where("PassengerId < 1500"), df.where("PassengerId >= 1500").drop("Survived")
    near = {r.PassengerId: r.p for r in M.svm_rff(tr, te, ["a", "b", "c"], dim=40).collect()}
    monkeypatch.setattr(M, "MACHINE_ROWS", 100)
    monkeypatch.setattr(machines, "BLOCK_ROWS", 200)
    monkeypatch.setattr(machines, "PART_ROWS", 400)
    monkeypatch.setattr(M, "LinearSVC", None)
    out = M.svm_rff(tr, te, ["a", "b", "c"], dim=40)
    far = {r.PassengerId: r.p for r in out.collect()}
    assert out.columns == [*te.columns, "p"] and far.keys() == near.keys()
    assert np.mean([abs(near[i] - far[i]) for i in near]) < 0.02


def test_machine_is_the_least_loss():
    n, fourier = 4000, machines.Fourier(3, 20, 0.3, 1)
    x = RNG.normal(size=(n, 3)).astype(np.float32)
    sign = np.where(x[:, 0] + RNG.normal(size=n) * 0.7 > 0, 1, -1).astype(np.float32)
    part = (np.arange(n) % 3).astype(np.int8)
    passes = []

    def added(_, one, inputs):
        passes.append(1)
        return one(x, sign, part)
    original, machines._added = machines._added, added
    try:
        coef = machines.fit(None, fourier, 3, 0.01)
    finally:
        machines._added = original
    assert len(passes) < 50
    z = fourier(x.astype(np.float64))
    for m in range(4):
        own = part != m
        spread = z[own].std(axis=0, ddof=1)
        loss = lambda c: np.maximum(0, 1 - sign[own] * (z[own] @ c[:-1] + c[-1])).mean() + 0.005 * ((c[:-1] * spread) ** 2).sum()  # noqa: B023, E731
        least = loss(coef[m])
        assert all(loss(coef[m] + RNG.normal(size=21) * s) > least - 2e-4 for s in (0.001, 0.01, 0.1) for _ in range(40))


@pytest.mark.parametrize("split", [None, "test"])
def test_sub_scores_of_a_split_are_those_of_all(spark, split):
    from kinfold.plans import q_fitted as QF
    from kinfold.plans import q_models as Q
    n = 300
    rows = [(i, (i // 2) % 2 if i % 3 else None, "train" if i % 3 else "test", "man" if i % 4 < 2 else "woman", float(i % 50), float(i % 70), 1 + i % 2, 1.0 + i % 3, None) for i in range(n)]
    frame = spark.createDataFrame(rows, "PassengerId long, Survived int, split string, Title string, Fare double, Age double, FamilySize int, FareAdj double, GroupId string") \
        .withColumn("TicketFreq", F.lit(1)).withColumn("FamilySize", F.when(F.col("Title") == "woman", 1).otherwise(F.col("FamilySize"))).cache()
    got = {r[0]: (r.p_men, r.p_women) for r in QF.sub_scores(spark, None, frame, split).collect()}
    want = {r[0]: (r.p_men, r.p_women) for r in QF.sub_scores(spark, None, frame).collect()}
    kept = {r[0] for r in frame.collect() if split in (None, r.split)}
    assert got == {k: v for k, v in want.items() if k in kept} and got
    assert Q.ID == "PassengerId"
