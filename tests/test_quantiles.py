"""Exact quantiles by range refinement against numpy, at every width of brackets."""

import numpy as np
import pytest

from kinfold.operators import profile as P

QS = {"q0": 0.0, "q1": 0.25, "med": 0.5, "q3": 0.75, "q99": 0.99, "q100": 1.0}
RNG = np.random.default_rng(2)


def rows():
    out = [("normal", float(v)) for v in RNG.normal(size=3000)]
    out += [("heavy", float(v)) for v in np.exp(5 * RNG.normal(size=2000))]
    out += [("ties", float(v)) for v in RNG.integers(0, 3, 2500)]
    out += [("one", 7.0)] * 1500 + [(None, float(v)) for v in range(901)] + [("single", 1.5), ("none", None)]
    out += [("mostly", 0.0)] * 1200 + [("mostly", float(v)) for v in RNG.normal(size=300)]
    return out


def check(got, data):
    by = {}
    for g, v in data:
        if v is not None:
            by.setdefault(g, []).append(v)
    assert len(got) == len(by)
    for r in got:
        v = by[r.g]
        assert r.n == len(v)
        for name, q in QS.items():
            assert r[name] == pytest.approx(float(np.quantile(v, q)), rel=1e-12, abs=1e-12), (r.g, name)


@pytest.mark.parametrize("direct,steps", [(200_000, 500), (400, 500), (50, 20), (1, 10)])
def test_equal_numpy(spark, monkeypatch, direct, steps):
    monkeypatch.setattr(P, "DIRECT", direct)
    monkeypatch.setattr(P, "STEPS", steps)
    data = rows()
    df = spark.createDataFrame(data, "g string, v double").repartition(5)
    check(P.exact_quantiles(df, "v", QS, ["g"]).collect(), data)


def test_many_groups_go_by_running_counts(spark, monkeypatch):
    monkeypatch.setattr(P, "FEW_GROUPS", 3)
    data = rows()
    df = spark.createDataFrame(data, "g string, v double")
    check(P.exact_quantiles(df, "v", QS, ["g"]).collect(), data)


def test_a_bracket_that_misses_its_rank_is_widened(spark):
    nn = spark.createDataFrame([(float(i),) for i in range(100)], "`__v` double")
    ranks = {((), "q"): (10, 11)}
    assert P._picked(nn, [], {((), "q"): (50.0, 60.0, 0, 0)}, ranks) == {((), "q"): [10.0, 11.0]}


def test_without_rows(spark):
    df = spark.createDataFrame([("a", None)], "g string, v double")
    assert P.exact_quantiles(df, "v", {"m": 0.5}, ["g"]).collect() == []
    [r] = P.exact_quantiles(df, "v", {"m": 0.5}).collect()
    assert r.m is None and r.n == 0


def test_rows_are_not_sorted_or_written(spark):
    df = spark.range(1000).selectExpr("id % 3 as g", "cast(id as double) as v")
    plan = P.exact_quantiles(df, "v", {"m": 0.5}, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # the result is a small local table
