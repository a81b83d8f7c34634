"""Whitening: rank-one updates against a dense solver, the whole operator against numpy, odd rows."""

import numpy as np
import pytest
from llm_tables import none_of, table
from pyspark.sql import functions as F

from kinfold.llm import whitening
from kinfold.llm.queries import QUERIES
from kinfold.llm.spectra import Spectrum, secular_roots

RNG = np.random.default_rng(3)
SETS = {
    "plain": np.floor(RNG.normal(size=(300, 12)) * 40),
    "fewer rows than entries": np.floor(RNG.normal(size=(9, 20)) * 40),
    "equal and empty columns": np.floor(RNG.normal(size=(200, 6)) * 10)[:, [0, 1, 1, 2, 2, 3]] * [1, 1, 1, 1, 1, 0],
    "scales": np.floor(RNG.normal(size=(300, 8)) * [1e6, 1e5, 1e4, 1e3, 1e2, 10, 1, 1]),
    "equal eigenvalues": np.repeat(np.eye(6) * 7, 20, axis=0),
    "one row repeated": np.ones((5, 3)),
    "one entry": np.arange(20.0)[:, None],
}


def spectrum(x):
    s = Spectrum(x.shape[1])
    for row in x:
        s.add(row)
    return s


def check(s, x):
    centred = x - x.mean(axis=0)
    scatter = centred.T @ centred
    assert s.n == len(x) and np.allclose(s.mean, x.mean(axis=0), atol=1e-9)
    assert np.abs(s.vectors.T @ s.vectors - np.eye(x.shape[1])).max() < 1e-12
    assert np.abs(s.vectors * s.values @ s.vectors.T - scatter).max() <= 1e-12 * max(1, np.abs(scatter).max())


@pytest.mark.parametrize("name", SETS)
def test_updates_equal_a_dense_solver(name):
    check(spectrum(SETS[name]), SETS[name])


@pytest.mark.parametrize("name", SETS)
def test_combined_spectra_equal_all_rows(name):
    x = SETS[name]
    s = spectrum(x[:2])
    for part in (x[2:2], x[2:3], x[3:]):
        s.merge(spectrum(part))
    check(s, x)


def test_secular_roots_of_close_poles():
    d = np.array([0, 1e-9, 1, 1 + 1e-12, 5])
    z = np.array([1, 1e-6, .5, 1e-3, 2])
    apart, roots = secular_roots(d, z * z, 0.7)
    assert (roots[:-1] >= d[:-1]).all() and (roots[:-1] <= d[1:]).all() and roots[-1] > d[-1]
    assert np.allclose(np.sort(roots), np.linalg.eigvalsh(np.diag(d) + .7 * np.outer(z, z)), atol=1e-13)
    assert np.allclose(apart, roots[:, None] - d[None, :], atol=1e-15)


def plain(rows, k=4):
    """(vec_id, vector) -> the contract's rows by numpy, signs left open."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([np.floor(256 * np.array(v, np.float64)) for _, v in kept]).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    deviation = ((n * x - s) ** 2).sum(axis=1)
    out = {}
    for c in range(1, k + 1):
        e = values[-c]
        w = (x - s / n) @ vectors[:, -c] / np.sqrt(e)
        for (i, _), dev, value in zip(kept, deviation, w, strict=True):
            out.setdefault((i, c), []).append((n, int(dev), value, e / values.sum()))
    return out


def check_rows(got, rows, k=4):
    want = plain(rows, k)
    assert len(got) == sum(map(len, want.values()))
    sign = {}
    for r in sorted(got, key=lambda r: -abs(r.whitened)):
        hit = [w for w in want[r.vec_id, r.component] if (w[0], w[1]) == (r.n, r.deviation) and abs(abs(w[2]) - abs(r.whitened)) < 1e-8]
        assert hit and abs(r.explained - hit[0][3]) < 1e-12 and r.identity_error < 1e-10
        if abs(r.whitened) > 1e-6:
            assert sign.setdefault(r.component, r.whitened * hit[0][2] > 0) == (r.whitened * hit[0][2] > 0)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query_equals_numpy(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in table(spark, "embeddings", sf).collect()]
    check_rows(QUERIES["op13_whitening"](spark, f"/root/testdata/{sf}").collect(), rows)


def test_many_small_tasks_are_combined_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    monkeypatch.setattr(whitening, "FEW", 20)
    rows = [(i, v) for i, v in enumerate((RNG.normal(size=(200, 5)) * [1, 2, 3, 4, 5]).tolist())]
    check_rows(whitening.whiten(spark.createDataFrame(rows * 2, "vec_id long, embedding array<double>")).collect(), rows * 2)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = (RNG.normal(size=(30, 3)) * [1, 2, 3]).tolist()
    rows = [(i, v, 5) for i, v in enumerate(good)] + [(0, good[0], 6)] * 40 + [(None, good[1], None), (90, None, 1), (91, [], 1), (92, [1., None, 2.], 1),
            (93, [1., nan, 2.], 1), (94, [inf, 1., 2.], 1), (95, [1., 2.], 1), (96, [1., 2., 3., 4.], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int").withColumn("x", F.lit("clash")).withColumn("component.a", F.lit(1))
    got = whitening.whiten(df).collect()
    check_rows(got, [(i, v) for i, v, _ in rows if v and len(v) == 3], 3)
    assert whitening.whiten(none_of(df)).collect() == []
    assert whitening.whiten(df.where("vec_id in (90, 91)")).collect() == []
    assert whitening.whiten(df.where("vec_id = 0")).collect() == []


def test_deviation_beyond_a_long_is_null(spark):
    df = spark.createDataFrame([(1, [1e15, 0.]), (2, [-1e15, 1.]), (3, [0., 2.])], "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    assert len(got) in (3, 6) and any(r.deviation is None for r in got)
