"""Embedding links: the index's bounds, all pairs by brute force, odd rows."""

import numpy as np
import pytest
from llm_tables import none_of, table
from oracle_check import compare, duck
from pyspark.sql import functions as F

from kinfold.llm import vector_links
from kinfold.llm.quantise import Quantiser, squared
from kinfold.llm.queries import ORACLES, QUERIES

RNG = np.random.default_rng(5)


def clouds(centres, members, size, spread):
    """Unit-like vectors around some centres; spread is the distance from the centre."""
    c = RNG.normal(size=(centres, size))
    c /= np.linalg.norm(c, axis=1)[:, None]
    off = RNG.normal(size=(centres, members, size))
    off /= np.linalg.norm(off, axis=2)[..., None]
    return (c[:, None] + spread * off).reshape(-1, size)


def plain(rows, cosine=0.98):
    """(vec_id, label, vector) -> (vec_id, n_links, component_id, kept) by all pairs."""
    ok = [v is not None and len(v) > 0 and l is not None and all(c is not None and np.isfinite(c) for c in v) and any(v) for _, l, v in rows]
    unit = [np.array(v) / np.abs(v).max() / np.linalg.norm(np.array(v) / np.abs(v).max()) if good else None for (_, _, v), good in zip(rows, ok, strict=True)]
    near = [[j for j in range(len(rows)) if i != j and ok[i] and ok[j] and rows[i][1] == rows[j][1] and len(unit[i]) == len(unit[j])
             and unit[i] @ unit[j] >= cosine] for i in range(len(rows))]
    comp = {}
    for i in range(len(rows)):
        if i not in comp:
            seen, todo = {i}, [i]
            while todo:
                for j in near[todo.pop()]:
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
            comp |= dict.fromkeys(seen, least)
    return [(r[0], len(near[i]), comp[i], r[0] is not None and r[0] == comp[i]) for i, r in enumerate(rows)]


def check(got, rows):
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(plain(rows), key=key)


def test_query_equals_sql(spark):
    r = compare(spark, duck("/root/testdata/sf0.01"), "op12", QUERIES["op12_embedding_links"], ORACLES["op12_embedding_links"], "/root/testdata/sf0.01")
    assert r["status"] == "ok", r


def test_probes_and_codes_lose_nothing():
    rows = clouds(40, 12, 16, 0.15)
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    q = Quantiser.fit(rows[::3], 12)
    near, far = q.assign(rows)
    radius = np.array([far[near == i].max(initial=-np.inf) for i in range(len(q.lists))])
    reach = np.sqrt(0.04)
    need = q.probes(rows, near, radius, reach)
    left, right = np.nonzero(squared(rows, rows) <= reach**2)
    assert need[left, near[right]].all() and need.mean() < 0.9
    codes, errors = q.encode(rows, near)
    truth = np.sqrt(squared(rows, rows))
    kept = 0
    for at in range(len(q.lists)):
        own = near == at
        d = q.distances(rows, at, codes[own])
        assert (np.abs(d - truth[:, own]) <= errors[own] + 1e-6).all()
        kept += (d <= reach + errors[own] + 1e-6).sum()
    assert len(left) <= kept < 0.6 * truth.size


@pytest.mark.parametrize("block,per_list,slices", [(512, 1024, 16), (7, 25, 1), (16, 60, 2)])
def test_all_pairs(spark, monkeypatch, block, per_list, slices):
    monkeypatch.setattr(vector_links, "BLOCK", block)
    monkeypatch.setattr(vector_links, "PER_LIST", per_list)
    monkeypatch.setattr(vector_links, "SLICE", slices)
    v = np.concatenate([clouds(20, 8, 10, 0.12), clouds(1, 150, 10, 0.13), clouds(200, 1, 10, 0)])
    rows = [(int(i), int(i) % 3 if i < 160 else 1, x.tolist()) for i, x in zip(RNG.permutation(len(v)), v, strict=True)]
    rows += [(1000 + i, 1, rows[-1][2]) for i in range(120)] + [(2000 + i, 1, [4 * c for c in rows[200][2]]) for i in range(3)]
    check(vector_links.link(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect(), rows)


def test_a_chain_is_one_component(spark):
    angle = np.arange(400) * 0.19
    rows = [(int(i), "a", [float(np.cos(a / 4)), float(np.sin(a / 4)), 0.]) for i, a in zip(RNG.permutation(400), angle, strict=True)]
    got = vector_links.link(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")).collect()
    assert {r.component_id for r in got} == {0} and [r.vec_id for r in got if r.kept] == [0]
    check(got, rows)


def test_odd_rows(spark):
    nan, inf, v = float("nan"), float("inf"), [1., 2., 3.]
    rows = [(5, 1, v), (3, 1, v), (3, 1, v), (9, 1, [1., 2., 3.01]), (1, 2, v), (7, None, v), (None, 1, v), (None, 3, v), (10, 1, None), (11, 1, []),
            (12, 1, [0., 0., 0.]), (13, 1, [1., nan, 3.]), (14, 1, [1., None, 3.]), (15, 1, [inf, 2., 3.]), (16, 1, [1e300, 2e300, 3e300]),
            (17, 1, [1e-300, 2e-300, 3e-300]), (18, 1, [1., 2.]), (19, 1, [-0., 5., 0.]), (20, 1, [0., 5., 0.]), (21, 1, [5e-324, 0., 0.]), (22, 1, [-1., -2., -3.])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("key", F.lit("clash")).withColumn("n.links", F.lit(1))
    check(vector_links.link(df).collect(), rows)
    assert vector_links.link(none_of(df)).collect() == []
    alone = [r for r in rows if r[0] in (7, 10, 11, 12)]
    check(vector_links.link(df.where("vec_id in (7, 10, 11, 12)")).collect(), alone)


def test_floats_of_the_table(spark):
    rows = [(r.vec_id, r.label, list(r.embedding)) for r in table(spark, "embeddings", "sf0.001").collect()]
    check(QUERIES["op12_embedding_links"](spark, "/root/testdata/sf0.001").collect(), rows)
