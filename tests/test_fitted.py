"""Stored models, stages that learn from what rules leave, soft-vote members, pair density."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.operators import boosting as B
from kinfold.operators import evaluate as EV
from kinfold.operators import models as M
from kinfold.operators import profile as P
from kinfold.plans import q_models as Q
from kinfold.sources import model_store as store

SF = "/root/testdata/sf0.001"
RNG = np.random.default_rng(8)


@pytest.fixture(scope="module")
def rows(spark):
    tr, te = Q.frames(spark, SF)
    return tr.cache(), te.cache()


def test_newest_of_a_tag_scores_without_a_fit(spark, rows, tmp_path, monkeypatch):
    tr, te = rows
    base = str(tmp_path)
    with pytest.raises(store.NoModel, match="'a'"):
        store.newest(spark, "a", base=base)
    store.save(spark, "a", *Q._stored_logreg(tr.where("Pclass = 1")), base=base)
    last = Q._stored_logreg(tr)
    store.save(spark, "a", *last, base=base)
    store.save(spark, "b", *Q._stored_logreg(tr.where("Pclass = 2")), base=base)
    assert len(store.versions(spark, "a", base=base)) == 2
    monkeypatch.setattr(M, "fitted_pipeline", None)
    monkeypatch.setattr(M, "fit_prep", None)
    model, prep = store.newest(spark, "a", te.columns, base=base)
    want = {r[0]: r.p for r in M.p1(last[0].transform(M.apply_prep(te, last[1]))).select(Q.ID, "p").collect()}
    got = {r[0]: r.p for r in M.p1(model.transform(M.apply_prep(te, prep))).select(Q.ID, "p").collect()}
    assert got == pytest.approx(want) and got
    with pytest.raises(store.ColumnsChanged, match="Fare"):
        store.newest(spark, "a", [c for c in te.columns if c != "Fare"], base=base)


def test_a_version_without_its_record_is_none(spark, rows, tmp_path):
    store.save(spark, "a", *Q._stored_logreg(rows[0]), base=str(tmp_path))
    (tmp_path / "models" / "a" / "99999999999999" / "model").mkdir(parents=True)
    assert len(store.versions(spark, "a", base=str(tmp_path))) == 1


def test_src_model_does_not_fit_when_one_is_stored(spark, monkeypatch):
    want = {r[0]: r.p >= .5 for r in Q.q_sink_model(spark, SF).collect()}
    monkeypatch.setattr(Q, "_stored_logreg", None)
    assert {r[0]: bool(r.prediction) for r in Q.q_src_model(spark, SF).collect()} == want


def test_stored_preprocessing_equals_the_design(spark, rows):
    tr, te = rows
    _, want, _ = M.design(tr, te)
    got = M.apply_prep(te, M.fit_prep(tr))
    a, b = ({r[0]: r.features.toArray() for r in d.select(Q.ID, "features").collect()} for d in (want, got))
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)


def test_prefit_and_fitted_holdout_agree(spark):
    got = {r.form: r.asDict() for r in Q.q_eval_holdout_model(spark, SF).collect()}
    assert got.keys() == {"fitted", "prefit"}
    assert {k: v for k, v in got["fitted"].items() if k != "form"} == {k: v for k, v in got["prefit"].items() if k != "form"}


def test_a_stage_reads_no_label_of_covered_or_held_rows(spark):
    n = 400
    x, y = RNG.normal(size=(n, 2)), RNG.integers(0, 2, n)
    base = [(i, float(a), float(b), int(t), i % 3 == 0) for i, ((a, b), t) in enumerate(zip(x, y))]
    other = [(i, a, b, 1 - t if c else t, c) for i, a, b, t, c in base]
    scores = []
    for data in (base, other):
        df = spark.createDataFrame(data, "id int, a double, b double, Survived int, rule boolean") \
            .withColumn("Survived", F.when(F.col("id") % 7 > 0, F.col("Survived")))
        d = M.fitted_stage(df, F.col("rule"), [F.col("a"), F.col("b")], B.Params(20, .3, 3, 1, 1))
        scores.append({r.id: r.p_rest for r in d.collect()})
    assert scores[0] == scores[1] and len(scores[0]) == n
    assert len(set(scores[0].values())) > 10


def test_soft_vote_members(spark):
    n = 600
    data = []
    for i in range(n):
        v = {c: float(RNG.integers(0, 3)) for c in M.MEMBER_FEATURES}
        data.append((i, int(v["Sex_male"] + v["Pclass"] + RNG.normal() * .5 > 2.2), *v.values()))
    df = spark.createDataFrame(data, "PassengerId int, Survived int, " + ", ".join(f"{c} double" for c in M.MEMBER_FEATURES))
    tr, te = df.where("PassengerId % 3 > 0"), df.where("PassengerId % 3 = 0")
    got = M.soft_vote(tr, te.drop("Survived"))
    out = got.join(te.select("PassengerId", F.col("Survived").alias("y")), "PassengerId").cache()
    assert out.count() == te.count() == got.select("PassengerId").distinct().count()
    for c in ("p_forest", "p_logistic", "p_machine", "p_mean"):
        assert out.where(~F.col(c).between(0, 1) | F.col(c).isNull()).count() == 0
        assert EV.auc(out, "y", c).first().auc > 0.85, c
    r = out.first()
    assert r.p_mean == pytest.approx((r.p_forest + r.p_logistic + r.p_machine) / 3)


def test_pair_density_is_near_that_of_the_rows(spark):
    v = RNG.normal(size=(500, 2)) * [2, 30] + [5, 100]
    data = [(int(i % 2), float(a), float(b)) for i, (a, b) in enumerate(v)] + [(None, 1.0, 1.0), (1, None, 2.0)]
    df = spark.createDataFrame(data, "g int, x double, y double")
    got = P.density_on_plane(df, "x", "y", "g", points=15, bins=256).collect()
    assert len(got) == 2 * 15 * 15
    peak = max(r.density for r in got)
    for g in (0, 1):
        w = v[g::2]
        h = [0.9 * min(w[:, c].std(ddof=1), np.subtract(*np.quantile(w[:, c], [.75, .25])) / 1.34) * len(w) ** -.2 for c in (0, 1)]
        for r in (r for r in got if r.g == g):
            z = ((r.x - w[:, 0]) / h[0]) ** 2 + ((r.y - w[:, 1]) / h[1]) ** 2
            want = np.exp(-z / 2).sum() / (len(w) * h[0] * h[1] * 2 * np.pi)
            assert abs(r.density - want) < 0.01 * peak


def test_pair_density_work_does_not_grow_with_rows(spark):
    x = F.rand(1)
    few, many = (spark.range(n).select(F.lit(1).alias("g"), x.alias("x"), F.rand(2).alias("y")) for n in (100, 20_000))
    assert P.density_on_plane(few, "x", "y", "g", 5, 4).count() == P.density_on_plane(many, "x", "y", "g", 5, 4).count() == 25
